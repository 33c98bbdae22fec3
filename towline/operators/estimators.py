"""Density, area expansion, catch rate, recovery and harvest estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.functions import units
from towline.functions.aggregates import sum_where
from towline.functions.scalar import guarded_div, null_div, swept_area
from towline.operators.cleaning import zero_fill
from towline.operators.joins import null_safe_join


def haul_frame(
    hauls: DataFrame,
    length: str,
    width: float = units.DREDGE_WIDTH_NMI,
    efficiency: float = units.DREDGE_EFFICIENCY,
) -> DataFrame:
    """Hauls with swept area ``ai``.

    The area of the bed is a property of the stratum, so it joins the estimates and not the hauls.
    """
    return hauls.withColumn("ai", swept_area(length, width, efficiency))


def sample_sizes(hauls: DataFrame, areas: DataFrame, bed: str) -> DataFrame:
    """Hauls made per bed, with the bed's area."""
    counts = hauls.groupBy(bed).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(areas.select(bed, "area"), bed, "left")


def add_density(df: DataFrame, measures: Sequence[str], area: str = "ai", total: str | None = "all") -> DataFrame:
    """Replace each measure by its density; ``total`` adds the density of their sum."""
    out = df
    names = list(measures)
    if total:
        summed = F.col(names[0])
        for m in names[1:]:
            summed = summed + F.col(m)
        out = out.withColumn(total, summed)
        names.append(total)
    return out.withColumns({m: null_div(F.col(m).cast("double"), F.col(area)) for m in names})


def _moments(densities: Sequence[str]) -> list[Column]:
    """Sum and variance of each density, one pass over the hauls."""
    out = [F.count(F.lit(1)).alias("n")]
    for m in densities:
        d = F.col(m).cast("double")
        out += [F.sum(d).alias(f"__sum_{m}"), F.var_samp(d).alias(f"__var_{m}")]
    return out


def _estimate_fields(measure: str) -> dict[str, Column]:
    """Statistics from the moments; a single haul has no variance, an empty total no CV."""
    n, area = F.col("n"), F.col("area")
    mean, var = F.col(f"__sum_{measure}") / n, F.col(f"__var_{measure}")
    ss = var * (n - 1)
    total = area * mean
    var_total = area * area * ss / F.nullif(n * (n - 1), F.lit(0))
    return {
        "dbar": mean,
        "var_dbar": var,
        "cv": F.try_divide(F.sqrt(var), mean) * 100,
        "ss": ss,
        "total": total,
        "var_total": var_total,
        "cv_total": F.try_divide(F.sqrt(var_total), total) * 100,
    }


def expand_estimate(
    df: DataFrame, strata: Sequence[str], densities: Sequence[str], areas: DataFrame, on: Sequence[str] = ("bed",)
) -> DataFrame:
    """Area-expansion estimate per stratum and measure, long form.

    ``df`` holds one row per haul, zero hauls included, with one density column per measure.
    ``areas`` has the columns ``on`` and ``area``; a stratum without an area has no total. All
    measures are aggregated in one pass over the wide rows, and only the few stratum rows meet the
    areas and are turned long. Rows whose density is null count in ``n`` only.
    """
    moments = df.groupBy(*strata).agg(*_moments(densities))
    placed = null_safe_join(moments, areas.select(*on, F.col("area").cast("double").alias("area")), on, "left")
    rows = []
    for m in densities:
        fields = {k: c.alias(k) for k, c in _estimate_fields(m).items()}
        rows.append(F.struct(F.lit(m).alias("variable"), *fields.values()))
    out = placed.select(*strata, "n", "area", F.inline(F.array(*rows)))
    out = out.withColumn("sd_total", F.sqrt("var_total"))
    return out.select(*strata, "variable", *[c for c in out.columns if c not in (*strata, "variable")])


def expand_estimate_wide(
    df: DataFrame,
    strata: Sequence[str],
    densities: Mapping[str, str],
    areas: DataFrame,
    on: Sequence[str] = ("bed",),
) -> DataFrame:
    """Same statistics side by side, one row per stratum: ``{column suffix: density column}``."""
    moments = df.groupBy(*strata).agg(*_moments(list(densities.values())))
    placed = null_safe_join(moments, areas.select(*on, F.col("area").cast("double").alias("area")), on, "left")
    fields = [c.alias(f"{k}_{s}") for s, m in densities.items() for k, c in _estimate_fields(m).items()]
    return placed.select(*strata, "n", "area", *fields)


def catch_table(df: DataFrame, bed: str, counts: Sequence[str], grams: Sequence[str]) -> DataFrame:
    """Raw catch by bed over hauls with complete data: counts with range, weight in kg and lb."""
    aggs = []
    for c in counts:
        aggs += [F.sum(c).alias(f"{c}_c"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for g in grams:
        aggs += [
            F.sum(F.col(g) * units.POUNDS_PER_GRAM).alias(f"{g}_lb"),
            F.sum(F.col(g) / units.GRAMS_PER_KG).alias(f"{g}_kg"),
        ]
    return df.dropna("any", subset=[*counts, *grams]).groupBy(bed).agg(*aggs)


def cpue(
    catch: DataFrame,
    hauls: DataFrame,
    event: str,
    bed: str,
    length: str,
    target: Column,
    unsorted: Column,
    sample_type: str = "sample_type",
    count: str = "count",
    weight: str = "weight",
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Catch per unit of effort with two-stage sub-samples expanded.

    ``target`` and ``unsorted`` are the predicates for the species counted and the unsorted
    remainder. Returns the per-haul and the per-bed table; hauls without catch count as 0.
    With ``strict`` a null among the summed values makes a haul's component null, which then
    reads as 0.
    """
    first, second = F.col(sample_type) == 1, F.col(sample_type) == 2
    parts = catch.groupBy(event).agg(
        sum_where(weight, unsorted & first, strict).alias("t1"),
        sum_where(weight, unsorted & second, strict).alias("t2"),
        sum_where(count, target & first, strict).alias("s1"),
        sum_where(count, target & second, strict).alias("s2"),
    )
    full = zero_fill(hauls.select(event, bed, length).join(parts, event, "left"), ["t1", "t2", "s1", "s2"])
    total = F.col("s1") + F.col("s2") + guarded_div(F.col("t1") * F.col("s2"), "t2")
    by_haul = full.withColumn("s_tot", total).withColumn("s_cpm", null_div(F.col("s_tot"), F.col(length)))
    return by_haul, summarise_cpue(by_haul, [bed])


def summarise_cpue(by_haul: DataFrame, by: Sequence[str]) -> DataFrame:
    return by_haul.groupBy(*by).agg(
        F.avg("s_cpm").alias("cpue_mean"),
        F.stddev_samp("s_cpm").alias("cpue_sd"),
        (F.try_divide(F.stddev_samp("s_cpm"), F.avg("s_cpm")) * 100).alias("cpue_cv"),
        F.sum("s_tot").alias("tot_catch"),
    )


def standardize(df: DataFrame, measures: Mapping[str, str], length: str) -> DataFrame:
    """Catch per unit of tow length: ``{new name: measure}``."""
    return df.withColumns({n: F.col(c) * F.try_divide(F.lit(1.0), F.col(length)) for n, c in measures.items()})


def mean_of_means(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean over ``outer`` of the means over ``inner``; ``outer`` is a subset of ``inner``."""
    per = df.groupBy(*inner).agg(F.avg(value).alias("__m"))
    return per.groupBy(*outer).agg(F.avg("__m").alias(name))


def harvest_levels(
    df: DataFrame,
    estimate: Mapping[str, Column | str],
    rates: Sequence[float] = units.HARVEST_RATES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Harvest levels from an interval: ``estimate`` gives the columns ll, meat and ul.

    For each rate ``r`` adds ``ghl_rr``, ``low_ghl_rr`` and ``high_ghl_rr``.
    """
    base = df.select(*keep, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in estimate.items()])
    out = {}
    for rate in rates:
        tag = f"{round(rate * 100):02d}"
        for prefix, source in (("", "meat"), ("low_", "ll"), ("high_", "ul")):
            out[f"{prefix}ghl_{tag}"] = F.col(source) * F.lit(rate)
    return base.withColumns(out)


def number_harvest(df: DataFrame, ratio: str, mean_weight: str, interval: Mapping[str, str], **kw) -> DataFrame:
    """Harvest in pounds of meat from abundance: ratio x number x mean weight in grams."""
    pounds = {
        name: F.col(ratio) * F.col(c) * F.col(mean_weight) / F.lit(units.GRAMS_PER_POUND)
        for name, c in interval.items()
    }
    return harvest_levels(df, pounds, **kw)


def weight_harvest(df: DataFrame, ratio: str, interval: Mapping[str, str], **kw) -> DataFrame:
    """Harvest in pounds of meat from round weight in pounds."""
    return harvest_levels(df, {name: F.col(ratio) * F.col(c) for name, c in interval.items()}, **kw)


def share_of_total(part: Column | str, rest: Column | str) -> Column:
    """``100 part / (part + rest)``; nothing at all gives null."""
    part = F.col(part) if isinstance(part, str) else part
    rest = F.col(rest) if isinstance(rest, str) else rest
    return F.try_divide(part, rest + part) * 100
