"""Design-based population estimate: tow summary, finite-population variance, t intervals, recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.functions import units
from towline.functions.aggregates import ratio_of_sums
from towline.functions.scalar import half_even, norm_key, standard_text
from towline.operators.joins import join_on_normalised, with_t_quantile

# Widths of dredge to a nautical mile: turns a mean per mile towed into one per square mile.
WIDTHS_PER_NMI = units.FEET_PER_NMI / units.DREDGE_WIDTH_FEET


def tow_summary(df: DataFrame, by: Sequence[str], length: str, count: str, weight: str, codes: Sequence[str] = ()) -> DataFrame:
    """Ten aggregates per stratum from one row per tow with raw catch and tow length.

    ``codes`` are columns whose distinct values in the stratum are kept too, as an array of structs of that name; null is a
    value. A stratum has few of them.
    """
    per_length = F.try_divide(F.lit(1.0), F.col(length))
    std_count, std_weight = F.col(count) * per_length, F.col(weight) * per_length
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("number_of_tows"),
        F.sum(length).alias("total_nm_towed"),
        F.sum(count).alias("raw_count"),
        F.sum(weight).alias("raw_wt_kg"),
        F.sum(std_count).alias("count_per_nm"),
        F.sum(std_weight).alias("wt_kg_per_nm"),
        F.avg(std_count).alias("mean_count_per_nm"),
        F.avg(std_weight).alias("mean_wt_kg_per_nm"),
        F.var_samp(std_count).alias("var_of_count"),
        F.var_samp(std_weight).alias("var_of_wt"),
        *([F.collect_set(F.struct(*codes)).alias("codes")] if codes else []),
    )


def stratum_frame(stations: DataFrame, by: Sequence[str], cell_area: str) -> DataFrame:
    """Area and number of station cells of each stratum."""
    return stations.groupBy(*by).agg(F.sum(cell_area).alias("sq_nm"), F.count(F.lit(1)).alias("big_n"))


def with_stratum_frame(
    summary: DataFrame, frame: DataFrame, by: Sequence[str], area_digits: int | None = 1
) -> DataFrame:
    """Attach stratum area, cell count and area swept.

    The cells were counted beforehand, so each summary row meets one frame row. The area is
    rounded to print precision before use unless ``area_digits`` is None; a first rounding to nine
    decimals keeps the order of addition from tipping a tie.
    """
    area = F.col("sq_nm") if area_digits is None else F.round(F.round("sq_nm", 9), area_digits)
    return (
        summary.join(frame, list(by))
        .withColumn("sq_nm", area)
        .withColumn("area_swept", F.col("number_of_tows") * F.lit(units.DREDGE_WIDTH_NMI_LONG))
    )


def population_estimate(df: DataFrame) -> DataFrame:
    """Totals in count, kg and lb, and the variance of the means with finite-population correction."""
    kg = F.lit(WIDTHS_PER_NMI) * F.col("mean_wt_kg_per_nm") * F.col("sq_nm")
    n = F.col("number_of_tows")
    correction = F.lit(1.0) - F.try_divide(n, F.col("big_n"))
    return df.withColumns(
        {
            "pop_wt_kg": kg,
            "pop_wt_lb": kg * F.lit(units.POUNDS_PER_KG_LONG),
            "pop_count": F.lit(WIDTHS_PER_NMI) * F.col("mean_count_per_nm") * F.col("sq_nm"),
            "var_cbar_count": F.col("var_of_count") / n * correction,
            "var_cbar_wt": F.col("var_of_wt") / n * correction,
        }
    )


def t_interval(df: DataFrame) -> DataFrame:
    """95 % half-widths of means and totals, population variances and CVs as ratios.

    Every stratum stays: one tow has no interval. A finite-population variance is negative where more tows than cells were made; its root,
    and all that follows from it, is then null.
    """
    scale = F.col("sq_nm") * F.lit(WIDTHS_PER_NMI)
    se = {m: F.when(F.col(f"var_cbar_{m}") >= 0, F.sqrt(f"var_cbar_{m}")) for m in ("count", "wt")}
    out = with_t_quantile(df, "number_of_tows", 95)
    out = out.withColumns(
        {
            "ci_mean_count": F.col("t") * se["count"],
            "ci_mean_wt": F.col("t") * se["wt"],
            "var_pop_count": F.col("var_cbar_count") * scale * scale,
            "var_pop_wt": F.col("var_cbar_wt") * scale * scale,
        }
    )
    root = {m: F.when(F.col(f"var_pop_{m}") >= 0, F.sqrt(f"var_pop_{m}")) for m in ("count", "wt")}
    return out.withColumns(
        {
            "ci_pop_count": F.col("t") * root["count"],
            "ci_pop_wt": F.col("t") * root["wt"],
            "cv_count": F.try_divide(root["count"], F.col("pop_count")),
            "cv_wt": F.try_divide(root["wt"], F.col("pop_wt_kg")),
        }
    )


def recovery_rates(recovery: DataFrame, by: Sequence[str], whole: str, meat: str) -> DataFrame:
    """Meat recovery rate per stratum: sum of meat weight over sum of whole weight.

    Text keys are compared without case or outer blanks, so they are normalised here.
    """
    text = {k for k in by if recovery.select(k).dtypes[0][1] == "string"}
    keys = [norm_key(k).alias(k) if k in text else F.col(k) for k in by]
    return recovery.groupBy(*keys).agg(ratio_of_sums(meat, whole).alias("mr_rate"))


def recovery_estimate(est: DataFrame, rates: DataFrame, keys: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """Meat weight from round weight and recovery rate; strata without a rate drop."""
    joined = join_on_normalised(est, rates, keys, exact)
    kg = F.col("pop_wt_kg") * F.col("mr_rate")
    return joined.withColumns(
        {
            "mean_wt_lb_per_nm": F.col("mean_wt_kg_per_nm") * F.lit(units.POUNDS_PER_KG_SHORT),
            "pop_wt_lb": F.col("pop_wt_kg") * F.lit(units.POUNDS_PER_KG_SHORT),
            "meat_kg": kg,
            "meat_lb": kg * F.lit(units.POUNDS_PER_KG_LONG),
        }
    )


def final_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Print-ready table: rounded numbers, text with separators, density and mean weight."""
    text = {
        "var_of_count": "var_of_count",
        "var_of_wt": "var_of_wt",
        "ci_mean_wt": "ci_mean_wt",
        "pop_wt_kg": "pop_wt_kg",
        "pop_wt_lb": "pop_wt_lb",
        "var_cbar_count": "var_cbar_count",
        "var_cbar_wt": "var_cbar_wt",
        "var_pop_count": "var_pop_count",
        "var_pop_wt": "var_pop_wt",
        "ci_pop_wt": "ci_pop_wt",
        "cv_wt": "cv_wt",
        "meat_kg": "meat_kg",
        "meat_lb": "meat_lb",
    }
    whole_text = ("ci_mean_count", "pop_count", "ci_pop_count")
    density = F.try_divide(F.col("pop_count"), F.col("sq_nm") * units.SQUARE_METRES_PER_SQUARE_NMI)
    return df.select(
        *keys,
        half_even("sq_nm", 2).alias("sq_nm"),
        "number_of_tows",
        half_even("total_nm_towed", 2).alias("total_nm_towed"),
        half_even("area_swept", 6).alias("area_swept"),
        "raw_count",
        half_even("wt_kg_per_nm", 1).alias("wt_kg_per_nm"),
        half_even("mean_count_per_nm", 2).alias("mean_count_per_nm"),
        half_even("mean_wt_kg_per_nm", 1).alias("mean_wt_kg_per_nm"),
        *[standard_text(c).alias(n) for n, c in text.items()],
        *[standard_text(half_even(c)).alias(c) for c in whole_text],
        standard_text(half_even("cv_count", 2)).alias("cv_count"),
        half_even("mr_rate", 3).alias("mr_rate"),
        half_even(density, 3).alias("density_m2"),
        half_even(F.try_divide(F.col("pop_wt_kg") * 1000, F.col("pop_count"))).alias("avg_weight_g"),
    ).distinct()
