"""Abundance, weight, meat ratio and harvest levels from one year's survey files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.functions import units
from towline.functions.aggregates import sum0
from towline.functions.scalar import precision_columns
from towline.operators import cleaning, estimators, resampling
from towline.operators.joins import complete_with_zero
from towline.operators.reshape import pivot_sum
from towline.sources import schemas, write_table


@dataclass(frozen=True)
class SurveySettings:
    """Codes and constants of a survey."""

    species: int
    classes: Mapping[int, str] = field(default_factory=lambda: {1: "large", 2: "small"})
    live: int = 1
    clapper: int = 52
    width: float = units.DREDGE_WIDTH_NMI
    efficiency: float = units.DREDGE_EFFICIENCY
    reps: int = units.REPLICATES
    seed: int = 1


STRATA = ("year", "district", "bed")


def survey_tables(hauls: DataFrame, catch: DataFrame, individuals: DataFrame, areas: DataFrame, s: SurveySettings) -> dict[str, DataFrame]:
    """Cleaned tables the estimates start from: hauls with effort, catch by class, individuals."""
    area = cleaning.project(areas, {"bed": "Bed", "area": "area_nm2"})
    events = estimators.haul_frame(cleaning.clean_hauls(hauls), "length", s.width, s.efficiency)
    caught = cleaning.project(catch, schemas.CATCH_COLUMNS)
    animals = cleaning.project(individuals, schemas.INDIVIDUAL_COLUMNS)
    live = caught.filter((F.col("species") == s.species) & (F.col("cond") == s.live))
    return {
        "events": events,
        "areas": area,
        "catch": caught,
        "individuals": animals,
        "counts": pivot_sum(live, ["event"], "size_class", "count", s.classes),
        "grams": pivot_sum(live, ["event"], "size_class", F.col("sample_wt") * units.GRAMS_PER_KG, s.classes),
    }


def densities(events: DataFrame, catch: DataFrame, measures: list[str], total: str | None = "all") -> DataFrame:
    """One row per haul with a density per measure; hauls without catch are zeros."""
    full = complete_with_zero(catch, events, ["event"], measures, how="frame")
    return estimators.add_density(full, measures, "ai", total)


def abundance_tables(
    hauls: DataFrame, catch: DataFrame, individuals: DataFrame, areas: DataFrame, settings: SurveySettings
) -> dict[str, DataFrame]:
    """All result tables of the survey, by name. Building the bootstraps already counts their strata."""
    s = settings
    t = survey_tables(hauls, catch, individuals, areas, s)
    events, classes = t["events"], list(s.classes.values())
    measures = [*classes, "all"]
    numbers = densities(events, t["counts"], classes)
    grams = densities(events, t["grams"], classes)

    raw = events.select("event", "bed").join(t["counts"], "event").join(
        t["grams"].withColumnsRenamed({c: f"{c}_g" for c in classes}), "event"
    )
    catch_table = estimators.catch_table(raw, "bed", classes, [f"{c}_g" for c in classes])

    original = estimators.expand_estimate(numbers, STRATA, measures, t["areas"])
    boot_n = resampling.bootstrap(numbers, STRATA, "event", measures, t["areas"], reps=s.reps, seed=s.seed)
    n_summary = resampling.bootstrap_summary(boot_n, [*STRATA, "variable"], {"total": "total", "dbar": "dbar"})

    boot_w = resampling.bootstrap(grams, STRATA, "event", measures, t["areas"], reps=s.reps, seed=s.seed + 1)
    pounds = boot_w.withColumns({c: F.col(c) * units.POUNDS_PER_GRAM for c in ("total", "dbar")})
    w_summary = resampling.bootstrap_summary(pounds, [*STRATA, "variable"], {"weight": "total", "dbar": "dbar"})

    ratios = cleaning.meat_ratio(t["individuals"], events, s.species).filter(F.col("ratio") > 0)
    ratios = ratios.withColumn("animal", F.struct("event", "number"))
    ratios = ratios.join(events.select("event", *STRATA), "event")
    boot_r = resampling.bootstrap_ratio(ratios, STRATA, "animal", "ratio", s.reps, s.seed + 2)
    meat = resampling.bootstrap_summary(boot_r, STRATA, {"ratio": "ratio"})

    large = classes[0]
    live = t["individuals"].filter(
        (F.col("species") == s.species) & (F.col("size_class") == 1) & F.col("clapper").isNull()
    )
    weights = estimators.mean_of_means(
        live.join(events.select("event", *STRATA), "event"), ["event", *STRATA], STRATA, "weight", "mean_wt"
    )
    by_number = (
        n_summary.filter(F.col("variable") == large)
        .join(weights, list(STRATA))
        .join(meat.select(*STRATA, "mean_ratio"), list(STRATA))
    )
    number_ghl = estimators.number_harvest(
        by_number, "mean_ratio", "mean_wt", {"ll": "ll_total", "meat": "mean_total", "ul": "ul_total"}, keep=STRATA
    )
    by_weight = w_summary.filter(F.col("variable") == large).join(meat.select(*STRATA, "mean_ratio"), list(STRATA))
    weight_ghl = estimators.weight_harvest(
        by_weight, "mean_ratio", {"ll": "ll_weight", "meat": "mean_weight", "ul": "ul_weight"}, keep=STRATA
    )

    return {
        "samples": estimators.sample_sizes(events, t["areas"], "bed"),
        "catch_table": catch_table,
        "numbers_original": original,
        "numbers": boot_n,
        "N_summary": n_summary,
        "weights_original": estimators.expand_estimate(grams, STRATA, measures, t["areas"]),
        "weights_summary": w_summary,
        "meat_wts": meat,
        "number_GHL": number_ghl,
        "weight_GHL": weight_ghl,
        "clapper_summary": clapper_summary(t, s, n_summary, w_summary, large),
        "precision_target": original.filter(F.col("variable") == large).withColumns(
            precision_columns("total")
        ),
    }


def clapper_estimate(tables: Mapping[str, DataFrame], s: SurveySettings) -> DataFrame:
    """Dead shells in number and weight (kg) per bed, with totals in pounds."""
    dead = tables["catch"].filter((F.col("species") == s.species) & (F.col("cond") == s.clapper))
    per_haul = dead.groupBy("event").agg(sum0("count").alias("c"), sum0("sample_wt").alias("wt"))
    wide = densities(tables["events"], per_haul, ["c", "wt"], total=None)
    est = estimators.expand_estimate_wide(wide, STRATA, {"c": "c", "wt": "wt"}, tables["areas"])
    return est.withColumns(
        {"dbar_wt_lb": F.col("dbar_wt") * units.POUNDS_PER_KG_SHORT, "total_wt_lb": F.col("total_wt") * units.POUNDS_PER_KG_SHORT}
    )


def clapper_summary(
    tables: Mapping[str, DataFrame], s: SurveySettings, numbers: DataFrame, weights: DataFrame, variable: str
) -> DataFrame:
    """Share of dead shells among all, in number and in weight, for every bed surveyed."""
    dead = clapper_estimate(tables, s).select(*STRATA, "n", "total_c", "total_wt_lb")
    live_n = numbers.filter(F.col("variable") == variable).select(*STRATA, F.col("mean_total").alias("__n"))
    live_w = weights.filter(F.col("variable") == variable).select(*STRATA, F.col("mean_weight").alias("__w"))
    joined = live_w.join(live_n.join(dead, list(STRATA), "right"), list(STRATA), "right")
    return joined.select(
        *STRATA,
        "n",
        estimators.share_of_total("total_c", "__n").alias("percent_clap"),
        estimators.share_of_total("total_wt_lb", "__w").alias("percent_clap_wt"),
    )


RESULTS = (
    "samples",
    "catch_table",
    "numbers_original",
    "N_summary",
    "weights_summary",
    "meat_wts",
    "weight_GHL",
    "number_GHL",
    "clapper_summary",
)


def write_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write every published table to ``folder/<name>``."""
    for name in RESULTS:
        write_table(tables[name], f"{folder}/{name}", fmt, mode)
