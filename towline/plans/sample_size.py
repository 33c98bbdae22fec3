"""How many stations are enough: resampling study of precision against sampled area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.functions import units
from towline.functions.aggregates import sum_strict
from towline.functions.scalar import reconcile
from towline.operators.cleaning import recode
from towline.operators.resampling import compare_designs, design_study

STRATA = ("area_name", "bed", "year")


def study_tows(
    hauls: DataFrame,
    catch: DataFrame,
    area_names: Mapping[str, str],
    species: int,
    condition: int = 1,
    tolerance: float = 0.10,
    width: float = units.DREDGE_WIDTH_NMI,
) -> DataFrame:
    """Used tows with standardised count. A tow with no catch record stays null."""
    used = hauls.filter(F.col("USED_IN_ESTIMATE") == "YES")
    used = recode(used, "SURVEY_AREA", area_names).select(
        F.col("YEAR").alias("year"),
        F.col("EVENT_ID").alias("event"),
        F.col("SURVEY_AREA").alias("area_name"),
        F.trim("BED").alias("bed"),
        reconcile("TOW_LENGTH_FIELD", "TOW_LENGTH_DESIGNATED", tolerance).alias("tow"),
    )
    chosen = catch.filter((F.col("SPECIES_CODE") == species) & (F.col("CONDITION_CODE") == condition))
    sums = chosen.groupBy(F.col("EVENT_ID").alias("event")).agg(
        sum_strict("COUNT").alias("count"), sum_strict("SAMPLE_WT_KG").alias("weight")
    )
    tows = used.join(sums, "event", "left")
    swept = F.col("tow") * F.lit(width)
    return tows.withColumns(
        {"s_wt": F.try_divide(F.col("weight"), swept), "s_count": F.try_divide(F.col("count"), swept)}
    )


def bed_areas(stations: DataFrame) -> DataFrame:
    """Area of each bed from its station cells."""
    return stations.groupBy(F.col("SURVEY_AREA").alias("area_name"), F.col("BED").alias("bed")).agg(
        F.sum("Area_Sq_NM").alias("area")
    )


def sample_size_tables(
    tows: DataFrame, areas: DataFrame, reps: int = units.REPLICATES, seed: int = 1, na_rm: bool = False
) -> dict[str, DataFrame]:
    """Replicate summary per design and its difference from sampling half the area."""
    study = design_study(tows, STRATA, "event", "s_count", areas, ["area_name", "bed"], reps=reps, seed=seed, na_rm=na_rm)
    return {"study": study, "comparison": compare_designs(study, STRATA, ["year"])}
