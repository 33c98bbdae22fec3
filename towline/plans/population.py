"""Design-based population estimate for a run of years, from tow records to the printed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.functions.scalar import norm_key, trailing
from towline.operators import design_based as db
from towline.operators.joins import lookup_sum

STRATA = ("area", "bed", "year")


def used_tows(hauls: DataFrame) -> DataFrame:
    """Tows marked for use, newest event first within a year."""
    used = hauls.filter(F.col("USED_IN_ESTIMATE") == "YES")
    return used.select("YEAR", "EVENT_ID", "BED", "STATION_ID", "USED_IN_ESTIMATE").orderBy(
        "YEAR", F.col("EVENT_ID").desc(), "BED", "STATION_ID"
    )


def tow_counts(hauls: DataFrame) -> DataFrame:
    used = hauls.filter(F.col("USED_IN_ESTIMATE") == "YES")
    return used.groupBy("YEAR", "BED").agg(F.count("USED_IN_ESTIMATE").alias("tows"))


def tow_catch(hauls: DataFrame, catch: DataFrame, species: int, condition: int, after_year: int = 1995) -> DataFrame:
    """One row per used tow with its catch; 0 where nothing was caught. Text keys are normalised."""
    used = hauls.filter((F.col("USED_IN_ESTIMATE") == "YES") & (F.col("YEAR") > after_year)).select(
        norm_key("SURVEY_AREA").alias("area"),
        norm_key("BED").alias("bed"),
        F.col("YEAR").alias("year"),
        F.col("PROJECT_CODE").alias("project_code"),
        "EVENT_ID",
        F.col("TOW_LENGTH_DESIGNATED").alias("length"),
    )
    chosen = (F.col("SPECIES_CODE") == species) & (F.col("CONDITION_CODE") == condition)
    return lookup_sum(used, catch, ["EVENT_ID"], {"count": "COUNT", "weight": "SAMPLE_WT_KG"}, chosen)


def population_tables(
    hauls: DataFrame,
    catch: DataFrame,
    stations: DataFrame,
    recovery: DataFrame,
    species: int,
    condition: int,
    after_year: int = 1995,
) -> dict[str, DataFrame]:
    """Every step of the estimate by name; ``report`` is the printed table.

    Strata are (area, bed, year). Two shuffles touch tow-sized data: catch to tow and tow to
    stratum; the rest joins tables of one row per stratum.
    """
    tows = tow_catch(hauls, catch, species, condition, after_year)
    # Projects of a stratum come with its sums from one aggregate, so tows are read once.
    summary = db.tow_summary(tows, STRATA, "length", "count", "weight", codes=["project_code"])
    cells = stations.withColumns({"area": norm_key("SURVEY_AREA"), "bed": norm_key("BED")})
    frame = db.stratum_frame(cells, ["area", "bed"], "Area_Sq_NM")
    total = db.population_estimate(db.with_stratum_frame(summary, frame, ["area", "bed"]))
    interval = db.t_interval(total)
    by_year = recovery.withColumn("year", trailing("SURVEY_AND_YEAR", 4).try_cast("int"))
    rates = db.recovery_rates(by_year, ["bed", "year"], "WHOLE_WT_KG", "MEAT_WT_KG")
    with_meat = db.recovery_estimate(interval, rates, ["bed"], ["year"])
    by_project = with_meat.select("*", F.inline("codes"))
    final = db.final_report(by_project, ["year", "project_code", "area", "bed"])
    return {
        "tows": tows,
        "summary": summary,
        "frame": frame,
        "population": total,
        "interval": interval,
        "rates": rates,
        "with_meat": with_meat,
        "report": final.orderBy("project_code", "area", "bed", "year"),
    }
