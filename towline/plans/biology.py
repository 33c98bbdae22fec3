"""Biological tables: condition classes by bed, expanded sizes, meat ratio by month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.functions.scalar import month_name
from towline.operators import distributions
from towline.operators.estimators import cpue
from towline.operators.reshape import col_percent, crosstab, with_margin

# Printed names of the class codes.
WORM_LABELS = {0: "0%", 1: "1 - 24%", 2: "25 - 49%", 3: "50 - 74%", 4: "75 - 100%"}
GONAD_LABELS = {1: "Empty", 2: "Initial Recovery", 3: "Filling", 4: "Full"}
BLISTER_LABELS = {0: "0%", 1: "1 - 24%", 2: "25 - 49%", 3: "50 - 74%"}
MEAT_LABELS = {1: "Good", 2: "Weak"}


def live_individuals(individuals: DataFrame, hauls: DataFrame, species: int) -> DataFrame:
    """Live animals of the species with the bed, the month and both together."""
    live = individuals.filter((F.col("species") == species) & F.col("clapper").isNull())
    joined = live.join(hauls.select("event", "bed", "date", "vessel"), "event")
    month = month_name("date")
    return joined.withColumns({"month": month, "bed_month": F.concat_ws(" ", F.col("bed"), month)})


def class_table(bio: DataFrame, code: str, by: str, labels: Mapping[int, str]) -> DataFrame:
    """Percent of animals in each class per column group, with a last row of counts.

    Codes outside the labels are left out of the percentages.
    """
    kept = bio.filter(F.col(code).isin(list(labels)))
    named = kept.select(by, F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col(code)).alias("class"))
    percents = col_percent(crosstab(named, "class", [by], list(labels.values())), [by])
    return with_margin(percents, "class", [by])


def wide_class_table(long: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """The class table with one column per group, in the order given."""
    return long.groupBy("class").pivot(by, list(columns)).agg(F.first("value"))


def bycatch_rate(catch: DataFrame, hauls: DataFrame, species: int, unsorted: int = 99997):
    """Catch per nautical mile of a by-catch species, by haul and by bed."""
    return cpue(
        catch,
        hauls,
        "event",
        "bed",
        "length",
        F.col("species") == species,
        F.col("species") == unsorted,
        weight="sample_wt",
    )


def expanded_heights(individuals: DataFrame, catch: DataFrame, hauls: DataFrame, species: int, live: int = 1) -> dict[str, DataFrame]:
    """Size distribution grown to the total caught per haul and size class."""
    beds = hauls.select("event", "bed")
    keys = ["event", "bed", "size_class"]
    seen = individuals.filter((F.col("species") == species) & F.col("clapper").isNull()).join(beds, "event")
    caught = catch.filter((F.col("species") == species) & (F.col("cond") == live)).join(beds, "event")
    totals = caught.groupBy(*keys).agg(F.sum("count").alias("total"))
    counts = distributions.allocate_lengths(seen, totals, keys, "height", "total")
    return {
        "totals": totals,
        "counts": counts,
        "rows": distributions.expand_lengths(seen, totals, keys, "height", "total"),
        "check": distributions.reconcile_totals(counts, totals, keys, F.col("measured") + F.col("added"), "total"),
    }
