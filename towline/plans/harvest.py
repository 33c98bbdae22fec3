"""Harvest levels and share of dead shells by stratum, all from one staged table of catch records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.functions import units
from towline.functions.aggregates import sum_where
from towline.operators import estimators, resampling
from towline.operators.joins import null_safe_join
from towline.session import cut_lineage


@dataclass
class HarvestAnalysis:
    """Tables of a survey, each made when it is asked for.

    ``records`` has a row per catch record with the columns of its haul, and one row for a haul without records: ``event``,
    the ``strata``, ``ai`` (area swept), ``live`` and ``dead`` (whether a record counts as such), ``count``, ``grams``,
    ``ratio`` (meat ratio of the animal), ``animal`` (differs between the animals of a stratum). ``areas`` has ``on`` and
    ``area``. Records are written to the checkpoint folder once; one row per haul is made of them and packed once, so
    numbers, weights and dead shells are measures of one draw.
    """

    records: DataFrame
    areas: DataFrame
    strata: Sequence[str] = ("year", "district", "bed")
    on: Sequence[str] = ("bed",)
    reps: int = units.REPLICATES
    seed: int = 1

    @cached_property
    def staged(self) -> DataFrame:
        columns = ["event", *self.strata, "ai", "live", "dead", "count", "grams", "ratio", "animal"]
        return cut_lineage(self.records.select(*columns))

    @cached_property
    def hauls(self) -> DataFrame:
        """One row per haul: densities of live and dead in number and grams, and the mean weight of its animals."""
        sums = self.staged.groupBy("event", *self.strata, "ai").agg(
            sum_where("count", F.col("live"), strict=False).alias("number"),
            sum_where("grams", F.col("live"), strict=False).alias("grams"),
            sum_where("count", F.col("dead"), strict=False).alias("dead"),
            sum_where("grams", F.col("dead"), strict=False).alias("dead_grams"),
            F.avg("grams").alias("mean_wt"),
        )
        measures = ["number", "grams", "dead", "dead_grams"]
        return sums.withColumns({c: F.try_divide(F.col(c), F.col("ai")) for c in measures})

    @cached_property
    def totals(self) -> DataFrame:
        """Bootstrap summary of number (``_n``) and weight in pounds (``_w``) per stratum, of one draw of hauls."""
        sums = resampling.resample(self.hauls, self.strata, "event", ["number", "grams"], self.reps, self.seed)
        placed = null_safe_join(sums, self.areas.select(*self.on, F.col("area").cast("double").alias("area")), self.on, "left")
        mean = lambda v: F.col("area") * F.try_divide(F.col(f"sum_{v}"), F.col("n"))
        both = placed.withColumns({"number": mean("number"), "pounds": mean("grams") * units.POUNDS_PER_GRAM})
        return resampling.bootstrap_summary(both, self.strata, {"n": "number", "w": "pounds"})

    @cached_property
    def ratios(self) -> DataFrame:
        """Bootstrap mean of the meat ratio per stratum."""
        animals = self.staged.where(F.col("ratio") > 0)
        drawn = resampling.bootstrap_ratio(animals, self.strata, "animal", "ratio", self.reps, self.seed)
        return drawn.groupBy(*self.strata).agg(F.avg("ratio").alias("mean_ratio"))

    @cached_property
    def mean_weights(self) -> DataFrame:
        """Mean over hauls of the mean weight of their animals."""
        return self.hauls.groupBy(*self.strata).agg(F.avg("mean_wt").alias("mean_wt"))

    def _with_ratio(self) -> DataFrame:
        return null_safe_join(self.totals, self.ratios, self.strata)

    def number_harvest(self) -> DataFrame:
        """Harvest levels from numbers; strata without measured animals drop."""
        joined = null_safe_join(self._with_ratio(), self.mean_weights.where("mean_wt IS NOT NULL"), self.strata)
        ends = {"ll": "ll_n", "meat": "mean_n", "ul": "ul_n"}
        return estimators.number_harvest(joined, "mean_ratio", "mean_wt", ends, keep=self.strata)

    def weight_harvest(self) -> DataFrame:
        """Harvest levels from weight."""
        ends = {"ll": "ll_w", "meat": "mean_w", "ul": "ul_w"}
        return estimators.weight_harvest(self._with_ratio(), "mean_ratio", ends, keep=self.strata)

    def clapper_share(self) -> DataFrame:
        """Share of dead shells in number and in weight, for every stratum with a haul."""
        measures = {"c": "dead", "wt": "dead_grams"}
        gone = estimators.expand_estimate_wide(self.hauls, self.strata, measures, self.areas)
        joined = null_safe_join(gone, self.totals.select(*self.strata, "mean_n", "mean_w"), self.strata, "left")
        pounds = F.col("total_wt") * units.POUNDS_PER_GRAM
        return joined.select(
            *self.strata,
            "n",
            estimators.share_of_total("total_c", "mean_n").alias("percent_clap"),
            estimators.share_of_total(pounds, "mean_w").alias("percent_clap_wt"),
        )
