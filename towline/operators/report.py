"""Print-ready tables. Formatting happens here only; estimates stay numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.functions.scalar import bucket_label
from towline.operators.reshape import domain_order, rollup_to


def number_text(c: Column | str, digits: int = 0) -> Column:
    """Half-even rounding and thousands separators."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_number(F.bround(c.cast("double"), digits), digits)


def print_table(
    df: DataFrame, keep: Sequence[str], numbers: Mapping[str, tuple[str, int]], bed: str, order: Sequence[str]
) -> DataFrame:
    """Formatted columns ``{title: (column, digits)}`` in the declared bed order."""
    texts = [number_text(c, digits).alias(title) for title, (c, digits) in numbers.items()]
    return domain_order(df, bed, order).select("ord", *keep, *texts).orderBy("ord", *keep).drop("ord")


def district_totals(
    summary: DataFrame, bed: str, districts: Mapping[str, list[str]], total: str, cv: str, by: Sequence[str] = ()
) -> DataFrame:
    """Sum of totals and mean of CVs by district, beds of no district under ``NA``."""
    group = bucket_label(bed, dict(districts), "NA")
    return rollup_to(summary, group, "district", {"N": total}, {"CV": cv}, by)


def survey_totals(df: DataFrame, beds: Sequence[str], bed: str, sums: Sequence[str], lows=(), highs=()) -> DataFrame:
    """One row of totals and ranges over some beds."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
    return df.where(F.col(bed).isin(list(beds))).agg(*aggs)
