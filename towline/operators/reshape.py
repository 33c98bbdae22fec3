"""Long to wide, wide to long, contingency tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towline.session import cut_lineage

# Classes of a block.
LEVEL_BLOCK = 5_000


def pivot_sum(
    df: DataFrame, ids: Sequence[str], column: str, value: str | Column, levels: Mapping[object, str]
) -> DataFrame:
    """One column of sums per level, missing cells 0: ``levels`` maps class code to column name.

    Null values are skipped. The levels are declared, so no extra pass looks for them. Classes
    outside the levels add no column, though their ids keep a row.
    """
    v = F.col(value) if isinstance(value, str) else value
    cells = [
        F.coalesce(F.sum(F.when(F.col(column) == F.lit(code), v)), F.lit(0).cast("double")).alias(name)
        for code, name in levels.items()
    ]
    return df.groupBy(*ids).agg(*cells)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable="variable", value="value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), variable, value)


def crosstab(df: DataFrame, row: str, by: Sequence[str], levels: Sequence | None = None) -> DataFrame:
    """Counts of ``row`` classes within ``by``, absent cells 0, rows with a null left out.

    Long form ``(*by, row, n)``. With declared ``levels`` all cells of a column group come from one aggregate. Otherwise
    the observed classes, however many, complete the grid of each column group: counts are written to the checkpoint folder
    once, classes are packed into blocks of some ``LEVEL_BLOCK``, and every column group meets the blocks by a join on their
    number. No array of all classes is made, in a task or on the driver.
    """
    kept = df.where(F.col(row).isNotNull())
    for b in by:
        kept = kept.where(F.col(b).isNotNull())
    if levels is None:
        counts = kept.groupBy(*by, row).agg(F.count(F.lit(1)).alias("n"))
        counts = cut_lineage(counts)
        classes = counts.select(row).distinct()
        blocks = classes.select(F.ceil(F.count(F.lit(1)) / LEVEL_BLOCK)).scalar()
        dealt = classes.withColumn("__block", F.pmod(F.xxhash64(row), blocks))
        packed = dealt.groupBy("__block").agg(F.collect_list(row).alias("__classes"))
        groups = counts.select(*by).distinct().withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        grid = groups.join(packed, "__block").select(*by, F.explode("__classes").alias(row))
        return grid.join(counts, [*by, row], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    levels = list(levels)
    cells = [F.count(F.when(F.col(row) == F.lit(v), F.lit(1))).alias(f"__{i}") for i, v in enumerate(levels)]
    wide = kept.where(F.col(row).isin(levels)).groupBy(*by).agg(*cells)
    entries = F.array(*[F.struct(F.lit(v).alias(row), F.col(f"__{i}").alias("n")) for i, v in enumerate(levels)])
    return wide.select(*by, F.inline(entries))


def col_percent(counts: DataFrame, by: Sequence[str], n: str = "n", digits: int = 2) -> DataFrame:
    """Add ``percent``: the cell's share of its column group, half-even rounded."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("percent", F.bround(F.try_divide(F.lit(100.0) * F.col(n), total), digits))


def with_margin(percents: DataFrame, row: str, by: Sequence[str], n: str = "n", margin: str = "n") -> DataFrame:
    """Percent table as text-labelled long form plus one margin row of counts per column group, by grouping sets."""
    sets = percents.groupingSets([[*by, row], list(by)], *by, row).agg(
        F.grouping(row).alias("__margin"), F.max("percent").alias("__percent"), F.sum(n).cast("double").alias("__n")
    )
    is_margin = F.col("__margin") == 1
    label = F.when(is_margin, F.lit(margin)).otherwise(F.col(row).cast("string"))
    return sets.select(*by, label.alias(row), F.when(is_margin, F.col("__n")).otherwise(F.col("__percent")).alias("value"))


def rollup_to(
    df: DataFrame, group: Column, name: str, sums: Mapping[str, str], means: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Re-aggregate strata to a coarser grouping: sums of totals, means of CVs."""
    out = [F.sum(c).alias(n) for n, c in sums.items()] + [F.avg(c).alias(n) for n, c in means.items()]
    return df.withColumn(name, group).groupBy(*by, name).agg(*out)


def domain_order(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    """Add ``ord``, the position of the value in a declared order, to sort by; unlisted values get null."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn("ord", F.when(position > 0, position))
