"""Ordered work on groups of any size: exact quantiles, running sums in range partitions.

No group is ordered as a whole. Quantiles are selected in two passes: a sketch of known error brackets each wanted rank, and
the second pass counts what lies outside and orders what lies inside the brackets. Running sums are taken over pieces of
range partitions, which are short; a piece gives its sums and extremes, and only those are added up along the group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towline.operators.joins import null_safe_join

# The functions that run in tasks travel with them, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A sketch's ranks are right to one part in so many of the group's rows.
ACCURACY = 5000


def with_group_values(rows: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row per group; one row in all if there are no group keys."""
    return null_safe_join(rows, values, by) if by else rows.crossJoin(F.broadcast(values))


def brackets(x: str, probs: Sequence[float], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates of one pass: ``n``, and ``__low_<i>, __high_<i>`` between which the ranks of each quantile lie.

    The sketch's error is one ``accuracy``-th of n and the brackets are two to each side, which holds the ranks if n is
    over twice the accuracy; groups of up to four times the accuracy are bracketed as a whole.
    """
    margin, c = 2 / accuracy, F.col(x)
    asked = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    found = F.percentile_approx(c, F.array(*[F.lit(a) for a in asked]), F.lit(accuracy))
    few, out = F.count(c) <= 4 * accuracy, [F.count(c).alias("n")]
    for i, p in enumerate(probs):
        low = F.min(c) if p - margin <= 0 else F.when(few, F.min(c)).otherwise(found[2 * i])
        high = F.max(c) if p + margin >= 1 else F.when(few, F.max(c)).otherwise(found[2 * i + 1])
        out += [low.alias(f"__low_{i}"), high.alias(f"__high_{i}")]
    return out


def bracketed(x: str, count: int) -> tuple[Column, Column]:
    """Order of a value among the brackets, and the value itself if it is inside one, else null.

    Values sort by the two, nulls last: outside values stand behind the brackets they are above of.
    """
    c = F.col(x)
    above = reduce(lambda a, b: a + b, [F.when(c >= F.col(f"__low_{i}"), 1).otherwise(0) for i in range(count)])
    inside = reduce(lambda a, b: a | b, [c.between(F.col(f"__low_{i}"), F.col(f"__high_{i}")) for i in range(count)])
    return above, F.when(inside, c)


def select_quantiles(counts: DataFrame, by: Sequence[str], probs: Sequence[float], name: str) -> DataFrame:
    """``(*by, prob, <name>)`` from ``(*by, n, __above, __inside, __c)``, the rows counted by :func:`bracketed`."""
    order = Window.partitionBy(*by).orderBy("__above", F.col("__inside").asc_nulls_last())
    upto = counts.withColumn("__to", F.sum("__c").over(order))
    held = F.filter(_ranks(probs, F.col("n")), lambda r: (r["rank"] >= F.col("__to") - F.col("__c")) & (r["rank"] < F.col("__to")))
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    value = F.when(F.col("__inside").isNull(), missed).otherwise(F.col("__inside"))
    found = upto.select(*by, "__inside", F.explode(held).alias("__r")).select(*by, "__r", value.alias("__x"))
    low, high = F.min("__x"), F.max("__x")
    part = F.max("__r.pos") - F.floor(F.max("__r.pos"))
    return found.groupBy(*by, F.col("__r.prob").alias("prob")).agg((low + (high - low) * part).alias(name))


def _ranks(probs: Sequence[float], n: Column) -> Column:
    """For each probability the two ranks its quantile lies between."""
    out = []
    for p in probs:
        pos = F.lit(float(p)) * (n - 1)
        for f in (F.floor, F.ceil):
            out.append(F.struct(F.lit(float(p)).alias("prob"), pos.alias("pos"), f(pos).alias("rank")))
    return F.array(*out)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    probs: Sequence[float],
    name: str = "quantile",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics: ``(*by, prob, <name>)``.

    Two scans and no job before the result is asked for. Without ``by`` the whole table is the group. Nulls are left out,
    and groups without values with them.
    """
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    found = rows.groupBy(*by).agg(*brackets("__x", probs, accuracy)).where("n > 0")
    above, inside = bracketed("__x", len(probs))
    joined = with_group_values(rows, found, by)
    counts = joined.groupBy(*by, "n", above.alias("__above"), inside.alias("__inside")).agg(F.count(F.lit(1)).alias("__c"))
    return select_quantiles(counts, by, probs, name)


def range_pieces(df: DataFrame, by: Sequence[str], order: str, steps: Sequence[str]) -> DataFrame:
    """Sum, and extremes of the running sum, of columns ``steps`` over pieces of each group along ``order``.

    Range partitions of (group, order) deal a group over as many tasks as its share of the rows takes; a piece is what an
    Arrow batch has of a group. Returns ``(*by, __part, __piece, sum_<step>, low_<step>, high_<step>)``; pieces of a group
    follow each other by the two numbers. Rows of equal ``order`` may be in two pieces, so sum them up before.
    """
    by, steps = list(by), list(steps)
    code = F.xxhash64(F.lit(0), *by, *[F.isnull(k) for k in by]).alias("__code")
    rows = df.select(*by, order, code, *[F.col(s).cast("double") for s in steps])
    rows = rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("__code").to_numpy()
            begins = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            columns = {k: batch.column(k).take(pa.array(begins)) for k in by}
            columns |= {"__part": pa.array(np.full(len(begins), partition, np.int32)), "__piece": pa.array(np.full(len(begins), piece))}
            piece += 1
            sizes = np.diff(np.append(begins, len(codes)))
            for s in steps:
                x = batch.column(s).to_numpy()
                total = np.cumsum(x)
                running = total - np.repeat(total[begins] - x[begins], sizes)
                ends = begins + sizes - 1
                columns |= {f"sum_{s}": pa.array(running[ends])}
                columns |= {f"low_{s}": pa.array(np.minimum.reduceat(running, begins)), f"high_{s}": pa.array(np.maximum.reduceat(running, begins))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([rows.schema[k] for k in by]).add("__part", T.IntegerType()).add("__piece", T.LongType())
    for s in steps:
        for name in ("sum", "low", "high"):
            schema.add(f"{name}_{s}", T.DoubleType())
    return rows.mapInArrow(run, schema)


def running_extremes(pieces: DataFrame, by: Sequence[str], steps: Sequence[str]) -> DataFrame:
    """``(*by, low_<step>, high_<step>)``: extremes of the running sum along the whole group."""
    along = Window.partitionBy(*by).orderBy("__part", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"__before_{s}": F.coalesce(F.sum(f"sum_{s}").over(along), F.lit(0.0)) for s in steps}
    placed = pieces.withColumns(before)
    ends = []
    for s in steps:
        ends.append(F.min(F.col(f"__before_{s}") + F.col(f"low_{s}")).alias(f"low_{s}"))
        ends.append(F.max(F.col(f"__before_{s}") + F.col(f"high_{s}")).alias(f"high_{s}"))
    return placed.groupBy(*by).agg(*ends)
