"""Joins with survey semantics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.functions.scalar import norm_key
from towline.functions.student_t import t_quantile
from towline.operators.cleaning import zero_fill

# Longest side that is broadcast.
BROADCAST_ROWS = 50_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it turns out to be short; otherwise leave the join to a shuffle.

    For narrow, aggregated frames whose length is not known beforehand. At most
    ``max_rows + 1`` rows are fetched; if that is all, they stand in for ``df``, so its input is
    not read a second time.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; keeps the left key columns."""
    if not keys:
        raise ValueError("no join keys")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def complete_with_zero(
    fact: DataFrame, frame: DataFrame, keys: Sequence[str], measures: Sequence[str], how: str = "full"
) -> DataFrame:
    """Every haul of the frame with its measures, 0 where nothing was caught.

    ``full`` also keeps facts without a haul (their frame columns stay null);
    ``frame`` keeps hauls only.
    """
    if how not in ("full", "frame"):
        raise ValueError("how is 'full' or 'frame'")
    joined = frame.join(fact, list(keys), "full" if how == "full" else "left")
    return zero_fill(joined, measures)


def with_t_quantile(df: DataFrame, n_col: str, level: int = 95) -> DataFrame:
    """Add ``t`` for the row's sample size, whatever it is; null below 2. No row is dropped."""
    return df.withColumn("t", t_quantile(n_col, level))


def lookup_sum(
    frame: DataFrame,
    fact: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str | Column],
    where: Column | None = None,
) -> DataFrame:
    """Per frame row the sum of matching facts, 0 if there are none: ``{new name: measure}``.

    Facts are summed per key before the join, so the join sees one row per key on the fact side.
    """
    chosen = fact if where is None else fact.filter(where)
    sums = chosen.groupBy(*keys).agg(
        *[F.sum(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in measures.items()]
    )
    return zero_fill(frame.join(sums, list(keys), "left"), list(measures))


def join_on_normalised(
    left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Join on keys compared without case or outer blanks, plus ``exact`` keys; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in (*keys, *exact)})
    conds = [norm_key(k) == norm_key(f"__r_{k}") for k in keys] + [F.col(k) == F.col(f"__r_{k}") for k in exact]
    return left.join(renamed, reduce(lambda a, b: a & b, conds), how).drop(*[f"__r_{k}" for k in (*keys, *exact)])


def replicates(df: DataFrame, count: int, name: str = "replicate") -> DataFrame:
    """Each row once per replicate number 0..count-1, generated row by row.

    For rows of strata. Facts are summed up per stratum first: what does not depend on the replicate need not be repeated
    before, and what does is drawn inside tasks (``resampling``).
    """
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name))
