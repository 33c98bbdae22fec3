"""Aggregate expressions for ``groupBy(...).agg(...)``. All combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from towline.functions.scalar import ColumnLike, as_column


def sum0(c: ColumnLike) -> Column:
    """Sum that skips nulls; nothing to sum gives 0."""
    return F.coalesce(F.sum(as_column(c)), F.lit(0).cast("double"))


def _complete(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def sum_strict(c: ColumnLike) -> Column:
    """Sum that is null as soon as one input is null."""
    c = as_column(c)
    return F.when(_complete(c), F.sum(c))


def mean_strict(c: ColumnLike) -> Column:
    """Mean that is null as soon as one input is null."""
    c = as_column(c)
    return F.when(_complete(c), F.avg(c))


def sum_where(c: ColumnLike, cond: Column, strict: bool = True) -> Column:
    """Sum over the rows that meet ``cond``; none gives 0.

    ``strict`` returns null when a chosen row holds a null or an unknown condition.
    """
    c = as_column(c)
    total = F.coalesce(F.sum(F.when(cond, c)), F.lit(0).cast("double"))
    if not strict:
        return total
    unknown = F.count(F.when(cond.isNull() | (cond & c.isNull()), F.lit(1)))
    return F.when(unknown == 0, total)


def cv(c: ColumnLike, percent: bool = True) -> Column:
    """Coefficient of variation; a zero mean gives null."""
    c = as_column(c)
    ratio = F.try_divide(F.stddev_samp(c), F.avg(c))
    return ratio * 100 if percent else ratio


def sum_squares(c: ColumnLike) -> Column:
    """Corrected sum of squares."""
    c = as_column(c)
    return F.var_samp(c) * (F.count(c) - 1)


def ratio_of_sums(num: ColumnLike, den: ColumnLike) -> Column:
    return F.try_divide(F.sum(as_column(num)), F.sum(as_column(den)))
