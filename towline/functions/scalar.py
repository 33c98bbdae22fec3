"""Scalar column helpers. Each takes and returns Columns and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_spaces(c: ColumnLike) -> Column:
    """Remove every blank, inner ones too."""
    return F.replace(as_column(c), F.lit(" "), F.lit(""))


def norm_key(c: ColumnLike) -> Column:
    """Key form for matching without regard to case or outer blanks."""
    return F.lower(F.trim(as_column(c)))


def parse_date(c: ColumnLike, fmt: str = "MM-dd-yyyy") -> Column:
    """Text to date; unreadable text gives null."""
    return F.try_to_timestamp(as_column(c), F.lit(fmt)).cast("date")


def month_name(c: ColumnLike) -> Column:
    return F.date_format(as_column(c), "MMMM")


def trailing(c: ColumnLike, n: int) -> Column:
    return F.right(as_column(c), F.lit(n))


def guarded_div(num: ColumnLike, den: ColumnLike, default: float | None = 0.0) -> Column:
    """``num / den`` where ``den`` is positive, else ``default``."""
    num, den = as_column(num), as_column(den)
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def null_div(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / den``; a zero denominator gives null instead of an error."""
    return F.try_divide(as_column(num), as_column(den))


def reconcile(field: ColumnLike, planned: ColumnLike, tolerance: float) -> Column:
    """The field value where it is off the planned one by more than ``tolerance`` of itself."""
    field, planned = as_column(field), as_column(planned)
    return F.when(F.abs(field - planned) > field * tolerance, field).otherwise(planned)


def half_even(c: ColumnLike, digits: int = 0) -> Column:
    return F.bround(as_column(c), digits)


def one_decimal(c: ColumnLike, digits: int = 1) -> Column:
    """Half-up rounding to a fixed print precision, kept as a number."""
    return F.round(as_column(c), digits)


def standard_text(c: ColumnLike, digits: int = 2) -> Column:
    """Text with thousands separators; rounds half up first, as ``format_number`` is half-even."""
    return F.format_number(F.round(as_column(c), digits), digits)


def parse_standard(c: ColumnLike) -> Column:
    """Number from text with thousands separators."""
    return F.replace(as_column(c), F.lit(","), F.lit("")).cast("double")


def bucket_label(c: ColumnLike, groups: dict[str, list[str]], default: str | None = None) -> Column:
    """First group that lists the value; nested if/else as one CASE."""
    value = as_column(c)
    out: Column | None = None
    for label, members in groups.items():
        cond = value.isin(list(members))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        raise ValueError("no groups given")
    return out.otherwise(F.lit(default))


def swept_area(length: ColumnLike, width: float, efficiency: float = 1.0) -> Column:
    """Area covered by one tow: length x gear width x gear efficiency."""
    return as_column(length) * F.lit(width) * F.lit(efficiency)


def precision_columns(total: ColumnLike, target: float = 0.20) -> dict[str, Column]:
    """Absolute half-width that a CV target allows, and half of it."""
    allowed = F.lit(target) * as_column(total)
    return {"mean_20": allowed, "half_mean_20": allowed / 2}
