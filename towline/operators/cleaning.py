"""Projection, recoding, null filling and duplicate checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.functions.scalar import parse_date, strip_spaces
from towline.sources import schemas


def project(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Select and rename: ``{new name: column}``."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def zero_fill(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Nulls in the measures become 0. Keys are never filled."""
    return df.fillna(0, subset=list(measures))


def recode(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace listed codes and keep the others.

    A dict becomes a CASE; a two-column DataFrame ``(code, label)`` with unique codes is joined.
    """
    if isinstance(mapping, DataFrame):
        code, label = mapping.columns
        lut = mapping.select(F.col(code).alias("__code"), F.col(label).alias("__label"), F.lit(True).alias("__hit"))
        joined = df.join(lut, F.col(column) == F.col("__code"), "left")
        value = F.when(F.col("__hit"), F.col("__label")).otherwise(F.col(column))
        return joined.withColumn(column, value).drop("__code", "__label", "__hit")
    case: Column | None = None
    for code, label in mapping.items():
        cond = F.col(column) == F.lit(code)
        case = F.when(cond, F.lit(label)) if case is None else case.when(cond, F.lit(label))
    return df if case is None else df.withColumn(column, case.otherwise(F.col(column)))


def label(df: DataFrame, code: str, lut: DataFrame, lut_code: str, lut_label: str, name: str) -> DataFrame:
    """Attach the label of a class code by value; codes the lookup lacks get null."""
    names = lut.select(F.col(lut_code).alias("__code"), F.col(lut_label).alias(name))
    return df.join(names, F.col(code) == F.col("__code"), "left").drop("__code")


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once.

    The counting combines on the map side and only repeated keys are joined back, so a key
    that holds a large share of the rows is never sorted in one task.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    repeated = repeated.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return df.join(repeated, cond, "left_semi")


def clean_hauls(raw: DataFrame, ancillary: bool = True) -> DataFrame:
    """Haul file to haul table: date and year, station without blanks, good tows only.

    ``ancillary=False`` also leaves out tows made for other purposes.
    """
    good = raw.filter(F.col("GEAR_PERFORMANCE_CODE_SW") == 1)
    if not ancillary:
        good = good.filter(F.col("STATION_TYPE") != "Ancillary")
    dated = good.withColumn("__date", parse_date(strip_spaces("DATE_SET")))
    return project(
        dated,
        {
            "year": F.year("__date"),
            "date": F.col("__date"),
            "station": strip_spaces("STATION_ID"),
            **schemas.HAUL_COLUMNS,
        },
    )


def meat_ratio(
    individuals: DataFrame,
    hauls: DataFrame,
    species: int,
    size_class: int = 1,
    event: str = "event",
) -> DataFrame:
    """Meat share of live animals of one class, for hauls in the frame; rows without a ratio drop."""
    chosen = individuals.filter(
        (F.col("species") == species) & (F.col("size_class") == size_class) & F.col("clapper").isNull()
    )
    ratio = chosen.withColumn("ratio", F.try_divide(F.col("meat_weight"), F.col("weight")))
    return ratio.filter(F.col("ratio").isNotNull()).join(hauls.select(event), event, "left_semi")
