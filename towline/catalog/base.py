"""Registry and the survey-shaped views of the test tables.

A haul is an order at the station of its customer; nations are beds, regions are districts. A line
item is a catch record: line status is the size class, return flag the condition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from towline.operators.cleaning import project
from towline.operators.reshape import pivot_sum
from towline.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the SQL that must give the same rows."""

    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return add


# Significant digits kept in aggregated results: engines add up in different orders.
DIGITS = 9
# Moves values that end exactly halfway, which the engines round differently, to one side.
NUDGE = "1.00000000002"


def significant(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string(f"%.{DIGITS - 1}e", c * float(NUDGE)).cast("double"))


def whole(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as the comparison SQL has them."""
    casts = {n: F.col(n).cast("bigint") for n, t in df.dtypes if t in ("int", "smallint", "tinyint")}
    return df.withColumns(casts) if casts else df


def tidy(df: DataFrame) -> DataFrame:
    """Aggregated result with doubles cut to significant digits."""
    rounded = {n: significant(n) for n, t in df.dtypes if t == "double"}
    df = df.withColumns(rounded) if rounded else df
    return whole(df)


def tidy_sql(sql: str, *doubles: str) -> str:
    """SQL side of :func:`tidy` for the named double columns."""
    if not doubles:
        return sql
    cut = ", ".join(f"CAST(printf('%.{DIGITS - 1}e', {c} * {NUDGE}::DOUBLE) AS DOUBLE) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({cut}) FROM ({sql})"


# Declared schemas, so no job looks into the files before a query runs.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
        p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP_NTZ""",
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", SCHEMAS[name])


def hauls(spark: SparkSession, sf: str) -> DataFrame:
    """One row per haul, with the order priority as a coarse stratum."""
    return project(
        read(spark, sf, "orders"),
        {
            "haul": "o_orderkey",
            "priority": "o_orderpriority",
            "year": F.year("o_orderdate").cast("bigint"),
            "date": F.col("o_orderdate").cast("date"),
            "effort": "o_totalprice",
            "status": "o_orderstatus",
            "station": "o_custkey",
        },
    )


HAULS = """hauls AS (
  SELECT o_orderkey AS haul, o_orderpriority AS priority, CAST(year(o_orderdate) AS BIGINT) AS year,
         CAST(o_orderdate AS DATE) AS date, o_totalprice AS effort, o_orderstatus AS status, o_custkey AS station
  FROM orders)"""


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """Station cells with bed, district and cell area."""
    customer, nation, region = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    located = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    located = located.join(region, nation.n_regionkey == region.r_regionkey)
    return project(
        located,
        {
            "station": "c_custkey",
            "bed": "n_name",
            "district": "r_name",
            "segment": "c_mktsegment",
            "cell_area": F.abs("c_acctbal"),
        },
    )


STATIONS = """stations AS (
  SELECT c_custkey AS station, n_name AS bed, r_name AS district, c_mktsegment AS segment, abs(c_acctbal) AS cell_area
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def located_hauls(spark: SparkSession, sf: str) -> DataFrame:
    """Hauls with the bed and district of their station."""
    return hauls(spark, sf).join(stations(spark, sf).drop("cell_area"), "station")


LOCATED = f"""{HAULS}, {STATIONS},
located AS (SELECT h.*, s.bed, s.district, s.segment FROM hauls h JOIN stations s ON h.station = s.station)"""


def bed_areas(spark: SparkSession, sf: str) -> DataFrame:
    return stations(spark, sf).groupBy("bed").agg(F.sum("cell_area").alias("area"))


AREAS = "areas AS (SELECT bed, sum(cell_area) AS area FROM stations GROUP BY bed)"

CLASSES = {"F": "large", "O": "small"}


def catch(spark: SparkSession, sf: str) -> DataFrame:
    """Catch records."""
    return project(
        read(spark, sf, "lineitem"),
        {
            "haul": "l_orderkey",
            "size_class": "l_linestatus",
            "count": "l_quantity",
            "weight": "l_extendedprice",
            "cond": "l_returnflag",
        },
    )


CATCH = """catch AS (
  SELECT l_orderkey AS haul, l_linestatus AS size_class, l_quantity AS count, l_extendedprice AS weight,
         l_returnflag AS cond
  FROM lineitem)"""


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Count by size class for each haul with a catch."""
    return pivot_sum(catch(spark, sf), ["haul"], "size_class", "count", CLASSES)


CLASS_COUNTS = f"""{CATCH},
class_counts AS (
  SELECT haul, sum(CASE WHEN size_class = 'F' THEN count ELSE 0 END) AS large,
         sum(CASE WHEN size_class = 'O' THEN count ELSE 0 END) AS small
  FROM catch GROUP BY haul)"""


def haul_densities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per located haul with densities per class."""
    from towline.operators.estimators import add_density, haul_frame
    from towline.operators.joins import complete_with_zero

    frame = haul_frame(located_hauls(spark, sf), "effort")
    full = complete_with_zero(class_counts(spark, sf), frame, ["haul"], ["large", "small"], how="frame")
    return add_density(full, ["large", "small"])


DENSITIES = f"""{LOCATED}, {AREAS}, {CLASS_COUNTS},
densities AS (
  SELECT l.haul, l.year, l.district, l.bed, l.priority, a.area, l.effort * 0.00131663 * 0.83 AS ai,
         coalesce(c.large, 0) / (l.effort * 0.00131663 * 0.83) AS large,
         coalesce(c.small, 0) / (l.effort * 0.00131663 * 0.83) AS small,
         (coalesce(c.large, 0) + coalesce(c.small, 0)) / (l.effort * 0.00131663 * 0.83) AS "all"
  FROM located l LEFT JOIN class_counts c ON l.haul = c.haul LEFT JOIN areas a ON l.bed = a.bed)"""


def individuals(spark: SparkSession, sf: str) -> DataFrame:
    """Measured animals. Height has two decimals; the meat share is one minus the discount."""
    line, part = read(spark, sf, "lineitem"), read(spark, sf, "part")
    return project(
        line.join(part, line.l_partkey == part.p_partkey),
        {
            "haul": "l_orderkey",
            "size_class": "l_linestatus",
            "height": F.col("p_size") + F.col("l_tax"),
            "weight": "l_extendedprice",
            "meat": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "stage": "l_returnflag",
            "kind": "p_type",
            "brand": "p_brand",
        },
    )


INDIVIDUALS = """individuals AS (
  SELECT l_orderkey AS haul, l_linestatus AS size_class, p_size + l_tax AS height, l_extendedprice AS weight,
         l_extendedprice * (1 - l_discount) AS meat, l_returnflag AS stage, p_type AS kind, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
