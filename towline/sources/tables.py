"""Reading, writing and staging tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towline.session import checkpoint_folder
from towline.sources import schemas


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str | None = None) -> DataFrame:
    """Read a headered CSV (``NA`` and empty are null) or a parquet table.

    CSV needs a schema: inferring one would scan the data an extra time. Columns are matched
    to the header by name, so the schema may list a subset of them in any order.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a CSV source needs an explicit schema")
    options = {"header": True, "nullValue": "NA", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    header = spark.read.options(**options).csv(path).columns
    wanted = {f.name.lower(): f for f in T.StructType.fromDDL(schema).fields}
    missing = [f.name for k, f in wanted.items() if k not in {h.lower() for h in header}]
    if missing:
        raise ValueError(f"columns not in the header: {missing}")
    full = ", ".join(
        f"`{h}` {wanted[h.lower()].dataType.simpleString() if h.lower() in wanted else 'string'}" for h in header
    )
    return spark.read.options(**options).schema(full).csv(path).select(*[f"`{f.name}`" for f in wanted.values()])


def read_lookup(
    spark: SparkSession, path: str, schema: str | None, key: str | Sequence[str], max_rows: int = 100_000
) -> DataFrame:
    """Read a lookup table; fails if its key is not unique.

    One of up to ``max_rows`` rows is marked for broadcast; a longer one joins by shuffle.
    """
    df = read_table(spark, path, schema)
    keys = [key] if isinstance(key, str) else list(key)
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{path} repeats a key of {keys}")
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read_t_table(spark: SparkSession, path: str) -> DataFrame:
    """Student-t quantiles by sample size, from a lookup file."""
    raw = read_lookup(spark, path, schemas.T_TABLE_FILE, "N", max_rows=10_000)
    return raw.select(
        F.col("N").alias("n"),
        "df",
        F.col("90_2tail").alias("t90"),
        F.col("95_2tail").alias("t95"),
        F.col("99_2tail").alias("t99"),
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a result table; CSV gets a header and ``NA`` for null."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)


def stage(df: DataFrame, name: str, materialize: bool = False) -> DataFrame:
    """Name a result for SQL use. By default a view; ``materialize`` writes it to the shared folder as parquet.

    The written table keeps column pruning and filters on its files; a lost executor loses nothing of it.
    """
    out = df
    if materialize:
        path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.createOrReplaceTempView(name)
    return out.sparkSession.table(name)
