"""Helpers shared by the operators: reading tables, staging, hashes, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from towline.session import checkpoint_folder

# Bytes of text that reach a Python task at once; texts are long, so rows alone are no bound.
ARROW_BYTES = 4 << 20


# Rows of a broadcast at most. Rows of more than so many are joined in several parts.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns (default: all) of a table of the corpus."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that memory of a task does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


# Removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, compression: str = "snappy", cleanup: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``cleanup`` the shuffle files of the write are removed at its end; nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if cleanup:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if cleanup:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged_table: DataFrame) -> None:
    """Delete the files of a :func:`staged` table that nothing will read again."""
    jvm, conf = staged_table.sparkSession._jvm, staged_table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in staged_table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bounded_parts(df: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """``df`` dealt by ``key`` into as many parts as it takes for each to have about ``rows`` rows or fewer."""
    n = -(-df.count() // rows)
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def fold(i: Column | str, modulus: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``modulus``; a null id is in no fold."""
    i = F.col(i) if isinstance(i, str) else i
    return F.crc32(i.cast("string").cast("binary")) % modulus


def temporary_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8; none for null."""
    return text.encode().lower().split() if text else []


# One value per byte, and an odd base: the letters and the places of a polynomial hash modulo 2**64.
_LETTERS = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_IN_WORD = np.array([c not in b"\x20\x09\x0a\x0b\x0c\x0d" for c in range(256)])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of them at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def hashed_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and where each text's begin (one entry more than texts).

    Words are those of :func:`words_of`. Texts are hashed together, some hundred thousand bytes at a time, without a look
    at single words: a word's hash is the difference of two sums over the bytes before its ends, moved to place zero.
    """
    hashes, counts, group, size = [], [], [], 0

    def flush() -> None:
        data = np.frombuffer(b"\n".join(group).lower() + b"\n", np.uint8)
        inside = _IN_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        begin, end = edges[::2], edges[1::2]
        powers, inverse = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * powers[: len(data)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[begin]) * inverse[begin]))
        places = np.cumsum([0, *(len(g) + 1 for g in group)])
        counts.append(np.diff(np.searchsorted(begin, places)))

    for t in texts:
        group.append(t.encode() if t else b"")
        size += len(group[-1]) + 1
        if size >= 1 << 18:
            flush()
            group, size = [], 0
    if group:
        flush()
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([[0], np.cumsum(np.concatenate([none.astype(np.int64), *counts]))])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit mixer (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
