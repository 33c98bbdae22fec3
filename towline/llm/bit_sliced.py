"""Exact top-k inner products on a bit-sliced index.

Vectors are cut into blocks of rows. Each attribute of a block is kept, quantised, as bitmaps: one slice per bit, one bit
per row. For a query the slices of all attributes are added with bitmap arithmetic, which gives slices of all rows' sums.
From the most significant sum slice downward the k-th largest sum is found; what quantising can have hidden bounds how far
below it a row of the true top k can lie; those boundary rows are resolved with exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towline.llm.common import ARROW_BYTES, staged


@dataclass
class Block:
    """Rows of an index: ids, exact vectors, and slices of the quantised attributes as integers of one bit per row."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    shift: int
    slices: list[list[int]]

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, bits: int) -> Block:
        low = vectors.min(axis=0)
        widest = int((vectors.max(axis=0) - low).max(initial=0)).bit_length()
        shift = max(0, widest - bits)
        coarse = (vectors - low) >> shift
        slices = [
            [int.from_bytes(np.packbits(coarse[:, d] >> b & 1, bitorder="little").tobytes(), "little") for b in range(widest - shift)]
            for d in range(vectors.shape[1])
        ]
        return Block(ids, vectors, low, shift, slices)

    def sums(self, query: list[int]) -> list[int]:
        """Slices, least significant first, of the sum over attributes of |weight| times value.

        Attributes of negative weight are taken as the complement of their value, so that all terms are positive.
        """
        every = (1 << len(self.ids)) - 1
        columns: list[list[int]] = []  # bitmaps to add up, by significance
        for weight, slices in zip(query, self.slices):
            for bit in range(abs(weight).bit_length()):
                if abs(weight) >> bit & 1:
                    while len(columns) < bit + len(slices):
                        columns.append([])
                    for b, s in enumerate(slices):
                        columns[bit + b].append(s if weight > 0 else s ^ every)
        out, place = [], 0
        while place < len(columns):
            column = columns[place]
            if len(column) > 1 and place + 1 == len(columns):
                columns.append([])
            while len(column) > 2:  # three bitmaps become their sum and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                odd = a ^ b
                column.append(odd ^ c)
                columns[place + 1].append(a & b | odd & c)
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                columns[place + 1].append(a & b)
            out.append(column[0] if column else 0)
            place += 1
        return out

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows (all, if fewer) other than those of the query's id."""
        rows = (1 << len(self.ids)) - 1
        for own in np.flatnonzero(self.ids == query_id).tolist():
            rows &= ~(1 << own)
        weights = query.tolist()
        slices = self.sums(weights)
        hidden = ((1 << self.shift) - 1) * sum(map(abs, weights))
        kth = kth_largest(slices, rows, k)
        found = at_least(slices, rows, kth - -(-hidden >> self.shift))
        packed = np.frombuffer(found.to_bytes(-(-len(self.ids) // 8), "little"), np.uint8)
        near = np.flatnonzero(np.unpackbits(packed, count=len(self.ids), bitorder="little"))
        scores = self.vectors[near] @ query
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near[best]], scores[best]


def kth_largest(slices: list[int], rows: int, k: int) -> int:
    """The ``k``-th largest sum among ``rows``, most significant slice first; the smallest, if they are fewer."""
    sure, tied, value = 0, rows, 0
    for place in range(len(slices) - 1, -1, -1):
        ones = tied & slices[place]
        if sure + ones.bit_count() >= k:
            tied = ones
            value |= 1 << place
        else:
            sure += ones.bit_count()
            tied &= ~slices[place]
    return value if rows.bit_count() >= k else 0


def at_least(slices: list[int], rows: int, bound: int) -> int:
    """Rows whose sum is at least ``bound``."""
    if bound <= 0:
        return rows
    if bound >> len(slices):
        return 0
    above, equal = 0, rows
    for place in range(len(slices) - 1, -1, -1):
        if bound >> place & 1:
            equal &= slices[place]
        else:
            above |= equal & slices[place]
            equal &= ~slices[place]
    return above | equal


def quantised(vector: Column | str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that is null or has null, NaN or infinite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & (F.size(v) > 0) & fine, whole)


def packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold all of them."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or -(1 << 8 * s - 1) <= values.min() and values.max() < 1 << 8 * s - 1)
    return values.astype(f"<i{size}").tobytes()


def unpacked(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    rows = np.frombuffer(ids, "<i8")
    size = len(data) // (len(rows) * dims)
    return rows, np.frombuffer(data, f"<i{size}").reshape(len(rows), dims).astype(np.int64)


def blocks(vectors: DataFrame, rows: int, places: int | None = None) -> DataFrame:
    """``dims, ids, data, place``: rows ``id, v`` packed into blocks of at most ``rows`` of equal length.

    A block's place is its partition, or it is sent to each of ``places`` places.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        here = TaskContext.get().partitionId()

        def one(dims: int) -> Iterator[pd.DataFrame]:
            ids, vs = zip(*waiting.pop(dims))
            i, data = np.array(ids, "<i8").tobytes(), packed(np.asarray(vs, "<i8"))
            goals = [here] if places is None else range(places)
            step = max(1, ARROW_BYTES // (len(i) + len(data)))  # copies leave a few at a time
            for first in range(0, len(goals), step):
                some = goals[first : first + step]
                yield pd.DataFrame({"dims": dims, "ids": [i] * len(some), "data": [data] * len(some), "place": some})

        for batch in batches:
            for i, v in zip(batch["id"], batch["v"]):
                group = waiting.setdefault(len(v), [])
                group.append((i, v))
                if len(group) >= rows:
                    yield from one(len(v))
        for dims in list(waiting):
            yield from one(dims)

    return vectors.mapInPandas(pack, "dims int, ids binary, data binary, place int")


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int, row_id: str, vector: str, bits: int = 6, block_rows: int = 16384, query_rows: int = 256
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows of ``vectors`` of largest integer
    inner product, rows of the query's own id left out, ties to the smaller id.

    Exact for components up to 2^24 in magnitude after scaling. Vectors that are null, empty or hold null or non-finite
    components, and null ids, take no part; a query meets vectors of its own length only. All candidates count, in
    blocks: each block of the index meets each block of queries, and ``k`` rows per query leave the pair. Repeated rows
    are candidates of their own; of queries that share an id the one of the smallest vector is asked. An empty table gives no rows. Other columns are not looked at.
    """

    def valid(df: DataFrame) -> DataFrame:
        return df.select(F.col(row_id).cast("long").alias("id"), quantised(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    candidates = valid(vectors)
    n = max(1, -(-candidates.count() // block_rows))
    index = staged(blocks(candidates.repartition(n), block_rows))
    # A block of queries goes to every place of the index: the stated query set against all rows.
    once = valid(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = blocks(once, query_rows, places=n)
    # They follow the place's block in one stream. As a join Spark may broadcast them, by the size they had before they were
    # sent to every place, or pairs each with a copy of the block and holds all pairs of a block at once.
    both = index.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    met = both.repartitionById(n, "place").sortWithinPartitions("place", "dims", "asks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, here = None, []
        for batch in batches:
            for r in batch.itertuples():
                if (r.place, r.dims) != at:
                    at, here = (r.place, r.dims), []
                ids, values = unpacked(r.ids, r.data, r.dims)
                if not r.asks:
                    here.append(Block.of(ids, values, bits))
                    continue
                for block in here:
                    found = [block.top(q, i, k) for i, q in zip(ids.tolist(), values)]
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat(ids, [len(x[0]) for x in found]),
                            "vec_id": np.concatenate([x[0] for x in found]),
                            "score": np.concatenate([x[1] for x in found]),
                        }
                    )

    best = met.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
