"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification of word shingles.

Two permutations of one universe make all coordinates of a signature: the first scatters the shingles, the second,
shifted circularly by k places, ranks them for coordinate k. Documents that agree on a band of coordinates meet in a
bucket. Buckets are not expanded into pairs: copies of one set count once, members are compared with leaders first, and
afterwards the members of a bucket that are not yet connected block against block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.llm.common import bounded_parts, hashed_words, mix, staged
from towline.llm.components import components

WIDTH = 5


class CirculantMinHash:
    """Signatures of ``bands * rows`` coordinates over a universe of ``2**bits`` places."""

    def __init__(self, bands: int, rows: int, bits: int = 20, seed: int = 1) -> None:
        self.bands, self.rows, self.size = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.shift = np.uint64(64 - bits)
        self.scatter = rng.permutation(1 << bits).astype(np.uint32)
        rank = rng.permutation(1 << bits).astype(np.uint32)
        # Row x of the windows is the second permutation under all shifts, as seen from place x.
        self.ranks = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: self.size]]), self.size)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[shingles >> self.shift]
        return np.min([self.ranks[places[k : k + 2048]].min(axis=0) for k in range(0, len(places), 2048)], axis=0)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, different for equal coordinates in different bands."""
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64)
        keys = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            keys = mix(keys ^ parts[:, r], r)
        return keys.view(np.int64)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    words, starts = hashed_words(texts)
    for a, b in zip(starts[:-1], starts[1:]):
        yield shingles_of(words[a:b])


def shingles_of(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Shingle set of hashed words; the whole sequence as one shingle if it is shorter."""
    if len(h) > width:
        n = len(h) - width + 1
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s = mix(s ^ h[k : k + n], k)
    elif len(h):
        s = np.zeros(1, np.uint64)
        for k in range(len(h)):
            s = mix(s ^ h[k : k + 1], k)
    else:
        return h
    return np.unique(s)


def sketches(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, keys, signature`` of every row; the last four null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = CirculantMinHash(bands, rows)
        for batch in batches:
            out = []
            for s in shingle_sets(batch["text"]):
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                signature = minhash.signature(s)
                h1, h2 = (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)
                out.append((len(s), h1, h2, minhash.band_keys(signature), signature.astype("<u2").tobytes()))
            frame = pd.DataFrame(out, columns=["n_shingles", "h1", "h2", "keys", "signature"], dtype=object)
            frame.insert(0, "doc_id", batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).to_numpy())
            yield frame

    rows_ = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows_.mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, signature binary")


def _sizes_fit(x: str, y: str, percent: int) -> str:
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes allow a link and whose signatures agree on at least two thirds of what a link has on average.

    With 128 coordinates a linked pair falls below that with a chance of about one in ten million.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                3 * 100 * int((x == y).sum()) >= 2 * percent * len(x)
                for x, y in ((np.frombuffer(p, "<u2"), np.frombuffer(q, "<u2")) for p, q in zip(batch["s_a"], batch["s_b"]))
            ]
            yield batch.loc[keep, ["a", "b"]]

    one = nodes.select("node", "n_shingles", "signature")
    both = pairs.join(one.toDF("a", "n_a", "s_a"), "a").where("n_a > 0").join(one.toDF("b", "n_b", "s_b"), "b")
    return both.where(_sizes_fit("n_a", "n_b", percent)).mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` with ``100 * intersection >= percent * union`` of their full shingle sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(shingle_sets(batch["t_a"]), shingle_sets(batch["t_b"])):
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(theirs) - common))
            yield batch.loc[keep, ["a", "b"]]

    met = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")
    return met.mapInPandas(run, "a long, b long").distinct()


def texts_of(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, text`` of the wanted ids: by broadcast if one part holds them, by shuffle otherwise."""
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    parts = bounded_parts(wanted, "node")
    return rows.join(F.broadcast(wanted) if len(parts) == 1 else wanted, "node", "left_semi")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, bands: int = 32, rows: int = 4
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Linked are documents whose sets of 5-word shingles have ``100 * intersection >= percent * union``; ``component_id``
    is the smallest id reachable over links. With the default bands a link of exactly 0.75 is met with a chance of
    1 - 5e-6, higher ones more surely; every link reported is verified on full sets. A null or empty text has an empty
    set and links with nothing, and so does a row with a null id (component null, kept). Fewer than five words are one
    shingle. Rows that share an id are one document. Other columns are not looked at.
    """
    sketch = staged(sketches(docs, doc_id, text, bands, rows))
    full = sketch.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
    # Copies: the smallest id stands for all documents with the same set.
    sets = staged(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    nodes = full.join(sets, ["h1", "h2"]).where("doc_id = node").select("node", "n_shingles", "keys", "signature").dropDuplicates(["node"])
    nodes = staged(nodes)
    entries = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    leaders = entries.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    buckets = staged(entries.join(leaders.select("key", "leader"), "key"))
    links = label = None
    for candidates in (_first_leaders, _leaders):
        good = staged(promising(candidates(buckets, label), nodes, percent))
        wanted = staged(good.select(F.col("a").alias("node")).union(good.select("b")).distinct())
        new = verified(good, staged(texts_of(docs, doc_id, text, wanted)), percent)
        links = staged(new if links is None else new.unionByName(links))
        label = components(links)
    entries = staged(_unconnected(buckets, label))
    rest = staged(texts_of(docs, doc_id, text, staged(entries.select("node").distinct())))
    label = components(links.unionByName(links_between(entries, rest, percent)))
    answer = sketch.select("doc_id", "n_shingles", "h1", "h2").join(sets, ["h1", "h2"], "left")
    answer = answer.join(label, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    answer = answer.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return answer.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _first_leaders(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """Each document with the smallest leader of its buckets."""
    return buckets.where("node <> leader").groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b"))


def _apart(label: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    if label is None:
        return pairs
    for x in ("a", "b"):
        pairs = pairs.join(label.toDF(x, f"of_{x}"), x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    return pairs.where("of_a <> of_b").select("a", "b")


def _leaders(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """Each document with all leaders of its buckets."""
    return _apart(label, buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())


def alone_counts(texts: DataFrame) -> DataFrame:
    """``node, alone``: how many shingles of each text no other of the texts has."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"]))
            nodes = np.repeat(batch["node"].to_numpy(), [len(x) for x in sets])
            yield pd.DataFrame({"node": nodes, "shingle": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)})

    owners = texts.mapInPandas(cut, "node long, shingle long").groupBy("shingle")
    single = owners.agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return single.groupBy("node").agg(F.count("*").alias("alone"))


def _unconnected(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """Entries ``key, node, n_shingles, of`` of buckets whose members are not all connected; ``of`` is the component."""
    one = buckets.select("key", "node", "n_shingles")
    one = one.withColumn("of", F.col("node")) if label is None else one.join(label.toDF("node", "of"), "node", "left").withColumn("of", F.coalesce("of", "node"))
    several = one.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x < y").select("key")
    return one.join(several, "key")


def links_between(entries: DataFrame, texts: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links ``a, b`` between members of a bucket that lie in different components, all of them.

    What A has alone, B has not, and the other way round: a link needs ``alone_a + alone_b`` at most ``(100 - percent)``
    in ``100 + percent`` of both sizes together. Members that no other of their bucket can make up for are left out. The
    rest of a bucket is dealt into blocks of about ``block`` members; a task compares the sets of two blocks at once and
    gives the links only, so a bucket is never expanded into pairs nor held in one task.
    """
    spare = F.lit(100 - percent) * F.col("n_shingles") - F.lit(100 + percent) * F.coalesce("alone", F.lit(0))
    rated = staged(entries.join(alone_counts(texts), "node", "left").withColumn("spare", spare))
    best = rated.groupBy("key").agg(F.max("spare").alias("best"))
    able = staged(rated.join(best, "key").where("spare + best >= 0").select("key", "node", "of"))
    sizes = able.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = able.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "items": [s.tobytes() for s in shingle_sets(batch["text"])]})

    sets = texts.mapInPandas(hashed, "node long, items binary")
    packed = placed.join(sets, "node").groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("node", "of", "items")).alias("members"))
    packed = staged(packed)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = packed.select("key", F.col("block").alias("i"), F.explode(F.filter(every, lambda j: j >= F.col("block"))).alias("j"), F.col("members").alias("x"))
    right = packed.select("key", F.explode(F.filter(every, lambda i: i <= F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("members").alias("y"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"]):
                yield pd.DataFrame(_linked(x, y, percent), columns=["a", "b"])

    return left.join(right, ["key", "i", "j"]).mapInPandas(compare, "a long, b long").distinct()


def _linked(x: list, y: list, percent: int) -> np.ndarray:
    """Linked pairs, larger id first, of members of two blocks that lie in different components."""
    sets = [[np.frombuffer(m["items"], np.uint64) for m in side] for side in (x, y)]
    sizes = [np.array([len(s) for s in side]) for side in sets]
    # Only shingles on both sides count; they become columns of two 0/1 matrices whose product has the common numbers.
    flat = [np.concatenate(side) for side in sets]
    shared = np.intersect1d(*(np.unique(f) for f in flat), assume_unique=True)
    if not len(shared):
        return np.zeros((0, 2), np.int64)
    matrices = []
    for f, n in zip(flat, sizes):
        at = np.minimum(np.searchsorted(shared, f), len(shared) - 1)
        hit, row = shared[at] == f, np.repeat(np.arange(len(n)), n)
        m = np.zeros((len(n), len(shared)), np.float32)
        m[row[hit], at[hit]] = 1
        matrices.append(m)
    common = np.rint(matrices[0] @ matrices[1].T).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    nodes, of = ([np.array([m[c] for m in side], np.int64) for side in (x, y)] for c in ("node", "of"))
    i, j = np.nonzero((100 * common >= percent * union) & (of[0][:, None] != of[1][None, :]))
    pairs = np.stack([nodes[0][i], nodes[1][j]], axis=1)
    return np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1)
