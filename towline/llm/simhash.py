"""Near-duplicate documents by SimHash fingerprints, met in shards and searched in BK-trees.

Fingerprints within r bits of each other agree in all but r of some blocks of their bits, so each is put into one shard
for every choice of the blocks that agree. A shard's fingerprints are a BK-tree: the children of a node are keyed by
their Hamming distance to it, and a search within the radius follows only edges whose key is the query's distance give or
take the radius. The trees of a task are built and searched together, level by level. A shard of many fingerprints is
dealt into several trees, which are broadcast to where the others' fingerprints are while their size allows that.

Only components are wanted, so a search does not enter subtrees whose nodes are all connected with the query already, and
a shard gives no more links than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.llm.common import BROADCAST_ROWS, staged
from towline.llm.components import components

# Fixed value: the seed of the hash.
SEED = 42
# Fingerprints of a tree at most, about.
TREE = 4096
# Trees that are broadcast at once at most: 64 bytes a fingerprint as rows of the broadcast, 64 MB in all.
BROADCAST_TREES = 256
# Fingerprints of an average shard from which on more blocks are compared.
SHARD = 256
# Pairs of query and node looked at together.
FRONTIER = 1 << 21
_KEY = 65  # more than any distance


def _hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of the word shingles, repeats included; the whole sequence is one shingle if it is shorter."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    """SimHash of each text: a bit is set if it is in over half of the shingles' hashes."""
    hashed = [np.array(_hashes(t, width), np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashed], np.int64)
    flat, of = np.concatenate([np.zeros(0, np.uint64), *hashed]), np.repeat(np.arange(len(texts)), sizes)
    counts = np.zeros((len(texts), 64), np.int64)
    for k in range(0, len(flat), 1 << 16):
        part, rows = flat[k : k + (1 << 16)], of[k : k + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        counts[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of each text as a long; zero without words or text."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints_of(texts.tolist(), width).view(np.int64))

    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))


class Forest:
    """BK-trees of groups of fingerprints, nodes numbered level by level so that children of a node are neighbours.

    ``label`` tells which nodes are known to be connected: at first along edges within the radius.
    """

    def __init__(self, prints: np.ndarray, groups: np.ndarray, radius: int) -> None:
        self.radius = radius
        order = np.argsort(groups, kind="stable")
        nodes, parents, edges = [], [], []
        element, (_, tree) = order, np.unique(groups[order], return_inverse=True)
        made, edge, parent = 0, None, None
        while len(element):
            first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            nodes.append(element[first])
            parents.append(np.full(len(first), -1) if parent is None else parent)
            edges.append(np.zeros(len(first), np.int64) if edge is None else edge)
            rest = np.ones(len(element), bool)
            rest[first] = False
            root, element, above = element[first][tree], element[rest], made + tree[rest]
            distance = np.bitwise_count(prints[element] ^ prints[root[rest]]).astype(np.int64)
            made += len(first)
            key = above * _KEY + distance
            order = np.argsort(key, kind="stable")
            element, (keys, tree) = element[order], np.unique(key[order], return_inverse=True)
            parent, edge = keys // _KEY, keys % _KEY
        none = np.zeros(0, np.int64)
        self.element, self.parent, self.edge = (np.concatenate([none, *x]) for x in (nodes, parents, edges))
        self.prints = prints[self.element]
        # Keys of the nodes in their parents, which are in order; roots come before all of them.
        self.key = np.where(self.parent < 0, -1, self.parent * _KEY + self.edge)
        self.node = np.empty(len(prints), np.int64)
        self.node[self.element] = np.arange(len(prints))
        self.levels = np.cumsum([0, *(len(x) for x in nodes)])
        self.root = np.arange(len(prints))
        for a, b in zip(self.levels[1:-1], self.levels[2:]):
            self.root[a:b] = self.root[self.parent[a:b]]
        self.label = np.arange(len(prints))
        near = (self.parent >= 0) & (self.edge <= radius)
        for a, b in zip(self.levels[1:-1], self.levels[2:]):
            here = np.arange(a, b)[near[a:b]]
            self.label[here] = self.label[self.parent[here]]

    def _uniform(self) -> np.ndarray:
        """The one label of all nodes of each subtree, or -1."""
        low, high = self.label.copy(), self.label.copy()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:0:-1]):
            np.minimum.at(low, self.parent[a:b], low[a:b])
            np.maximum.at(high, self.parent[a:b], high[a:b])
        return np.where(low == high, low, -1)

    def connect(self, queries: np.ndarray, roots: np.ndarray, labels: np.ndarray) -> None:
        """Search every query from its root on and connect it with the nodes within the radius.

        ``labels`` are of one numbering with the trees' own; both are brought up to date. A label is the number of some
        node, or beyond the nodes' numbers.
        """
        sizes = np.bincount(self.root, minlength=len(self.root))
        cost = np.cumsum(sizes[roots])
        at, budget = 0, FRONTIER >> 6  # first a few, whose links let the others pass by
        while at < len(queries):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + budget, "right")))
            budget = min(FRONTIER, 4 * budget)
            found = self._search(queries[at:stop], roots[at:stop], labels[at:stop], self._uniform())
            if len(found):
                self._merge(found, labels)
            at = stop

    def _search(self, queries: np.ndarray, roots: np.ndarray, labels: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """Pairs of different labels, of queries and of nodes within the radius of them."""
        q, x, found = np.arange(len(queries)), roots, []
        while len(q):
            on = uniform[x] != labels[q]
            q, x = q[on], x[on]
            d = np.bitwise_count(queries[q] ^ self.prints[x]).astype(np.int64)
            hit = (d <= self.radius) & (labels[q] != self.label[x])
            if hit.any():
                found.append(np.unique(np.stack([labels[q[hit]], self.label[x[hit]]], axis=1), axis=0))
            a = np.searchsorted(self.key, x * _KEY + np.maximum(d - self.radius, 0), "left")
            b = np.searchsorted(self.key, x * _KEY + np.minimum(d + self.radius, _KEY - 1), "right")
            n = b - a
            q = np.repeat(q, n)
            x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def _merge(self, pairs: np.ndarray, labels: np.ndarray) -> None:
        up: dict[int, int] = {}

        def top(k: int) -> int:
            while up.get(k, k) != k:
                up[k] = up.get(up[k], up[k])
                k = up[k]
            return k

        for a, b in pairs.tolist():
            x, y = sorted((top(a), top(b)))
            up[y] = x
        old = np.array(sorted(up), np.int64)
        new = np.array([top(k) for k in old.tolist()], np.int64)
        for v in (self.label, labels):
            place = np.minimum(np.searchsorted(old, v), len(old) - 1)
            v[:] = np.where(old[place] == v, new[place], v)

    def connect_all(self) -> np.ndarray:
        """Connect the fingerprints of each tree; for each fingerprint that of its component's first node."""
        big = np.bincount(self.root, minlength=len(self.root))[self.root] > 1
        mine = np.flatnonzero(big)
        labels = self.label[mine].copy()
        self.connect(self.prints[mine], self.root[mine], labels)
        return self.prints[self.label[self.node]]


def masks(blocks: int, radius: int) -> list[int]:
    """Bits that agree in some choice of the blocks, as signed 64-bit masks: one for each choice of ``radius`` that may not."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def blocks_for(n: int, radius: int) -> int:
    """Blocks of the bits for ``n`` fingerprints: from ``radius + 1`` on, until an average shard is short. Any number gives
    the same links; more blocks are more and smaller shards."""
    blocks = radius + 1
    while blocks < radius + 4 and n > SHARD << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def _tree_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links ``a, b`` of the shards in batches ``mask, shard, print`` that are sorted by shard."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        prints = frame["print"].to_numpy().view(np.uint64)
        changes = (frame["mask"].diff() != 0) | (frame["shard"].diff() != 0)
        first = Forest(prints, changes.to_numpy().cumsum(), radius).connect_all()
        return pd.DataFrame({"a": prints.view(np.int64), "b": first.view(np.int64)})[prints != first]

    held = None
    for batch in batches:
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (frame["mask"] == frame["mask"].iloc[-1]) & (frame["shard"] == frame["shard"].iloc[-1])
        held = frame[last]  # the next batch may go on with it
        if not last.all():
            yield search(frame[~last].reset_index(drop=True))
    if held is not None and len(held):
        yield search(held.reset_index(drop=True))


def _grown(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """``prints`` of each row with ``firsts``, for each the first of its component."""
    for batch in batches:
        firsts = [Forest(p.view(np.uint64), np.zeros(len(p), np.int64), radius).connect_all().view(np.int64) for p in batch["prints"]]
        yield batch.assign(firsts=firsts)


def _across(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links ``a, b`` between the firsts of two trees that hold fingerprints within the radius of each other."""
    for batch in batches:
        out = [np.zeros((0, 2), np.int64)]
        for mine, my_firsts, theirs, their_firsts in zip(*(batch[c] for c in ("x_prints", "x_firsts", "y_prints", "y_firsts"))):
            tree = Forest(theirs.view(np.uint64), np.zeros(len(theirs), np.int64), radius)
            n = len(theirs)
            # One numbering of both sides' components: by the node of the first in the tree, and behind the nodes.
            place = {f: k for k, f in enumerate(theirs.tolist())}
            names, label = np.unique(my_firsts, return_inverse=True)
            tree.label = tree.node[np.array([place[f] for f in their_firsts.tolist()], np.int64)][tree.element]
            known = tree.label.copy()
            labels = n + label
            before = labels.copy()
            tree.connect(mine.view(np.uint64), np.zeros(len(mine), np.int64), labels)
            old, new = np.concatenate([before, known]), np.concatenate([labels, tree.label])
            pairs = np.unique(np.stack([old, new], axis=1)[old != new], axis=0)
            name = np.concatenate([tree.prints.view(np.int64), names])
            out.append(name[pairs])
        yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def links_between(prints: DataFrame, radius: int = 3, tree: int = TREE, trees_at_once: int = BROADCAST_TREES) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``print`` as all pairs within ``radius`` bits do."""
    entry = [F.struct(F.lit(k).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("shard")) for k, m in enumerate(masks(blocks_for(prints.count(), radius), radius))]
    entries = prints.select("print", F.explode(F.array(*entry)).alias("e")).select("e.mask", "e.shard", "print")
    counted = entries.groupBy("mask", "shard").agg(F.count("*").alias("n")).where("n > 1")
    sizes = staged(counted.select("mask", "shard", F.ceil(F.col("n") / tree).cast("int").alias("trees")))
    large = sizes.where("trees > 1")
    n_large = large.count()
    met = entries.join(sizes.where("trees = 1"), ["mask", "shard"])
    one_task = met.select("mask", "shard", "print").repartition("mask", "shard").sortWithinPartitions("mask", "shard")
    links = one_task.mapInPandas(lambda b: _tree_links(b, radius), "a long, b long")
    if not n_large:
        return links.distinct()
    dealt = entries.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, ["mask", "shard"])
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("print"), F.col("trees")).cast("int"))
    packed = dealt.groupBy("mask", "shard", "trees", "tree").agg(F.collect_list("print").alias("prints"))
    grown = packed.mapInPandas(
        lambda b: _grown(b, radius), "mask int, shard long, trees int, tree int, prints array<long>, firsts array<long>"
    )
    grown = staged(grown)
    inside = grown.select(F.explode(F.arrays_zip("prints", "firsts")).alias("l")).select(F.col("l.prints").alias("a"), F.col("l.firsts").alias("b"))
    few = grown.count() <= trees_at_once
    later = F.filter(F.sequence(F.lit(0), F.col("trees") - 1), lambda j: j > F.col("tree"))
    pairs = grown.select("mask", "shard", F.col("tree").alias("i"), F.explode(later).alias("j")).repartition("mask", "shard", "i", "j")
    for side, at in (("x", "i"), ("y", "j")):
        trees = grown.select("mask", "shard", F.col("tree").alias(at), F.col("prints").alias(f"{side}_prints"), F.col("firsts").alias(f"{side}_firsts"))
        pairs = pairs.join(F.broadcast(trees) if few else trees, ["mask", "shard", at])
    across = pairs.select("x_prints", "x_firsts", "y_prints", "y_firsts").mapInPandas(lambda b: _across(b, radius), "a long, b long")
    return links.unionByName(inside.where("a <> b")).unionByName(across).distinct()


def as_hex(fingerprint: Column) -> Column:
    """16 lowercase hexadecimal digits of an unsigned 64-bit fingerprint."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3, tree: int = TREE
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    A fingerprint is the SimHash of the XXH64 of all shingles of ``width`` words, repeats included (of the whole sequence,
    if it is shorter; zero without words, so null and empty texts are alike). Fingerprints that differ in ``radius`` bits
    or fewer are linked; ``component_id`` is the smallest id reachable over links. Equal texts have equal fingerprints and
    so one component, however many there are. A row with a null id has a fingerprint, links like any other and has a null
    component. Rows that share an id are one document: their fingerprints are linked. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(fingerprints(rows, "text", "fingerprint", width).drop("text"))
    known = staged(rows.groupBy(F.col("fingerprint").alias("print")).agg(F.min("doc_id").alias("least")))
    shared = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("last")).where("b < last")
    same_id = rows.join(shared, "doc_id").select(F.col("fingerprint").alias("a"), "b").where("a <> b")
    label = components(links_between(known.select("print"), radius, tree).unionByName(same_id))
    named = known.join(label.withColumnRenamed("node", "print"), "print", "left")
    named = named.select("print", "least", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select(F.col("print").alias("fingerprint"), "component_id")
    answer = rows.join(of, "fingerprint")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return answer.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), component.alias("component_id"))
