"""Bootstrap within strata and the sample-size study.

Rows are ordered by stratum and key in range partitions, so a stratum of any size is dealt over tasks, and packed into
tiles: stretches of a stratum's rows, each an array in one row. Draws are made inside the task that holds the tile, so no
draw is ever shuffled; what leaves a task is one partial sum per (tile, replicate).

How many draws of a replicate fall to which part of a stratum is read from a splitting tree. Its nodes halve the unit
interval, which stands for the stratum's rows in order, down to leaves of ``LEAF`` rows at most; of the c draws of a node
as many go left as there are ones among c bits of the counter hash. Within a leaf a draw is one number of the same hash.
The tree depends on the number of rows only. A tile is a node of it, so the replicates are the same whatever the size of
tiles, and a stratum of one leaf is the tree of depth 0.

Every random number is a hash of (seed, stratum, replicate, draw), so a result depends neither on
partitioning nor on retries.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towline.functions import units
from towline.operators.joins import null_safe_join
from towline.session import cut_lineage

# The functions that run in tasks travel with them, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a leaf of the splitting tree at most; other leaves mean other draws.
LEAF = 256
# Rows of a tile at most; tiles are smaller where that fills more tasks.
TILE_ROWS = 65_536
# Draws, and rows to draw from, of one task, about.
DRAWS_PER_TASK = 100_000_000
ROWS_PER_TASK = 4_000_000
# Words of random bits, or counts of draws by tile and replicate, that one block of replicates takes to deal them to tiles.
WORDS_PER_BLOCK = 4_000_000
# Draws, and words of random bits, held in memory at once.
DRAW_BATCH = 1 << 15
# Leaves of replicates whose draws are counted together.
CELLS = 1 << 16
# Strata of several tiles whose sums a task holds at once.
HELD = 64
# Numbers of the counter hash from which on those of the tree's nodes stand.
NODES = 1 << 62

# Increment and multipliers of the SplitMix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def mix64(z: np.ndarray) -> np.ndarray:
    """SplitMix64 output function on unsigned 64-bit arrays; works in place."""
    high = np.empty_like(z)
    for shift, factor in ((30, MIX_1), (27, MIX_2), (31, None)):
        np.right_shift(z, np.uint64(shift), out=high)
        z ^= high
        if factor:
            z *= np.uint64(factor)
    return z


def stratum_hash(seed: int, keys: Sequence[str | Column]) -> Column:
    """60-bit integer of the seed and the stratum key, the same in every SQL engine with md5."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def counter_hash(base: int | np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers of the stream ``base`` at the given places."""
    z = counter.astype(np.uint64)
    z *= np.uint64(GOLDEN)
    z ^= np.asarray(base).astype(np.uint64)
    return mix64(z)


def _flat(sizes: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray, int]]:
    """Cells of these sizes laid end to end, about ``most`` places at a time: the cells met, how much of each, and the
    place at which the first of them goes on."""
    ends = np.cumsum(sizes)
    total, a = int(ends[-1]) if len(ends) else 0, 0
    while a < total:
        b = min(total, a + most)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1
        begin = ends[i:j] - sizes[i:j]
        yield slice(i, j), np.minimum(ends[i:j], b) - np.maximum(begin, a), a - int(begin[0])
        a = b


def _steps(count: int) -> np.ndarray:
    """What the counter hash adds to the number of a run's first place, for each place of a batch."""
    return np.arange(min(count, DRAW_BATCH), dtype=np.uint64) * np.uint64(GOLDEN)


def _runs(first: np.ndarray, begin: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Counters times the increment of the generator, for runs of ``sizes`` consecutive counters from ``first`` on that
    stand at ``begin`` of the batch."""
    start = (first - begin).astype(np.uint64) * np.uint64(GOLDEN)
    length = int(begin[-1] + sizes[-1])
    return steps[:length] + (start if len(start) == 1 else np.repeat(start, sizes))


def _left(base: int, m: int, replicate: np.ndarray, node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of ``count`` draws in a node of the tree how many go left, for each entry: ones among as many random bits."""
    words = -(-count // 64)
    # Entries of a node lie at an even distance, so most nodes are hashed once.
    names, which = np.unique(node, return_inverse=True)
    stream = counter_hash(base, names.astype(np.uint64) + np.uint64(NODES))[which]
    first = replicate * -(-m // 64) + 1
    left, steps = np.zeros(len(count), np.int64), _steps(int(words.sum()))
    for cells, part, ahead in _flat(words, DRAW_BATCH):
        begin, counter, upto = np.cumsum(part) - part, first[cells].copy(), part.copy()
        counter[0] += ahead
        upto[0] += ahead
        z = _runs(counter, begin, part, steps)
        z ^= np.repeat(stream[cells], part)
        mix64(z)
        ends = np.flatnonzero((upto == words[cells]) & (part > 0))
        spare = (64 * upto - count[cells])[ends].astype(np.uint64)
        z[begin[ends] + part[ends] - 1] &= np.uint64(2**64 - 1) >> spare
        met = np.flatnonzero(part)
        left[cells.start + met] += np.add.reduceat(np.bitwise_count(z), begin[met], dtype=np.int64)
    return left


def _split(base: int, m: int, replicate: np.ndarray, node: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level of the tree below ``node``: its nodes, and ``counts`` (replicates down, nodes across) in them."""
    shape = counts.shape
    left = _left(base, m, np.repeat(replicate, shape[1]), np.tile(node, shape[0]), counts.ravel()).reshape(shape)
    below = np.stack([left, counts - left], axis=2).reshape(shape[0], -1)
    return np.stack([2 * node, 2 * node + 1], axis=1).ravel(), below


def leaf_depth(n: int, leaf: int = LEAF) -> int:
    """Depth at which nodes of a stratum of ``n`` rows are leaves."""
    return max(0, math.ceil(n / leaf) - 1).bit_length()


def _tile_sums(
    values: list[np.ndarray], n: int, depth: int, tile: int, base: int, m: int, counts: np.ndarray, offsets: np.ndarray
) -> list[np.ndarray]:
    """Per replicate the sum of the drawn values, and how many were not missing, for each of ``values``.

    ``counts`` are the draws that fall to the tile, ``offsets`` those that fall to the left of it.
    """
    leaves = leaf_depth(n)
    whole, rest, first = n >> leaves, n & ((1 << leaves) - 1), (tile * n) >> depth
    start, ahead = divmod((tile << (leaves - depth)) * n, 1 << leaves)
    begin = ahead + np.arange(1 << (leaves - depth)) * n
    begin, rem = (begin >> leaves) + start - first, (begin & ((1 << leaves) - 1)).astype(np.uint64)
    # A row number and its fraction fit one word, unless the stratum is very long.
    short = (len(values[0]) + 1) << (leaves + 32) <= 1 << 64
    if short:
        at_leaf = ((begin.astype(np.uint64) << np.uint64(leaves)) + rem) << np.uint64(32)
    rem <<= np.uint64(32)
    missing = [np.isnan(v) for v in values]
    missing = [gone if gone.any() else None for gone in missing]
    clean = [v if gone is None else np.where(gone, 0.0, v) for v, gone in zip(values, missing)]
    out = [np.zeros(len(counts)) for _ in range(2 * len(values))]
    most, steps = max(1, CELLS >> (leaves - depth)), _steps(int(counts.sum()))
    for a in range(0, len(counts), most):
        b = min(len(counts), a + most)
        replicate, node, cells = np.arange(a, b), np.array([(1 << depth) + tile]), counts[a:b, None]
        for _ in range(leaves - depth):
            node, cells = _split(base, m, replicate, node, cells)
        # The draws of a replicate in the tile are consecutive numbers, whatever the leaf.
        counter, done = replicate * m + offsets[a:b] + 1, np.zeros(b - a, np.int64)
        for some, part, _ in _flat(cells.ravel(), DRAW_BATCH):
            to = np.arange(some.start, some.stop) >> (leaves - depth)
            low = int(to[0])
            drawn = np.bincount(to - low, part).astype(np.int64)
            met = np.flatnonzero(drawn)
            to, drawn = low + met, drawn[met]
            starts = np.cumsum(drawn) - drawn
            v = _runs(counter[to] + done[to], starts, drawn, steps)
            done[to] += drawn
            v ^= np.uint64(base)
            mix64(v)
            v >>= np.uint64(32)
            leaf = np.arange(some.start, some.stop) & ((1 << (leaves - depth)) - 1)
            if short:
                v *= np.uint64(n)
                if leaves:
                    v += np.repeat(at_leaf[leaf], part)
                v >>= np.uint64(leaves + 32)
                row = v.view(np.int64)
            else:
                at = v * np.uint64(rest)
                at += np.repeat(rem[leaf], part)
                at >>= np.uint64(leaves)
                v *= np.uint64(whole)
                v += at
                v >>= np.uint64(32)
                row = v.view(np.int64) + np.repeat(begin[leaf], part)
            to += a
            for k, (x, gone) in enumerate(zip(clean, missing)):
                # Rows lie within the tile, so nothing is clipped; the mode spares a copy.
                out[2 * k][to] += np.add.reduceat(x.take(row, mode="clip"), starts)
                out[2 * k + 1][to] += drawn if gone is None else np.add.reduceat(~gone[row], starts, dtype=np.int64)
    return out


def _pack(by: list[str], values: list[str]):
    """Consecutive rows of a stratum as one row of arrays, with the partition and the rows before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("__code").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
            sizes, local = np.diff(edges), np.zeros(len(edges) - 1, np.int64)
            if code[0] == last:
                local[0] = done
            last, done = code[-1], int(local[-1] + sizes[-1])
            firsts = pa.array(edges[:-1])
            columns = {k: batch.column(k).take(firsts) for k in by}
            columns |= {"__part": pa.array(np.full(len(sizes), partition, np.int32)), "__local": pa.array(local), "__size": pa.array(sizes)}
            offsets = pa.array(edges.astype(np.int32))
            columns |= {f"__v_{v}": pa.ListArray.from_arrays(offsets, batch.column(f"__v_{v}")) for v in values}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _share(by: list[str]):
    """Draws of each tile, replicate by replicate, of strata of several tiles; an entry of the input is a block of replicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.select(["__depth", "__index", "m", "__base", "__first", "__last"]).to_pylist()):
                replicate = np.arange(r["__first"], r["__last"])
                node, counts = np.array([1]), np.full((len(replicate), 1), r["m"], np.int64)
                for _ in range(r["__depth"]):
                    node, counts = _split(r["__base"], r["m"], replicate, node, counts)
                offsets = np.cumsum(counts, axis=1) - counts
                tiles = len(node)
                columns = {c: batch.column(c).take(pa.array(np.full(tiles, k))) for c in by}
                columns |= {
                    "__tile": pa.array(np.arange(tiles)),
                    "__index": pa.array(np.full(tiles, r["__index"], np.int32)),
                    "__first": pa.array(np.full(tiles, r["__first"], np.int64)),
                }
                lists = pa.array((np.arange(tiles + 1) * len(replicate)).astype(np.int32))
                for name, x in (("__counts", counts), ("__offsets", offsets)):
                    columns[name] = pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(x.T).ravel()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _kernel(keys: list[str], values: list[str], reps: int):
    stats = [f"{p}_{v}" for v in values for p in ("sum", "cnt")]

    def rows(key: dict[str, pa.Array], index: int, m: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        columns = {c: a.take(pa.array(np.zeros(reps, np.int64))) for c, a in key.items()}
        columns |= {"__index": pa.array(np.full(reps, index, np.int32)), "m": pa.array(np.full(reps, m, np.int64))}
        columns["replicate"] = pa.array(np.arange(reps))
        for name, v in zip(stats, sums):
            columns[name] = pa.array(v.astype(np.int64) if name.startswith("cnt_") else v)
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tiles of a stratum that meet in a task leave it as one sum.
        held: dict[tuple, tuple] = {}
        for batch in batches:
            arrays = [batch.column(f"__v_{v}") for v in values]
            shared = batch.column("__shares")
            plain = batch.select([*keys, "__depth", "__tile", "__designs"]).to_pylist()
            for k, r in enumerate(plain):
                x = [a[k].values.to_numpy(zero_copy_only=False) for a in arrays]
                key = {c: batch.column(c).take(pa.array([k])) for c in keys}
                shares = {}
                if r["__depth"]:
                    some = shared[k].values
                    index, first, counts, offsets = (some.field(c) for c in ("__index", "__first", "__counts", "__offsets"))
                    for i in np.argsort(first.to_numpy()):
                        shares.setdefault(index[i].as_py(), []).append((counts[i].values.to_numpy(), offsets[i].values.to_numpy()))
                for d in r["__designs"]:
                    place = (d["__index"], d["m"])
                    if not r["__depth"]:
                        counts, offsets = np.full(reps, d["m"], np.int64), np.zeros(reps, np.int64)
                        yield rows(key, *place, _tile_sums(x, r["n"], 0, r["__tile"], d["__base"], d["m"], counts, offsets))
                        continue
                    counts, offsets = (np.concatenate(c) for c in zip(*shares[d["__index"]]))
                    sums = _tile_sums(x, r["n"], r["__depth"], r["__tile"], d["__base"], d["m"], counts, offsets)
                    name = (*[r[c] for c in keys], *place)
                    if name in held:
                        for total, more in zip(held[name][-1], sums):
                            total += more
                        continue
                    if len(held) == HELD:
                        yield from (rows(*h) for h in held.values())
                        held.clear()
                    held[name] = (key, *place, sums)
        yield from (rows(*h) for h in held.values())

    return run


def pack_strata(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str]) -> DataFrame:
    """Rows of each stratum in order of ``key``, packed and written to the checkpoint folder: one pass over ``df``.

    Range partitions deal a stratum over as many tasks as its share of the rows takes. Several calls of :func:`resample`
    may draw from one packing. Returns ``(*by, __part, __local, __size, __v_<value>...)``.
    """
    by, values = list(by), list(values)
    code = F.xxhash64(F.lit(0), *by, *[F.isnull(k) for k in by])
    # Missing values travel as NaN, so the arrays reach Python as plain double arrays.
    cells = [F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(f"__v_{v}") for v in values]
    rows = df.select(*by, F.col(key).alias("__key"), code.alias("__code"), *cells)
    order = [*by, "__key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__key")
    schema = T.StructType([rows.schema[k] for k in by])
    schema.add("__part", T.IntegerType()).add("__local", T.LongType()).add("__size", T.LongType())
    for v in values:
        schema.add(f"__v_{v}", T.ArrayType(T.DoubleType()))
    return cut_lineage(rows.mapInArrow(_pack(by, values), schema))


# Draws of a design that fall to a tile, from replicate ``__first`` on.
SHARE = "struct<__index: int, __first: bigint, __counts: array<bigint>, __offsets: array<bigint>>"


def _tiles(placed: DataFrame, shares: DataFrame | None, keys: list[str], by: list[str], values: list[str], tasks: int) -> DataFrame:
    """``(*keys, __depth, __designs, __tile, __shares, __v_<value>...)``: rows and draws of each node of the tree at a
    stratum's tile depth.

    ``placed`` are pieces with ``keys``, the tile depth and the number ``__at`` of their first row in the stratum. Rows and
    ``shares`` meet in one shuffle and no join: shares are made of a short table, so a join would take them for short and
    broadcast them, though they grow with tiles and replicates.
    """
    # Tile j has the rows that meet the part of the unit interval from j / 2^depth on; a row at a border is in two tiles.
    first = "(__at << __depth) div n"
    last = "(((__at + __size) << __depth) - 1) div n"
    placed = placed.withColumn("__tile", F.explode(F.expr(f"sequence({first}, {last})")))
    low = F.expr("greatest(__at, (__tile * n) >> __depth)")
    high = F.expr("least(__at + __size, (((__tile + 1) * n - 1) >> __depth) + 1)")
    cut = [F.slice(f"__v_{v}", (low - F.col("__at") + 1).cast("int"), (high - low).cast("int")).alias(f"__v_{v}") for v in values]
    rest = [c for c in [*keys, "__depth", "__designs"] if c not in by]
    met = placed.select(*by, "__tile", *rest, F.struct(low.alias("__low"), *cut).alias("__part"))
    if shares is None:
        met = met.withColumn("__share", F.lit(None).cast(SHARE))
    else:
        met = met.unionByName(shares, allowMissingColumns=True)
    grouped = met.repartition(tasks, *by, "__tile").groupBy(*by, "__tile").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in rest],
        F.sort_array(F.collect_list("__part")).alias("__parts"),
        F.collect_list("__share").alias("__shares"),
    )
    flat = [F.flatten(F.col(f"__parts.__v_{v}")).alias(f"__v_{v}") for v in values]
    return grouped.select(*keys, "__depth", "__tile", "__designs", "__shares", *flat)


def resample(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    values: Sequence[str],
    reps: int = units.REPLICATES,
    seed: int = 1,
    draws: Mapping[object, Column] | None = None,
    design: str = "design",
    attributes: DataFrame | None = None,
    on: Sequence[str] = (),
    tile_rows: int = TILE_ROWS,
    packed: DataFrame | None = None,
) -> DataFrame:
    """Draw rows with replacement within each stratum, ``reps`` times, and sum the values drawn.

    ``key`` is unique within a stratum and fixes the row order. By default a replicate draws as
    many rows as the stratum has. ``draws`` gives other sizes instead, as ``{label: size}``; every
    label is drawn from the same tiles and named in column ``design``. Sizes are made of ``n`` (rows in
    the stratum) and of the columns of ``attributes``, a table that is unique in ``on``, some of
    the stratum's keys. ``packed`` is the result of :func:`pack_strata`, to draw from it again in place of ``df``. Tiles of
    any size give the same replicates; ``tile_rows`` bounds the memory of a task.

    Returns ``(*by, [design], n, *attributes, m, replicate, sum_<value>, cnt_<value>)`` where ``m`` is
    the number of draws and ``cnt`` the drawn values that were not missing.
    """
    if tile_rows < 1:
        raise ValueError("tile_rows is 1 or more")
    by, values = list(by), list(values)
    pieces = pack_strata(df, by, key, values) if packed is None else packed
    parallel = pieces.sparkSession.sparkContext.defaultParallelism
    n_strata, largest, total = (x or 0 for x in _sizes(pieces, by).agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first())
    tasks = max(parallel, total * reps * len(draws or "1") // DRAWS_PER_TASK, total // ROWS_PER_TASK)
    # Few strata are cut finer, so that they fill the tasks.
    tile = tile_rows if n_strata >= 4 * parallel else min(tile_rows, max(LEAF, total // (4 * parallel)))
    split = largest > max(tile, LEAF)
    deep = lambda rows: F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows))).cast("int")
    strata = _sizes(pieces, by).withColumn("__depth", F.least(deep(tile), deep(LEAF)) if split else F.lit(0))
    extra = []
    if attributes is not None:
        extra = [c for c in attributes.columns if c not in on]
        strata = null_safe_join(strata, attributes, on, "left")
    sizes = {None: F.col("n")} if draws is None else dict(draws)
    designs = [
        F.struct(
            F.lit(i).alias("__index"),
            size.cast("bigint").alias("m"),
            stratum_hash(seed, by if draws is None else [*by, F.lit(label)]).alias("__base"),
        )
        for i, (label, size) in enumerate(sizes.items())
    ]
    strata = strata.withColumn("__designs", F.filter(F.array(*designs), lambda d: d["m"] > 0)).where(F.size("__designs") > 0)

    keys = [*by, "n", *extra]
    # Rows of the stratum in partitions before that of a piece, and before it there.
    earlier = F.filter("__runs", lambda r: r["__part"] < F.col("__part"))
    placed = null_safe_join(pieces, strata, by)
    placed = placed.withColumn("__at", F.aggregate(earlier, F.col("__local"), lambda at, r: at + r["__rows"]))
    shares = _shares(strata.where("__depth > 0"), by, reps, max(parallel, tasks // 8)) if split else None
    tiles = _tiles(placed, shares, keys, by, values, tasks)
    schema = T.StructType([tiles.schema[k] for k in keys])
    schema.add("__index", T.IntegerType()).add("m", T.LongType()).add("replicate", T.LongType())
    for v in values:
        schema.add(f"sum_{v}", T.DoubleType()).add(f"cnt_{v}", T.LongType())
    out = tiles.mapInArrow(_kernel(keys, values, reps), schema)
    if split:
        sums = [F.sum(f"{p}_{v}").alias(f"{p}_{v}") for v in values for p in ("sum", "cnt")]
        out = out.groupBy(*keys, "__index", "m", "replicate").agg(*sums)
    label = [] if draws is None else [F.element_at(F.array(*[F.lit(k) for k in sizes]), F.col("__index") + 1).alias(design)]
    return out.select(*by, *label, "n", *extra, "m", "replicate", *[f"{p}_{v}" for v in values for p in ("sum", "cnt")])


def _sizes(pieces: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, n, __runs)``: rows of each stratum, and how many of them each partition of the packing has."""
    runs = pieces.groupBy(*by, "__part").agg(F.sum("__size").alias("__rows"))
    return runs.groupBy(*by).agg(F.sum("__rows").alias("n"), F.collect_list(F.struct("__part", "__rows")).alias("__runs"))


def _shares(strata: DataFrame, by: list[str], reps: int, tasks: int) -> DataFrame:
    """``(*by, __tile, __share)``: draws that fall to each tile and to the left of it, by design and block of replicates."""
    one = strata.select(*by, "__depth", F.inline("__designs"))
    # A replicate costs its draws / 32 words, and as many counts as there are tiles.
    cost = F.greatest(F.col("m") / 32, F.pow(F.lit(2.0), F.col("__depth")))
    per = F.greatest(F.lit(1), F.least(F.lit(reps), F.floor(F.lit(WORDS_PER_BLOCK) / cost))).cast("bigint")
    one = one.withColumn("__per", per).withColumn("__first", F.explode(F.expr(f"sequence(0L, {reps - 1}L, __per)")))
    one = one.withColumn("__last", F.least(F.col("__first") + F.col("__per"), F.lit(reps).cast("bigint")))
    schema = T.StructType([one.schema[k] for k in by])
    schema.add("__tile", T.LongType()).add("__index", T.IntegerType()).add("__first", T.LongType())
    schema.add("__counts", T.ArrayType(T.LongType())).add("__offsets", T.ArrayType(T.LongType()))
    one = one.select(*by, "__depth", "__index", "m", "__base", "__first", "__last").repartition(tasks, *by, "__index", "__first")
    dealt = one.mapInArrow(_share(by), schema)
    return dealt.select(*by, "__tile", F.struct("__index", "__first", "__counts", "__offsets").alias("__share"))


def drawn_mean(value: str, na_rm: bool = False) -> Column:
    """Mean of the values drawn in a replicate; a missing one makes it null unless ``na_rm``."""
    total, count = F.col(f"sum_{value}"), F.col(f"cnt_{value}")
    if na_rm:
        return F.try_divide(total, count)
    return F.when(count == F.col("m"), F.try_divide(total, F.col("m")))


def bootstrap(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    measures: Sequence[str],
    areas: DataFrame,
    on: Sequence[str] = ("bed",),
    reps: int = units.REPLICATES,
    seed: int = 1,
    method: str = "exact",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Bootstrap of mean density and total per stratum, measure and replicate, long form.

    ``areas`` has the columns ``on`` and ``area``; it joins the replicates, not the rows.
    All measures of a stratum share its draws. ``exact`` draws as many rows as the stratum has;
    ``poisson`` gives each row a Poisson(1) weight and needs no shuffle of rows, for strata of
    hundreds of rows or more.
    """
    if method == "exact":
        sums = resample(df, strata, key, measures, reps, seed, tile_rows=tile_rows)
        means = {v: F.try_divide(F.col(f"sum_{v}"), F.col("n")) for v in measures}
    elif method == "poisson":
        sums = poisson_sums(df, strata, key, measures, reps, seed)
        means = {v: F.try_divide(F.col(f"sum_{v}"), F.col("weight")) for v in measures}
    else:
        raise ValueError("method is 'exact' or 'poisson'")
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), c.alias("dbar")) for v, c in means.items()])
    placed = null_safe_join(sums, areas.select(*on, "area"), on, "left")
    long = placed.select(*strata, F.col("area").cast("double").alias("area"), "replicate", F.inline(cells))
    return long.select(
        *strata, "variable", "replicate", "dbar", (F.col("area") * F.col("dbar")).alias("total")
    )


def bootstrap_ratio(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    ratio: str,
    reps: int = units.REPLICATES,
    seed: int = 1,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Bootstrap of the mean of an individual ratio per stratum and replicate."""
    sums = resample(df, strata, key, [ratio], reps, seed, tile_rows=tile_rows)
    return sums.select(*strata, "replicate", drawn_mean(ratio).alias("ratio"))


def bootstrap_summary(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, str], probs: Sequence[float] = units.INTERVAL_PROBS
) -> DataFrame:
    """Mean, percentile interval, variance and CV over replicates: ``{suffix: statistic}``.

    A group holds one value per replicate, so the exact percentile needs bounded memory.
    """
    aggs = []
    for suffix, stat in stats.items():
        c = F.col(stat)
        q = F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))
        aggs += [
            F.avg(c).alias(f"mean_{suffix}"),
            q[0].alias(f"ll_{suffix}"),
            q[len(probs) - 1].alias(f"ul_{suffix}"),
            F.var_samp(c).alias(f"var_{suffix}"),
            (F.try_divide(F.stddev_samp(c), F.avg(c)) * 100).alias(f"cv_{suffix}"),
        ]
    return df.groupBy(*by).agg(*aggs)


# Cumulative Poisson(1) probabilities scaled to 32 bits, for weights 0 to 11.
POISSON_CUTS = [
    int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)
]


def poisson_weights(keys: np.ndarray, seed: int, first: int, last: int) -> np.ndarray:
    """Weights of rows (down) and replicates ``first`` to ``last - 1`` (across)."""
    rows = mix64(keys.astype(np.uint64) + np.uint64(seed * GOLDEN % 2**64))
    reps = np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    u = mix64(rows[:, None] + reps[None, :]) >> np.uint64(32)
    return np.searchsorted(np.array(POISSON_CUTS, dtype=np.uint64), u, side="right").astype(np.int64)


def poisson_sums(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    values: Sequence[str],
    reps: int,
    seed: int = 1,
    max_groups: int = 500,
) -> DataFrame:
    """Poisson-weighted sums per (stratum, replicate), one pass without a shuffle of rows.

    ``key`` differs between the rows of a stratum; one that is no integer is hashed. Weights end at 12, which is beyond
    what a 32-bit uniform number can ask for. Each task adds up its rows
    per stratum and only partial sums leave it. Rows with a null value add their weight only.
    """
    by, values = list(by), list(values)
    whole = isinstance(df.select(key).schema[0].dataType, T.IntegralType)
    number = F.col(key).cast("bigint") if whole else F.xxhash64(key)
    rows = df.select(*by, number.alias("__key"), *[F.col(v).cast("double") for v in values])
    schema = T.StructType([rows.schema[b] for b in by])
    schema.add("replicate", T.LongType()).add("weight", T.LongType())
    for v in values:
        schema.add(f"sum_{v}", T.DoubleType())
    block = 100

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for group, sums in state.items():
                data = {b: [g] * reps for b, g in zip(by, group)}
                data["replicate"] = np.arange(reps)
                data["weight"] = sums[0].astype(np.int64)
                data.update({f"sum_{v}": sums[i + 1] for i, v in enumerate(values)})
                yield pd.DataFrame(data)
            state.clear()

        for pdf in batches:
            for group, part in pdf.groupby(by, dropna=False, sort=False):
                if group not in state:
                    if len(state) >= max_groups:
                        yield from flush()
                    state[group] = np.zeros((len(values) + 1, reps))
                sums = state[group]
                x = np.nan_to_num(part[values].to_numpy(dtype=float))
                ids = part["__key"].to_numpy()
                for first in range(0, reps, block):
                    last = min(first + block, reps)
                    w = poisson_weights(ids, seed, first, last)
                    sums[0, first:last] += w.sum(axis=0)
                    sums[1:, first:last] += x.T @ w
        yield from flush()

    partial = rows.mapInPandas(run, schema)
    return partial.groupBy(*by, "replicate").agg(
        F.sum("weight").alias("weight"), *[F.sum(f"sum_{v}").alias(f"sum_{v}") for v in values]
    )


def design_sizes(
    fractions: Sequence[float] = units.DESIGN_FRACTIONS, floored: Sequence[float] = (0.35,), area: str = "area"
) -> dict[float, Column]:
    """Sample sizes by fraction of the stratum area: rounded, or floored on the rounded area."""
    whole = F.bround(F.col(area))
    return {f: F.floor(whole * f) if f in floored else F.bround(F.col(area) * f) for f in fractions}


def design_study(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    density: str,
    areas: DataFrame,
    on: Sequence[str],
    fractions: Sequence[float] = units.DESIGN_FRACTIONS,
    floored: Sequence[float] = (0.35,),
    reps: int = units.REPLICATES,
    seed: int = 1,
    na_rm: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Mean, sd and variance of the replicate totals for each stratum and sampled fraction.

    ``areas`` has the columns ``on`` and ``area``, which also sets the sample sizes. All fractions
    are drawn in one job from one packing of the rows. A replicate that drew a
    missing value is null; ``na_rm`` drops such replicates, and with them a stratum and fraction that has no other;
    otherwise they make the summary null.
    """
    sums = resample(
        df,
        strata,
        key,
        [density],
        reps,
        seed,
        draws=design_sizes(fractions, floored),
        design="fraction",
        attributes=areas.select(*on, F.col("area").cast("double").alias("area")),
        on=on,
        tile_rows=tile_rows,
    )
    p = sums.withColumn("P", drawn_mean(density) * F.col("area"))
    if na_rm:
        p = p.where("P IS NOT NULL")
    complete = F.lit(True) if na_rm else F.count("P") == F.count(F.lit(1))
    return p.groupBy(*strata, "fraction").agg(
        F.max("m").alias("m"),
        F.when(complete, F.avg("P")).alias("p_mean"),
        F.when(complete, F.stddev_samp("P")).alias("p_sd"),
        F.when(complete, F.var_samp("P")).alias("p_var"),
    )


def compare_designs(
    study: DataFrame, strata: Sequence[str], over: Sequence[str], reference: float = 0.5
) -> DataFrame:
    """Percent difference of mean and sd from the reference design, averaged over ``over``, long form."""
    keys = list(strata)
    is_ref = F.col("fraction") == reference
    # A stratum has one row per fraction, so its designs travel together and the study is read once.
    designs = study.groupBy(*keys).agg(
        F.max(F.when(is_ref, F.col("p_mean"))).alias("__mean"),
        F.max(F.when(is_ref, F.col("p_sd"))).alias("__sd"),
        F.max(is_ref).alias("__has"),
        F.collect_list(F.struct("fraction", "p_mean", "p_sd")).alias("__designs"),
    )
    joined = designs.filter("__has").select(*keys, "__mean", "__sd", F.inline("__designs")).filter(F.col("fraction") != reference)

    def diff(x: str, r: str) -> Column:
        return F.try_divide(F.abs(F.col(r) - F.col(x)), F.abs(F.col(r))) * 100

    averaged = joined.groupBy(*[k for k in keys if k not in over], "fraction").agg(
        F.avg(diff("p_mean", "__mean")).alias("mean"), F.avg(diff("p_sd", "__sd")).alias("sd")
    )
    ids = [k for k in keys if k not in over] + ["fraction"]
    return averaged.unpivot(ids, ["mean", "sd"], "type", "value")
