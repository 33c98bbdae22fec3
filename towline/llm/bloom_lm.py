"""Language-model scores from a log-frequency Bloom filter.

The model is an interpolated bigram model. The filter holds counts on a logarithmic scale: an n-gram of level L is entered
as L members (n-gram, 1) .. (n-gram, L), and its level is read back by asking for ever higher members until one is missing.
Three families are in it: counts of words, counts of bigrams, and for each history the share of its mass that kept bigrams
take, which is what the rest of the words must be discounted by. The filter has the same bits an entry at every size. Its
shards hold a bounded number of entries, those of words and shares apart from those of bigrams, so 40 bits of an n-gram's
hash tell it from the others of its shard. Up to a bound the filter is broadcast; beyond that its shards stay in the shared
folder and n-grams are sent to the shard that has them.
Exact word counts for a baseline come from a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.llm.common import discard, hashed_words, mix, staged

# Stands before the first word and behind the last one; no word has a line feed in it.
BOUNDARY = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
WORD, PAIR, SHARE = 1, 2, 3  # families of the filter
_HALF = np.uint64(32)
_INNER = np.uint64(24)  # bits of a key that only choose its shard
_BITS = np.uint64(40)  # the other ones


@dataclass(frozen=True)
class Setting:
    word_base: float = 1.3  # levels of word counts: level L stands for base ** (L - 1) up to base ** L
    pair_base: float = 1.5
    min_pair: int = 1  # bigrams seen less often in training are left to the word model
    discount: float = 0.75  # taken from the count of every kept bigram
    share_steps: int = 32
    bits_per_entry: int = 10
    probes: int = 4
    most_bytes: int = 128 << 20  # of a filter that is broadcast; a larger one is asked shard by shard
    shard_tokens: int = 1 << 21  # training tokens per shard of the bigram counts
    buffer: int = 1 << 21  # bigrams that a task holds before it adds them up
    ask_bytes: int = 8 << 20  # of texts that ask the shards together; what they share is sent once
    slice_bytes: int = 4 << 20  # of texts that are scored at once


SETTING = Setting()
# Asks shards whatever the size of the filter: no step in what a growing corpus takes, and no filter on the driver.
APART = Setting(most_bytes=0)


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's closed by the boundary, and where each text starts."""
    words, starts = hashed_words(texts)
    out = np.full(len(words) + len(starts) - 1, BOUNDARY)
    out[np.arange(len(words)) + np.repeat(np.arange(len(starts) - 1), np.diff(starts))] = words
    return out, starts + np.arange(len(starts))


def pairs_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bigram of each token with the one before it: 32 bits of either hash."""
    before = np.roll(tokens, 1)
    before[starts[:-1]] = BOUNDARY
    return before >> _HALF << _HALF | tokens >> _HALF


def level(count: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log(count)), safe against rounding at whole powers; 0 for a count of 0."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(base) + 1e-9), 0).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``np.unique`` without counts goes by a hash table, which takes many times as long."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of equal length in few bytes: the first bytes of all values, then the second ones, and so on."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueezed(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of :func:`squeezed`, given their types."""
    flat, sizes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(flat) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def steps_of(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which take fewer bytes; ``np.cumsum`` gives the keys again."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def squeezed_pairs(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted bigrams with counts: the histories repeat, most counts are 1."""
    return squeezed(steps_of((keys >> _HALF).astype("<u4")), keys.astype("<u4"), counts.astype("<u4"))


def unsqueezed_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    high, low, counts = unsqueezed(data, "<u4", "<u4", "<u4")
    return np.cumsum(high, dtype=np.uint32).astype(np.uint64) << _HALF | low, counts.astype(np.int64)


def squeezed_entries(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """What the filter needs to know of the keys of one shard, with their levels."""
    inner = keys >> _INNER
    order = np.argsort(inner)
    return squeezed(steps_of(inner[order]), levels[order].astype(np.uint8))


def unsqueezed_entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, levels = unsqueezed(data, "<u8", "u1")
    return np.cumsum(steps, dtype=np.uint64), levels


def squeezed_texts(texts: list[bytes]) -> bytes:
    """Texts in few bytes, given in UTF-8."""
    sizes = np.array([len(texts), *map(len, texts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([sizes, *texts]))


def unsqueezed_texts(data: bytes, most: int) -> Iterator[list[str]]:
    """The texts of :func:`squeezed_texts` in lists of up to ``most`` bytes, of one text at least."""
    flat = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(flat[:4], "little")
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(flat, "<u4", n + 1)[1:], dtype=np.int64)
    begin, i = 4 * (n + 1), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, begin + most, side="right")))
        starts = [begin, *ends[i : j - 1].tolist()]
        yield [flat[a:b].decode() for a, b in zip(starts, ends[i:j].tolist())]
        begin, i = int(ends[j - 1]), j


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``token, c``: training count of each token hash (64 bits; equal hashes of different words add up)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            tokens, n = np.unique(tokens_of(batch[text])[0], return_counts=True)
            known = added_up(np.concatenate([known[0], tokens]), np.concatenate([known[1], n]))
            if len(known[0]) > 1 << 20:
                yield pd.DataFrame({"token": known[0].view(np.int64), "n": known[1]})
                known = known[0][:0], known[1][:0]
        yield pd.DataFrame({"token": known[0].view(np.int64), "n": known[1]})

    partial = texts.select(text).mapInPandas(count, "token long, n long")
    return partial.groupBy("token").agg(F.sum("n").alias("c"))


def pair_shards(texts: DataFrame, text: str, shards: int, s: Setting) -> DataFrame:
    """``shard, data, entries, histories, shares``: bigrams seen ``min_pair`` times or more, a row per shard.

    A task adds up what it has read before it deals the bigrams to shards by their hash, so the bigrams of one very
    frequent history are spread over all shards. ``shares`` has the discounted counts of each history in the shard.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0

        def rows() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            shard = (mix(keys, PAIR) % np.uint64(shards)).astype(np.min_scalar_type(shards))  # small types sort quicker
            order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
            ends = np.searchsorted(shard[order], np.arange(1, shards + 1))
            out = [(k, squeezed_pairs(keys[part], counts[part])) for k, part in enumerate(np.split(order, ends[:-1])) if len(part)]
            return pd.DataFrame(out, columns=["shard", "data"])

        for batch in batches:
            waiting.append(pairs_of(*tokens_of(batch[text])))
            size += len(waiting[-1])
            if size >= s.buffer:
                yield rows()
                waiting, size = [], 0
        if size:
            yield rows()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unsqueezed_pairs(d) for d in group["data"]]
        keys, counts = added_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        keep = counts >= s.min_pair
        keys, levels = keys[keep], level(counts[keep], s.pair_base)
        mass = s.pair_base ** (levels - 1.0) - s.discount
        histories, where = np.unique(keys >> _HALF, return_inverse=True)
        entered = levels - pair_floor(s)
        return pd.DataFrame(
            {
                "shard": [int(group["shard"].iloc[0])],
                "data": [squeezed_entries(mix(keys, PAIR), entered)],
                "entries": [int(entered.sum())],
                "histories": [histories.astype(np.int64)],
                "shares": [np.bincount(where, weights=mass, minlength=len(histories))],
            }
        )

    dealt = texts.select(text).mapInPandas(deal, "shard int, data binary")
    schema = "shard int, data binary, entries long, histories array<long>, shares array<double>"
    return dealt.groupBy("shard").applyInPandas(merge, schema)


def pair_floor(s: Setting) -> int:
    """Levels below the least kept bigram, which need no entries."""
    return int(level(np.array([s.min_pair]), s.pair_base)[0]) - 1


@dataclass
class Model:
    """The filter with what turns levels into probabilities."""

    bits: np.ndarray  # bytes of all shards, those of words first; none if they stay in ``stored``
    shards: int  # of words and shares, and as many of bigrams
    word_bits: int  # bits of a shard of words and shares
    pair_bits: int
    mass: float  # sum of what word levels stand for, plus vocabulary, plus one
    setting: Setting
    entries: int
    stored: DataFrame | None = None  # ``shard, bits`` of a filter too large to broadcast

    def levels(self, keys: np.ndarray, pairs_from: int) -> np.ndarray:
        """Level of each key of :func:`asked` in the filter at hand; bigrams begin at ``pairs_from``."""
        shards, out = np.uint64(self.shards), []
        for part, first, size in (keys[:pairs_from], 0, self.word_bits), (keys[pairs_from:], self.shards * self.word_bits, self.pair_bits):
            base = part % shards * np.uint64(size) + np.uint64(first)
            out.append(levels_in(self.bits, part >> _INNER, base, size, self.setting))
        return np.concatenate(out)

    def log10(self, tokens: np.ndarray, starts: np.ndarray, word_at: np.ndarray, pair_at: np.ndarray, end: int, told: np.ndarray) -> np.ndarray:
        """Log10 probability of each text of :func:`tokens_of`.

        ``word_at`` and ``pair_at`` tell which of the distinct words and bigrams each token is and ends, ``end`` which word
        is the boundary, ``told`` the levels of :func:`asked`.
        """
        s = self.setting
        n = int(word_at.max(initial=-1)) + 1
        word_level, share_level, pair_level = np.split(told, [n, 2 * n])
        count = np.where(word_level > 0, s.word_base ** (word_level - 1.0), 0.0)
        alone = ((count + 1) / self.mass)[word_at]
        before = np.roll(word_at, 1)
        before[starts[:-1]] = end
        seen = (word_level > 0)[before]
        history_count = s.word_base ** word_level[before].astype(float)  # not under the true count
        share = np.minimum(share_level, s.share_steps)[before] / s.share_steps
        together = np.where(pair_level > 0, s.pair_base ** (pair_level + pair_floor(s) - 1.0) - s.discount, 0.0)[pair_at]
        # At least a thousandth of a word's own probability is left, should false positives have taken it all.
        p = np.where(seen, np.minimum(together / history_count, 1.0) + np.maximum(1 - share, 1e-3) * alone, alone)
        return np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts[:-1]) if len(tokens) else np.zeros(0)


def asked(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Keys whose levels score texts of these distinct tokens and bigrams: words, shares of the words, bigrams."""
    return np.concatenate([mix(words, WORD), mix(words >> _HALF, SHARE), mix(pairs, PAIR)])


def placed(keys: np.ndarray, pairs_from: int, shards: int) -> np.ndarray:
    """Shard of each key of :func:`asked` (words' first) and the 40 bits asked within it, in one number; equal ones ask the same."""
    shard = keys % np.uint64(shards)
    shard[pairs_from:] += np.uint64(shards)
    return shard << _BITS | keys >> _INNER


def asks_of(data: bytes, shards: int, s: Setting) -> np.ndarray:
    """What all texts of :func:`squeezed_texts` ask: their :func:`placed` keys, distinct and sorted."""
    asks = [np.zeros(0, np.uint64)]
    for texts in unsqueezed_texts(data, s.slice_bytes):
        tokens, starts = tokens_of(texts)
        words = distinct(tokens)
        asks.append(placed(asked(words, distinct(pairs_of(tokens, starts))), 2 * len(words), shards))
    return distinct(np.concatenate(asks))


def levels_in(bits: np.ndarray, keys: np.ndarray, base: np.ndarray, shard_bits: int, s: Setting) -> np.ndarray:
    """Level of each key within its shard, by probing members 1, 2, .. until one is missing; the shard begins at bit ``base``."""
    out, live, step = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(live) and step < 256:
        here, stride = start_of(keys[live], step)
        for _ in range(s.probes):
            at = base[live] + place_of(here, shard_bits)
            hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            live, stride = live[hit], stride[hit]
            here = here[hit] + stride
        out[live] = step
        step += 1
    return out


def start_of(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of the probes for member ``step`` of each key, for :func:`place_of`."""
    f = mix(keys ^ np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return f, mix(f, 1) | np.uint64(1)


def place_of(here: np.ndarray, shard_bits: int) -> np.ndarray:
    """Place of a probe among the bits of a shard (under ``2**32``), by its upper half and without a division."""
    return (here >> _HALF) * np.uint64(shard_bits) >> _HALF


def packed_entries(rows: DataFrame, family: int, shards: int, s: Setting) -> DataFrame:
    """``shard, data, entries, mass`` of rows ``raw, x``: word counts or shares. ``mass`` is what word levels stand for."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, x = mix(batch["raw"].to_numpy(np.int64).view(np.uint64), family), batch["x"].to_numpy(float)
            lev = level(x, s.word_base) if family == WORD else np.clip(np.ceil(x * s.share_steps), 0, s.share_steps).astype(np.int64)
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            parts = np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))
            out = [
                (k, squeezed_entries(keys[p], lev[p]), int(lev[p].sum()), float((s.word_base ** (lev[p] - 1.0)).sum()))
                for k, p in enumerate(parts)
                if len(p)
            ]
            yield pd.DataFrame(out, columns=["shard", "data", "entries", "mass"])

    return rows.select("raw", F.col("x").cast("double").alias("x")).mapInPandas(
        pack, "shard int, data binary, entries long, mass double"
    )


def entered(parts, shard_bits: int, s: Setting) -> bytes:
    """Bits of a shard with the entries of all parts."""
    bits = np.zeros(shard_bits, bool)
    for data in parts:
        keys, lev = unsqueezed_entries(data)
        for step in range(1, int(lev.max(initial=0)) + 1):
            here, stride = start_of(keys[lev >= step], step)
            for _ in range(s.probes):
                bits[place_of(here, shard_bits)] = True
                here = here + stride
    return np.packbits(bits, bitorder="little").tobytes()


def filter_shards(words: DataFrame, pairs: DataFrame, shards: int, word_bits: int, pair_bits: int, s: Setting) -> DataFrame:
    """``shard, bits`` of the filter, made shard by shard in tasks and written to the shared folder.

    Parts of ``words`` meet by shard. ``pairs`` has a row per shard already, whose bits are made where it is read.
    """

    def of_words(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "bits": [entered(group["data"], word_bits, s)]})

    def of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data in zip(batch["shard"].tolist(), batch["data"]):
                yield pd.DataFrame({"shard": [shard + shards], "bits": [entered([data], pair_bits, s)]})

    a = words.select("shard", "data").groupBy("shard").applyInPandas(of_words, "shard int, bits binary")
    return staged(a.unionByName(pairs.select("shard", "data").mapInPandas(of_pairs, "shard int, bits binary")), cleanup=True)


def filter_bits(built: DataFrame, shards: int, word_bits: int, pair_bits: int) -> np.ndarray:
    """All shards of :func:`filter_shards` in one array on the driver."""
    out = np.zeros(shards * (word_bits + pair_bits) // 8, np.uint8)
    for r in built.toLocalIterator():  # read from the folder, so shards are built side by side
        k = r["shard"]
        at = (k * word_bits if k < shards else shards * word_bits + (k - shards) * pair_bits) // 8
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def train(texts: DataFrame, counts: DataFrame, text: str = "text", s: Setting = SETTING) -> Model:
    """Model of training texts, given their :func:`word_counts`."""
    n = counts.agg(F.sum("c")).first()[0] or 0
    shards = max(1, -(-n // s.shard_tokens))
    pairs = staged(pair_shards(texts, text, shards, s), cleanup=True)
    shares = pairs.select(F.explode(F.arrays_zip("histories", "shares")).alias("x")).select("x.histories", "x.shares")
    shares = shares.groupBy(F.col("histories").alias("raw")).agg(F.sum("shares").alias("mass"))
    halves = counts.groupBy(F.shiftrightunsigned("token", 32).alias("raw")).agg(F.sum("c").alias("c"))
    shares = shares.join(halves, "raw").select("raw", (F.col("mass") / F.col("c")).alias("x"))
    words = packed_entries(counts.select(F.col("token").alias("raw"), F.col("c").alias("x")), WORD, shards, s)
    words = words.unionByName(packed_entries(shares, SHARE, shards, s).withColumn("mass", F.lit(0.0)))
    words = staged(words, cleanup=True)
    (word_entries, mass), pair_entries = words.agg(F.sum("entries"), F.sum("mass")).first(), pairs.agg(F.sum("entries")).first()[0]
    word_bits, pair_bits = (max(64, -(-int(e or 0) * s.bits_per_entry // shards // 8) * 8) for e in (word_entries, pair_entries))
    vocabulary = counts.count()
    built, short = filter_shards(words, pairs, shards, word_bits, pair_bits, s), (word_bits + pair_bits) * shards <= s.most_bytes * 8
    discard(pairs)
    discard(words)
    bits = filter_bits(built, shards, word_bits, pair_bits) if short else np.zeros(0, np.uint8)
    entries = int(word_entries or 0) + int(pair_entries or 0)
    return Model(bits, shards, word_bits, pair_bits, (mass or 0.0) + vocabulary + 1, s, entries, None if short else built)


def with_levels(numbered: DataFrame, model: Model) -> DataFrame:
    """``batch, rows, doc_ids, texts, told``: batches of squeezed texts with the levels of their :func:`asked` keys, parts by shard.

    Each batch sends its keys to the shards that have them, each key once. A task reads a shard's bits first and then the
    keys that ask it, so it holds one shard and one Arrow batch of keys, whatever the corpus. Texts are staged and shuffled
    squeezed.
    """
    shards, word_bits, pair_bits, s = model.shards, model.word_bits, model.pair_bits, model.setting

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ids, texts, size = [], [], [], 0

        def packed() -> pd.DataFrame:
            return pd.DataFrame({"batch": [rows[0]], "rows": [rows], "doc_ids": [ids], "texts": [squeezed_texts(texts)]})

        for b in batches:
            rows += b["row"].tolist()
            ids += b["doc_id"].tolist()
            data = [t.encode() if t else b"" for t in b["text"]]
            texts += data
            size += sum(map(len, data))
            if size >= s.ask_bytes:
                yield packed()
                rows, ids, texts, size = [], [], [], 0
        if rows:
            yield packed()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for batch, data in zip(b["batch"], b["texts"]):
                asks = asks_of(data, shards, s)
                ends = np.searchsorted(asks, np.arange(2 * shards + 1, dtype=np.uint64) << _BITS)
                asks &= (np.uint64(1) << _BITS) - np.uint64(1)
                parts = enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))
                out = [(k, batch, squeezed(steps_of(asks[i:j]))) for k, (i, j) in parts if j > i]
                yield pd.DataFrame(out, columns=["shard", "batch", "data"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, bits = None, None
        for b in batches:
            out = []
            for shard, part in b.groupby("shard"):
                own = part["batch"].isna()
                if own.any():
                    here, bits = shard, np.frombuffer(part.loc[own, "data"].iloc[0], np.uint8)
                part = part[~own]
                if not len(part):
                    continue
                each = [np.cumsum(unsqueezed(data, "<u8")[0], dtype=np.uint64) for data in part["data"]]
                # Batches ask much the same; what several of them ask is looked up once.
                keys, where = np.unique(np.concatenate(each), return_inverse=True)
                size = word_bits if shard < shards else pair_bits
                # A shard without bits has no entries.
                told = levels_in(bits, keys, np.zeros(len(keys), np.uint64), size, s) if shard == here else np.zeros(len(keys))
                parts = np.split(told.astype(np.uint8)[where], np.cumsum([len(e) for e in each])[:-1])
                out += [(int(batch), int(shard), squeezed(p)) for batch, p in zip(part["batch"], parts)]
            yield pd.DataFrame(out, columns=["batch", "shard", "told"])

    packed = staged(numbered.mapInPandas(pack, "batch long, rows array<long>, doc_ids array<string>, texts binary"))
    keys = packed.select("batch", "texts").mapInPandas(deal, "shard int, batch long, data binary")
    bits = model.stored.select("shard", F.lit(None).cast("long").alias("batch"), F.col("bits").alias("data"))
    met = bits.unionByName(keys).repartition("shard").sortWithinPartitions("shard", F.col("batch").asc_nulls_first())
    # Staged, so that the keys are off the disk before the texts are shuffled.
    told = staged(met.mapInPandas(look, "batch long, shard int, told binary"), cleanup=True)
    told = told.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("shard", "told"))).alias("told"))
    return packed.join(told, "batch")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) and counts of the most frequent tokens, at most ``most``: what tasks look up without a shuffle."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(F.col("c") >= least).sort("token").toPandas()
    return top["token"].to_numpy(np.int64), top["c"].to_numpy(np.int64)


def score(
    df: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text", most_frequent: int = 1 << 18
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``df``.

    ``score`` is the model's log10 probability of the text and its end. ``base_score`` is that of the word counts alone with
    one added to each, exact: the most frequent words (a bounded number) are looked up in the task, the others are joined
    with ``counts``. A null or empty text is one token, its end; with nothing learned all probabilities are 1.
    """
    spark = df.sparkSession
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    # What is broadcast has no data frame in it.
    shared, top = spark.sparkContext.broadcast(replace(model, stored=None)), spark.sparkContext.broadcast(frequent(counts, most_frequent))
    columns = ["row", "doc_id", "token", "tf", "known", "logs", "n_tokens", "score"]

    def slices(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Callable]]:
        """Texts to score at once, with what tells the levels of their :func:`asked` keys."""
        if "told" not in batch:
            yield batch, shared.value.levels
            return
        shards, s = shared.value.shards, shared.value.setting
        for rows, ids, data, parts in zip(batch["rows"], batch["doc_ids"], batch["texts"], batch["told"]):
            # The parts answer what all texts of the batch ask, in its order.
            asks, answers = asks_of(data, shards, s), np.concatenate([unsqueezed(p["told"], "u1")[0] for p in parts])

            def told(keys: np.ndarray, pairs_from: int) -> np.ndarray:
                return answers[np.searchsorted(asks, placed(keys, pairs_from, shards))].astype(np.int64)

            at = 0
            for texts in unsqueezed_texts(data, s.slice_bytes):
                own = slice(at, at + len(texts))
                yield pd.DataFrame({"row": rows[own], "doc_id": ids[own], "text": texts}), told
                at += len(texts)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, known_counts = top.value
        logs_of = np.append(np.log10(known_counts + 1.0), 0.0)
        for batch, levels in (one for b in batches for one in slices(b)):
            tokens, starts = tokens_of(batch["text"])
            words, where = np.unique(tokens, return_inverse=True)
            bigrams, pair_at = np.unique(pairs_of(tokens, starts), return_inverse=True)
            told = levels(asked(words, bigrams), 2 * len(words))
            scores = shared.value.log10(tokens, starts, where, pair_at, int(np.searchsorted(words, BOUNDARY)), told)
            learned = words.view(np.int64)
            at = np.searchsorted(known, learned)
            found = np.append(known, 0)[at] == learned
            found &= at < len(known)
            at = np.where(found, at, len(known))
            row_of = np.repeat(np.arange(len(batch)), np.diff(starts))
            # The other words of each text, once per text.
            rest = ~found[where]
            pairs, tf = np.unique(row_of[rest] * len(learned) + where[rest], return_counts=True)
            rows = batch["row"].to_numpy(np.int64)
            texts = {
                "row": rows,
                "doc_id": batch["doc_id"],
                "token": mix(rows.view(np.uint64)).view(np.int64),
                "tf": np.zeros(len(rows), np.int64),
                "known": np.bincount(row_of, weights=found[where], minlength=len(rows)).astype(np.int64),
                "logs": np.bincount(row_of, weights=logs_of[at][where], minlength=len(rows)),
                "n_tokens": np.diff(starts),
                "score": scores,
            }
            yield pd.DataFrame(texts, columns=columns)
            others = {"row": rows[pairs // len(learned)], "token": learned[pairs % len(learned)], "tf": tf}
            none = {"doc_id": None, "known": 0, "logs": 0.0, "n_tokens": 0, "score": 0.0}
            yield pd.DataFrame(others | none, columns=columns)

    # Ids pass Python as text: a null beside them would make floats of longs there.
    ids = F.col(doc_id).cast("long").cast("string").alias("doc_id")
    numbered = df.select(F.monotonically_increasing_id().alias("row"), ids, F.col(text).alias("text"))
    # A row per text, with no words (tf 0) under a token spread at random, and one per text and other word.
    texts = numbered if model.stored is None else with_levels(numbered, model)
    flat = texts.mapInPandas(look, "row long, doc_id string, token long, tf int, known long, logs double, n_tokens long, score double")
    met = flat.join(counts, "token", "left").withColumn("tf", F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))
    total = met.groupBy("row").agg(
        F.max("doc_id").cast("long").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum("tf")).alias("n_known"),
        (F.sum("logs") + F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))).alias("logs"),
        F.sum("score").alias("score"),
    )
    return total.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
    )
