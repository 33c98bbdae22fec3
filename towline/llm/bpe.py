"""Byte-level BPE: speculate with greedy longest match, verify adjacent pairs, merge exactly where that fails.

A sequence of reachable tokens is the BPE encoding of its bytes if and only if no merge ever crosses a border of two
neighbours. So words are cut by greedy longest match, all adjacent pairs of all new words are tested together with
numpy, and only the words with a failing pair go through the merges one by one.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.llm.common import temporary_name

# The public pattern of byte-level BPE that cuts text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern for the standard library's quicker engine. Its classes agree with the ones above on the
# characters of _COMMON: ASCII without the separators 1C-1F, Latin letters and usual punctuation.
_QUICK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_COMMON = "\t-\r -~\xa0-\xb1\xb4-\xb8\xba-\xbb\xbf-ɏ‐-‧"

_words, _quick, _uncommon = regex.compile(WORD_PATTERN), re.compile(_QUICK_PATTERN), re.compile(f"[^{_COMMON}]")
_NEVER = np.int64(1) << 40


def split_words(text: str) -> list[str]:
    """Words of the pattern, in order; joined they are the text."""
    return (_words if _uncommon.search(text) else _quick).findall(text)


def byte_characters() -> dict[str, int]:
    """Byte written by each character of a vocabulary file: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a ``tokenizers`` file of the byte-level kind, with each merge making its own token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], byte_characters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE vocabulary")
        size = max(*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        self.special = {}
        for a in spec["added_tokens"]:
            if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]:
                raise ValueError("added tokens must match literally")
            self.special[a["content"]] = a["id"]
            self.bytes[a["id"]] = a["content"].encode()
        self.size = size
        # Children of the merge that makes a token, and its rank; -1 for single bytes and added tokens.
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1, np.int64)
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.rank[made] >= 0:
                raise ValueError("two merges make one token")
            self.left[made], self.right[made], self.rank[made] = i, j, rank
            pairs[i * size + j] = rank, made
        self.pairs = pairs
        keys = np.array(list(pairs), np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.int64(size) * size)
        self._ranks = np.append(np.array([r for r, _ in pairs.values()], np.int64)[order], _NEVER)
        self.byte_id = [model["vocab"][c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        merged = np.flatnonzero(self.rank >= 0)
        # A token that merging its own bytes does not give must not be proposed.
        good = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        reachable = [*self.byte_id, *merged[good].tolist()]
        self.prefixes = {self.bytes[i][:k]: -1 for i in reachable for k in range(1, len(self.bytes[i]))}
        self.prefixes |= {self.bytes[i]: i for i in reachable}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank under ``before`` (default: any) crosses the border of tokens ``a`` and ``b``.

        Undoes, for all pairs at once, the merges of both tokens along the border, latest first. ``x`` and ``y`` are
        the pieces that then touch it, each with the rank at which it goes into a larger one. A merge of ``x`` and
        ``y`` takes place if its rank comes before both; of equal ranks the leftmost goes first, so the one that ends
        ``x`` does and the one that ends ``y`` does not.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        end_x = np.full(len(x), _NEVER) if before is None else before.astype(np.int64)
        end_y = end_x.copy() if before is None else end_x - 1
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            keys = x * self.size + y
            at = np.searchsorted(self._keys, keys)
            cross = np.where(self._keys[at] == keys, self._ranks[at], _NEVER)
            bad = (cross < end_x) & (cross <= end_y) & (cross < _NEVER)
            good[live[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            x, y, end_x, end_y, live, rank_x, rank_y = (v[go] for v in (x, y, end_x, end_y, live, rank_x, rank_y))
            # With equal ranks the merge right of the border was the later one.
            undo_x = rank_x > rank_y
            end_x, end_y = np.where(undo_x, rank_x, end_x), np.where(undo_x, end_y, rank_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from left to right, along the prefixes of tokens."""
        prefixes, out, at, n = self.prefixes, [], 0, len(word)
        while at < n:
            end = at + 1
            i = prefixes[word[at:end]]
            best, stop = i, end
            while end < n:
                end += 1
                i = prefixes.get(word[at:end])
                if i is None:
                    break
                if i >= 0:
                    best, stop = i, end
            out.append(best)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equal ranks."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        pairs, size = self.pairs, self.size
        none = (1 << 40, -1)
        found = [pairs.get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = pairs.get(ids[k - 1] * size + best[1], none)
            if k < len(found):
                found[k] = pairs.get(best[1] * size + ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, n log n for n bytes."""
        n, pairs, size = len(ids), self.pairs, self.size
        after, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], k, *p2) for k, p2 in enumerate(zip(ids, ids[1:])) if (p := p2[0] * size + p2[1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            m = after[k]
            if ids[k] != a or m >= n or ids[m] != b:
                continue  # one of the two is gone
            ids[k], ids[m] = pairs[a * size + b][1], -1
            after[k] = after[m]
            if after[k] < n:
                prev[after[k]] = k
            for i, j in ((prev[k], k), (k, after[k])):
                if i >= 0 and j < n and (p := ids[i] * size + ids[j]) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, ids[i], ids[j]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words needed exact merging."""
        proposed = [self.greedy(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(itertools.chain.from_iterable(proposed), np.int64, int(counts.sum()))
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(counts) - 1] = False  # the last token of a word has no neighbour in it
        a = np.flatnonzero(inside)
        distinct, where = np.unique(flat[a] * self.size + flat[a + 1], return_inverse=True)
        bad = ~self.compatible(distinct // self.size, distinct % self.size)[where]
        failing = np.unique(np.repeat(np.arange(len(words)), counts)[a[bad]])
        for k in failing.tolist():
            proposed[k] = self.merge(words[k])
        return proposed, len(failing)


class Encoder:
    """Encodes texts; remembers the ids of up to ``most`` words."""

    def __init__(self, vocabulary: Vocabulary, most: int = 150_000) -> None:
        self.v, self.most, self.known = vocabulary, most, {}

    def _learn(self, parts: list[list[str]]) -> dict[str, bytes]:
        """Ids, packed as little-endian 32-bit integers, of all words of ``parts`` at least."""
        here = set().union(*parts)
        words = list(here.difference(self.known))
        if len(self.known) + len(words) > self.most:  # of what is known, keep what is in use
            self.known = {w: self.known[w] for w in here.intersection(self.known)}
        ids, _ = self.v.encode_words([w.encode() for w in words])
        ends = np.cumsum([len(i) for i in ids]).tolist()
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
        fresh = {w: flat[4 * a : 4 * b] for w, a, b in zip(words, [0, *ends], ends)}
        if len(fresh) > self.most:
            return self.known | fresh
        self.known.update(fresh)
        return self.known

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, packed, in order. Words of some two million characters of text are learned together."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (size < 1 << 21 or not group):
                group.append(self._pieces(texts[at]))
                size += len(texts[at])
                at += 1
            ids = self._learn([words for pieces in group for words in pieces if not isinstance(words, int)])
            for pieces in group:
                yield b"".join(
                    np.array([p], "<u4").tobytes() if isinstance(p, int) else b"".join(map(ids.__getitem__, p)) for p in pieces
                )

    def _pieces(self, text: str) -> list[list[str] | int]:
        """Words between added tokens, and the ids of those."""
        if not self.v._special or not any(s in text for s in self.v.special):
            return [split_words(text)]
        return [self.v.special[p] if k % 2 else split_words(p) for k, p in enumerate(self.v._special.split(text))]

    def decode(self, packed: bytes) -> str:
        table = self.v.bytes
        return b"".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encode_column(text: Column, vocabulary: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(vocabulary)
        for texts in batches:
            yield pd.Series(list(e.packed([t or "" for t in texts])), dtype=object)
        e.known = {}  # the process goes on to other work; what it has learned must not stay in its memory

    return run.asNondeterministic()(text)  # evaluated once per row


def decode_column(ids: Column, vocabulary: str) -> Column:
    """Text of packed ids; bytes that are no UTF-8 become U+FFFD. Null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(vocabulary)
        for packed in batches:
            yield packed.map(e.decode, na_action="ignore")

    return run.asNondeterministic()(ids)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with packed token ids and their number. A null text has no tokens; rows are independent of each other,
    so repeated rows get equal ids. The vocabulary file must be on every executor. Existing columns of the names
    ``ids`` and ``count`` are replaced."""
    return df.withColumn(ids, encode_column(F.col(text), vocabulary)).withColumn(
        count, (F.octet_length(ids) / 4).cast("long")
    )


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of packed token ids (null for null)."""
    return df.withColumn(text, decode_column(F.col(ids), vocabulary))


def round_trip(
    df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded"
) -> DataFrame:
    """:func:`encode` and then :func:`decode` by one Python function, so a task holds one process with one vocabulary."""

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for texts in batches:
            packed = list(e.packed([t or "" for t in texts]))
            yield pd.DataFrame({"ids": packed, "decoded": [e.decode(p) for p in packed]}, dtype=object)
        e.known = {}  # as in encode_column

    both = temporary_name(df, "both")
    out = df.withColumn(both, run.asNondeterministic()(F.col(text)))
    named = {ids: F.col(both).getField("ids"), decoded: F.col(both).getField("decoded")}
    return out.withColumns(named | {count: (F.octet_length(F.col(both).getField("ids")) / 4).cast("long")}).drop(both)
