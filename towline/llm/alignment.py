"""Alignment of two tokenizers' tokens by an associative composition of fragments.

Byte offsets at which tokens of both tokenizers end cut a text into groups. A fragment is what a range of bytes tells of
that: tokens before its first common end (an open prefix), whole groups, and tokens behind its last common end (an open
suffix). Fragments compose associatively, so any cut of a text into ranges and any order of composing neighbours give the
groups of the whole. Long documents are cut into byte ranges, wherever those fall in a token; their fragments are made in
different tasks and composed by a tree reduction. Whole documents are closed fragments, aligned many at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.llm.bpe import WORD_PATTERN, byte_characters
from towline.llm.common import staged, temporary_name

# A pair of ids as one integer: first id times PAIR plus second id.
PAIR = 1 << 15
# Documents of more bytes are cut into ranges of so many.
RANGE_BYTES = 1 << 16
# Neighbouring fragments composed in one task at once.
FAN = 8
# Pairs whose counts are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 1_500_000
# No token of either tokenizer crosses such a place: no piece has a space but at its begin, none a line feed.
_PLACE = re.compile(r"(?<=\S)(?=[ \n])")
# White space of such length is too much for the quick encoder.
_BLANK = re.compile(r"\s{2000}")


def stretches(text: str) -> list[str]:
    """``text`` cut at all places that no token crosses."""
    return _PLACE.split(text) if text else []


@dataclass
class Tokens:
    """Tokens of both sides, each an array of rows ``id, end``; ends are byte offsets in the document."""

    a: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate([self.a, other.a]), np.concatenate([self.b, other.b]))

    def until(self, end: int) -> tuple[Tokens, Tokens]:
        """Tokens that end at ``end`` or before, and the others."""
        i, j = (int(np.searchsorted(s[:, 1], end, "right")) for s in (self.a, self.b))
        return Tokens(self.a[:i], self.b[:j]), Tokens(self.a[i:], self.b[j:])

    def __len__(self) -> int:
        return len(self.a) + len(self.b)

    def common_ends(self) -> np.ndarray:
        """Byte offsets at which a token of either side ends, in order."""
        if not len(self.b):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.b[:, 1], self.a[:, 1]), len(self.b) - 1)
        return self.a[self.b[at, 1] == self.a[:, 1], 1]

    def packed(self) -> bytes:
        return np.array([len(self.a)], "<i8").tobytes() + np.concatenate([self.a, self.b]).astype("<i8").tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Tokens:
        flat = np.frombuffer(data, "<i8")
        rows = flat[1:].reshape(-1, 2)
        return Tokens(rows[: flat[0]], rows[flat[0] :])


@dataclass
class Groups:
    """Closed groups: how many tokens, groups and links they have, their text, and how often each pair is linked."""

    n_a: int = 0
    n_b: int = 0
    n: int = 0
    text: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Groups) -> Groups:
        pairs, where = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(where, np.concatenate([self.times, other.times]), len(pairs)).astype(np.int64)
        text = b";".join(t for t in (self.text, other.text) if t)
        return Groups(self.n_a + other.n_a, self.n_b + other.n_b, self.n + other.n, text, pairs, times)


def _linked(tokens: Tokens, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all links of the groups that end at ``ends``, the number of the group of each, and the tokens in order.

    The last group ends with the last token of both sides. Tokens in order are those of the first side, then those of the
    second, group by group; one is its id times 4, plus 2 for the second side, plus 1 if it is the last of its side there.
    """
    ids = [s[:, 0] for s in (tokens.a, tokens.b)]
    cuts = [np.searchsorted(s[:, 1], ends, "right") for s in (tokens.a, tokens.b)]
    begins = [np.concatenate([[0], c[:-1]])[: len(ends)] for c in cuts]
    n_a, n_b = (c - s for c, s in zip(cuts, begins))
    # Each token of the first side with the run of tokens of its group on the second.
    per, first = np.repeat(n_b, n_a), np.repeat(begins[1], n_a)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first, per)
    order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for side, (mine, before) in enumerate(((ids[0], begins[1]), (ids[1], cuts[0]))):
        n = (n_a, n_b)[side]
        code = mine * 4 + 2 * side
        code[cuts[side] - 1] += 1
        order[np.arange(len(mine)) + np.repeat(before, n)] = code
    return np.repeat(ids[0], per) * PAIR + ids[1][at], np.repeat(np.arange(len(ends)), n_a * n_b), order


_NAMES: list[bytes] = []


def _text(order: np.ndarray) -> bytes:
    """The text of groups whose tokens are in order."""
    if not len(order):
        return b""
    for k in range(len(_NAMES) // 4, int(order.max()) // 4 + 1):
        _NAMES.extend(str(k).encode() + mark for mark in (b",", b"|", b",", b";"))
    return b"".join(map(_NAMES.__getitem__, order.tolist()))[:-1]


def groups_of(tokens: Tokens, ends: np.ndarray) -> Groups:
    """Groups of tokens that end at ``ends``, the last with the last token of both sides."""
    if not len(ends):
        return Groups()
    linked, _, order = _linked(tokens, ends)
    pairs, times = np.unique(linked, return_counts=True)
    return Groups(len(tokens.a), len(tokens.b), len(ends), _text(order), pairs, times)


@dataclass
class Fragment:
    """Open prefix, closed groups, open suffix. Without a common end ``closed`` is None and all tokens are in the prefix.

    The prefix includes the tokens that end at the first common end; only what is left of it is not known.
    """

    prefix: Tokens = field(default_factory=Tokens)
    closed: Groups | None = None
    suffix: Tokens = field(default_factory=Tokens)

    @staticmethod
    def of(tokens: Tokens) -> Fragment:
        ends = tokens.common_ends()
        if not len(ends):
            return Fragment(tokens)
        prefix, rest = tokens.until(ends[0])
        inside, suffix = rest.until(ends[-1])
        return Fragment(prefix, groups_of(inside, ends[1:]), suffix)

    def _sealed(self) -> Groups:
        """Groups of the fragment when a common end is right before it and one at its end."""
        ends = self.prefix.common_ends()
        return groups_of(self.prefix, ends) + (self.closed or Groups())

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both byte ranges, ``other`` following this one."""
        middle = Fragment.of((self.prefix if self.closed is None else self.suffix) + other.prefix)
        if self.closed is None:
            if other.closed is None:
                return middle
            return Fragment(middle.prefix, middle.closed + other.closed, other.suffix)
        if middle.closed is None:
            return Fragment(self.prefix, self.closed, middle.prefix)
        return Fragment(self.prefix, self.closed + middle._sealed() + (other.closed or Groups()), middle.suffix if other.closed is None else other.suffix)

    def whole(self) -> Groups | None:
        """Groups of a whole document; None if its sides do not end together."""
        if self.closed is None or len(self.suffix):
            return None if len(self.prefix) else Groups()
        return self._sealed()


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        import sentencepiece
        import tiktoken

        self.path, self._exact = byte_bpe, None
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_a = [b""] * (max(*vocab.values(), *special.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        # The same vocabulary for a quicker encoder: merges are in the order of the ids they make.
        ranks = {self.bytes_a[i]: i for i in vocab.values()}
        self.quick = tiktoken.Encoding("quick", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_b = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
            if " " in piece.replace("▁", " ").lstrip(" ") or "\n" in piece:
                raise ValueError("pieces must hold no space but at their begin, and no line feed")
        if len(self.bytes_b) > PAIR or len(self.bytes_a) * PAIR > 1 << 31:
            raise ValueError("ids do not fit into pairs")
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for texts that begin with a space or a line feed; None if a side has other bytes than the text."""
        # Behind a line feed the second tokenizer adds no space; what it makes of the line feed is cut off.
        b = [ids[2:] for ids in self.second.encode(["\n" + s for s in texts], num_threads=1)] if texts else []
        out = []
        for s, y in zip(texts, b):
            x = self._exactly(s) if _BLANK.search(s) else self.quick.encode_ordinary(s)
            data = s.encode()
            good = all(b"".join(map(t.__getitem__, ids)) == data for ids, t in ((x, self.bytes_a), (y, self.bytes_b)))
            out.append((x, y) if good else None)
        return out

    def _exactly(self, text: str) -> list[int]:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
            self._exact.encode_special_tokens = True
            self._exact.no_truncation()
            self._exact.no_padding()
        return self._exact.encode(text, add_special_tokens=False).ids

    def tokens(self, several: list[tuple[list[int], list[int]]], offset: int = 0) -> Tokens:
        """Tokens of texts one behind the other, the first at a byte offset."""
        sides = []
        for side, lengths in enumerate(self.lengths):
            n = sum(len(ids[side]) for ids in several)
            flat = np.fromiter(chain.from_iterable(ids[side] for ids in several), np.int64, n)
            sides.append(np.stack([flat, offset + np.cumsum(lengths[flat])], axis=1).reshape(-1, 2))
        return Tokens(*sides)

    def whole(self, texts: list[str | None]) -> list[Groups | None]:
        """Groups of each text, a space put before it; None if a side has other bytes or there is no text."""
        some = [k for k, t in enumerate(texts) if t]
        encoded = dict(zip(some, self.encode([" " + texts[k] for k in some])))
        some = [k for k in some if encoded[k] is not None]
        out: list[Groups | None] = [None] * len(texts)
        if not some:
            return out
        # One behind the other they are a text with a common end behind each.
        tokens = self.tokens([encoded[k] for k in some])
        ends = tokens.common_ends()
        linked, of, order = _linked(tokens, ends)
        n_a, n_b = (np.array([len(encoded[k][side]) for k in some]) for side in (0, 1))
        last = np.searchsorted(tokens.a[:, 1], ends)
        text = np.repeat(np.arange(len(some)), n_a)[last]
        keys, times = np.unique((text[of] << 31) + linked, return_counts=True)
        pairs, n_groups = keys & ((1 << 31) - 1), np.bincount(text, minlength=len(some))
        pair_ends = np.cumsum(np.bincount(keys >> 31, minlength=len(some))).tolist()
        token_ends = np.cumsum(n_a + n_b).tolist()
        for n, (k, i, j, u, v) in enumerate(zip(some, [0, *pair_ends], pair_ends, [0, *token_ends], token_ends)):
            out[k] = Groups(int(n_a[n]), int(n_b[n]), int(n_groups[n]), _text(order[u:v]), pairs[i:j], times[i:j])
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, pieces: str) -> Aligner:
    """The aligner of two vocabulary files, made once per Python process."""
    if (byte_bpe, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_bpe, pieces] = Aligner(byte_bpe, pieces)
    return _ALIGNERS[byte_bpe, pieces]


def ranges_of(text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
    """Byte ranges of ``text``: for each its begin and end, and the part of the text that holds its tokens with its offset.

    Ends are multiples of ``size``, wherever they fall; the stretch that holds one is in both parts. An end within a
    stretch longer than ``size`` is left out, so no stretch is in more than two parts.
    """
    parts = stretches(text)
    lengths = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    borders = np.arange(size, ends[-1], size)
    holder = np.searchsorted(ends, borders, "left")
    borders = borders[lengths[holder] <= size]
    low = 0
    for high in [*borders.tolist(), int(ends[-1])]:
        i, j = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(begins, high, "left"))
        yield low, high, int(begins[i]), "".join(parts[i:j])
        low = high


_GROUPS = "n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<int>, times array<int>"
_FRAGMENT = f"row long, part long, good boolean, prefix binary, suffix binary, {_GROUPS}"
_ADDED = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")


def _columns(groups: list[Groups | None]) -> dict[str, list]:
    g = [x or Groups() for x in groups]
    return {
        "n_a": [x.n_a for x in g],
        "n_b": [x.n_b for x in g],
        "n_groups": [x.n for x in g],
        "n_links": [int(x.times.sum()) for x in g],
        "groups": [x.text for x in g],
        "pairs": [x.pairs.astype(np.int32) for x in g],
        "times": [x.times.astype(np.int32) for x in g],
    }


def _fragments_frame(rows: list[int], parts: list[int], fragments: list[Fragment | None]) -> pd.DataFrame:
    f = [x or Fragment() for x in fragments]
    return pd.DataFrame(
        {
            "row": rows,
            "part": parts,
            "good": [x is not None for x in fragments],
            "prefix": [x.prefix.packed() for x in f],
            # Without a common end there is no suffix.
            "suffix": [None if x.closed is None else x.suffix.packed() for x in f],
            **_columns([x.closed for x in f]),
        }
    )


def _fragments_from(frame: pd.DataFrame) -> list[Fragment | None]:
    out = []
    for r in frame.itertuples(index=False):
        if not r.good:
            out.append(None)
        elif r.suffix is None:
            out.append(Fragment(Tokens.unpacked(r.prefix)))
        else:
            pairs, times = (np.asarray(x, np.int64) for x in (r.pairs, r.times))
            out.append(Fragment(Tokens.unpacked(r.prefix), Groups(r.n_a, r.n_b, r.n_groups, r.groups, pairs, times), Tokens.unpacked(r.suffix)))
    return out


def composed(fragments: list[Fragment | None]) -> Fragment | None:
    """Neighbours composed in pairs until one is left; None if a side has other bytes somewhere."""
    if any(f is None for f in fragments):
        return None
    while len(fragments) > 1:
        fragments = [fragments[k] + fragments[k + 1] if k + 1 < len(fragments) else fragments[k] for k in range(0, len(fragments), 2)]
    return fragments[0]


# Characters of text that are aligned together.
_GROUP_CHARS = 1 << 18


def _short(byte_bpe: str, pieces: str, text: Column) -> Column:
    """Groups of texts that are aligned as a whole."""

    @F.pandas_udf(_GROUPS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = aligner(byte_bpe, pieces)
        for texts in batches:
            found, group, size = [], [], 0
            for k, t in enumerate(texts.tolist()):
                group.append(t)
                size += len(t) if t else 0
                if size >= _GROUP_CHARS or k == len(texts) - 1:
                    found += both.whole(group)
                    group, size = [], 0
            yield pd.DataFrame(_columns(found))

    return run.asNondeterministic()(text)


def _long(docs: DataFrame, byte_bpe: str, pieces: str, size: int, fan: int) -> DataFrame:
    """Groups of documents that are cut into byte ranges."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                found = list(enumerate(ranges_of(" " + text, size)))
                for k in range(0, len(found), 64):
                    some = [(row, n, *r) for n, r in found[k : k + 64]]
                    yield pd.DataFrame(some, columns=["row", "part", "low", "high", "offset", "text"])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(byte_bpe, pieces)
        for batch in batches:
            made = []
            for text, low, high, offset in zip(batch["text"], batch["low"], batch["high"], batch["offset"]):
                ids = both.encode([text])[0]
                made.append(None if ids is None else Fragment.of(both.tokens([ids], offset).until(low)[1].until(high)[0]))
            yield _fragments_frame(batch["row"], batch["part"], made)

    def reduce(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one = composed(_fragments_from(frame.sort_values("part")))
        return _fragments_frame([key[0]], [key[1]], [one])

    def finish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one = composed(_fragments_from(frame.sort_values("part")))
        return pd.DataFrame({"row": [key[0]], **_columns([one and one.whole()])})

    parts = docs.select("row", "text").mapInPandas(cut, "row long, part long, low long, high long, offset long, text string")
    fragments = staged(parts.repartition("row", "part").mapInPandas(make, _FRAGMENT))
    most = fragments.agg(F.max("part")).first()[0] or 0
    while most >= fan:
        up = fragments.withColumn("above", F.expr(f"part div {fan}"))
        up = up.groupBy("row", "above").applyInPandas(lambda key, frame: reduce(key, frame.drop(columns="above")), _FRAGMENT)
        fragments, most = staged(up), most // fan
    # Written, so that no task runs one Python function on what another gives and holds two processes.
    return staged(fragments.groupBy("row").applyInPandas(finish, f"row long, {_GROUPS}"))


def align(docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text", range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """``docs`` with the groups of tokens of a space and each text.

    Adds ``n_a, n_b, n_groups, n_links``, ``groups`` (ids ``a1,a2|b1;a3|b2,b3`` in order, as UTF-8 bytes), and the pairs of
    ids linked: arrays ``pairs`` (first id times ``PAIR`` plus second) and ``times``. A text that is null or empty, or of
    which a tokenizer's token bytes are not the text's, has no tokens: zeros and empty values. Texts of more than
    ``range_bytes`` bytes are written to the shared folder and cut into ranges there. Rows are independent of each other,
    so repeated rows and ids get equal answers; columns of the added names are replaced. Both vocabulary files must be on
    every executor.
    """
    rest = docs.drop(*(c for c in _ADDED if c != text))
    found, row = temporary_name(docs, "found"), temporary_name(docs, "row")
    long = F.coalesce(F.octet_length(text) >= range_bytes, F.lit(False))
    short = rest.where(~long).withColumn(found, _short(byte_bpe, pieces, F.col(text)))
    apart = staged(rest.where(long).withColumn(row, F.monotonically_increasing_id()))
    texts = apart.select(F.col(row).alias("row"), F.col(text).alias("text"))
    cut = _long(texts, byte_bpe, pieces, range_bytes, fan)
    cut = cut.select(F.col("row").alias(row), F.struct(*_ADDED).alias(found))
    both = short.unionByName(apart.join(cut, row).drop(row))
    return both.withColumns({c: F.col(f"`{found}`.{c}") for c in _ADDED}).drop(found)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many rows hold a pair of ids linked, and whether no pair of its first id is held by more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = staged(counts.withColumn("a", F.expr(f"pair div {PAIR}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, row: str, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best``, its links whose pair is held by most rows among those of the first id, and
    ``count_sum``, the sum of that number of rows over all links. ``row`` numbers the rows of ``aligned``."""
    counts = staged(counts)
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = aligned.select(F.col(row).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("t"))
    sums = links.join(counts, "pair").groupBy(F.col("row").alias(row)).agg(
        F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum")
    )
    kept = aligned.drop("n_best", "count_sum").join(sums, row, "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
