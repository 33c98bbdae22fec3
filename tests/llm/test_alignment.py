from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import documents, rows
from towline.llm import alignment
from towline.llm.alignment import Fragment, Groups, Tokens
from towline.llm.queries import op12_token_alignment, vocabulary_path

A_PATH, B_PATH = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


class Brute:
    """Token ids and bytes by the two libraries on whole texts, groups by comparing offsets."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        with open(A_PATH, encoding="utf-8") as f:
            self.entry = {i: t for t, i in json.load(f)["model"]["vocab"].items()}

    def sides(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        pieces = [self.b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        return (a, [bytes(self.byte[c] for c in self.entry[i]) for i in a]), (b, bytes_b)

    def groups(self, text):
        """Lists of the ids of both sides for each group."""
        if not text:
            return []
        (a, of_a), (b, of_b) = self.sides(text)
        whole = (" " + text).encode()
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            return []
        out, x, y, i, j = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                out[-1][0].append(a[i])
                x += len(of_a[i])
                i += 1
            else:
                out[-1][1].append(b[j])
                y += len(of_b[j])
                j += 1
            if x == y and i + j < len(a) + len(b):
                out.append(([], []))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def links_of(groups):
    return Counter((i, j) for a, b in groups for i in a for j in b)


def expected_rows(brute, docs):
    found = [(i, brute.groups(t)) for i, t in docs]
    held = Counter(p for _, g in found for p in links_of(g))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (
            i,
            sum(len(a) for a, _ in g),
            sum(len(b) for _, b in g),
            len(g),
            sum(links_of(g).values()),
            sum(n for p, n in links_of(g).items() if held[p] == most[p[0]]),
            sum(n * held[p] for p, n in links_of(g).items()),
            hashlib.sha256(text_of(g).encode()).hexdigest() if g else "",
        )
        for i, g in found
    ]


HARD = [
    None, "", " ", "  ", "\n", " \n ", "a", "one two", "two  spaces", "end ", "tab\tand\rreturn", "line\nfeed\n\nmore\n", "don't we'll",
    "▁ is a space to one of them", "plain ▁x", "café naïve 日本語 \U0001f600\U0001f468‍\U0001f469", "x y　z  w",
    "<|endoftext|> and </s><s><unk> <0x0A>", "a\x00b\x1c c", "123456789 3.14159", "A" * 500, "ab" * 300 + " " + "é" * 100, "  lead", "trail  \n",
]


def mixed(rng, n):
    words = ["the", "quick", "brown", "föx", "jumps,", "over.", "(lazy)", "dögs'", "日本", "1234", "antidisestablishmentarianism", "\n", "", "x\ty"]
    return " ".join(rng.choice(words) for _ in range(n))


def same(x, y):
    return (x.n_a, x.n_b, x.n, x.text, x.pairs.tolist(), x.times.tolist()) == (y.n_a, y.n_b, y.n, y.text, y.pairs.tolist(), y.times.tolist())


def equal(x, y):
    if (x.closed is None) != (y.closed is None) or x.closed is not None and not same(x.closed, y.closed):
        return False
    return all(np.array_equal(getattr(getattr(x, p), s), getattr(getattr(y, p), s)) for p in ("prefix", "suffix") for s in ("a", "b"))


@st.composite
def cut_tokens(draw):
    """Tokens of two sides of one text, and byte offsets to cut them at."""
    n = draw(st.integers(1, 60))
    ends = [sorted({n, *draw(st.lists(st.integers(1, n), max_size=40))}) for _ in range(2)]
    sides = [np.array([[draw(st.integers(0, 3)), e] for e in s], np.int64) for s in ends]
    return Tokens(*sides), sorted(set(draw(st.lists(st.integers(0, n), max_size=8)))), draw(st.randoms(use_true_random=False))


@settings(max_examples=300, deadline=None)
@given(cut_tokens())
def test_any_cut_and_any_order_give_the_fragment_of_the_whole(drawn):
    tokens, cuts, rng = drawn
    parts, rest = [], tokens
    for c in cuts:
        part, rest = rest.until(c)
        parts.append(Fragment.of(part))
    parts.append(Fragment.of(rest))
    while len(parts) > 1:  # neighbours in any order
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert equal(parts[0], Fragment.of(tokens))
    none = Fragment()
    assert equal(parts[0] + none, parts[0]) and equal(none + parts[0], parts[0])
    whole = parts[0].whole()
    assert whole.n_a + whole.n_b == len(tokens) and whole.n == len(np.intersect1d(tokens.a[:, 1], tokens.b[:, 1]))


def test_fragment_by_hand():
    left = Fragment.of(Tokens(np.array([[1, 2], [2, 5]]), np.array([[7, 2], [8, 4]])))
    right = Fragment.of(Tokens(np.array([[3, 9]]), np.array([[9, 5], [6, 9]])))
    assert left.closed.n == 0 and left.prefix.a.tolist() == [[1, 2]] and left.suffix.b.tolist() == [[8, 4]]
    both = (left + right).whole()
    assert (both.text, both.n_a, both.n_b, both.n) == (b"1|7;2|8,9;3|6", 3, 4, 3)
    assert both.pairs.tolist() == [1 * 32768 + 7, 2 * 32768 + 8, 2 * 32768 + 9, 3 * 32768 + 6] and both.times.tolist() == [1] * 4
    assert Fragment.of(Tokens(np.array([[1, 2]]), np.array([[7, 3]]))).whole() is None
    assert same(Fragment().whole(), Groups())


def test_many_texts_together_and_their_stretches_give_the_tokens_of_whole_texts(brute):
    rng = random.Random(1)
    texts = [*HARD, *(mixed(rng, n) for n in (1, 5, 50, 500)), "x" + " " * 5000 + "y", " " * 300_000, "a" * 100_000]
    both = alignment.Aligner(A_PATH, B_PATH)
    for t, found in zip(texts, both.whole(texts)):
        groups = brute.groups(t)
        assert (found is None) == (not groups), t
        if groups:
            pairs = {divmod(p, alignment.PAIR): n for p, n in zip(found.pairs.tolist(), found.times.tolist())}
            assert (found.text.decode(), pairs) == (text_of(groups), dict(links_of(groups))), t
            assert (found.n_a, found.n_b, found.n) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups))
            (a, _), (b, _) = brute.sides(t)
            apart = both.encode(alignment.stretches(" " + t))
            assert ([i for x, _ in apart for i in x], [i for _, y in apart for i in y]) == (a, b)
    assert both.whole([]) == [] and both.whole([None, ""]) == [None, None]


def test_ranges_cover_every_byte_once():
    rng = random.Random(2)
    for text in [mixed(rng, 200), " x" + "y" * 500 + " z", "y" * 1000]:
        for size in (7, 64, 400):
            ranges = list(alignment.ranges_of(" " + text, size))
            assert [r[0] for r in ranges] == [0, *(r[1] for r in ranges[:-1])] and ranges[-1][1] == len((" " + text).encode())
            for low, high, offset, part in ranges:
                data = part.encode()
                assert offset <= low and offset + len(data) >= high and (" " + text).encode()[offset : offset + len(data)] == data


@pytest.mark.parametrize("range_bytes,fan", [(1 << 16, 8), (20, 2), (64, 3)])
def test_equals_brute_force_however_texts_are_cut(spark, brute, range_bytes, fan):
    rng = random.Random(range_bytes)
    texts = HARD + [mixed(rng, n) for n in (3, 30, 300)]
    docs = documents(spark, texts, ids=[None, *range(1, len(texts))]).withColumn("row", F.lit("mine")).withColumn("pairs", F.lit(1))
    got = alignment.align(docs, A_PATH, B_PATH, range_bytes=range_bytes, fan=fan)
    assert set(got.columns) == {*docs.columns, "n_a", "n_b", "n_groups", "n_links", "groups", "times"}
    found = {(r.doc_id, r.text): r for r in got.collect()}
    assert len(found) == len(texts) and all(r["row"] == "mine" for r in found.values())
    for i, t in zip([None, *range(1, len(texts))], texts):
        r, groups = found[i, t], brute.groups(t)
        links = {divmod(p, alignment.PAIR): n for p, n in zip(r["pairs"], r["times"])}
        assert (bytes(r["groups"]).decode(), links, r["n_groups"]) == (text_of(groups), dict(links_of(groups)), len(groups)), t
        assert (r["n_a"], r["n_b"], r["n_links"]) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), sum(links.values()))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_counts_by_broadcast_and_by_shuffle(spark, brute, most):
    texts = ["the cat", "the cat sat", "the dog", "", None, "the cat"]
    aligned = alignment.align(documents(spark, texts), A_PATH, B_PATH).withColumn("n", F.col("doc_id"))
    got = alignment.scored(aligned, "n", alignment.pair_counts(aligned), most)
    expected = [(r[0], r[5], r[6]) for r in expected_rows(brute, list(enumerate(texts)))]
    assert sorted(rows(got, "doc_id", "n_best", "count_sum")) == expected


def test_very_long_text(spark, brute):
    text = mixed(random.Random(9), 60_000)
    got = alignment.align(documents(spark, [text]), A_PATH, B_PATH).first()
    assert bytes(got["groups"]).decode() == text_of(brute.groups(text))


def test_query_equals_brute_force(spark, brute, tmp_path):
    rng = random.Random(4)
    texts = HARD + [mixed(rng, rng.randint(1, 60)) for _ in range(40)] + ["same row"] * 3
    ids = [*range(len(texts) - 3), 5, 5, None]
    documents(spark, texts, ids=ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(op12_token_alignment(spark, str(tmp_path)))
    assert sorted(got, key=repr) == sorted(expected_rows(brute, list(zip(ids, texts))), key=repr)


def test_query_on_test_table_and_on_an_empty_one(spark, brute, sf_dir, tmp_path):
    docs = rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    assert sorted(rows(op12_token_alignment(spark, sf_dir))) == sorted(expected_rows(brute, docs))
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_token_alignment(spark, str(tmp_path)).count() == 0
