from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm import periodic_runs
from towline.llm.queries import op13_periodic_runs


def smallest_period(s):
    return next(p for p in range(1, len(s) + 1) if all(a == b for a, b in zip(s, s[p:])))


def brute_runs(s):
    """Every stretch that equals itself some words on and cannot be extended, kept with its smallest period only."""
    out = set()
    for p in range(1, len(s) // 4 + 1):
        x = 0
        while x < len(s) - p:
            y = x
            while y < len(s) - p and s[y] == s[y + p]:
                y += 1
            if y + p - x >= max(6, 4 * p) and smallest_period(s[x : y + p]) == p:
                out.add((x, y + p - x, p))
            x = max(y, x + 1)
    return sorted(out)


def brute(doc_id, text):
    """The row of the query for one document, by the wording of the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


@st.composite
def sequences(draw):
    out = []
    for _ in range(draw(st.integers(0, 4))):
        block = draw(st.lists(st.integers(0, draw(st.sampled_from([1, 2, 30]))), min_size=1, max_size=40))
        out += (block * draw(st.integers(1, 8)))[: draw(st.integers(1, 250))]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(sequences(), max_size=5))
def test_runs_of_many_sequences_equal_brute_force(several):
    of, start, length, period = periodic_runs.runs([np.array(s, np.int64) for s in several])
    found = [[] for _ in several]
    for k, *run in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()):
        found[k].append(tuple(run))
    assert found == [brute_runs(s) for s in several]


def test_extensions_equal_word_by_word_comparison():
    rng = random.Random(3)
    s = [rng.randint(0, 1) for _ in range(170)] * 3 + [2]
    extend = periodic_runs.Extensions(np.array(s))
    pairs = [(i, j) for i in range(0, 511, 3) for j in range(1, 511, 7) if i != j]
    i, j = np.array(pairs).T
    expected = []
    for a, b in pairs:
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        expected.append(k)
    assert extend(i, j).tolist() == expected


def test_every_difference_has_a_step_into_the_cover():
    p, cover = periodic_runs.PERIOD, periodic_runs.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def test_written_down_by_hand(spark):
    texts = ["a a a a a a", "a a a a a", "x a b a b a b a b y", "a b a b a b a", "A a A a A a A a", "p q r " * 4 + "p"]
    got = rows(periodic_runs.periodic_runs(documents(spark, texts)), "runs", "best", "collapsed")
    assert [([tuple(r) for r in runs], best and tuple(best), kept) for runs, best, kept in got] == [
        ([(0, 6, 1)], (0, 6, 1), "a"),
        ([], None, "a a a a a"),
        ([(1, 8, 2)], (1, 8, 2), "x a b y"),
        ([], None, "a b a b a b a"),
        ([(0, 8, 2)], (0, 8, 2), "A a"),
        ([(0, 13, 3)], (0, 13, 3), "p q r"),
    ]


def test_greatest_exponent_and_its_ties(spark):
    texts = ["a " * 8 + "b " * 8 + "c d " * 9, "a b " * 4 + "c " * 6, "a b c " * 4 + "x y " * 4]
    got = [r[0] for r in rows(periodic_runs.periodic_runs(documents(spark, texts)), "best")]
    assert [tuple(r) for r in got] == [(16, 18, 2), (8, 6, 1), (0, 12, 3)]


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "one", "a\x0ba\x0ca\ra\ta\na", "é é é é é é", "a a a a a a"]
    docs = documents(spark, texts, ids=[1, 1, None, 3, 4, 5, 5]).withColumn("runs", F.lit("mine")).withColumn("found", F.lit(7))
    got = periodic_runs.periodic_runs(docs)
    assert set(got.columns) == {*docs.columns, "best", "collapsed"}
    assert [(i, len(r), c, f) for i, r, c, f in rows(got, "doc_id", "runs", "collapsed", "found")] == [
        (1, 0, "", 7),
        (1, 0, "", 7),
        (None, 0, "", 7),
        (3, 0, "one", 7),
        (4, 1, "a", 7),
        (5, 1, "é", 7),
        (5, 1, "a", 7),
    ]
    prefixed = periodic_runs.periodic_runs(documents(spark, ["a"]), prefix="p_")
    assert {"p_runs", "p_best", "p_collapsed"} <= set(prefixed.columns)
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


def test_very_long_text(spark):
    block = " ".join(f"w{k}" for k in range(20_000))
    docs = documents(spark, [f"start {block} {block} {block} {block} end", "z " * 300_000])
    got = rows(periodic_runs.periodic_runs(docs), "runs", "collapsed")
    assert [[tuple(r) for r in runs] for runs, _ in got] == [[(1, 80_000, 20_000)], [(0, 300_000, 1)]]
    assert got[0][1] == f"start {block} end" and got[1][1] == "z"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = [None, "", "  \n "]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
            parts += (block * rng.randint(1, 7))[: rng.randint(1, 40)]
        texts.append(rng.choice([" ", "\t", " \n"]).join(parts))
    ids = [*range(100, 100 + len(texts) - 4), None, 7, 7, 7]
    folder = str(tmp_path_factory.mktemp("runs"))
    documents(spark, texts, ids=ids).write.parquet(f"{folder}/documents.parquet")
    return folder, list(zip(ids, texts))


def test_query_equals_brute_force(spark, table):
    folder, docs = table
    got = rows(op13_periodic_runs(spark, folder))
    # A document without an id has no crc32 of it, so its words stay as they are.
    expected = [brute(i, t) if i is not None else (None, *brute("2", t)[1:]) for i, t in docs]
    assert zlib.crc32(b"2") % 10 != 0
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs) > 5


def test_query_on_test_table(spark, sf_dir):
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' WHERE length(text) < 4000").fetchall()
    got = {r[0]: r for r in rows(op13_periodic_runs(spark, sf_dir))}
    assert all(got[i] == brute(i, t) for i, t in docs)
