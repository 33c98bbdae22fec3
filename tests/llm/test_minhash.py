from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm import minhash
from towline.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):  # groups of near copies, from certain links to none
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([6, 20, 80, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            texts.append(" ".join(edited(rng, base, min(len(base), rng.choice([0, 1, 2, 5, 10])))))
    chain = [f"c{k}" for k in range(200)]  # each link holds to the next document only
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[12:] + [f"d{k}_{j}" for j in range(12)]
    texts += ["", None, " \t", "one", "ONE", "one two three four", "one two three four", "A b c d e", "a B c d e", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    df = documents(spark, [t for _, t in docs])
    got = {i: (n, c) for i, n, c, _ in rows(minhash.near_duplicates(df))}
    want = brute(docs)
    assert got == want
    kept = {i for i, _, c, k in rows(minhash.near_duplicates(df)) if k}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_large_group_of_copies_and_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)] * 300 + [" ".join(edited(rng, base, 2)) for _ in range(150)] + ["x " * 3000]
    got = rows(minhash.near_duplicates(documents(spark, texts)), "doc_id", "component_id", "kept")
    assert sum(k for _, _, k in got) == 2
    assert {c for i, c, _ in got if i < 450} == {0}


def test_links_of_one_bucket_beyond_its_leader_are_found(spark):
    # The leader of the bucket is like none of the others, which are alike among themselves.
    buckets = spark.createDataFrame([(7, 1, 100, 1), (7, 2, 100, 1), (7, 3, 100, 1), (8, 4, 9, 4), (8, 5, 9, 4)], "key long, node long, n_shingles long, leader long")
    label = spark.createDataFrame([(4, 4), (5, 4)], "node long, component long")
    assert sorted(rows(minhash._unconnected(buckets, label))) == [(7, 1, 100, 1), (7, 2, 100, 2), (7, 3, 100, 3)]


@pytest.mark.parametrize("block", [3, 256])
def test_links_between_blocks_against_all_pairs(spark, block):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    texts = {k: " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 9]))) for k in range(60)}
    of = {k: k if k % 3 else 0 for k in texts}
    entries = [(key, k, len(shingles(texts[k])), of[k]) for key in (1, 2) for k in texts if key == 1 or k % 2]
    got = minhash.links_between(
        spark.createDataFrame(entries, "key long, node long, n_shingles long, of long"),
        spark.createDataFrame(list(texts.items()), "node long, text string"),
        75,
        block,
    )
    want = set()
    for a in texts:
        for b in texts:
            x, y = shingles(texts[a]), shingles(texts[b])
            if a > b and of[a] != of[b] and 100 * len(x & y) >= 75 * len(x | y):
                want.add((a, b))
    assert set(rows(got)) == want and 20 < len(want) < 1500


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", None, "q w e r t y"], ids=[None, 4, 5, 6])
    df = df.withColumns({"node": F.lit(1), "key": F.lit("k"), "n_shingles": F.lit("z"), "component": F.lit(3)})
    got = sorted(rows(minhash.near_duplicates(df)), key=str)
    assert got == [(4, 2, 4, True), (5, 0, 5, True), (6, 2, 6, True), (None, 2, None, True)]
    twice = rows(minhash.near_duplicates(documents(spark, ["a b c d e f"] * 2, ids=[3, 3])))
    assert twice == [(3, 2, 3, True)] * 2
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    m, rng = minhash.CirculantMinHash(32, 4), np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64) << np.uint64(1)
            n = round(2 * share * 400 / (1 + share))
            y = np.concatenate([x[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.int64).astype(np.uint64) << np.uint64(1)])
            errors.append((m.signature(np.unique(x)) == m.signature(np.unique(y))).mean() - n / (800 - n))
        assert abs(np.mean(errors)) < 0.03


def test_shingle_hashes_count_distinct_shingles():
    rng = random.Random(2)
    for _ in range(50):
        t = " ".join(rng.choices(["a", "B", "c"], k=rng.randint(0, 60)))
        assert len(next(minhash.shingle_sets([t]))) == len(shingles(t))


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    df = spark.createDataFrame([*links, (None, 5), (7, None), (900, 900)], "a long, b long")
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert dict(rows(components(df))) == {i: find(i) for i in up}
    assert components(df.limit(0)).count() == 0
