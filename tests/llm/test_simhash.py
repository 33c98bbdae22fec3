from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm import simhash
from towline.llm.queries import op11_simhash_components


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """Smallest place reachable over links, by comparing all pairs."""
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(i) for i in range(len(prints))]


def brute(docs):
    prints = [brute_print(t) for _, t in docs]
    label = brute_components(prints, 3)
    least = {}
    for (i, _), c in zip(docs, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{p:016x}", least[c] if i is not None else None) for (i, _), p, c in zip(docs, prints, label)), key=repr)


def flipped(rng, x, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        x ^= 1 << b
    return x


def clustered(seed, n=500):
    """Distinct fingerprints: chains, dense balls and strangers."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 7, 15}
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 40, 120])):
            x = flipped(rng, base, rng.choice([1, 3, 6]))
            out.add(x)
            if rng.random() < 0.5:
                base = x
    out = list(out)
    rng.shuffle(out)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_one_tree_connects_what_all_pairs_connect(radius):
    prints = clustered(radius)
    first = simhash.Forest(np.array(prints, np.uint64), np.zeros(len(prints), np.int64), radius).connect_all().tolist()
    expected = brute_components(prints, radius)
    assert len(set(zip(first, expected))) == len(set(first)) == len(set(expected))


def test_trees_of_a_forest_are_apart():
    a, b = clustered(1, 200), clustered(2, 300)
    groups = np.array([0] * len(a) + [1] * len(b))
    together = simhash.Forest(np.array(a + b, np.uint64), groups, 3).connect_all().tolist()
    alone = [simhash.Forest(np.array(x, np.uint64), np.zeros(len(x), np.int64), 3).connect_all().tolist() for x in (a, b)]
    assert together == alone[0] + alone[1]


def test_children_are_keyed_by_their_distance():
    prints = np.array(clustered(3), np.uint64)
    forest = simhash.Forest(prints, np.zeros(len(prints), np.int64), 3)
    child = forest.parent >= 0
    assert (~child).sum() == 1
    assert (np.bitwise_count(forest.prints[child] ^ forest.prints[forest.parent[child]]) == forest.edge[child]).all()
    assert len(set(zip(forest.parent.tolist(), forest.edge.tolist()))) == len(prints)
    assert sorted(forest.prints.tolist()) == sorted(prints.tolist())


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_every_near_pair_meets_in_a_shard(blocks):
    rng = random.Random(blocks)
    masks = simhash.masks(blocks, 3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = flipped(rng, x, 3)
        assert any((x ^ y) & (m % (1 << 64)) == 0 for m in masks)


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n, 3) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 34, 1 << 45)] == [4, 4, 5, 6, 7]


@pytest.mark.parametrize("tree,at_once", [(4096, 256), (40, 10_000), (40, 0)])
def test_links_connect_what_all_pairs_connect(spark, tree, at_once):
    prints = clustered(11, 1500)
    # Many that share three blocks of bits and are far apart otherwise: a shard of its own.
    rng = random.Random(4)
    prints = list({*prints, *((rng.getrandbits(16) << 20) + 5 for _ in range(500))})
    table = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    label = list(range(len(prints)))
    place = {signed(p): k for k, p in enumerate(prints)}
    links = rows(simhash.links_between(table, 3, tree, at_once))
    assert len(links) < 10 * len(prints)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        label[y] = x
    assert [find(k) for k in range(len(prints))] == brute_components(prints, 3)


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "One two", "a b c", "A B C d", "é Ä é\x0bx", "x " * 70_000]
    texts += [" ".join(rng.choice(["the", "of", "and", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert simhash.fingerprints_of(texts).tolist() == [brute_print(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == []


def test_hash_is_the_one_of_spark(spark):
    text = "some words é here"
    expected = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert signed(xxhash.xxh64_intdigest(text.encode(), simhash.SEED)) == expected


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "word", "WORD", "two words", "a b c"]
    for _ in range(40):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for k in rng.sample(range(len(copy)), min(len(copy), rng.choice([0, 0, 1, 2, 4]))):
                copy[k] = f"n{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_equals_brute_force(spark):
    texts = corpus(1)
    ids = [i if i % 9 else None for i in range(len(texts))]
    docs = documents(spark, texts, ids=ids).withColumn("fingerprint", F.lit("mine")).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(rows(got), key=repr) == brute(list(zip(ids, texts)))


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = "first text of some words " * 9, "other things entirely said here " * 9
    got = rows(simhash.near_duplicates(documents(spark, [a, b, a, b], ids=[7, 7, 3, 9])))
    assert {(i, c) for i, _, c in got} == {(7, 3), (3, 3), (9, 3)} and len(got) == 4


def test_many_copies_and_an_empty_table(spark):
    docs = documents(spark, ["the same words again"] * 3000 + [None] * 2000)
    assert {(c,) for _, _, c in rows(simhash.near_duplicates(docs))} == {(0,), (3000,)}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    assert sorted(rows(op11_simhash_components(spark, sf_dir)), key=repr) == brute(docs)
