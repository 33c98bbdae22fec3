from __future__ import annotations

import glob
import math
import os
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm import bloom_lm as lm
from towline.llm.common import fold, hashed_words, staged, words_of
from towline.llm.queries import QUERIES
from towline.session import checkpoint_folder


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def scored(spark, df, learned, s=lm.SETTING):
    counts = lm.word_counts(learned, "text").cache()
    return lm.score(df, lm.train(learned, counts, s=s), counts, most_frequent=3)


def corpus(n, seed):
    rng = random.Random(seed)
    follow = {f"w{k}": [f"w{rng.randint(0, 199)}" for _ in range(3)] for k in range(200)}
    out = []
    for _ in range(n):
        w = [f"w{rng.randint(0, 199)}"]
        for _ in range(rng.randint(3, 60)):
            w.append(rng.choice(follow.get(w[-1], w)) if rng.random() < 0.8 else f"W{rng.randint(0, 999)}")
        out.append(" ".join(w))
    return out


def test_baseline_is_exact_and_model_beats_it(spark):
    texts = corpus(400, 1)
    df = documents(spark, texts)
    out = {r.doc_id: r for r in scored(spark, df, df.where(fold("doc_id", 7) != 2)).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2]
    c = Counter(w for i, t in enumerate(texts) if i not in set(held) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = tokens(t)
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-9)
        assert out[i].score <= 0
    assert sum(out[i].score for i in held) > 0.9 * sum(out[i].base_score for i in held)  # nearer to 0


def reference(texts, s):
    """The model with dictionaries in place of the filter: log10 probability of a token list."""
    words, pairs = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        words.update(w)
        pairs.update(zip([b"\n", *w], w))
    lev = lambda c, base: 1 + math.floor(math.log(c) / math.log(base) + 1e-9)
    rep = {w: s.word_base ** (lev(c, s.word_base) - 1) for w, c in words.items()}
    kept = {p: s.pair_base ** (lev(c, s.pair_base) - 1) - s.discount for p, c in pairs.items() if c >= s.min_pair}
    taken = Counter()
    for (h, _), m in kept.items():
        taken[h] += m
    mass = sum(rep.values()) + len(words) + 1

    def probability(h, w):
        alone = (rep.get(w, 0) + 1) / mass
        if h not in words:
            return alone
        share = math.ceil(taken[h] / words[h] * s.share_steps) / s.share_steps
        return kept.get((h, w), 0) / s.word_base ** lev(words[h], s.word_base) + max(1 - share, 1e-3) * alone

    return words, probability


def test_filter_gives_the_model_of_exact_tables(spark):
    texts = corpus(150, 2)
    sure = lm.Setting(bits_per_entry=40, probes=12)  # next to no false positives
    words, p = reference(texts, sure)
    df = documents(spark, texts + corpus(20, 3) + ["", None, "never seen"])
    got = dict(rows(scored(spark, df, df.where("doc_id < 150"), sure), "doc_id", "score"))
    for i, t in rows(df, "doc_id", "text"):
        w = tokens(t)
        assert got[i] == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip([b"\n", *w], w)), abs=1e-6)
    for h in [*list(words)[:20], b"unseen"]:  # never more than one in all
        assert sum(p(h, w) for w in words) + p(h, b"unseen") <= 1 + 1e-9


def test_bound_of_the_filter_holds(spark):
    df = documents(spark, corpus(60, 4))
    model = lm.train(df, lm.word_counts(df, "text"), s=lm.Setting(most_bytes=2048, shard_tokens=400))
    assert model.shards > 3 and len(model.bits) <= 2048 + 16 * model.shards


def test_a_filter_beyond_the_bound_keeps_its_bits_and_scores(spark):
    texts = [*corpus(300, 7), "", None, "never seen", "w1 w2"]
    df = documents(spark, texts, ids=[*range(len(texts) - 1), None]).repartition(5)
    learned = df.where(fold("doc_id", 7) != 2)
    counts = lm.word_counts(learned, "text").cache()
    whole, parted = (lm.train(learned, counts, s=lm.Setting(shard_tokens=1000, most_bytes=m)) for m in (1 << 20, 512))
    assert whole.stored is None and parted.stored is not None and len(parted.bits) == 0
    assert parted.entries == whole.entries and (parted.word_bits + parted.pair_bits) * parted.shards >= 10 * parted.entries
    a, b = (sorted(rows(lm.score(df, m, counts, most_frequent=3)), key=str) for m in (whole, parted))
    assert len(a) == len(b) == len(texts)
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and y[4:] == pytest.approx(x[4:], abs=1e-9)


def test_splitting_the_work_changes_nothing(spark):
    df = documents(spark, corpus(120, 5))
    counts = lm.word_counts(df, "text").cache()
    a = lm.train(df.coalesce(1), counts, s=lm.Setting(shard_tokens=500))
    b = lm.train(df.repartition(9), counts, s=lm.Setting(shard_tokens=500, buffer=50))
    assert np.array_equal(a.bits, b.bits) and a.entries == b.entries


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64) << np.uint64(1))
    counts = rng.integers(1, 99, len(keys))
    k, c = lm.unsqueezed_pairs(lm.squeezed_pairs(keys, counts))
    assert np.array_equal(k, keys) and np.array_equal(c, counts)
    inner, levels = lm.unsqueezed_entries(lm.squeezed_entries(keys, counts))
    order = np.argsort(keys >> np.uint64(24), kind="stable")
    assert np.array_equal(inner, np.sort(keys >> np.uint64(24))) and np.array_equal(levels, counts[order])
    assert all(len(x) == 0 for x in lm.unsqueezed_entries(lm.squeezed_entries(keys[:0], counts[:0])))


def test_nulls_empty_tables_repeats_and_clashing_columns(spark):
    df = documents(spark, ["a b", "a b", None, "", "x" * 50000, "a " * 20000], ids=[None, 1, 1, 3, 4, 5]).withColumns({"token": F.lit(1), "c": F.lit("z"), "row": F.lit(0)})
    out = rows(scored(spark, df, df), "doc_id", "n_tokens", "n_known")
    assert sorted(out, key=str) == sorted([(None, 3, 3), (1, 3, 3), (1, 1, 1), (3, 1, 1), (4, 2, 2), (5, 20001, 20001)], key=str)
    nothing = rows(scored(spark, df, df.limit(0)), "n_known", "train_tokens", "base_score", "score")
    assert nothing == [(0, 0, 0.0, 0.0)] * 6
    assert scored(spark, df.limit(0), df).count() == 0


def test_hashes_are_those_of_words():
    rng = random.Random(6)
    texts = ["".join(rng.choices("abAB é\t\n\r\x0b\x0c\x1c\x85\xa0", k=rng.choice([0, 1, 5, 200]))) for _ in range(300)] + [None, "", "x" * 300_000, " y"]
    hashes, starts = hashed_words(texts)
    words = [words_of(t) for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    seen = dict(zip(flat, hashes.tolist()))
    assert [seen[w] for w in flat] == hashes.tolist() and len(set(seen.values())) == len(seen)
    assert np.array_equal(np.concatenate([hashed_words([t])[0] for t in texts]), hashes)


def test_query_covers_the_table(spark, sf_dir):
    out = QUERIES["op1_lm_scores"](spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_what_is_done_with_is_off_the_disk(spark):
    df = documents(spark, corpus(200, 8))
    counts = lm.word_counts(df, "text").cache()
    before = stage_folders(spark)
    model = lm.train(df, counts, s=lm.Setting(shard_tokens=500, most_bytes=512))
    filters = stage_folders(spark) - before
    assert model.stored is not None and len(filters) == 1  # bigrams and word entries are in the filter now
    lm.score(df, model, counts).count()
    assert stage_folders(spark) > before | filters
    # The shuffle of a staged write goes with it; the session is as it was.
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, wrote = spark.conf.get(setting, None), shuffle_files(spark)
    staged(spark.range(1000).repartition(7, "id"), cleanup=True)
    assert spark.conf.get(setting, None) == was and not shuffle_files(spark) - wrote


def test_texts_that_ask_together_send_each_key_once(spark):
    texts = [*corpus(200, 9), "", None, "é \U0001f600 " * 300, "w1 w2"]
    df = documents(spark, texts).coalesce(1)
    counts = lm.word_counts(df, "text").cache()
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    before, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")  # small batches reach Python
    try:
        for name, ask, part in ("together", 1 << 20, 400), ("apart", 1, 1 << 20):
            model = lm.train(df, counts, s=lm.Setting(shard_tokens=1000, most_bytes=0, ask_bytes=ask, slice_bytes=part))
            levels = lm.with_levels(numbered, model).select("texts", F.expr("transform(told, x -> x.told)").alias("told")).collect()
            told = sum(len(lm.unsqueezed(t, "u1")[0]) for r in levels for t in r["told"])
            got[name] = len(levels), told, sorted(rows(lm.score(df, model, counts, most_frequent=3)), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got["together"][0] == 1 and got["apart"][0] == -(-len(texts) // 25)
    words, pairs = (len(set(x)) for x in zip(*((w, p) for t in texts for w, p in zip(tokens(t), zip([b"\n", *tokens(t)], tokens(t))))))
    assert got["together"][1] == 2 * words + pairs < got["apart"][1]
    assert got["together"][2] == got["apart"][2]


def test_texts_and_distinct_values_round_trip():
    rng = random.Random(10)
    texts = ["".join(rng.choices("ab é\U0001f600\x00\n", k=rng.choice([0, 1, 30]))) for _ in range(100)] + ["x" * 500, ""]
    for most in 1, 40, 1 << 20:
        parts = list(lm.unsqueezed_texts(lm.squeezed_texts([t.encode() for t in texts]), most))
        assert [t for p in parts for t in p] == texts
        assert all(len(p) == 1 or sum(len(t.encode()) for t in p) <= most for p in parts)
    assert list(lm.unsqueezed_texts(lm.squeezed_texts([]), 9)) == []
    x = np.random.default_rng(2).integers(0, 50, 300).astype(np.uint64)
    assert np.array_equal(lm.distinct(x), np.unique(x)) and len(lm.distinct(x[:0])) == 0


def test_long_ids_beside_a_null_stay_whole(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    df = documents(spark, ["a b", "b c", "c a"], ids=ids).coalesce(1)
    counts = lm.word_counts(df, "text").cache()
    for s in lm.SETTING, lm.APART:
        out = rows(lm.score(df, lm.train(df, counts, s=s), counts), "doc_id")
        assert sorted(out, key=str) == sorted([(i,) for i in ids], key=str)


def test_query_takes_one_way_at_every_size(spark, sf_dir, monkeypatch):
    score, models, before = lm.score, [], stage_folders(spark)
    monkeypatch.setattr(lm, "score", lambda df, model, counts: models.append(model) or score(df, model, counts))
    out = QUERIES["op1_lm_scores"](spark, sf_dir)
    assert models[0].stored is not None and len(models[0].bits) == 0  # the filter was not on the driver
    assert len(stage_folders(spark) - before) == 3  # counts, texts and levels; the filter has been asked
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = docs.where(fold("doc_id", 7) != 2)
    counts = lm.word_counts(learned, "text").cache()
    whole = score(docs, lm.train(learned, counts), counts)
    a, b = (sorted(rows(x.select("doc_id", "n_tokens", "n_known", "score"))) for x in (out, whole))
    assert a == b


def stage_folders(spark):
    return set(glob.glob(f"{checkpoint_folder(spark).removeprefix('file:')}/stage-*"))


def shuffle_files(spark):
    context = spark.sparkContext
    folder = os.environ.get("SPARK_LOCAL_DIRS") or context.getConf().get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*.data", recursive=True))
