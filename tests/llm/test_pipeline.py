from __future__ import annotations

import hashlib
import struct
from collections import Counter, defaultdict

import corpus_pipeline
import test_decontaminate
import test_minhash
from helpers import documents, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from towline.llm import language_id
from towline.llm.line_templates import VARIABLE, masked
from towline.llm.queries import QUERIES, SQL, vocabulary_path


def brute_lines(docs, min_docs=5):
    """Texts without recurring templates, one line after the other."""
    lines = [(i, n, x, tuple(masked(x))) for i, t in docs for n, x in enumerate((t or "").split("\n"))]
    known = [(i, (len(w), w[:3]), w) for i, _, _, w in lines if len(w) >= 4]
    kinds = defaultdict(set)
    for i, leaf, w in known:
        kinds[leaf, w].add(i)
    at = Counter()
    for (leaf, w), ids in kinds.items():
        for p, token in enumerate(w):
            at[leaf, p, token] += len(ids)
    shapes, support = {}, defaultdict(set)
    for (leaf, w), ids in kinds.items():
        shape = tuple(t if t != VARIABLE and at[leaf, p, t] >= min_docs else None for p, t in enumerate(w))
        if sum(x is not None for x in shape) >= 0.7 * len(w):
            shapes[w] = leaf, shape
            support[leaf, shape] |= ids
    rate = lambda w: n if w in shapes and (n := len(support[shapes[w]])) >= min_docs else 1
    out = []
    for i, t in docs:
        own = [(x, rate(tuple(masked(x))), bool(masked(x))) for x in (t or "").split("\n")]
        rates = sorted(r for _, r, some in own if some)
        usual = rates[(len(rates) - 1) // 2] if rates else 1
        kept = [x for x, r, some in own if not (some and r >= min_docs and r >= 4 * usual)]
        out.append((i, t if t is None or len(kept) == len(own) else "\n".join(kept)))
    return out


def brute(spark, df, items):
    dictionaries = language_id.learn_dictionaries(df)
    tools = language_id.Compressors(dictionaries, 3, 12)
    docs = []
    for i, t in sorted(rows(df, "doc_id", "text")):
        name, score, _ = language_id._predict_one(t, tools, 4096)
        if name != language_id.UNDETERMINED and score >= 0.4:
            docs.append((i, t))
    docs = brute_lines(docs)
    near = test_minhash.brute(docs)
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    bad = {r[0] for r in test_decontaminate.brute(docs, items) if r[-1]}
    library = Tokenizer.from_file(vocabulary_path())
    out = []
    for i, t in docs:
        if i not in bad:
            ids = library.encode(t or "", add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
            text = library.decode(ids, skip_special_tokens=False)
            out.append((i, len(t), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(corpus_pipeline.run(spark, sf_dir), "doc_id", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(got) == brute(spark, docs, rows(items, "item_id", "text"))


def test_stages_keep_the_columns_and_stand_odd_rows(spark, sf_dir):
    line = "the same words on every page"
    unlike = [" ".join(f"the{k}an{j} ing" for j in range(20)).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(9)]
    texts = [None, "", "...", *(f"{line}\n{u}\n{u} more" for u in unlike), unlike[0], "x" * 100_000, unlike[3] + " ", unlike[3]]
    docs = documents(spark, texts)
    docs = docs.union(docs.select(F.lit(None).cast("long"), *docs.columns[1:]).limit(4))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        docs = stage(spark, docs, sf_dir).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "line dedup":
            assert docs.where(F.col("text").contains(line) & F.col("doc_id").isNotNull()).count() == 0
    assert docs.where("doc_id IS NULL").count() == 1
    assert docs.select("doc_id").distinct().count() == docs.count()


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(SQL) == {n for n in QUERIES if n.split("_")[0] in ("op5", "op6", "op8", "op9", "op10")}


def test_queries_equal_their_sql(spark, sf_dir):
    import oracle

    con = oracle.connect(sf_dir)
    for name, sql in SQL.items():
        assert oracle.compare(QUERIES[name](spark, sf_dir), con, sql) is None, name
