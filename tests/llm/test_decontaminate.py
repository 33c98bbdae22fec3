from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm import common, decontaminate


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, x in items:
            v = words(x)
            for s in range(max(1, len(v) - 9)) if v else ():
                window = v[s : s + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(name))
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def check(spark, texts, items):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(rows(decontaminate.contamination(documents(spark, texts), df)))
    assert got == sorted(brute(docs, items))


def test_against_brute_force(spark):
    rng = random.Random(6)
    letters = ["to", "be", "or", "not", "é", "Éa", "x1", "日本"]
    items = [(k, " ".join(rng.choices(letters, k=rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(25)]
    items += [(30, None), (31, ""), (32, " .,"), (33, items[0][1]), (34, "K be")]
    texts = [" ".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(30)]
    for _ in range(30):
        parts = [rng.choice(letters) for _ in range(10)] + [rng.choice(items)[1] or ""] + ["END"]
        texts.append(rng.choice([", ", " ", "--"]).join(parts).replace(" ", rng.choice([" ", "\n", "; "])).swapcase())
    texts += [None, "", "...", "k be", "K be", "!to be!" * 500]
    check(spark, texts, items)


def test_parts_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(k, " ".join(f"w{rng.randint(0, 60)}" for _ in range(14))) for k in range(12)]
    texts = [" ".join([f"w{rng.randint(0, 60)}" for _ in range(9)] + [rng.choice(items)[1]]) for _ in range(20)]
    monkeypatch.setattr(common.bounded_parts, "__defaults__", (7,))
    check(spark, texts, items)


def test_only_dataframe_functions(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = decontaminate.contamination(documents(spark, ["zero one two three", "x"]), items)
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_nulls_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "one two"), (None, "three four")], "item_id long, text string")
    docs = documents(spark, ["one two", "one two", "three four"], ids=[None, 2, 2]).withColumns({"word": F.lit(1), "phrase": F.lit(2), "pieces": F.lit(3)})
    got = sorted(rows(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "contaminated"), key=str)
    assert got == [(2, 2, 2, True), (2, 2, 2, True), (None, 2, 0, False)]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert rows(decontaminate.contamination(docs, items.limit(0)), "contaminated") == [(False,)] * 3
