from __future__ import annotations

import random

from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm.line_templates import drop_recurring_lines, masked


def body(rng, n=6):
    return [" ".join(f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(12)) for _ in range(n)]


def test_fields_are_generalised_and_templates_dropped(spark):
    rng = random.Random(8)
    names = ["ann", "bob", "cy", "dee", "eve", "fay", "gus", "hal"]
    texts = ["\n".join([*body(rng), f"Posted on 2020-01-0{k} by {n} at the site today", *body(rng, 2)]) for k, n in enumerate(names)]
    texts += ["\n".join(body(rng)) for _ in range(5)]
    out = rows(drop_recurring_lines(documents(spark, texts)).orderBy("doc_id"), "text", "kept_text", "n_lines", "n_dropped")
    for text, kept, n, dropped in out[:8]:
        assert (n, dropped) == (9, 1)
        assert kept == "\n".join(x for x in text.split("\n") if not x.startswith("Posted"))
    assert all(text == kept and dropped == 0 for text, kept, _, dropped in out[8:])


def test_copies_stay_whole(spark):
    rng = random.Random(9)
    page = "\n".join(body(rng))
    footer = "all rights reserved by this company"
    texts = [page] * 8 + ["\n".join([*body(rng), footer]) for _ in range(40)] + [page + "\n" + footer] * 6 + [footer] * 9
    out = rows(drop_recurring_lines(documents(spark, texts)).orderBy("doc_id"), "kept_text", "n_dropped")
    assert out[:8] == [(page, 0)] * 8
    assert all(n == 1 and footer not in t for t, n in out[8:48])
    assert out[54:] == [(footer, 0)] * 9  # a document of one line is left to document-level deduplication


def test_support_counts_documents_not_lines(spark):
    line = "the very same line here"
    rng = random.Random(10)
    texts = ["\n".join([line] * 20 + body(rng, 30))] + ["\n".join(body(rng)) for _ in range(6)]
    assert rows(drop_recurring_lines(documents(spark, texts)).where("n_dropped > 0")) == []


def test_nulls_blank_lines_repeats_and_clashing_columns(spark):
    line = "this line is on every page"
    rng = random.Random(11)
    texts = [f"\n{line}\n\n{body(rng, 1)[0]}\n\n{body(rng, 1)[0]}\n" for _ in range(6)] + [None, "", "\n\n", " "]
    ids = [0, 1, 2, 3, 4, None, 6, 7, 8, 9]
    docs = documents(spark, texts, ids=ids)
    docs = docs.union(docs.where("doc_id = 1")).withColumns({"kept_text": F.lit(1), "leaf": F.lit(2), "of": F.lit(3), "lines": F.lit(4)})
    out = rows(drop_recurring_lines(docs), "doc_id", "text", "kept_text", "n_lines", "n_dropped", "leaf", "of")
    assert len(out) == 11
    for i, text, kept, n, dropped, leaf, of in out:
        assert (leaf, of) == (2, 3)
        if i in range(5):
            assert (n, dropped) == (3, 1) and kept == text.replace(line + "\n", "")
        else:
            assert (kept, n, dropped) == (text, 0, 0)
    assert drop_recurring_lines(docs.limit(0)).count() == 0


def test_masked():
    assert masked("On 2020-01-01 A b7 c") == [b"on", b"<*>", b"a", b"<*>", b"c"]
