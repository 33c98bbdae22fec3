from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import documents, rows
from towline.llm import token_counts
from towline.llm.bpe import encoder
from towline.llm.queries import vocabulary_path

PATH = vocabulary_path()


def brute(offsets, sections, rule):
    """Tokens and crossing tokens per section, one token after the other."""
    n, c = [0] * len(sections), [0] * len(sections)
    for a, b in offsets:
        over = [min(b, e) - max(a, s) for s, e in sections]
        hit = [k for k, o in enumerate(over) if o > 0]
        if hit:
            k = hit[0] if rule == "first" else max(hit, key=lambda k: (over[k], -k))
            n[k] += 1
            c[k] += a < sections[k][0] or b > sections[k][1]
    return list(zip(n, c))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_given_sections_against_brute_force(spark, rule):
    rng = random.Random(5)
    library = Tokenizer.from_file(PATH)
    texts = ["".join(rng.choices(["the", "ing", " ", "é", "日", "😀", "\n", "12"], k=rng.randint(1, 80))) for _ in range(40)]
    data, want = [], []
    for i, t in enumerate(texts):
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, rng.randint(2, 6))))
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        want.append(brute(library.encode(t, add_special_tokens=False).offsets, spans, rule))
        data.append((i, t, spans))
    df = spark.createDataFrame(data, "doc_id long, text string, spans array<struct<start:int,end:int>>")
    out = token_counts.section_tokens(df, PATH, sections="spans", rule=rule).orderBy("doc_id")
    assert [[(s.n_tokens, s.n_crossing) for s in r.section_tokens] for r in out.collect()] == want


def test_lines_add_up_and_edges(spark):
    texts = [None, "", "\n", "one\ntwo three\n\nfour", "no end", "x" * 30000 + "\ny"]
    out = rows(token_counts.section_tokens(documents(spark, texts), PATH).orderBy("doc_id"), "text", "section_tokens")
    library = Tokenizer.from_file(PATH)
    for text, sections in out:
        if not text:
            assert sections == []
            continue
        assert sum(s.n_tokens for s in sections) == len(library.encode(text, add_special_tokens=False).ids)
        assert sections[0].start == 0 and sections[-1].end == len(text)
        assert all(a.end == b.start for a, b in zip(sections, sections[1:]))
    assert token_counts.section_tokens(documents(spark, []), PATH).count() == 0


def test_rules_differ_on_a_crossing_token():
    first, stop = np.array([0, 3]), np.array([5, 9])
    starts, ends = np.array([0, 4]), np.array([4, 9])
    assert token_counts.allocate(first, stop, starts, ends, "first")[0].tolist() == [0, 0]
    assert token_counts.allocate(first, stop, starts, ends, "most")[0].tolist() == [0, 1]
    with pytest.raises(ValueError):
        token_counts.counted_column(None, None, PATH, "middle")


def test_overlapping_sections_are_refused(spark):
    df = spark.createDataFrame([("abc", [(0, 2), (1, 3)])], "text string, s array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="overlap"):
        token_counts.section_tokens(df, PATH, sections="s").collect()


def test_spans_equal_the_library():
    e, library = encoder(PATH), Tokenizer.from_file(PATH)
    lengths = np.array([len(b) for b in e.v.bytes])
    for text in ("a\nb\n\n", "😀😀\n日本\n", "ñandú — “x”"):
        packed = next(e.packed([text]))
        got = token_counts.token_spans(text.encode(), lengths[np.frombuffer(packed, "<u4")])
        assert list(zip(*(x.tolist() for x in got))) == [tuple(o) for o in library.encode(text, add_special_tokens=False).offsets]
