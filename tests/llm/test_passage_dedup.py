from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm.passage_dedup import UNITS, deduplicate, repeated_passages


def brute(docs, unit, min_words):
    """Units in order of ids and offsets; what was seen before is a repeat, adjoining repeats are one passage."""
    seen, out = {}, []
    for i, t in sorted((i, t) for i, t in docs if t):
        run = []
        for m in re.finditer(UNITS[unit], t):
            w = tuple(m[0].encode().lower().split())
            if not w:
                continue
            if w in seen and run:  # a unit that is new has ended the run
                run.append((m.start(), m.end(), len(w), *seen[w]))
            else:
                out += [run] if run else []
                run = [(m.start(), m.end(), len(w), *seen[w])] if w in seen else []
            seen.setdefault(w, (i, m.start()))
        out += [run] if run else []
        out = [(i, r[0][0], r[-1][1], sum(x[2] for x in r), r[0][3], r[0][4]) if isinstance(r, list) else r for r in out]
    return sorted(r for r in out if r[3] >= min_words)


def texts(seed):
    rng = random.Random(seed)
    sentences = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 15))) + rng.choice([".", "!", "?!"]) for _ in range(60)]
    out = []
    for _ in range(50):
        lines = [" ".join(rng.choices(sentences, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        t = rng.choice(["\n", "\n\n", " \n"]).join(lines)
        out.append(t.upper() if rng.random() < 0.2 else t)
    return out


@pytest.mark.parametrize("unit,min_words", [("sentence", 12), ("line", 1), ("paragraph", 5)])
def test_against_brute_force(spark, unit, min_words):
    docs = list(enumerate(texts(1)))
    df = documents(spark, [t for _, t in docs])
    want = brute(docs, unit, min_words)
    assert sorted(rows(repeated_passages(df, unit=unit, min_words=min_words))) == want and want
    for t, removed, kept in rows(deduplicate(df, unit=unit, min_words=min_words), "text", "removed", "kept_text"):
        left, at = "", 0
        for s in removed:
            left, at = left + t[at : s.start], s.end
        assert kept == left + t[at:]


def test_units_tile_texts():
    for t in [*texts(2), "a.b. c", "x\n", "no end", "😀. é!\n\n  z"]:
        for pattern in UNITS.values():
            assert "".join(m[0] for m in re.finditer(pattern, t)) == t


def test_planted_passage_inside_paragraphs(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(9)) + ". "
    passage = "".join(sentence() for _ in range(7))
    docs = ["".join(sentence() for _ in range(5)) + (passage if k % 2 else "") + sentence() for k in range(10)]
    got = rows(repeated_passages(documents(spark, docs)), "doc_id", "words", "from_doc")
    assert sorted(got) == [(k, 63, 1) for k in (3, 5, 7, 9)]


def test_passages_go_over_blank_lines(spark):
    paragraphs = [" ".join(f"p{k}w{j}" for j in range(20)) for k in range(5)]
    for between in ("\n", "\n\n", "\n \n\t\n"):
        text = between.join(paragraphs)
        got = rows(repeated_passages(documents(spark, [text, "Own words first.\n" + text])))
        assert got == [(1, 17, 17 + len(text), 100, 0, 0)]
    apart = f"{paragraphs[0]}\n\nown words\n\n{paragraphs[1]}"
    assert rows(repeated_passages(documents(spark, ["\n".join(paragraphs), apart]))) == []


def test_nulls_repeats_empty_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(40)) + ".\n"
    docs = documents(spark, [long, long, long, None, "", long], ids=[None, 2, 2, 3, 4, 5])
    docs = docs.withColumns({"removed": F.lit(1), "start": F.lit(2), "of": F.lit(3), "h1": F.lit(4)})
    assert rows(repeated_passages(docs)) == [(5, 0, len(long), 40, 2, 0)]
    out = {(i, t): (k, len(r), o) for i, t, k, r, o in rows(deduplicate(docs), "doc_id", "text", "kept_text", "removed", "of")}
    assert out == {(None, long): (long, 0, 3), (2, long): (long, 0, 3), (3, None): (None, 0, 3), (4, ""): ("", 0, 3), (5, long): ("", 1, 3)}
    assert repeated_passages(docs.limit(0)).count() == 0 == deduplicate(docs.limit(0)).count()


def test_very_long_texts(spark):
    long = "word " * 200_000
    assert rows(repeated_passages(documents(spark, [long, long + "x", long])), "doc_id", "words", "from_doc") == [(2, 200_000, 0)]
