from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helpers import documents, rows
from towline.llm.common import fold
from towline.llm.language_id import UNDETERMINED, identify, learn_dictionaries, letters_of

SYLLABLES = {"aa": "the an ing er tion st re", "bb": "que eau oi ment ier ou ch", "cc": "ung sch der ein keit zu pf"}


def text(rng, lang, words):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    return documents(spark, [text(rng, g, rng.randint(5, 200)) for g in langs], langs).cache()


def test_held_out_accuracy(spark, labelled):
    d = learn_dictionaries(labelled.where(fold("doc_id", 5) != 0))
    assert sorted(d) == sorted(SYLLABLES)
    told = identify(labelled.where(fold("doc_id", 5) == 0), d)
    right = told.where("lang = lang_pred").count()
    assert right >= 0.98 * told.count()
    assert told.where("lang_pred_score < 0 OR lang_pred_score > 1").count() == 0


def test_case_symbols_and_length_do_not_matter(spark, labelled):
    d = learn_dictionaries(labelled)
    rng = random.Random(4)
    base = text(rng, "bb", 60)
    long = " ".join(text(rng, "cc", 1000) for _ in range(30))
    got = rows(identify(documents(spark, [base, base.upper(), base.replace(" ", "!! 12 "), long]), d), "lang_pred")
    assert got == [("bb",), ("bb",), ("bb",), ("cc",)]


def test_undetermined_and_ties(spark, labelled):
    d = learn_dictionaries(labelled)
    out = rows(identify(documents(spark, [None, "", " \n", "12 + 3 = ?", "²³"]), d), "lang_pred", "lang_pred_score", "lang_pred_rejected")
    assert out == [(UNDETERMINED, 0.0, True)] * 5
    same = {"x": b"abc " * 500, "y": b"abc " * 500}
    (name, score, rejected), = rows(identify(documents(spark, ["zzz"]), same, min_score=0.6), "lang_pred", "lang_pred_score", "lang_pred_rejected")
    assert (name, score, rejected) == ("x", 0.5, True)


def test_narrow_margins_are_rejected_at_the_default(spark, labelled):
    d, rng = learn_dictionaries(labelled), random.Random(5)
    clear = [text(rng, g, n) for g in SYLLABLES for n in (20, 150, 3000)]
    mixed = [text(rng, a, n) + " " + text(rng, b, n) for a, b in (("aa", "bb"), ("bb", "cc"), ("cc", "aa")) for n in (1500, 6000)]
    other = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=3000))
    unlearned = ["".join(rng.choices("абвгдежзик  ", k=300)), other]
    out = rows(identify(documents(spark, [*clear, *mixed, *unlearned]), d), "lang_pred_rejected")
    assert out == [(False,)] * len(clear) + [(True,)] * (len(mixed) + len(unlearned))
    tie = {"x": b"abc " * 500, "y": b"abc " * 500}
    assert rows(identify(documents(spark, ["zzz", "abc abc abc"]), tie), "lang_pred", "lang_pred_rejected") == [("x", True)] * 2


def test_empty_tables_repeated_rows_and_clashing_columns(spark, labelled):
    empty = labelled.limit(0)
    assert learn_dictionaries(empty) == {}
    assert learn_dictionaries(labelled.withColumn("lang", F.lit(None).cast("string"))) == {}
    d = learn_dictionaries(labelled)
    assert identify(empty, d).count() == 0
    assert rows(identify(labelled.limit(3), {}), "lang_pred") == [(UNDETERMINED,)] * 3
    twice = documents(spark, ["theing antion", "theing antion"], ids=[1, 1]).withColumns({"lang_pred": F.lit(5), "prediction": F.lit(6), "h": F.lit(7)})
    out = identify(twice, d)
    assert len(set(rows(out, "lang_pred", "lang_pred_score"))) == 1 and out.count() == 2
    assert rows(out, "prediction", "h") == [(6, 7)] * 2


def test_sample_is_bounded_and_stable(spark, labelled):
    a = learn_dictionaries(labelled, sample_rows=5, dict_bytes=500)
    assert all(len(x) <= 500 for x in a.values())
    assert a == learn_dictionaries(labelled.repartition(7), sample_rows=5, dict_bytes=500)


def test_letters():
    assert letters_of("Ab-c_1 É") == "ab c é"
