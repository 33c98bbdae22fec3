from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import documents, rows
from towline.llm import bpe
from towline.llm.queries import QUERIES, vocabulary_path

PATH = vocabulary_path()
ODD = [
    "", " ", "  a  b\n\n c \t", "a" * 5000, "日本語 テキスト １２３ ²³½ Ⅷ", "a\x1cb\x85c d", "'s't're don't I'LL", "ﬁ €5 “x” — é́ É",
    "\x00\x01" + "😀" * 50, "12 345 ١٢٣", "<|endoftext|>a<|endoftext|><|endoftext", "x<|endoftext|>", "_a_ __", "ñandú\xa0\xa0x",
    "\r\n\r\n x", "ab" * 3000 + "\n" * 300,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equals_the_library(spark, library):
    rng = random.Random(1)
    words = [" ".join("".join(rng.choices("the an ing er tion é ñ ß qu 1 2 .".split(" "), k=rng.randint(1, 6))) for _ in range(50)) for _ in range(60)]
    noise = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x4E00, 0x4F00)])) for _ in range(200)) for _ in range(60)]
    texts = ODD + words + noise
    out = bpe.decode(bpe.encode(documents(spark, texts), PATH), PATH).orderBy("doc_id")
    for t, want, (packed, n, text) in zip(texts, expected(library, texts), rows(out, "ids", "n_tokens", "decoded")):
        assert ids_of(packed) == want and n == len(want)
        assert text == t == library.decode(want, skip_special_tokens=False)


def test_verification_agrees_with_exact_merging():
    v = bpe.encoder(PATH).v
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 14))).encode() for _ in range(3000)]
    proposed, failing = v.encode_words(words)
    assert proposed == [v.merge(w) for w in words]
    assert 0 < failing < len(words)
    # A word fails if and only if its greedy cut is not its encoding.
    assert failing == sum(v.greedy(w) != v.merge(w) for w in words)


def test_long_words_merge_like_short_ones():
    v = bpe.encoder(PATH).v
    rng = random.Random(3)
    for n in (1, 2, 30, 64):
        ids = [v.byte_id[b] for b in bytes(rng.choices(b"aeiou ths", k=n))]
        word = b"".join(v.bytes[i] for i in ids)
        assert v._merge_long(list(ids)) == v.merge(word)


def test_quick_pattern_is_the_pattern_on_common_characters():
    common = [chr(c) for c in range(0x3000) if not bpe._uncommon.search(chr(c))]
    assert len(common) > 500
    for quick, full in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"), (r"(?:[^\s\w]|_)", r"[^\s\p{L}\p{N}]")):
        q, f = re.compile(quick), regex.compile(full)
        assert [c for c in common if bool(q.fullmatch(c)) != bool(f.fullmatch(c))] == []


def test_forgetting_changes_nothing():
    v = bpe.encoder(PATH).v
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(20)]
    small, large = bpe.Encoder(v, most=50), bpe.Encoder(v)
    assert [x for t in texts for x in small.packed([t])] == list(large.packed(texts))
    assert len(small.known) <= 50


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, [None, "", "hi", "hi"], ids=[1, None, 3, 3]).withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "extra": F.lit(2)})
    out = rows(bpe.decode(bpe.encode(docs, PATH), PATH), "n_tokens", "decoded", "extra")
    assert out == [(0, "", 2), (0, "", 2), (1, "hi", 2), (1, "hi", 2)]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert rows(bpe.decode(docs.select(F.lit(None).cast("binary").alias("ids")).limit(1), PATH), "decoded") == [(None,)]


def test_round_trip_is_encode_and_decode_by_one_python_function(spark, sf_dir):
    docs = documents(spark, [*ODD, None], ids=[*range(len(ODD)), None]).withColumns({"ids": F.lit(1), "both": F.lit("x")})
    out = bpe.round_trip(docs, PATH)
    columns = ["doc_id", "both", "text", "ids", "n_tokens", "decoded"]
    assert rows(out, *columns) == rows(bpe.decode(bpe.encode(docs, PATH), PATH), *columns)
    stage = dict(corpus_pipeline.STAGES)["BPE encoding and decoding"]
    for df in (stage(spark, docs, sf_dir), QUERIES["op3_bpe_round_trip"](spark, sf_dir)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
