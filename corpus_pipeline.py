"""Corpus pipeline over ``documents``: language, boilerplate lines, near duplicates, benchmark leaks, token ids.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the last one token ids. Between
stages the documents are written as Parquet to the shared folder and read again. Null ids are carried along; the stages
are those operators of ``towline.llm`` with their own answers to nulls, empty tables and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towline.llm import bpe, decontaminate, language_id, line_templates, minhash
from towline.llm.common import bound_batches, read_table, staged
from towline.llm.queries import vocabulary_path


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents but those of the ids; rows with a null id stay."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; rejected are texts without letters and narrow margins."""
    bound_batches(spark)
    dictionaries = language_id.learn_dictionaries(docs)
    told = language_id.identify(docs, dictionaries, out="told")
    return told.where(~F.col("told_rejected")).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template recurs across documents; ``n_chars`` follows."""
    bound_batches(spark)
    cleaned = line_templates.drop_recurring_lines(docs)
    texts = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return cleaned.withColumns(texts).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    bound_batches(spark)
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text they decode to."""
    bound_batches(spark)
    path = vocabulary_path()
    decoded = bpe.round_trip(docs, path)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_boilerplate),
    ("near duplicates", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

# Compression sizes and token ids are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, from the whole table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
