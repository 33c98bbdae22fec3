"""Substring deduplication by hashing lines or paragraphs over the whole corpus.

Texts are cut into units that tile them: lines, or lines and their sentences. Units are normalised and hashed; of each
digest the earliest occurrence (smallest document id, then smallest offset) stays and all others are repeats. Runs of
neighbouring repeats long enough to be a passage are removed; their offsets in the original text are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towline.llm.common import staged, temporary_name, words_of

# Patterns of units; each tiles a text, ends included with what they end.
UNITS = {
    "line": r"[^\n]*\n|[^\n]+\Z",
    "sentence": r"[^\n]*?(?:[.!?]+[ \t]+|\n)|[^\n]+\Z",
    "paragraph": r"(?s:.+?)(?:\n[ \t]*\n\s*|\Z)",
}


def digests(df: DataFrame, doc_id: str, text: str, unit: str) -> DataFrame:
    """``doc_id, unit, start, end, words, h1, h2``: units with offsets in characters and a 128-bit digest of their words.

    Normalised: A-Z lower-cased, ASCII white space between words as one space. Units without words are left out; the others
    are numbered in order, so those on both sides of a blank line are neighbours.
    """
    pattern = re.compile(UNITS[unit])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"].tolist(), batch["text"]):
                n = 0
                for m in pattern.finditer(t):
                    words = words_of(m[0])
                    if words:
                        n += 1
                        h = xxhash.xxh3_128_intdigest(b" ".join(words))
                        rows.append((i, n, m.start(), m.end(), len(words), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "start", "end", "words", "h1", "h2"])

    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text != ''")
    return texts.mapInPandas(cut, "doc_id long, unit int, start int, end int, words int, h1 long, h2 long")


def repeats(units: DataFrame) -> DataFrame:
    """Units that are not the earliest with their digest."""
    firsts = (
        units.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last"))
        .where("first < last")
        .select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    )
    # Written first, so both sides of the join are plain shuffles and adaptive execution can split a very common digest.
    firsts = staged(firsts)
    later = "doc_id > first_doc OR doc_id = first_doc AND start > first_start"
    return units.join(firsts, ["h1", "h2"]).where(later)


def passages(repeated: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, start, end, words, from_doc, from_start``: maximal runs of neighbouring repeats with ``min_words`` words or more.

    Blank lines do not end a run. Where two rows share an id, their equal units count once. ``from_doc`` and ``from_start`` tell where the first unit
    of the run stays.
    """
    unit = repeated.dropDuplicates(["doc_id", "unit", "start", "end"])
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.lag("unit").over(by_doc)
    begins = (F.col("unit") != before + 1) | before.isNull()
    numbered = unit.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(by_doc))
    runs = numbered.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").alias("words"),
        F.min(F.struct("start", "first_doc", "first_start")).alias("f"),
    )
    return runs.where(F.col("words") >= min_words).select(
        "doc_id", "start", "end", F.col("words").cast("int").alias("words"), F.col("f.first_doc").alias("from_doc"), F.col("f.first_start").alias("from_start")
    )


def without(text: Column, removed: Column) -> Column:
    """Text without the spans (sorted structs with ``start`` and ``end``, in characters from 0)."""
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    out = F.aggregate(
        removed,
        begin,
        lambda acc, s: F.struct(
            F.concat(acc["kept"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("kept"), s["end"].alias("at")
        ),
    )
    return F.concat(out["kept"], F.substring(text, out["at"] + 1, F.lit((1 << 31) - 1) - out["at"]))


def repeated_passages(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = 25
) -> DataFrame:
    """``doc_id, start, end, words, from_doc, from_start``: passages to remove, offsets in characters of the original text.

    The earliest occurrence of every unit, by document id and offset, is not among them, so nothing is lost from the
    corpus. A passage may go over blank lines; runs of repeats of fewer than ``min_words`` words stay in the corpus. Null and empty texts and null ids have none. Rows that share an id are one document: a row is no copy of
    itself. Other columns are not looked at.
    """
    return passages(repeats(digests(df, doc_id, text, unit)), min_words)


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = 25) -> DataFrame:
    """``df`` with ``removed`` (array of ``start, end, words, from_doc, from_start``: the passages of
    :func:`repeated_passages`) and ``kept_text``; the text column stays as it is. Rows that share an id lose the same
    spans. Existing columns named ``removed`` or ``kept_text`` are replaced."""
    found = repeated_passages(df, doc_id, text, unit, min_words)
    key, spans = temporary_name(df, "of"), temporary_name(df, "spans")
    per_doc = found.groupBy(F.col("doc_id").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "words", "from_doc", "from_start"))).alias(spans)
    )
    joined = df.join(per_doc, F.col(doc_id).cast("long") == F.col(key), "left")
    none = F.array().cast(per_doc.schema[spans].dataType)
    return joined.withColumns(
        {
            "removed": F.coalesce(spans, none),
            "kept_text": F.when(F.col(spans).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(spans))),
        }
    ).drop(key, spans)
