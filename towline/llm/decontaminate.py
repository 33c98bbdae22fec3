"""Benchmark decontamination: a prefix-filtered set join with exact verification, DataFrame functions only.

Every window of an item is a set of words that must be contained whole in a document. Ordered by rarity, a set of n words
of which all n must be found has a necessary prefix of n - n + 1 = 1 word: its rarest. So only document words that are
the rarest word of some window are joined. The positions of the word in window and document fix where the window would
start; windows that would begin before or end behind the document are out; the rest is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.llm.common import bounded_parts, staged

# What is between words, given that A-Z count as lower case.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def split_words(text: Column) -> Column:
    """Words in their own case. The first or last entry is empty if the text begins or ends between words."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS)


def count_words(pieces: Column) -> Column:
    """Words among the pieces of :func:`split_words`; only its outer ones can be empty."""
    n = F.size(pieces)
    ends = F.when(pieces[0] == "", 1).otherwise(0) + F.when((n > 1) & (pieces[n - 1] == ""), 1).otherwise(0)
    return (n - ends).cast("long")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """``item_id, words, phrase``: every window of ``window`` consecutive words of an item, or all words of a shorter one."""
    words = F.filter(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), BETWEEN_WORDS), lambda w: w != "")
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), words.alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(window - 1))))
    cut = rows.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("words"))
    return cut.select("item_id", "words", F.concat_ws(" ", "words").alias("phrase")).distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: occurrences in ``docs`` of each ``word`` of the vocabulary, without those that never occur."""
    words = docs.select(F.explode(split_words(F.col(text))).alias("w")).select(F.lower("w").alias("word"))
    counts = None
    for part in bounded_parts(vocabulary, "word"):
        found = words.join(F.broadcast(part), "word").groupBy("word").agg(F.count("*").alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    return counts


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, offset, length, phrase``: each distinct phrase with its rarest word and that word's place in it.

    A phrase with a word that no document has cannot occur and is left out.
    """
    phrases = windows.select("phrase", "words").dropDuplicates(["phrase"])
    parts = phrases.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "w"))
    rated = parts.withColumn("word", F.lower("w")).join(counts, "word", "left")
    rarest = rated.groupBy("phrase").agg(
        F.first("length").alias("length"),
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("r"),
    )
    return rarest.where("r.n > 0").select("r.word", "r.offset", "length", "phrase")


def occurrences(docs: DataFrame, anchors: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, end, phrase``: every place at which a document has a phrase (words counted from 1, both ends in)."""
    pieces = docs.select(F.col(doc_id).alias("doc_id"), split_words(F.col(text)).alias("pieces"))
    # The pieces stay references until a word has met its anchor and its place is possible: one stage, no copies.
    placed = pieces.select("doc_id", "pieces", F.posexplode("pieces").alias("at", "w"))
    found = None
    for part in bounded_parts(anchors, "phrase"):
        start = F.col("at") - F.col("offset") + 1
        met = placed.join(F.broadcast(part), F.lower(placed["w"]) == part["word"]).where(
            (start >= 1) & (start + F.col("length") - 1 <= F.size("pieces"))
        )
        same = lower_ascii(F.concat_ws(" ", F.slice("pieces", start, F.col("length")))) == F.col("phrase")
        hits = met.where(same).select("doc_id", start.alias("start"), (start + F.col("length") - 1).alias("end"), "phrase")
        found = hits if found is None else found.unionByName(hits)
    return found


def covered(spans: Column) -> Column:
    """Number of places inside any of the spans (structs ``start, end``, both in)."""
    begin = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("last"))

    def step(acc: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["end"] - F.greatest(acc["last"], s["start"] - 1))
        return F.struct((acc["hit"] + new).cast("long").alias("hit"), F.greatest(acc["last"], s["end"].cast("long")).alias("last"))

    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: acc["hit"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated``, one row per row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window of ``window`` words of an item (of all its words, if it has
    fewer); ``item_ids`` are the items with such windows as sorted texts. Null and empty texts have no words and no hits;
    an item without words hits nothing; items with equal windows all count. Rows that share an id share the union of
    their hits; a row with a null id has none. Other columns are not looked at.
    """
    windows = item_windows(items, item_id, item_text, window)
    vocabulary = windows.select(F.explode("words").alias("w")).select(F.lower("w").alias("word")).distinct()
    anchors = staged(anchored(windows, word_counts(docs, vocabulary, text)))  # read twice: counted, then joined
    hits = occurrences(docs, anchors, doc_id, text)
    spans = hits.groupBy("doc_id", "phrase").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    named = spans.join(windows.select("phrase", "item_id"), "phrase")
    # Windows of many items repeat their spans; a document's distinct spans are no more than its words times item sizes.
    per_doc = named.groupBy("doc_id").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    per_doc = per_doc.select("doc_id", covered(F.col("spans")).alias("n_hit"), "item_ids")
    none = F.array().cast("array<string>")
    sizes = docs.select(F.col(doc_id).alias("doc_id"), count_words(split_words(F.col(text))).alias("n_words"))
    return sizes.join(per_doc, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
