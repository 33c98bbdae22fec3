"""Line deduplication with a log-template tree.

A line's path in the tree of fixed depth is its number of tokens and its leading tokens; tokens with a digit are variable
from the start. At a leaf, a token is a constant if enough documents have it at its place and a variable field otherwise;
what remains is the line's template. Counting replaces the one-by-one matching of a log parser: it gives the same
templates in any order of lines, merges partial results and needs no leaf in one place. Lines whose template recurs across
documents are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.llm.common import bounded_parts, staged, temporary_name, words_of

VARIABLE = b"<*>"
_DIGITS = frozenset(b"0123456789")


def masked(line: str) -> list[bytes]:
    """Tokens of a line, those with a digit as variable fields."""
    return [VARIABLE if not _DIGITS.isdisjoint(w) else w for w in words_of(line)]


def _signed(h: int) -> int:
    return h - (1 << 63)


def parsed(df: DataFrame, doc_id: str, text: str, depth: int, min_tokens: int, tokens: bool) -> DataFrame:
    """``doc_id, version, line_no, leaf, line``: a row per line that has tokens, ``leaf`` null if under ``min_tokens``.

    ``line_no`` counts from 0, ``line`` hashes the masked tokens, ``version`` the text. With ``tokens``, instead
    ``leaf, line, tokens`` of the lines that have a leaf.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t, version in zip(batch["doc_id"].tolist(), batch["text"], batch["version"].tolist()):
                for n, one in enumerate(t.split("\n")):
                    words = masked(one)
                    if not words:
                        continue
                    leaf = None
                    if len(words) >= min_tokens:
                        leaf = _signed(xxhash.xxh3_64_intdigest(b"%d " % len(words) + b" ".join(words[:depth])))
                    joined = b" ".join(words)
                    line = _signed(xxhash.xxh3_64_intdigest(joined))
                    if not tokens:
                        rows.append((i, version, n, leaf, line))
                    elif leaf is not None:
                        rows.append((leaf, line, joined.decode()))
            names = ["leaf", "line", "tokens"] if tokens else ["doc_id", "version", "line_no", "leaf", "line"]
            out = pd.DataFrame(rows, columns=names, dtype=object)  # integers with nulls must not become floats
            yield out.drop_duplicates() if tokens else out

    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    texts = texts.where("doc_id IS NOT NULL AND text != ''")
    schema = "leaf long, line long, tokens string" if tokens else "doc_id long, version long, line_no int, leaf long, line long"
    return texts.mapInPandas(cut, schema)


def templates(lines: DataFrame, texts: DataFrame, min_docs: int, min_constant: float) -> DataFrame:
    """``leaf, line, docs``: for lines whose template has at least ``min_constant`` of its tokens constant, the number of
    documents with the template, if it is ``min_docs`` or more.

    ``lines`` and ``texts`` are the two forms of :func:`parsed`. A leaf seen in fewer documents cannot hold a recurring
    template and is left out at once.
    """
    known = lines.where("leaf IS NOT NULL")
    leaves = staged(
        known.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    )
    here = kept = None
    for part in bounded_parts(leaves, "leaf"):
        a, b = known.join(F.broadcast(part), "leaf"), texts.join(F.broadcast(part), "leaf")
        here, kept = (a, b) if here is None else (here.unionByName(a), kept.unionByName(b))
    here = staged(here.select("leaf", "line", "doc_id").distinct())
    kinds = here.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    kinds = staged(kinds.join(kept.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")), ["leaf", "line"]))
    placed = kinds.select("leaf", "line", "docs", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
    constant = placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs)
    constant = constant.where(F.col("token") != VARIABLE.decode()).select("leaf", "at", "token", F.lit(True).alias("constant"))
    shaped = placed.join(constant, ["leaf", "at", "token"], "left").groupBy("leaf", "line").agg(
        F.count("constant").alias("constants"),
        F.count("*").alias("tokens"),
        F.array_sort(F.collect_list(F.when(F.col("constant"), F.struct("at", "token")))).alias("shape"),
    )
    shaped = shaped.where(F.col("constants") >= min_constant * F.col("tokens"))
    shaped = shaped.select("leaf", "line", F.xxhash64("leaf", "shape").alias("template"))
    of_docs = here.join(shaped, ["leaf", "line"]).select("leaf", "template", "doc_id").distinct()
    support = of_docs.groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    return shaped.join(support, ["leaf", "template"]).select("leaf", "line", "docs")


def boilerplate(
    df: DataFrame, doc_id: str, text: str, depth: int, min_tokens: int, min_docs: int, min_constant: float, factor: float
) -> DataFrame:
    """``doc_id, version, n_lines, dropped``: per text with tokens, its lines with tokens and the numbers of those to drop."""
    lines = staged(parsed(df, doc_id, text, depth, min_tokens, False))
    found = templates(lines, parsed(df, doc_id, text, depth, min_tokens, True), min_docs, min_constant)
    rated = lines.join(found, ["leaf", "line"], "left").withColumn("docs", F.coalesce("docs", F.lit(1)))
    per_doc = rated.groupBy("doc_id", "version").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY docs)").alias("usual"),
        F.collect_set(F.when(F.col("docs") >= min_docs, F.struct("line_no", "docs"))).alias("high"),
        F.countDistinct("line_no").alias("n_lines"),
    )
    above = F.filter("high", lambda x: x["docs"] >= factor * F.col("usual"))
    return per_doc.select("doc_id", "version", "n_lines", F.transform(above, lambda x: x["line_no"]).alias("dropped"))


def drop_recurring_lines(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = 3,
    min_tokens: int = 4,
    min_docs: int = 5,
    min_constant: float = 0.7,
    factor: float = 4.0,
) -> DataFrame:
    """``df`` with ``kept_text``, ``n_lines`` and ``n_dropped``; the text column stays as it is.

    A line is dropped if its template is in ``min_docs`` documents or more and in ``factor`` times as many as the median
    line of its own document. The second condition tells boilerplate from copies: in a copied document all lines recur
    alike, so it stays whole for document-level deduplication, and so does a document of one line. Lines of fewer than
    ``min_tokens`` tokens say too little to be templates. ``n_lines`` counts lines with tokens. Null, empty and blank
    texts and null ids keep their text with 0 lines; repeated rows count as one document and get equal results. Existing
    columns of the three names are replaced.
    """
    found = boilerplate(df, doc_id, text, depth, min_tokens, min_docs, min_constant, factor)
    key, version, n, cut = (temporary_name(df, x) for x in ("of", "version", "lines", "cut"))
    found = found.toDF(key, version, n, cut)
    own = temporary_name(df, "own")
    joined = df.withColumn(own, F.xxhash64(text)).join(
        found, (F.col(doc_id).cast("long") == F.col(key)) & (F.col(own) == F.col(version)), "left"
    )
    stays = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(cut, i))
    return joined.withColumns(
        {
            "kept_text": F.when(F.size(F.coalesce(F.col(cut), F.array().cast("array<int>"))) > 0, F.array_join(stays, "\n")).otherwise(F.col(text)),
            "n_lines": F.coalesce(n, F.lit(0)).cast("long"),
            "n_dropped": F.size(F.coalesce(F.col(cut), F.array().cast("array<int>"))).cast("long"),
        }
    ).drop(key, version, n, cut, own)
