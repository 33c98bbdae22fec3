"""Registered queries of the operators, each over the whole of its table, with comparison SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from towline.llm import (
    alignment,
    bit_sliced,
    bloom_lm,
    bpe,
    decontaminate,
    html_tree,
    language_id,
    line_templates,
    minhash,
    passage_dedup,
    periodic_runs,
    simhash,
    token_counts,
)
from towline.llm.common import discard, fold, read_table, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, found without loading anything."""
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


def registered(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@registered
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model and under word counts, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    learned = docs.where(fold("doc_id", 7) != 2)
    counts = staged(bloom_lm.word_counts(learned, "text"), cleanup=True)
    model = bloom_lm.train(learned, counts, s=bloom_lm.APART)
    scored = bloom_lm.score(docs, model, counts)
    discard(model.stored)  # has been asked
    return scored.withColumn("held_out", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))


@registered
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_tree.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@registered
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    path = vocabulary_path()
    decoded = bpe.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@registered
def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, the document encoded as a whole; one row with nulls if it has no lines."""
    counted = token_counts.section_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path())
    return counted.select("doc_id", F.explode_outer("section_tokens").alias("s")).select("doc_id", "s.*")


@registered
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of near duplicates it belongs to."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


SQL["op5_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[s : s + 4] AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


@registered
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and the items."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op6_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS words
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(words) AS n FROM windows),
places AS (
  SELECT doc_id, s, n, w[s : s + n - 1] AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (words)),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@registered
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    dictionaries = language_id.learn_dictionaries(docs.where(fold("doc_id", 5) != 0))
    predicted = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    return predicted.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "lang_pred",
        F.col("lang_pred_score").alias("score"),
        F.col("lang_pred_rejected").alias("rejected"),
    )


@registered
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as recurring templates, and what stays."""
    cleaned = line_templates.drop_recurring_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL["op8_line_templates"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
masked AS (
  SELECT doc_id, n, line,
         list_transform(list_filter(regexp_split_to_array(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''),
           lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w
  FROM lines),
known AS (SELECT *, (len(w), w[1:3]) AS leaf FROM masked WHERE len(w) >= 4),
kinds AS (SELECT leaf, w, count(DISTINCT doc_id) AS docs FROM known GROUP BY ALL),
placed AS (SELECT leaf, w, docs, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM kinds),
constant AS (
  SELECT leaf, place, token FROM placed WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 5),
shaped AS (
  SELECT p.leaf, p.w, count(c.token) AS constants, list((p.place, p.token) ORDER BY p.place) FILTER (WHERE c.token IS NOT NULL) AS shape
  FROM placed p LEFT JOIN constant c ON p.leaf = c.leaf AND p.place = c.place AND p.token = c.token GROUP BY ALL),
fixed AS (SELECT * FROM shaped WHERE constants >= 0.7 * len(w)),
support AS (
  SELECT leaf, shape, count(DISTINCT doc_id) AS docs FROM known JOIN fixed USING (leaf, w) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
found AS (SELECT leaf, w, docs FROM fixed JOIN support USING (leaf, shape)),
rated AS (
  SELECT m.doc_id, m.n, m.line, len(m.w) AS tokens, coalesce(f.docs, 1) AS docs
  FROM masked m LEFT JOIN found f ON (len(m.w), m.w[1:3]) = f.leaf AND m.w = f.w),
usual AS (SELECT doc_id, quantile_disc(docs, 0.5) AS usual FROM rated WHERE tokens > 0 GROUP BY doc_id),
decided AS (
  SELECT r.*, coalesce(tokens > 0 AND docs >= 5 AND docs >= 4 * usual, false) AS dropped FROM rated r LEFT JOIN usual USING (doc_id))
SELECT doc_id, CAST(coalesce(sum(CASE WHEN tokens > 0 THEN 1 END), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(CASE WHEN dropped THEN 1 END), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM documents LEFT JOIN decided USING (doc_id) GROUP BY doc_id"""


@registered
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of largest integer inner product with every query vector."""
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % 50 == 0)  # the query set; candidates are all rows
    found = bit_sliced.top_k(queries, vectors, 5, "vec_id", "embedding")
    return found.select("query_id", "rank", "vec_id", "score")


SQL["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores
QUALIFY rank <= 5"""


@registered
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats an earlier one, with its offsets and the document that keeps it."""
    return passage_dedup.repeated_passages(read_table(spark, sf_dir, "documents", "doc_id", "text"))


SQL["op10_repeated_passages"] = r"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS u, generate_subscripts(p, 1) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*?(?:[.!?]+[ \t]+|\n)|[^\n]+\z') AS p FROM documents WHERE text <> '')),
placed AS (
  SELECT doc_id, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY n) AS stop, length(u) AS size,
         list_filter(regexp_split_to_array(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM pieces),
units AS (
  SELECT doc_id, CAST(stop - size AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, w, len(w) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY stop) AS unit
  FROM placed WHERE len(w) > 0),
firsts AS (SELECT w, min((doc_id, start)) AS f FROM units GROUP BY w),
repeated AS (
  SELECT doc_id, unit, start, stop, words, f[1] AS first_doc, f[2] AS first_start
  FROM units JOIN firsts USING (w) WHERE (doc_id, start) > f),
runs AS (
  SELECT *, sum(CASE WHEN unit = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run
  FROM (SELECT *, lag(unit) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM repeated))
SELECT doc_id, min(start) AS start, max(stop) AS "end", CAST(sum(words) AS INTEGER) AS words,
       arg_min(first_doc, start) AS from_doc, arg_min(first_start, start) AS from_start
FROM runs GROUP BY doc_id, run HAVING sum(words) >= 25"""


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document, by the crc32 ``h`` of its id, repeats a stretch of its words to its end.

    With g = h div 10, words from place a = g mod n on become those from a on, repeated with period 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n, a, p = F.size("w"), F.col("a"), F.col("p")
    chosen = chosen.withColumn("a", (F.col("g") % F.greatest(n, F.lit(1))).cast("int"))
    chosen = chosen.withColumn("p", (F.floor((n - a) / (3 + F.col("g") % 8)) + 1).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return chosen.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


@registered
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of them with a periodic tail."""
    docs = with_periodic_tails(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@registered
def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component of fingerprints within three bits that it belongs to."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@registered
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers in every document, and how common their links are in all documents."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    aligned = alignment.align(docs, vocabulary_path(), vocabulary_path("piece_bpe_32k.model")).drop("text")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = staged(aligned.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()))
    counted = alignment.scored(aligned, "row", alignment.pair_counts(aligned))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
