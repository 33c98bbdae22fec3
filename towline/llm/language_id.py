"""Language identification by compression with per-language raw-content dictionaries.

A text belongs to the language whose dictionary lets zstandard write it in the fewest bytes. Dictionaries
are raw text of a bounded sample of labelled rows. A text is cut into blocks that are compressed one by one,
so the dictionary, not the text's own beginning, is what each block is matched against, and memory does not
depend on the text's length. All blocks of a text count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.llm.common import temporary_name

UNDETERMINED = "und"
PREDICTION = "lang string, score double, margin double, narrow boolean"
SHORT_BYTES = 1024
# Bounds of what is told apart, calibrated on learned rows of the test tables: for short texts and for others.
MIN_MARGIN = 0.006, 0.0  # lead on the second language, as a share of the text's bytes
MIN_LEAD = 0.0, 0.003  # the same as a share of the second's compressed bytes, which a repetitive text has few of
MIN_GAIN = 0.15, 0.02  # bytes that the best dictionary saves, as a share of those written without one
MAX_MIXED = 0.03  # bytes lost by one language for all blocks, as a share of those of the best language of each

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """Lower-cased text with everything but letters as single spaces: what dictionaries and texts hold."""
    return _NOT_LETTERS.sub(" ", text).lower()


def learn_dictionaries(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    row_id: str = "doc_id",
    sample_rows: int = 256,
    piece_chars: int = 1024,
    dict_bytes: int = 1 << 16,
    seed: int = 7,
) -> dict[str, bytes]:
    """Raw-content dictionary of every language of ``labelled``.

    Bounded sample: of each language ``sample_rows`` rows, those with the smallest hash of their id, and of
    each the ``piece_chars`` characters in its middle; at most ``dict_bytes`` bytes are kept per language.
    Rows without text, label or id are left out. The driver receives at most ``sample_rows * piece_chars``
    characters per language. Languages come with the most frequent first.
    """
    rows = labelled.select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(row_id), F.lit(seed)).alias("h"), F.col(row_id).alias("i")
    ).where("lang IS NOT NULL AND text IS NOT NULL AND i IS NOT NULL AND text != ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # A hash threshold leaves about four times the sample, so that ranking never sorts a whole language.
    scale = 1 << 30
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, -(-scale * 4 * sample_rows // n)))])
    few = rows.where(F.pmod("h", F.lit(scale)) < limits[F.col("lang")])
    few = few.withColumn("n", F.length("text")).select(
        "lang",
        "h",
        "i",
        F.substring("text", F.greatest(F.lit(1), ((F.col("n") - piece_chars) / 2).cast("int") + 1), F.lit(piece_chars)).alias("piece"),
    )
    sample = few.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("h", "i", "piece"))), 1, sample_rows)["piece"].alias("pieces")
    )
    learned = {r["lang"]: letters_of("\n".join(dict.fromkeys(r["pieces"]))).encode()[-dict_bytes:] for r in sample.collect()}
    return {k: learned[k] for k in sorted(learned, key=lambda k: (-counts[k], k))}


class Compressors:
    """One compressor per language for ordinary blocks and one, with a costlier search, for short texts.

    A short text alone leaves too few bytes to tell languages apart, so it is compressed behind a lead of
    ``LEAD`` bytes of the language's own text, and the bytes that the lead takes alone are subtracted.
    """

    LEAD = 1536

    def __init__(self, dictionaries: dict[str, bytes], level: int, short_level: int) -> None:
        self.names = list(dictionaries)
        self.long = [self._one(d, level) for d in dictionaries.values()]
        self.leads = [d[: min(self.LEAD, len(d) // 2)] for d in dictionaries.values()]
        self.short = [self._one(d[len(x) :], short_level) for d, x in zip(dictionaries.values(), self.leads)]
        self.alone = [len(c.compress(x)) for c, x in zip(self.short, self.leads)]
        self.bare_long, self.bare_short = (
            zstandard.ZstdCompressor(level=n, write_content_size=False, write_checksum=False) for n in (level, short_level)
        )

    @staticmethod
    def _one(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False)

    @staticmethod
    def _blocks(data: bytes, block: int) -> list[bytes]:
        n = -(-len(data) // block)  # blocks of equal length, none of them a short rest
        cuts = [len(data) * k // n for k in range(n + 1)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def by_block(self, data: bytes, block: int) -> list[list[int]]:
        """Compressed bytes of each block of ``data`` by language."""
        if len(data) <= block // 4:
            return [[len(c.compress(x + data)) - n] for c, x, n in zip(self.short, self.leads, self.alone)]
        blocks = self._blocks(data, block)
        return [[len(c.compress(b)) for b in blocks] for c in self.long]

    def sizes(self, data: bytes, block: int) -> list[int]:
        """Compressed bytes of all blocks of ``data`` by language."""
        return [sum(x) for x in self.by_block(data, block)]

    def bare(self, data: bytes, block: int) -> int:
        """Compressed bytes of all blocks of ``data`` without a dictionary."""
        if len(data) <= block // 4:
            return len(self.bare_short.compress(data))
        return sum(len(self.bare_long.compress(b)) for b in self._blocks(data, block))


def predict(
    text: Column | str, dictionaries, level: int = 3, short_level: int = 12, block_bytes: int = 4096
) -> Column:
    """Struct ``lang, score, margin, narrow`` of a text, given a broadcast of :func:`learn_dictionaries`.

    ``lang`` is the language of fewest compressed bytes, ties going to the language learned from most rows, and
    ``und`` (score and margin 0) for a text that is null, has no letter, or when nothing was learned. ``margin`` is the
    saving against the second language as a share of the text's bytes (1 if one language was learned). ``score`` weighs
    each language by two to the power of minus its bytes: the winner's share, near 1 if the margin is wide and one over
    the number of languages if all tie. ``narrow`` tells texts whose language is not clear: two languages tie or nearly
    do, the best dictionary hardly helps (a language not learned, or no language), or blocks are in different languages.
    """

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = Compressors(dictionaries.value, level, short_level)
        for texts in batches:
            yield pd.DataFrame([_judged(t, tools, block_bytes) for t in texts], columns=["lang", "score", "margin", "narrow"])

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)  # evaluated once per row


def _predict_one(text: str | None, tools: Compressors, block: int) -> tuple[str, float, float]:
    return _judged(text, tools, block)[:3]


def _judged(text: str | None, tools: Compressors, block: int) -> tuple[str, float, float, bool]:
    if not text or not tools.names:
        return UNDETERMINED, 0.0, 0.0, True
    letters = letters_of(text)
    if not any(map(str.isalpha, letters)):
        return UNDETERMINED, 0.0, 0.0, True
    data = letters.encode()
    blocks = np.array(tools.by_block(data, block))
    sizes = blocks.sum(axis=1)
    best = int(sizes.argmin())
    score = 1.0 / float(np.exp2(np.maximum(sizes[best] - sizes, -1000.0)).sum())
    second = np.partition(sizes, 1)[1] if len(sizes) > 1 else sizes[best] + len(data)
    lead, bare = int(second - sizes[best]), tools.bare(data, block)
    long = len(data) > SHORT_BYTES
    narrow = (
        lead == 0
        or lead < MIN_MARGIN[long] * len(data)
        or lead < MIN_LEAD[long] * second
        or bare - sizes[best] < MIN_GAIN[long] * bare
        or sizes[best] > (1 + MAX_MIXED) * blocks.min(axis=0).sum()
    )
    return tools.names[best], score, lead / len(data), bool(narrow)


def identify(
    df: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    out: str = "lang_pred",
    min_score: float = 0.4,
    **how: int,
) -> DataFrame:
    """``df`` with ``<out>``, ``<out>_score``, ``<out>_margin`` and ``<out>_rejected``.

    A row is rejected if its language is undetermined or not clear: ``narrow`` by :func:`predict`, or a score below
    ``min_score``. Rows are neither
    dropped nor merged; repeated rows get equal answers. New columns replace existing ones of the same name.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    p = temporary_name(df, "prediction")
    return df.withColumn(p, predict(text, shared, **how)).withColumns(
        {
            out: F.col(p)["lang"],
            f"{out}_score": F.col(p)["score"],
            f"{out}_margin": F.col(p)["margin"],
            f"{out}_rejected": (F.col(p)["lang"] == UNDETERMINED) | (F.col(p)["score"] < min_score) | F.col(p)["narrow"],
        }
    ).drop(p)
