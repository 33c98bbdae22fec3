"""Token counts of fields or sections by offsets.

A document is encoded once as a whole. Token spans in characters are joined with the spans of its sections: both are
sorted, so each token finds its section by binary search. A token that crosses a border goes to one section by an explicit
rule, so the counts of sections that tile a document add up to the document's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.llm.bpe import encoder

RULES = ("first", "most")
_COUNTED = "array<struct<section:int,start:int,end:int,n_tokens:long,n_crossing:long>>"


def token_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one behind the last, of each token, given the tokens' bytes.

    A character whose bytes are in several tokens is in the span of each of them.
    """
    data = np.frombuffer(text, np.uint8)
    character = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, 0)
    stops = np.cumsum(lengths)
    return character[stops - lengths], character[stops - 1] + 1


def allocate(
    first: np.ndarray, stop: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "first"
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether it crosses a border of its section.

    Sections are sorted and disjoint but need not tile the text. Rule ``first``: the section of the token's first
    character, or else the first section that it reaches. Rule ``most``: the section with most of its characters, the
    earlier of equals. A token of a shared character overlaps every section that has the character.
    """
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    low = np.searchsorted(ends, first, "right")  # first section that ends behind the token's first character
    low = np.where(low < len(starts), low, len(starts) - 1)
    high = np.maximum(np.searchsorted(starts, stop, "left") - 1, 0)  # last section that starts before its end

    def overlap(s: np.ndarray) -> np.ndarray:
        return np.minimum(stop, ends[s]) - np.maximum(first, starts[s])

    section = low.copy()
    if rule == "most":
        best, step = overlap(section), 1
        while (live := low + step <= high).any():
            s = np.where(live, low + step, low)
            better = live & (overlap(s) > best)
            section, best, step = np.where(better, s, section), np.where(better, overlap(s), best), step + 1
    met = overlap(section) > 0
    crossing = met & ((first < starts[section]) | (stop > ends[section]))
    return np.where(met, section, -1), crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines of a text, each with its line feed: they tile the text."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    starts = np.append(0, ends[:-1])
    some = ends > starts
    return starts[some], ends[some]


def counted_column(text: Column, sections: Column | None, vocabulary: str, rule: str) -> Column:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(texts: pd.Series, spans: pd.Series | None, e, lengths: np.ndarray) -> pd.Series:
        clean = [t or "" for t in texts]
        out = []
        for k, packed in enumerate(e.packed(clean)):
            if spans is None:
                starts, ends = line_sections(clean[k])
                numbers = np.arange(len(starts))
            else:
                given = spans.iloc[k]
                rows = sorted((s["start"], s["end"], n) for n, s in enumerate([] if given is None else given) if s["end"] > s["start"])
                starts, ends, numbers = (np.array([r[c] for r in rows], np.int64) for c in range(3))
                if (starts[1:] < ends[:-1]).any():
                    raise ValueError("sections overlap")
            first, stop = token_spans(clean[k].encode(), lengths[np.frombuffer(packed, "<u4")])
            section, crossing = allocate(first, stop, starts, ends, rule)
            inside = section >= 0
            n = np.bincount(section[inside], minlength=len(starts))
            c = np.bincount(section[inside & crossing], minlength=len(starts))
            rows = zip(numbers.tolist(), starts.tolist(), ends.tolist(), n.tolist(), c.tolist())
            out.append([dict(zip(("section", "start", "end", "n_tokens", "n_crossing"), r)) for r in rows])
        return pd.Series(out, dtype=object)

    def tools():
        e = encoder(vocabulary)
        return e, np.array([len(b) for b in e.v.bytes])

    if sections is None:

        @F.pandas_udf(_COUNTED)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            e, lengths = tools()
            for texts in batches:
                yield count(texts, None, e, lengths)
            e.known = {}

        return run.asNondeterministic()(text)

    @F.pandas_udf(_COUNTED)
    def run_given(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        e, lengths = tools()
        for texts, spans in batches:
            yield count(texts, spans, e, lengths)
        e.known = {}

    return run_given.asNondeterministic()(text, sections)


def section_tokens(
    df: DataFrame, vocabulary: str, text: str = "text", sections: str | None = None, rule: str = "first", out: str = "section_tokens"
) -> DataFrame:
    """``df`` with an array of ``section, start, end, n_tokens, n_crossing`` per row.

    Sections are the lines of the text, each with its line feed, or the array of structs ``start, end`` (characters
    from 0, end not included, disjoint, any order) in the column ``sections``, numbered as given; empty ones are left out.
    ``n_tokens`` counts the tokens that the rule of :func:`allocate` gives the section and ``n_crossing`` those of them
    that also reach beyond it; tokens in no section are not counted. A null or empty text has no sections of its own and
    no tokens. Rows stand for themselves; an existing column ``out`` is replaced. Overlapping sections are an error.
    """
    return df.withColumn(out, counted_column(F.col(text), F.col(sections) if sections else None, vocabulary, rule))
