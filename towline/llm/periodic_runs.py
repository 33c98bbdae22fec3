"""Periodic runs of words: longest common extensions over a difference cover drive a harmonic grid of candidate periods.

A run of period p compares equal with itself p words on over a stretch of three periods and more, so it holds a point of a
grid of that step; over all periods the grids have n log n / 3 points. Two such points are extended to both sides. An
extension compares few words until both places lie in the cover's sample; from there the sorted sample's common prefixes,
asked by a sparse table of minima, tell the rest at once. Only places of the sample are sorted, and only of documents in
which some point of the grid is promising.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.llm.common import temporary_name

# A perfect difference set. Every difference modulo the period is one of two of its members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
# Runs are at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Grid points looked at together.
POINTS = 1 << 20


def _steps_to_cover() -> np.ndarray:
    """Steps that take places i and j into the sample both, by i and j - i modulo the period."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    steps = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for d in range(PERIOD):
            steps[i, d] = next(s for s in range(PERIOD) if inside[i + s] and inside[(i + d + s) % PERIOD])
    return steps


_STEPS = _steps_to_cover()


class Extensions:
    """Longest common extensions to the right of places of a sequence that ends with an element found nowhere else."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.n = len(sequence)
        last = int(sequence.max()) + 1 if self.n else 0
        self.w = np.concatenate([sequence, last + np.arange(2 * PERIOD)]).astype(np.int64)
        self.table: list[np.ndarray] | None = None

    def _sort_sample(self) -> None:
        """Order of the sampled suffixes, and the common prefixes of neighbours in that order with their minima."""
        at = np.flatnonzero(np.isin(np.arange(self.n) % PERIOD, COVER))
        m = len(at)
        index = np.full(self.n + 2 * PERIOD, m)
        index[at] = np.arange(m)
        # Big-endian bytes compare as the words do.
        blocks = np.lib.stride_tricks.sliding_window_view(self.w.astype(">u4"), PERIOD)[at]
        _, rank = np.unique(np.ascontiguousarray(blocks).view(f"V{4 * PERIOD}").ravel(), return_inverse=True)
        following = np.append(index[at + PERIOD], m)  # a place of the sample and the next of its class; m: none
        levels, nexts = [np.append(rank + 1, 0)], [following]
        while levels[-1].max() < m:  # prefix doubling until all are told apart
            r, f = levels[-1], nexts[-1]
            _, doubled = np.unique(r[:m] * (m + 1) + r[f[:m]], return_inverse=True)
            levels.append(np.append(doubled + 1, 0))
            nexts.append(f[f])
        order = np.argsort(levels[-1][:m])
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        i, j, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][i] == levels[k][j]) & (i < m) & (j < m)
            common += np.where(same, PERIOD << k, 0)
            i, j = np.where(same, nexts[k][i], i), np.where(same, nexts[k][j], j)
        # The block that differs is compared word by word.
        common += self._compare(np.append(at, self.n)[i], np.append(at, self.n)[j], np.full(len(i), PERIOD))
        self.table, width = [common.astype(np.int32)], 1
        while 2 * width <= len(common):
            t = self.table[-1]
            self.table.append(np.minimum(t[: len(t) - width], t[width:]))
            width *= 2
        self.index = index

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most``."""
        out, live, k = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(live):
            live = live[most[live] > k]
            live = live[self.w[i[live] + k] == self.w[j[live] + k]]
            k += 1
            out[live] = k
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``i`` and at ``j`` (pairwise different)."""
        steps = _STEPS[i % PERIOD, (j - i) % PERIOD]
        out = self._compare(i, j, steps)
        on = np.flatnonzero(out == steps)
        if len(on):
            if self.table is None:
                self._sort_sample()
            x, y = (self.rank[self.index[v[on] + steps[on]]] for v in (i, j))
            out[on] += self._least(np.minimum(x, y), np.maximum(x, y))
        return out

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest common prefix of neighbours between two ranks."""
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            here = level == k
            t = self.table[k]
            out[here] = np.minimum(t[low[here]], t[high[here] - (1 << k)])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequence number, period and place of all grid points of sequences of these lengths, some at a time."""
    periods = sizes // LEAST_PERIODS
    of = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(LEAST_WORDS, LEAST_PERIODS * p) - p  # a run's words that have an equal word p words on
    counts = -(-(sizes[of] - p) // step)
    ends = np.cumsum(counts)
    a = 0
    while a < len(of):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POINTS, "right")))
        c = counts[a:b]
        x = (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(step[a:b], c)
        yield np.repeat(of[a:b], c), np.repeat(p[a:b], c), x
        a = b


def _chained(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences in one, with an element of its own before, between and behind them, and where each begins."""
    alone = max((int(s.max()) for s in sequences if len(s)), default=0) + 1
    parts, begins, at = [np.array([alone])], [], 1
    for k, s in enumerate(sequences):
        parts += [s, np.array([alone + 1 + k])]
        begins.append(at)
        at += len(s) + 1
    return np.concatenate(parts).astype(np.int64), np.array(begins, np.int64)


def _promising(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points that can lie in a run: equal words one period on here and at two places more to one side."""
    w, begins = _chained(sequences)
    w = np.concatenate([[-1], w, np.full(3, -2)])
    begins = begins + 1
    found = []
    for of, p, x in _grid(np.array([len(s) for s in sequences], np.int64)):
        at = begins[of] + x
        on = np.flatnonzero(w[at] == w[at + p])
        at, q = at[on], p[on]
        right = (w[at + 1] == w[np.minimum(at + q + 1, len(w) - 1)]) & (w[at + 2] == w[np.minimum(at + q + 2, len(w) - 1)])
        left = (w[at - 1] == w[at + q - 1]) & (w[at - 2] == w[at + q - 2])
        on = on[right | left]
        found.append((of[on], p[on], x[on]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def runs(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, start, length and period of every run of integer sequences, by sequence, start and period.

    A run is a stretch that no neighbour extends with its smallest period, of ``LEAST_WORDS`` elements and
    ``LEAST_PERIODS`` periods at least.
    """
    of, p, x = _promising(sequences)
    chosen, of = np.unique(of, return_inverse=True)
    w, begins = _chained([sequences[k] for k in chosen])
    right, left = Extensions(w), Extensions(w[::-1])
    at = begins[of] + x
    after, before = right(at, at + p), left(len(w) - at, len(w) - at - p)
    start, length = x - before, before + p + after
    good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    of, start, length, p = of[good], start[good], length[good], p[good]
    # Multiples of the smallest period have the same stretch, and several grid points lie in one run.
    order = np.lexsort((p, length, start, of))
    of, start, length, p = (v[order] for v in (of, start, length, p))
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of, start, length, p = (v[first] for v in (of, start, length, p))
    order = np.lexsort((p, start, of))
    return chosen[of[order]], start[order], length[order], p[order]


@dataclass
class Periodicity:
    """Runs of one text and the text without what they repeat."""

    starts: list[int]
    lengths: list[int]
    periods: list[int]
    collapsed: bytes

    def best(self) -> int | None:
        """Place of the run with the greatest length by period, ties to the smallest start, then period."""
        best = None
        for k, (s, n, p) in enumerate(zip(self.starts, self.lengths, self.periods)):
            if best is None:
                best = k
                continue
            ahead = n * self.periods[best] - self.lengths[best] * p
            if ahead > 0 or ahead == 0 and (s, p) < (self.starts[best], self.periods[best]):
                best = k
        return best


def periodicities(texts: list[str | None]) -> Iterator[Periodicity]:
    """Runs of the words ``[^\\x20\\x09-\\x0D]+`` of each text, in order; texts share one numbering of their words."""
    words = [t.encode().split() if t else [] for t in texts]
    number = {w: k for k, w in enumerate(set().union(*words))}
    sequences = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
    of, start, length, period = runs(sequences)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    for ws, a, b in zip(words, edges[:-1], edges[1:]):
        kept = ws
        if a < b:
            change = np.zeros(len(ws) + 1, np.int64)
            np.add.at(change, start[a:b] + period[a:b], 1)
            np.add.at(change, start[a:b] + length[a:b], -1)
            kept = [ws[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        yield Periodicity(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), b" ".join(kept))


# Characters of text whose words are numbered and searched together.
GROUP_CHARS = 1 << 21


def periodic_runs(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the runs of each text and the text without what they repeat.

    Adds, under names that begin with ``prefix``: ``runs``, an array of structs ``start, length, period`` by start and
    period (words counted from 0); ``best``, the struct of the run of the greatest length by period (ties: smallest start,
    then period), null without runs; ``collapsed``, the kept words joined by one space, where a word goes if a run has it
    behind its first period. A null or empty text has no words and no runs; its collapsed text is empty. Rows are
    independent of each other, so repeated rows and ids get equal answers; columns of the added names are replaced. The
    memory of a task grows with the longest text, not with the table.
    """
    run = "struct<start: long, length: long, period: long>"

    @F.pandas_udf(f"struct<runs: array<{run}>, best: {run}, collapsed: string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, group, size = [], [], 0
            texts = batch.tolist()
            for k, t in enumerate(texts):
                group.append(t)
                size += len(t) if t else 0
                if size >= GROUP_CHARS or k == len(texts) - 1:
                    for found in periodicities(group):
                        rows = [{"start": s, "length": n, "period": p} for s, n, p in zip(found.starts, found.lengths, found.periods)]
                        best = found.best()
                        out.append((rows, None if best is None else rows[best], found.collapsed.decode()))
                    group, size = [], 0
            yield pd.DataFrame(out, columns=["runs", "best", "collapsed"])

    found = temporary_name(docs, "found")
    names = {f"{prefix}{c}": F.col(f"`{found}`.{c}") for c in ("runs", "best", "collapsed")}
    return docs.withColumn(found, search.asNondeterministic()(F.col(text))).withColumns(names).drop(found)
