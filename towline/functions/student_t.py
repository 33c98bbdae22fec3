"""Two-tailed quantiles of Student's t for any sample size."""

from __future__ import annotations

import math
import sys
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The functions that run in tasks travel with them, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# From so many degrees of freedom on, the expansion in 1 / df is right to more than ten decimals.
EXPANSION_FROM = 150


def _two_tail(t: float, df: int) -> float:
    """P(|T| <= t) by the finite sum that holds for whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(df))
    cos, sin = math.cos(theta), math.sin(theta)
    term = total = cos if df % 2 else 1.0
    for j in range(3 if df % 2 else 2, df - 1, 2):
        term *= cos * cos * (j - 1) / j
        total += term
    if df % 2 == 0:
        return sin * total
    return 2 / math.pi * (theta + (sin * total if df > 1 else 0.0))


def _expanded(level: float, df: int) -> float:
    """Expansion of the quantile around the normal one (Abramowitz and Stegun 26.7.5)."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return z + sum(c / df ** (k + 1) for k, c in enumerate(terms))


@lru_cache(maxsize=4096)
def quantile(level: float, df: int) -> float:
    """Two-tailed quantile, cut after six decimals as published tables are."""
    if df >= EXPANSION_FROM:
        return math.floor(_expanded(level, df) * 1e6) / 1e6
    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        if _two_tail(mid, df) < level:
            low = mid
        else:
            high = mid
    return math.floor((low + high) / 2 * 1e6) / 1e6


def t_quantile(n: Column | str, level: int = 95) -> Column:
    """``t`` of a sample of size ``n``; null for one of fewer than two. Distinct sizes are computed once per batch."""

    @F.pandas_udf("double")
    def run(sizes: pd.Series) -> pd.Series:
        distinct, where = np.unique(sizes.fillna(0).to_numpy(np.int64), return_inverse=True)
        values = [quantile(level / 100, int(m) - 1) if m >= 2 else np.nan for m in distinct]
        out = pd.Series(np.array(values, dtype=float)[where], index=sizes.index)
        return out.astype(object).where(out.notna(), None)

    return run((F.col(n) if isinstance(n, str) else n).cast("long"))
