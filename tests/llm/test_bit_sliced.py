from __future__ import annotations

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from towline.llm.bit_sliced import Block, at_least, kth_largest, packed, top_k, unpacked


def brute(data, queries, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if queries(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("bits,block_rows", [(6, 50), (3, 1000), (2, 7), (20, 64)])
def test_against_brute_force(spark, bits, block_rows):
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(4, 12))
    data = [(i, [float(np.float32(x)) for x in (centres[i % 4] + rng.normal(size=12) * 0.3) / 4]) for i in range(300)]
    df = table(spark, data)
    got = top_k(df.where("vec_id % 10 = 0"), df, 5, "vec_id", "embedding", bits=bits, block_rows=block_rows, query_rows=9)
    assert sorted(rows(got)) == brute(data, lambda i: i % 10 == 0, 5)


def test_ties_repeats_nulls_and_lengths(spark):
    data = [(k, [0.5, -0.25]) for k in range(20)] + [(3, [0.5, -0.25]), (40, [0.0, 0.0]), (41, [1.0]), (42, [2.0]), (50, [])]
    data += [(60, None), (61, [None, 1.0]), (62, [float("nan"), 1.0]), (63, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = table(spark, data).withColumns({"id": F.lit("x"), "place": F.lit("y"), "score": F.lit("z"), "dims": F.lit("d")})
    got = sorted(rows(top_k(df.where("vec_id IN (0, 3, 40, 41, 61)"), df, 5, "vec_id", "embedding", block_rows=6)))
    want = sorted(set(brute(data, lambda i: i in (0, 3, 40, 41), 5)))
    assert sorted(set(got)) == want
    assert top_k(df.limit(0), df, 5, "vec_id", "embedding").count() == 0
    assert top_k(df, df.limit(0), 5, "vec_id", "embedding").count() == 0


def test_slices_select_like_sorting():
    rng = random.Random(4)
    for _ in range(50):
        n, width = rng.randint(1, 90), rng.randint(1, 9)
        values = [rng.randrange(1 << width) for _ in range(n)]
        slices = [sum(1 << r for r, v in enumerate(values) if v >> b & 1) for b in range(width)]
        rows_ = [r for r in range(n) if rng.random() < 0.8]
        mask, k = sum(1 << r for r in rows_), rng.randint(1, 10)
        ranked = sorted((values[r] for r in rows_), reverse=True)
        kth = kth_largest(slices, mask, k)
        assert kth == (ranked[k - 1] if len(ranked) >= k else 0)
        for bound in (-1, 0, kth, 1 << width, 1 << width + 2):
            assert at_least(slices, mask, bound) == sum(1 << r for r in rows_ if values[r] >= bound)


def test_sums_are_exact_without_quantising():
    rng = np.random.default_rng(5)
    v, q = rng.integers(-150, 150, (40, 8)), rng.integers(-150, 150, 8)
    block = Block.of(np.arange(40), v, 20)
    slices = block.sums(q.tolist())
    sums = np.array([sum((s >> r & 1) << b for b, s in enumerate(slices)) for r in range(40)])
    assert np.array_equal(sums - sums[0], v @ q - v[0] @ q)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    for top in (0.49, 100.0, 65000.0):  # blocks of one, two and four bytes a value
        data = [(i, [float(np.float32(x)) for x in rng.uniform(-top, top, 5)]) for i in range(40)]
        df = table(spark, data)
        got = top_k(df.where("vec_id % 8 = 0"), df, 3, "vec_id", "embedding", block_rows=15, query_rows=2)
        assert sorted(rows(got)) == brute(data, lambda i: i % 8 == 0, 3)
    for values in ([-128, 127], [-129, 0], [0, 128], [-32768, 32767], [32768, 0], [-(1 << 31), 5], [1 << 31, 5], [-(1 << 62), 1]):
        ids, back = unpacked(np.arange(1).tobytes(), packed(np.array([values])), 2)
        assert ids.tolist() == [0] and back.tolist() == [values]


MANY_QUERIES = """
import numpy as np
from towline.llm.bit_sliced import top_k
from towline.session import build_session

conf = {"spark.driver.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": 2}
spark = build_session("many-queries", "local[2]", **conf)
spark.sparkContext.setLogLevel("OFF")
df = spark.range(16384).selectExpr("id AS vec_id", "transform(sequence(1, 64), j -> CAST(hash(id, j) % 256 / 512 AS FLOAT)) AS embedding")
found = top_k(df.where("vec_id < 200"), df, 5, "vec_id", "embedding", query_rows=1)
got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
plan = found._jdf.queryExecution().executedPlan().toString()
assert "Join" not in plan and "Broadcast" not in plan, plan
v = np.floor(np.array([r.embedding for r in df.orderBy("vec_id").collect()]) * 256).astype(np.int64)
want = []
for i in range(200):
    best = [j for j in np.argsort(-(v @ v[i]), kind="stable").tolist() if j != i][:5]
    want += [(i, n + 1, j, int(v[i] @ v[j])) for n, j in enumerate(best)]
assert got == want
"""


def test_memory_does_not_grow_with_the_blocks_of_queries():
    """200 blocks of queries meet a block of the index in a process of 512 MB; as rows of a join they hold 1.7 GB."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", MANY_QUERIES], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
