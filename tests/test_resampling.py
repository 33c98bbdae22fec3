"""Bootstrap properties, exactness of the split strata, reproducibility."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from towline.operators import resampling as rs


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": np.where(np.arange(1300) < 900, "hot", "cold"), "id": np.arange(1300)})
    pdf.loc[1299, "g"] = "single"
    pdf["x"] = rng.gamma(2, 3, 1300)
    return pdf


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([("hot", 10.0), ("cold", 10.0), ("single", 10.0)], "g string, area double")


def test_draws_are_rows_of_the_stratum(spark, sample):
    out = rs.resample(spark.createDataFrame(sample), ["g"], "id", ["x"], reps=5, seed=3).toPandas()
    single = sample[sample.g == "single"].x.iloc[0]
    assert out[out.g == "single"].sum_x.tolist() == [single] * 5
    assert (out.cnt_x == out.n).all() and out.groupby("g").replicate.nunique().eq(5).all()


MASK = (1 << 64) - 1


def hash64(base, counter):
    z = (counter * rs.GOLDEN & MASK) ^ base
    z = (z ^ z >> 30) * rs.MIX_1 & MASK
    z = (z ^ z >> 27) * rs.MIX_2 & MASK
    return z ^ z >> 31


def positions(base, r, m, n):
    """Row positions drawn in a replicate, by plain integers down the tree."""
    depth = 0
    while rs.LEAF << depth < n:
        depth += 1
    out = []

    def go(level, j, c, before):
        if level == depth:
            for k in range(c):
                v = hash64(base, r * m + before + k + 1) >> 32
                out.append(((j << 32) + v) * n >> (depth + 32))
            return
        stream = hash64(base, rs.NODES + (1 << level) + j)
        bits = sum(hash64(stream, r * -(-m // 64) + w + 1) << 64 * w for w in range(-(-c // 64)))
        left = (bits & (1 << c) - 1).bit_count()
        go(level + 1, 2 * j, left, before)
        go(level + 1, 2 * j + 1, c - left, before + left)

    go(0, 0, m, 0)
    return out


def by_hand(sample, seed, reps):
    """The same draws without Spark."""
    import hashlib

    want = {}
    for g, part in sample.groupby("g"):
        x = part.sort_values("id").x.to_numpy()
        base = int(hashlib.md5(f"{seed}|{g}".encode()).hexdigest()[:15], 16)
        for r in range(reps):
            want[g, r] = x[positions(base, r, len(x), len(x))].sum()
    return want


@pytest.mark.parametrize("tile_rows", [1, 100, 500, 65_536])
def test_replicates_are_the_same_for_tiles_of_any_size(spark, sample, tile_rows):
    df = spark.createDataFrame(sample)
    out = rs.resample(df, ["g"], "id", ["x"], reps=6, seed=9, tile_rows=tile_rows).collect()
    want = by_hand(sample, 9, 6)
    assert {(r.g, r.replicate) for r in out} == set(want) and len(out) == len(want)
    for r in out:
        assert r.sum_x == pytest.approx(want[r.g, r.replicate], rel=1e-12) and r.cnt_x == r.m == r.n


@pytest.mark.parametrize("n,m,depth", [(1, 5, 0), (256, 300, 0), (257, 1, 1), (1000, 7, 2), (5000, 4000, 5), (5000, 9000, 3)])
def test_tiles_of_a_depth_add_up_to_the_draws(n, m, depth):
    x, base, reps = np.arange(1.0, n + 1), 123456789, 3
    depth = min(depth, rs.leaf_depth(n))
    node, counts = np.array([1]), np.full((reps, 1), m)
    for _ in range(depth):
        node, counts = rs._split(base, m, np.arange(reps), node, counts)
    before = np.cumsum(counts, axis=1) - counts
    total = np.zeros(reps)
    for j in range(1 << depth):
        rows = x[(j * n) >> depth : (((j + 1) * n - 1) >> depth) + 1]
        total += rs._tile_sums([rows], n, depth, j, base, m, counts[:, j], before[:, j])[0]
    assert total.tolist() == [float(sum(p + 1 for p in positions(base, r, m, n))) for r in range(reps)]


def test_places_of_a_very_long_stratum():
    # A tile deep in a stratum of 10^10 rows: positions stay inside it.
    n, m = 10**10 + 7, 50
    depth = rs.leaf_depth(n)
    tile = (1 << depth) - 3
    first, last = (tile * n) >> depth, ((tile + 1) * n - 1) >> depth
    x = np.arange(last - first + 1, dtype=float)
    sums = rs._tile_sums([x], n, depth, tile, 99, m, np.array([m]), np.array([0]))
    assert 0 < sums[0][0] < m * (last - first) and sums[1][0] == m


def test_left_counts_are_binomial():
    n = np.full(4000, 900)
    left = rs._left(77, 900, np.arange(4000), np.full(4000, 1), n)
    assert left.mean() == pytest.approx(450, abs=1) and left.var() == pytest.approx(225, rel=0.1)
    assert rs._left(77, 900, np.arange(5), np.full(5, 3), np.zeros(5, np.int64)).tolist() == [0] * 5


def test_exact_draws(spark, sample):
    out = rs.resample(spark.createDataFrame(sample), ["g"], "id", ["x"], reps=4, seed=9).collect()
    want = by_hand(sample, 9, 4)
    assert {(r.g, r.replicate) for r in out} == set(want)
    for r in out:
        assert r.sum_x == pytest.approx(want[r.g, r.replicate], rel=1e-12)


def test_same_seed_same_answer_under_other_partitioning(spark, sample, areas):
    df = spark.createDataFrame(sample)
    for tile in (65_536, 100):
        a = rs.bootstrap(df, ["g"], "id", ["x"], areas, ["g"], 20, 5, tile_rows=tile).toPandas()
        b = rs.bootstrap(df.repartition(7, F.rand(1)), ["g"], "id", ["x"], areas, ["g"], 20, 5, tile_rows=tile).toPandas()
        order = ["g", "replicate"]
        a, b = a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True)
        assert np.allclose(a.dbar, b.dbar, rtol=1e-12)
    other = rs.bootstrap(df, ["g"], "id", ["x"], areas, ["g"], 20, 6).toPandas()
    assert not np.allclose(sorted(a.dbar), sorted(other.dbar))


@pytest.mark.parametrize("tile_rows", [65_536, 64, 7])
def test_split_strata_have_the_bootstrap_distribution(spark, sample, tile_rows):
    reps = 600
    out = rs.resample(spark.createDataFrame(sample), ["g"], "id", ["x"], reps, 2, tile_rows=tile_rows).toPandas()
    assert len(out) == 3 * reps
    for g, part in sample.groupby("g"):
        got, n = out[out.g == g], len(part)
        assert (got.cnt_x == n).all() and (got.n == n).all()
        mean, sd = part.x.mean(), part.x.std(ddof=0) / np.sqrt(n)
        if n == 1:
            assert np.allclose(got.sum_x, part.x.iloc[0])
            continue
        means = got.sum_x / n
        assert abs(means.mean() - mean) < 4 * sd / np.sqrt(reps)
        assert means.std() == pytest.approx(sd, rel=0.12)


def test_small_batches_give_the_same_sums(sample, monkeypatch):
    x = sample.x.to_numpy()[:700]
    args = ([x], 700, 0, 0, 12345, 650, np.full(4, 650), np.zeros(4, np.int64))
    whole = rs._tile_sums(*args)
    monkeypatch.setattr(rs, "DRAW_BATCH", 8)
    parts = rs._tile_sums(*args)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_draws_of_tiles_are_never_broadcast(spark, sample):
    df = spark.createDataFrame(sample)
    out = rs.resample(df, ["g"], "id", ["x"], reps=50, seed=3, tile_rows=100)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above, below = plan[: plan.rindex("_share")], plan[plan.rindex("_share") :]
    # Two maps: draws of the strata are dealt to tiles, and tiles are drawn from. Nothing is joined between them.
    assert plan.count("MapInArrow") == 2 and below and "Join" not in above[above.index("MapInArrow") : above.index("Union")]


def test_tasks_that_deal_draws_are_fewer_than_those_that_draw(spark, sample, monkeypatch):
    # Many tasks on both sides of the shuffle of tiles would make blocks by the square of the rows.
    monkeypatch.setattr(rs, "DRAWS_PER_TASK", 100)
    df = spark.createDataFrame(sample)
    plan = rs.resample(df, ["g"], "id", ["x"], reps=8, seed=3, tile_rows=100)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(line.split("REPARTITION_BY_NUM")[0].rsplit("), ", 1)[0].rsplit(", ", 1)[-1]) for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert sorted(dealt)[-1] == 1300 * 8 // 100 and sorted(dealt)[0] <= 1300 * 8 // 100 // 8


def test_tiles_of_a_task_leave_it_as_one_sum(sample):
    import pyarrow as pa

    x, n, depth, reps, base = sample.x.to_numpy()[:900], 900, 2, 4, 4711
    node, counts = np.array([1]), np.full((reps, 1), n)
    for _ in range(depth):
        node, counts = rs._split(base, n, np.arange(reps), node, counts)
    before = np.cumsum(counts, axis=1) - counts
    rows = [
        {
            "g": "hot",
            "n": n,
            "__depth": depth,
            "__tile": j,
            "__designs": [{"__index": 0, "m": n, "__base": base}],
            "__shares": [{"__index": 0, "__first": 0, "__counts": counts[:, j].tolist(), "__offsets": before[:, j].tolist()}],
            "__v_x": x[(j * n) >> depth : (((j + 1) * n - 1) >> depth) + 1].tolist(),
        }
        for j in range(1 << depth)
    ]
    out = list(rs._kernel(["g", "n"], ["x"], reps)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert sum(b.num_rows for b in out) == reps
    assert out[0].column("sum_x").to_pylist() == pytest.approx([sum(x[p] for p in positions(base, r, n, n)) for r in range(reps)], rel=1e-12)


def test_packed_rows_are_drawn_from_again(spark, sample):
    df = spark.createDataFrame(sample).withColumn("y", F.col("x") * 2)
    packed = rs.pack_strata(df, ["g"], "id", ["x", "y"])
    for values, draws in ((["x"], None), (["y", "x"], {"few": F.lit(3), "half": F.floor(F.col("n") / 2)})):
        order = ["g", *(["design"] if draws else []), "replicate"]
        got, want = (
            rs.resample(df, ["g"], "id", values, 4, 2, draws=draws, packed=p).toPandas().sort_values(order).reset_index(drop=True) for p in (packed, None)
        )
        pd.testing.assert_frame_equal(got, want)


def test_whole_table_and_empty_table(spark, sample):
    df = spark.createDataFrame(sample)
    got = rs.resample(df.withColumn("all", F.lit(None).cast("int")), ["all"], "id", ["x"], 3, 1, tile_rows=100).collect()
    assert sorted(r.replicate for r in got) == [0, 1, 2] and all(r["all"] is None and r.n == 1300 for r in got)
    assert rs.resample(df.limit(0), ["g"], "id", ["x"], 3, 1).count() == 0


def test_missing_values_are_counted(spark):
    df = spark.createDataFrame([("a", i, None if i == 0 else 1.0) for i in range(4)], "g string, id int, x double")
    out = rs.resample(df, ["g"], "id", ["x"], reps=200, seed=1).withColumn("strict", rs.drawn_mean("x"))
    got = out.withColumn("lenient", rs.drawn_mean("x", na_rm=True)).toPandas()
    assert (got.sum_x == got.cnt_x).all()
    assert got.strict.isna().equals(got.cnt_x < 4)
    assert got.lenient.dropna().eq(1).all()


def test_key_of_equal_groups_and_null_stratum(spark):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(30)] + [("b", i, 2.0) for i in range(3)], "g string, id int, x double")
    for tile in (1000, 8):
        out = rs.resample(df, ["g"], "id", ["x"], reps=2, seed=1, tile_rows=tile).toPandas()
        assert sorted(out.sum_x) == [6.0, 6.0, 30.0, 30.0]


def test_poisson(spark, sample, areas):
    out = rs.bootstrap(spark.createDataFrame(sample), ["g"], "id", ["x"], areas, ["g"], 400, 4, "poisson").toPandas()
    part = sample[sample.g == "hot"]
    got = out[out.g == "hot"]
    assert got.dbar.mean() == pytest.approx(part.x.mean(), rel=0.01)
    assert got.dbar.std() == pytest.approx(part.x.std() / 30, rel=0.15)
    assert np.allclose(got.total, got.dbar * 10)
    weights = rs.poisson_weights(np.arange(4000, dtype=np.int64), 1, 0, 50)
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02)


def test_poisson_flushes_many_strata(spark):
    df = spark.createDataFrame([(i % 40, i, 1.0) for i in range(400)], "g int, id long, x double")
    a = rs.poisson_sums(df, ["g"], "id", ["x"], 10, 1, max_groups=3).toPandas()
    b = rs.poisson_sums(df, ["g"], "id", ["x"], 10, 1).toPandas()
    order = ["g", "replicate"]
    assert a.sort_values(order).reset_index(drop=True).equals(b.sort_values(order).reset_index(drop=True))
    assert len(a) == 400


def test_summary(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)], "g string, x double")
    r = rs.bootstrap_summary(df, ["g"], {"x": "x"}).first()
    assert (r.mean_x, r.ll_x, r.ul_x) == (50.0, 2.5, 97.5)
    assert r.cv_x == pytest.approx(100 * np.std(np.arange(101), ddof=1) / 50)


def test_design_sizes_and_study(spark):
    rows = [("a", y, i, float(i % 5)) for y in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "bed string, year int, id int, d double")
    areas = spark.createDataFrame([("a", 90.2)], "bed string, area double")
    study = rs.design_study(df, ["bed", "year"], "id", "d", areas, ["bed"], reps=150, seed=1)
    got = study.toPandas()
    assert got.groupby("fraction").m.first().to_dict() == {0.2: 18, 0.3: 27, 0.35: 31, 0.4: 36, 0.5: 45}
    assert got.p_mean.to_numpy() == pytest.approx(2 * 90.2, rel=0.05)
    wide = got.pivot(index="year", columns="fraction", values="p_sd")
    assert (wide[0.2] > wide[0.5]).all()
    diff = rs.compare_designs(study, ["bed", "year"], ["year"]).toPandas()
    assert len(diff) == 8 and set(diff.type) == {"mean", "sd"} and (diff.value >= 0).all()
    want = np.mean([100 * abs((wide[0.5][y] - wide[0.2][y]) / wide[0.5][y]) for y in (1, 2)])
    assert diff[(diff.fraction == 0.2) & (diff.type == "sd")].value.iloc[0] == pytest.approx(want)


def test_designs_without_a_complete_replicate_are_left_out(spark):
    rows = [("a", y, i, None if y == 1 and i < 29 else 1.0 + i % 5) for y in (1, 2) for i in range(30)]
    rows += [("b", 1, i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "bed string, year int, id int, d double")
    areas = spark.createDataFrame([("a", 90.0), ("b", 90.0)], "bed string, area double")
    study = rs.design_study(df, ["bed", "year"], "id", "d", areas, ["bed"], reps=20, seed=1, na_rm=True)
    assert {(r.bed, r.year) for r in study.collect()} == {("a", 2)}
    diff = rs.compare_designs(study, ["bed", "year"], ["year"]).collect()
    assert {r.bed for r in diff} == {"a"} and all(r.value is not None for r in diff)
    whole = rs.design_study(df, ["bed", "year"], "id", "d", areas, ["bed"], reps=20, seed=1).collect()
    assert len(whole) == 15 and all((r.p_mean is None) == ((r.bed, r.year) != ("a", 2)) for r in whole)
