"""Edge cases and brute-force checks of the operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from towline.functions import aggregates as agg
from towline.functions import scalar
from towline.operators import cleaning, distributions, estimators, joins, ordering, reshape
from towline.operators import design_based as db
from towline.functions.student_t import EXPANSION_FROM, _expanded, _two_tail, quantile
from towline.sources import read_lookup, read_table, read_t_table, stage, write_table


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Sources and sinks


def test_csv_round_trip_with_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id int, name string, x double")
    path = str(tmp_path / "t")
    write_table(df, path)
    back = read_table(spark, path, "x double, id int, name string")
    assert back.columns == ["x", "id", "name"]
    assert rows(back, "id") == [(2.5, 1, "a"), (None, 2, None)]
    raw = tmp_path / "raw.csv"
    raw.write_text('id,name,x,extra\n1,,2.5,q\n2,NA,,r\n3,"b c",NA,\n')
    got = rows(read_table(spark, str(raw), "id int, name string, x double, extra string"), "id")
    assert got == [(1, None, 2.5, "q"), (2, None, None, "r"), (3, "b c", None, None)]
    with pytest.raises(ValueError):
        read_table(spark, path)
    with pytest.raises(ValueError):
        read_table(spark, path, "id int, gone string")


def test_lookup_with_blanks_and_checks(spark, tmp_path):
    path = tmp_path / "area.csv"
    path.write_text("Bed, area_nm2, grids\nA,    89.11,       88\nB,    8.49,       8\n")
    got = read_lookup(spark, str(path), "Bed string, area_nm2 double, grids int", "Bed")
    assert rows(got, "Bed") == [("A", 89.11, 88), ("B", 8.49, 8)]
    long = read_lookup(spark, str(path), "Bed string, area_nm2 double, grids int", "Bed", max_rows=1)
    assert rows(long, "Bed") == rows(got, "Bed")
    assert "broadcast" in got._jdf.queryExecution().toString() and "broadcast" not in long._jdf.queryExecution().toString()
    path.write_text("Bed, area_nm2, grids\nA, 1, 2\nA, 2, 3\n")
    with pytest.raises(ValueError):
        read_lookup(spark, str(path), "Bed string, area_nm2 double, grids int", "Bed")


def test_t_table_file_and_rule(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"ID","N","df","90_2tail","95_2tail","99_2tail"\n1,2,1,6.313751,12.706204,63.656741\n')
    assert rows(read_t_table(spark, str(path))) == [(2, 1, 6.313751, 12.706204, 63.656741)]
    table = {n: tuple(quantile(level, n - 1) for level in (0.90, 0.95, 0.99)) for n in (2, 5, 51, 100)}
    assert table[2] == (6.313751, 12.706204, 63.656741)
    assert table[5] == (2.131846, 2.776445, 4.604094)
    assert table[51] == (1.675905, 2.008559, 2.677793)
    assert table[100] == (1.660391, 1.984216, 2.626405)


def test_stage(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    stage(df, "towline_v")
    assert spark.sql("select sum(x) from towline_v").first()[0] == 20
    stored = stage(df, "towline_m", materialize=True)
    assert "x" in stored.columns and spark.table("towline_m").count() == 5


# Cleaning


def test_reconcile_is_strict(spark):
    df = spark.createDataFrame([(1.0, 0.901), (1.0, 0.9), (1.0, 0.899)], "f double, d double")
    # 1 - 0.9 is a hair under a tenth, so the planned length stays.
    assert [r[0] for r in df.select(scalar.reconcile("f", "d", 0.10)).collect()] == [0.901, 0.9, 1.0]


def test_half_values(spark):
    df = spark.createDataFrame([(0.125, 2.5)], "a double, b double")
    r = df.select(scalar.half_even("a", 2), scalar.half_even("b"), scalar.standard_text("a"), scalar.one_decimal("b", 0)).first()
    assert tuple(r) == (0.12, 2.0, "0.13", 3.0)
    big = spark.createDataFrame([(1234567.891,)], "x double").select(scalar.standard_text("x").alias("t"))
    assert big.first().t == "1,234,567.89"
    assert big.select(scalar.parse_standard("t")).first()[0] == 1234567.89


def test_dates(spark):
    df = spark.createDataFrame([("04-14-2016", "4/30/2015 0:00:00", "2016-4-14"), ("x", None, "")], "a string, b string, c string")
    got = rows(
        df.select(
            scalar.parse_date("a").cast("string"),
            scalar.parse_date("b", "M/d/yyyy H:mm:ss").cast("string"),
            scalar.parse_date("c", "yyyy-M-d").cast("string"),
        )
    )
    assert got == [("2016-04-14", "2015-04-30", "2016-04-14"), (None, None, None)]


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 3), ("a", None, 4), ("b", 1, 5)], "k string, s int, id int")
    assert [r[0] for r in cleaning.find_duplicates(df, ["k", "s"]).select("id").orderBy("id").collect()] == [1, 2, 3, 4]


def test_recode_keeps_others(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    assert [r[0] for r in cleaning.recode(df, "c", {"x": "X"}).collect()] == ["X", "y", None]
    lut = spark.createDataFrame([("x", "X"), ("z", None)], "a string, b string")
    got = cleaning.recode(df, "c", lut)
    assert sorted(str(r[0]) for r in got.collect()) == ["None", "X", "y"]


def test_clean_hauls(spark):
    from towline.sources import schemas

    raw = spark.createDataFrame([("G 34", " 04-14-2016", 1, "Standard"), ("A", "04-15-2016", 1, "Ancillary"), ("B", "04-15-2016", 5, "Standard")], "STATION_ID string, DATE_SET string, GEAR_PERFORMANCE_CODE_SW int, STATION_TYPE string")
    for c in schemas.HAULS.replace("\n", " ").split(","):
        name, kind = c.split()
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    got = cleaning.clean_hauls(raw)
    assert len(got.columns) == 24
    assert rows(got.select("station", "year"), "station") == [("A", 2016), ("G34", 2016)]
    assert cleaning.clean_hauls(raw, ancillary=False).count() == 1


# Joins


def test_complete_with_zero(spark):
    frame = spark.createDataFrame([("h1", "a"), ("h2", "a")], "h string, bed string")
    fact = spark.createDataFrame([("h1", 3), ("orphan", 9)], "h string, c int")
    assert rows(joins.complete_with_zero(fact, frame, ["h"], ["c"]), "h") == [("h1", "a", 3), ("h2", "a", 0), ("orphan", None, 9)]
    assert rows(joins.complete_with_zero(fact, frame, ["h"], ["c"], "frame"), "h") == [("h1", "a", 3), ("h2", "a", 0)]


def test_t_quantile_of_any_size(spark):
    sizes = [None, 0, 1, 2, 100, 101, 151, 1000, 5000, 1_000_000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = dict(rows(joins.with_t_quantile(df, "n")))
    assert [got[n] for n in sizes[:3]] == [None] * 3
    # Published values.
    want = {2: 12.706204, 100: 1.984216, 101: 1.983971, 151: 1.975905, 1000: 1.962341, 5000: 1.960438, 1_000_000: 1.959966}
    assert {n: got[n] for n in want} == pytest.approx(want, abs=1.1e-6)
    assert joins.with_t_quantile(df.limit(0), "n").count() == 0


def test_t_quantile_is_smooth_where_its_formula_changes():
    for level in (0.90, 0.95, 0.99):
        for df in range(EXPANSION_FROM, EXPANSION_FROM + 40):
            assert _two_tail(_expanded(level, df), df) == pytest.approx(level, abs=1e-11)


def test_t_quantile_equals_the_comparison_sql():
    import duckdb

    from towline.catalog.join_queries import t_sql

    got = duckdb.sql(f"SELECT n, {t_sql('n')} FROM range(2, 3000) s(n)").fetchall()
    assert [n for n, t in got if t != quantile(0.95, n - 1)] == []


def test_normalised_join(spark):
    left = spark.createDataFrame([("East", 1), ("South ", 1), ("North", 2)], "bed string, year int")
    right = spark.createDataFrame([("EAST", 1, 0.5), (" south", 1, 0.6), ("NORTH", 1, 0.7)], "bed string, year int, r double")
    assert rows(joins.join_on_normalised(left, right, ["bed"], ["year"]), "r") == [("East", 1, 0.5), ("South ", 1, 0.6)]


# Aggregates


def test_strict_and_lenient(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "g string, x double")
    got = df.groupBy("g").agg(agg.sum0("x"), agg.sum_strict("x"), agg.mean_strict("x"), agg.cv("x"))
    assert rows(got, "g") == [("a", 1.0, None, None, None), ("b", 2.0, 2.0, 2.0, None), ("c", 0.0, None, None, None)]


def test_pivot_and_crosstab(spark):
    df = spark.createDataFrame([("h", 1, 2.0), ("h", 2, None), ("i", 3, 5.0), ("h", 1, 1.0)], "h string, c int, x double")
    assert rows(reshape.pivot_sum(df, ["h"], "c", "x", {1: "large", 2: "small"}), "h") == [("h", 3.0, 0.0), ("i", 0.0, 0.0)]
    cells = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1), (None, 1), ("b", None)], "bed string, w int")
    tab = reshape.crosstab(cells, "w", ["bed"])
    assert rows(tab, "bed", "w") == [("a", 0, 2), ("a", 1, 1), ("b", 0, 0), ("b", 1, 1)]
    pct = reshape.col_percent(tab, ["bed"])
    assert [r.percent for r in pct.orderBy("bed", "w").collect()] == [66.67, 33.33, 0.0, 100.0]
    margin = reshape.with_margin(pct, "w", ["bed"])
    assert ("a", "n", 3.0) in rows(margin)
    many = spark.range(3000).selectExpr("id % 2 AS g", "id AS level")
    grid = reshape.crosstab(many, "level", ["g"])
    assert grid.count() == 6000 and grid.where("n = 1").count() == 3000


def test_domain_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("x",)], "c string")
    assert rows(reshape.domain_order(df, "c", ["b", "a"]), "c") == [("a", 2), ("b", 1), ("x", None)]


# Estimators


def test_small_strata(spark):
    df = spark.createDataFrame([("one", 4.0), ("two", 1.0), ("two", 3.0), ("zero", 0.0), ("zero", 0.0), ("no_area", 1.0)], "bed string, d double")
    areas = spark.createDataFrame([(b, 10.0) for b in ("one", "two", "zero", "unused")], "bed string, area double")
    got = {r.bed: r for r in estimators.expand_estimate(df, ["bed"], ["d"], areas).collect()}
    assert set(got) == {"one", "two", "zero", "no_area"} and got["no_area"].total is None and got["no_area"].dbar == 1.0
    assert (got["one"].n, got["one"].total, got["one"].var_total, got["one"].cv_total) == (1, 40.0, None, None)
    assert (got["two"].ss, got["two"].total, got["two"].var_total) == (2.0, 20.0, 100.0)
    assert (got["zero"].total, got["zero"].var_total, got["zero"].cv, got["zero"].cv_total) == (0.0, 0.0, None, None)


def test_cpue_expansion(spark):
    catch = spark.createDataFrame(
        [("h1", 7, 1, 4, 0.0), ("h1", 9, 1, 0, 20.0), ("h1", 9, 2, 0, 5.0), ("h1", 7, 2, 3, 0.0), ("h2", 7, 1, 2, 0.0), ("h2", 7, 2, 9, 0.0), ("h3", 7, 1, None, 0.0)],
        "h string, sp int, sample_type int, count int, weight double",
    )
    hauls = spark.createDataFrame([("h1", "a", 2.0), ("h2", "a", 1.0), ("h3", "b", 1.0), ("h4", "b", 1.0)], "h string, bed string, len double")
    by_haul, by_bed = estimators.cpue(catch, hauls, "h", "bed", "len", F.col("sp") == 7, F.col("sp") == 9)
    # h1: 4 + 3 + 20 * 3 / 5; h2 has no second-stage weight; h3 holds a null count; h4 caught nothing.
    assert rows(by_haul.select("h", "s_tot", "s_cpm"), "h") == [("h1", 19.0, 9.5), ("h2", 11.0, 11.0), ("h3", 0.0, 0.0), ("h4", 0.0, 0.0)]
    bed = {r.bed: r for r in by_bed.collect()}
    assert bed["a"].cpue_mean == 10.25 and bed["a"].tot_catch == 30.0 and bed["b"].cpue_cv is None


def test_finite_population_limits(spark):
    df = spark.createDataFrame([("a", 4, 4, 2.0, 2.0, 3.0, 3.0, 10.0), ("b", 5, 4, 2.0, 2.0, 3.0, 3.0, 10.0)], "bed string, number_of_tows long, big_n long, mean_count_per_nm double, mean_wt_kg_per_nm double, var_of_count double, var_of_wt double, sq_nm double")
    got = {r.bed: r for r in db.t_interval(db.population_estimate(df)).collect()}
    assert got["a"].var_cbar_count == 0 and got["a"].ci_pop_count == 0
    assert got["b"].var_cbar_count < 0 and got["b"].ci_pop_count is None and got["b"].cv_count is None


# Ordered work on uneven groups


@pytest.fixture(scope="module")
def uneven(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(6000) < 0.6, "hot", rng.integers(0, 30, 6000).astype(str))})
    # Long-tailed values with ties and one far outlier, so most fall in one range.
    pdf["x"] = np.round(rng.lognormal(0, 2, 6000), 2)
    pdf.loc[0, "x"] = 1e9
    pdf["s"] = rng.integers(0, 2, 6000)
    pdf.loc[pdf.index % 97 == 5, "x"] = np.nan
    return pdf


@pytest.mark.parametrize("accuracy", [5000, 50])
def test_quantiles_match_numpy(spark, uneven, accuracy):
    df = spark.createDataFrame(uneven).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    probs = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)
    for by in (["g"], []):
        found = ordering.group_quantiles(df, by, "x", probs, accuracy=accuracy).collect()
        got = {(r.g if by else "all", r.prob): r.quantile for r in found}
        clean = uneven.dropna() if by else uneven.dropna().assign(g="all")
        for g, part in clean.groupby("g"):
            for p in probs:
                assert got[g, p] == pytest.approx(np.quantile(part.x, p), rel=1e-12)
        assert len(found) == clean.g.nunique() * len(probs)


def test_brackets_keep_few_rows_of_a_long_group(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).cast("double").alias("x"))
    stats = df.agg(*ordering.brackets("x", (0.025, 0.5), 1000))
    above, inside = ordering.bracketed("x", 2)
    counts = df.crossJoin(F.broadcast(stats)).groupBy(above.alias("a"), inside.alias("v")).count().collect()
    kept = sorted(r.v for r in counts if r.v is not None)
    assert len(kept) < 500 and 0 < min(kept) < 999 < max(kept) and len([r for r in counts if r.v is None]) == 3
    assert ordering.group_quantiles(df, [], "x", (0.025, 0.5), accuracy=1000).orderBy("prob").collect()[0].quantile == 0.025 * 39_999


def test_quantiles_of_nothing(spark, counted_jobs):
    df = spark.createDataFrame([("a", None), (None, 1.0), (None, 3.0)], "g string, x double")
    with counted_jobs() as jobs:
        out = ordering.group_quantiles(df, ["g"], "x", (0.5,))
        grid = distributions.density_grid(df, "x", [], points=3)
        ks = distributions.ks_two_sample(df, [], "g", "x", "a", "b")
    assert jobs() == 0
    assert rows(out) == [(None, 0.5, 2.0)]
    assert grid.count() == 3 and ks.count() == 0
    assert ordering.group_quantiles(df.limit(0), [], "x", (0.5,)).count() == 0


def test_running_extremes(spark, uneven):
    clean = uneven.dropna().assign(step=lambda d: 2 * d.s - 1)
    ties = clean.groupby(["g", "x"], as_index=False).step.sum()
    df = spark.createDataFrame(ties).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = ordering.running_extremes(ordering.range_pieces(df, ["g"], "x", ["step"]), ["g"], ["step"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {r.g: (r.low_step, r.high_step) for r in found}
    for g, part in ties.sort_values(["g", "x"]).groupby("g"):
        assert got[g] == (part.step.cumsum().min(), part.step.cumsum().max())
    assert len(got) == ties.g.nunique()


def ks_by_hand(a, b):
    points = np.union1d(a, b)
    f = lambda s: np.searchsorted(np.sort(s), points, side="right") / len(s)
    return np.abs(f(a) - f(b)).max()


def test_ks_with_ties(spark, uneven):
    df = spark.createDataFrame(uneven.dropna())
    got = {r.g: r for r in distributions.ks_two_sample(df, ["g"], "s", "x", 0, 1).collect()}
    for g, part in uneven.dropna().groupby("g"):
        a, b = part.x[part.s == 0].to_numpy(), part.x[part.s == 1].to_numpy()
        if len(a) and len(b):
            d = ks_by_hand(a, b)
            lam = d * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
            p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
            assert got[g].d == pytest.approx(d, abs=1e-12)
            assert got[g].p_value == pytest.approx(min(1, max(0, p)), abs=1e-9)
    same = spark.createDataFrame([("a", s, 1.0) for s in (0, 1)], "g string, s int, x double")
    assert distributions.ks_two_sample(same, ["g"], "s", "x", 0, 1).first().p_value == 1.0


# Size distributions


def allocate_by_hand(counts, total):
    m = sum(counts.values())
    need = total - m if total > 0 and m > 1 and total - m > 1 else 0
    base = {b: need * c // m for b, c in counts.items()}
    rest = need - sum(base.values())
    order = sorted(counts, key=lambda b: (-(need * counts[b] % m), b))
    return {b: base[b] + (b in order[:rest]) for b in counts}


def test_length_expansion(spark):
    rng = np.random.default_rng(5)
    cases = {"one": (1, 50), "below": (40, 30), "equal": (10, 10), "by_one": (10, 11), "grow": (40, 333), "two": (2, 9)}
    measured = {k: np.round(rng.normal(110, 12, m), 1) for k, (m, _) in cases.items()}
    df = spark.createDataFrame([(k, float(h)) for k, hs in measured.items() for h in hs], "h string, height double")
    totals = spark.createDataFrame([(k, t) for k, (_, t) in cases.items()] + [("none", 12)], "h string, total long")
    got = distributions.allocate_lengths(df, totals, ["h"], "height", "total").toPandas()
    for k, (m, total) in cases.items():
        part = got[got.h == k].set_index("bin_units")
        counts = pd.Series(np.round(measured[k] * 10).astype(int)).value_counts().to_dict()
        assert part.measured.to_dict() == counts
        assert part.added.to_dict() == allocate_by_hand(counts, total)
    grown = distributions.expand_lengths(df, totals, ["h"], "height", "total")
    sizes = {r.h: r.n for r in grown.groupBy("h").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"one": 1, "below": 40, "equal": 10, "by_one": 10, "grow": 333, "two": 9}
    check = distributions.reconcile_totals(spark.createDataFrame(got), totals, ["h"], F.col("measured") + F.col("added"), "total")
    assert {r.h: r.difference for r in check.collect()} == {"one": -49, "below": 10, "equal": 0, "by_one": -1, "grow": 0, "two": 0, "none": -12}


def test_repeat_rows_in_pieces(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 0), ("d", 10)], "k string, n long")
    got = distributions.repeat_rows(df, "n", piece=10).groupBy("k").count()
    assert rows(got, "k") == [("a", 25), ("b", 1), ("d", 10)]


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": rng.normal(0, 1, 3000)}))
    got = distributions.density_grid(df, "x", ["g"]).toPandas().sort_values("x")
    assert np.trapezoid(got.density, got.x) == pytest.approx(1, abs=0.01)
    assert got.density.max() == pytest.approx(0.4, abs=0.04)
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, x double")
    assert distributions.density_grid(flat, "x", ["g"]).count() > 0


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    assert rows(distributions.histogram(df, "x", bins=2), "bin") == [(0, 0.0, 1), (1, 5.0, 2)]
    weighted = spark.createDataFrame([(0.4, 3), (0.6, 4)], "x double, w int")
    assert rows(distributions.histogram(weighted, "x", width=0.5, weight="w"), "bin") == [(0, 0.0, 3), (1, 0.5, 4)]
    gaps = spark.createDataFrame([("a", 0.5), ("a", 3.5), ("b", 2.0), (None, 1.0)], "g string, x double")
    got = sorted(rows(distributions.histogram(gaps, "x", ["g"], width=1.0)), key=str)
    assert got == sorted([("a", 0, 0.0, 1), ("a", 1, 1.0, 0), ("a", 2, 2.0, 0), ("a", 3, 3.0, 1), ("b", 2, 2.0, 1), (None, 1, 1.0, 1)], key=str)


def test_fit(spark):
    x = np.linspace(50, 150, 40)
    df = spark.createDataFrame(pd.DataFrame({"m": "May", "h": x, "w": 0.001 * x**2.9}))
    r = distributions.log_log_fit(df, "w", "h", ["m"]).first()
    assert (r.n, r.r2) == (40, pytest.approx(1)) and r.slope == pytest.approx(2.9)
    assert math.exp(r.intercept) == pytest.approx(0.001)


def test_allocation_is_spread_over_tasks(spark):
    # Few bytes would be merged into one partition, in which all sorts of all groups are held at once.
    measured = spark.range(400).select((F.col("id") % 100).alias("h"), (F.col("id") * 0.1).alias("height"))
    totals = spark.range(100).select(F.col("id").alias("h"), F.lit(50).alias("total"))
    counts = distributions.allocate_lengths(measured, totals, ["h"], "height", "total")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    assert counts.rdd.getNumPartitions() == tasks
    out = distributions.reconcile_totals(counts, totals, ["h"], F.col("measured") + F.col("added"), "total").collect()
    assert len(out) == 100 and all(r.difference == 0 for r in out)
