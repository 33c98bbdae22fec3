"""Published estimates reproduced from their own records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from survey_data import AREAS, BED_E, BED_W, EXPECTED, EXPECTED_CATCH, POPULATION, RECOVERY

from towline.operators import design_based as db
from towline.plans.abundance import SurveySettings, abundance_tables, write_results
from towline.functions.scalar import norm_key, trailing
from towline.sources import schemas

SPECIES = 74120


def haul_rows():
    rows = []
    for bed, tows in (("E", BED_E), ("W", BED_W)):
        for i, tow in enumerate(tows):
            rows.append((f"{bed}{i:03d}", bed, *tow))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = haul_rows()
    hauls = spark.createDataFrame(
        [(e, b, length) for e, b, length, _, _ in rows] + [("bad", "E", 1.0)],
        "EVENT_ID string, BED_SW string, TOW_LENGTH_DESIGNATED double",
    )
    blank = [c for c in schemas.HAULS.replace("\n", " ").split(",")]
    for c in blank:
        name, kind = c.split()
        if name not in hauls.columns:
            hauls = hauls.withColumn(name, F.lit(None).cast(kind))
    hauls = hauls.withColumns(
        {
            "DATE_SET": F.lit("04-14-2016"),
            "STATION_ID": F.lit("G 34"),
            "DISTRICT": F.concat(F.col("BED_SW"), F.lit("D")),
            "STATION_TYPE": F.lit("Standard"),
            "GEAR_PERFORMANCE_CODE_SW": F.when(F.col("EVENT_ID") == "bad", 4).otherwise(1),
        }
    )
    catch = []
    for event, _, _, large, small in rows:
        if large is not None:
            catch += [(event, SPECIES, 1, large, 0.25 * large, 1, 1), (event, SPECIES, 2, small, 0.05 * small, 1, 1)]
    catch += [("W000", SPECIES, 1, 3, 0.3, 52, 1), ("W001", 99, 1, 500, 9.0, 1, 1), ("orphan", SPECIES, 1, 7, 1.0, 1, 1)]
    animals = [
        (event, SPECIES, j, 1, 250.0 + j, 0, 120.0, 1, 3, 0, 1, 25.0 + j, None, 1)
        for event, _, _, large, _ in rows
        if large
        for j in range(min(large, 10))
    ]
    return abundance_tables(
        hauls,
        spark.createDataFrame(catch, schemas.CATCH),
        spark.createDataFrame(animals, schemas.INDIVIDUALS),
        spark.createDataFrame(AREAS, schemas.AREAS),
        SurveySettings(SPECIES, reps=300, seed=7),
    )


def test_numbers_match_published_values(tables):
    got = {(r.bed, r.variable): r for r in tables["numbers_original"].collect()}
    assert set(got) == set(EXPECTED)
    for key, want in EXPECTED.items():
        r = got[key]
        values = (r.n, r.dbar, r.var_dbar, r.cv, r.ss, r.total, r.var_total, r.cv_total)
        assert values == pytest.approx(want, rel=1e-9)
        assert (r.year, r.district) == (2016, f"{key[0]}D")


def test_samples_and_catch_table(tables):
    assert {(r.bed, r.n, r.area) for r in tables["samples"].collect()} == {("E", 31, 89.11), ("W", 16, 48.66)}
    west = {r.bed: r for r in tables["catch_table"].collect()}["W"]
    got = (west.large_c, west.small_c, west.min_large, west.max_large, west.min_small, west.max_small)
    assert got == EXPECTED_CATCH["W"]
    assert west.large_g_kg == pytest.approx(0.25 * 1766)
    assert west.large_g_lb == pytest.approx(0.25 * 1766 * 1000 * 0.00220462)


def test_bootstrap_brackets_the_estimate(tables):
    got = {(r.bed, r.variable): r for r in tables["N_summary"].collect()}
    for key, want in EXPECTED.items():
        r = got[key]
        assert r.ll_total < want[5] < r.ul_total
        assert r.mean_total == pytest.approx(want[5], rel=4 * want[7] / 100 / 300**0.5)
        # Bootstrap variance is that of the mean with n instead of n - 1.
        assert r.var_total == pytest.approx(want[6] * (want[0] - 1) / want[0], rel=0.35)


def test_harvest_and_clappers(tables):
    summary = {(r.bed, r.variable): r for r in tables["N_summary"].collect()}
    ratio = {r.bed: r.mean_ratio for r in tables["meat_wts"].collect()}
    for r in tables["number_GHL"].collect():
        assert r.ghl_05 == pytest.approx(r.meat * 0.05) and r.high_ghl_10 == pytest.approx(r.ul * 0.10)
        weight = r.meat * 453.592 / ratio[r.bed] / summary[r.bed, "large"].mean_total
        assert 250 <= weight <= 260
    pounds = {r.bed: r.mean_weight for r in tables["weights_summary"].collect() if r.variable == "large"}
    for r in tables["weight_GHL"].collect():
        assert r.meat == pytest.approx(ratio[r.bed] * pounds[r.bed])
    clappers = {r.bed: r for r in tables["clapper_summary"].collect()}
    assert clappers["E"].percent_clap == 0 and 0 < clappers["W"].percent_clap < 1
    assert clappers["W"].n == 16


def test_results_are_written(tables, tmp_path, spark):
    chosen = {k: v for k, v in tables.items()}
    write_results({k: chosen[k].limit(3) for k in chosen}, str(tmp_path / "out"))
    assert (tmp_path / "out" / "number_GHL").exists()


def test_population_chain_matches_printed_values(spark):
    cols = "bed string, year int, sq_nm double, big_n long, number_of_tows long, mean_count_per_nm double, "
    cols += "mean_wt_kg_per_nm double, var_of_count double, var_of_wt double"
    keys = ("bed", "year", "sq_nm", "big_n", "n", "mean_count", "mean_wt", "var_count", "var_wt")
    rows = [tuple(r[k] for k in keys) for r in POPULATION]
    summary = spark.createDataFrame(rows, cols)
    frame = summary.select("bed", "year", "sq_nm", "big_n")
    est = db.population_estimate(db.with_stratum_frame(summary.drop("sq_nm", "big_n"), frame, ["bed", "year"]))
    est = db.t_interval(est)
    recovery = spark.createDataFrame(RECOVERY, schemas.RECOVERY)
    recovery = recovery.withColumn("year", trailing("SURVEY_AND_YEAR", 4).try_cast("int"))
    rates = db.recovery_rates(recovery, ["bed", "year"], "WHOLE_WT_KG", "MEAT_WT_KG")
    est = db.recovery_estimate(est.withColumn("bed", F.concat(F.col("bed"), F.lit(" "))), rates, ["bed"], ["year"])
    got = {(r.bed.strip(), r.year): r for r in est.collect()}
    assert len(got) == len(POPULATION)
    for want in POPULATION:
        r = got[want["bed"], want["year"]]
        # Inputs are printed with two decimals, so results carry that rounding.
        assert r.pop_count == pytest.approx(want["pop_count"], rel=1e-3)
        assert r.var_cbar_count == pytest.approx(want["var_cbar_count"], rel=1e-4)
        assert r.var_pop_count == pytest.approx(want["var_pop_count"], rel=1e-4)
        assert r.ci_mean_count == pytest.approx(want["ci_mean_count"], abs=0.51)
        assert r.ci_pop_count == pytest.approx(want["ci_pop_count"], rel=1e-3)
        assert round(r.cv_count, 2) == pytest.approx(want["cv_count"], abs=0.011)
        assert r.area_swept == pytest.approx(want["area_swept"], abs=1e-6)
        assert r.pop_count / (r.sq_nm * 3429904) == pytest.approx(want["density"], abs=6e-4)
        assert round(r.mr_rate, 3) == want["mr_rate"]


def test_norm_key_is_needed(spark):
    df = spark.createDataFrame([("EAST",), ("East",), ("South ",)], "b string")
    assert [r[0] for r in df.select(norm_key("b")).collect()] == ["east", "east", "south"]
