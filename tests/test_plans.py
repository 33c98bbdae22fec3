"""Population chain, sample-size study and biology tables on small records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from towline.operators import report
from towline.plans import biology
from towline.plans.population import population_tables, tow_counts, used_tows
from towline.plans.sample_size import bed_areas, sample_size_tables, study_tows
from towline.sources import schemas


@pytest.fixture(scope="module")
def inputs(spark):
    hauls, catch = [], []
    for area, bed in (("Near Dredge", "East"), ("Near Dredge", "West "), ("Far Dredge", "East")):
        for year in (1995, 1996, 1998):
            for i in range(6):
                event = f"{area[0]}{bed[0]}{year}{i}"
                hauls.append((year, "P1", event, area, bed, f"S{i}", 1.0 + 0.3 * (i == 2), 1.0, "YES" if i < 5 else "NO"))
                if i != 3:
                    catch += [(event, 850, 1, 10 * (i + 1), 2.0 * (i + 1)), (event, 850, 52, 99, 9.0), (event, 7, 1, 50, 5.0)]
    stations = [(k, "P1", f"S{k}", a, "YES", b, 1.02) for k, (a, b) in enumerate([("Near Dredge", "East"), ("Near Dredge", "West"), ("Far Dredge", "East")] * 12)]
    recovery = [("EAST", "Any 1996", 10.0, 1.0), ("EAST", "Any 1996", 30.0, 2.0), ("WEST ", "Any 1998", 20.0, 1.0)]
    return (
        spark.createDataFrame(hauls, schemas.LONG_TERM_HAULS),
        spark.createDataFrame(catch, schemas.LONG_TERM_CATCH),
        spark.createDataFrame(stations, "RECORD_ID int, FK_PROJECT_CODE string, STATION_ID string, SURVEY_AREA string, STANDARD_STATION string, BED string, Area_Sq_NM double"),
        spark.createDataFrame(recovery, schemas.RECOVERY),
    )


def test_population_chain(spark, inputs):
    hauls, catch, stations, recovery = inputs
    t = population_tables(hauls, catch, stations, recovery, 850, 1)
    assert t["tows"].count() == 30
    assert t["tows"].where("count = 0").count() == 6
    frame = {(r.area, r.bed): (r.sq_nm, r.big_n) for r in t["frame"].collect()}
    assert frame["near dredge", "west"] == (pytest.approx(12.24), 12)
    row = t["population"].where("area = 'near dredge' and bed = 'east' and year = 1996").first()
    counts = [10, 20, 30, 0, 50]
    mean = sum(counts) / 5
    var = sum((c - mean) ** 2 for c in counts) / 4
    assert (row.number_of_tows, row.raw_count, row.sq_nm) == (5, 110, 12.2)
    assert row.pop_count == pytest.approx(759.5 * mean * 12.2)
    assert row.var_cbar_count == pytest.approx(var / 5 * (1 - 5 / 12))
    rep = t["report"].collect()
    # East has a rate for 1996 in both areas, West for 1998.
    assert [(r.bed, r.year, r.mr_rate) for r in rep] == [("east", 1996, 0.075), ("east", 1996, 0.075), ("west", 1998, 0.05)]
    assert [r.area for r in rep] == ["far dredge", "near dredge", "near dredge"]


def test_used_tows_order(inputs):
    got = [(r.YEAR, r.EVENT_ID) for r in used_tows(inputs[0]).collect()]
    assert got == sorted(got, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    assert {r.tows for r in tow_counts(inputs[0]).collect()} == {5, 10}


def test_sample_size_study(spark, inputs):
    hauls, catch, stations, _ = inputs
    tows = study_tows(hauls, catch, {"Near Dredge": "Near", "Far Dredge": "Far"}, 850)
    assert {r.area_name for r in tows.select("area_name").distinct().collect()} == {"Near", "Far"}
    # Tow 2 was 30 % longer in the field than planned, so the field length counts.
    assert {r.tow for r in tows.where("event like '%2'").select("tow").collect()} == {1.3}
    assert tows.where("s_count is null").count() == 9
    named = stations.withColumn("SURVEY_AREA", F.regexp_replace("SURVEY_AREA", " Dredge", ""))
    areas = bed_areas(named)
    got = sample_size_tables(tows, areas, reps=60, na_rm=True)
    study = got["study"].toPandas()
    assert set(study.m) == {2, 4, 5, 6} and study.p_mean.notna().all()
    strict = sample_size_tables(tows, areas, reps=60)["study"].toPandas()
    assert strict.p_mean.isna().all()
    assert set(got["comparison"].columns) == {"area_name", "bed", "fraction", "type", "value"}


def test_biology_tables(spark):
    hauls = spark.createDataFrame([("h1", "A", "v"), ("h2", "B", "v")], "event string, bed string, vessel string")
    hauls = hauls.withColumn("date", F.to_date(F.lit("2016-04-14")))
    people = [("h1", 1, 1, 1, 0, 100.0, None), ("h1", 1, 2, 1, 0, 101.0, None), ("h1", 1, 3, 1, 1, 103.0, None), ("h2", 1, 1, 2, 4, 60.0, None), ("h2", 1, 2, 1, 0, 99.0, 1)]
    animals = spark.createDataFrame(people, "event string, species int, number int, size_class int, worm int, height double, clapper int")
    bio = biology.live_individuals(animals, hauls, 1)
    assert {r.bed_month for r in bio.collect()} == {"A April", "B April"}
    table = biology.class_table(bio, "worm", "bed", biology.WORM_LABELS)
    wide = {r["class"]: (r.A, r.B) for r in biology.wide_class_table(table, "bed", ["A", "B"]).collect()}
    assert wide["0%"] == (66.67, 0.0) and wide["75 - 100%"] == (0.0, 100.0) and wide["n"] == (3.0, 1.0)
    catch = spark.createDataFrame([("h1", 1, 1, 1, 12), ("h2", 1, 1, 2, 1)], "event string, species int, cond int, size_class int, count int")
    grown = biology.expanded_heights(animals, catch, hauls, 1)
    assert grown["rows"].where("event = 'h1'").count() == 12
    assert {r.difference for r in grown["check"].collect()} == {0}


def test_bycatch(spark):
    hauls = spark.createDataFrame([("h1", "A", 2.0)], "event string, bed string, length double")
    catch = spark.createDataFrame([("h1", 68560, 1, 4, 1.0)], "event string, species int, sample_type int, count int, sample_wt double")
    assert biology.bycatch_rate(catch, hauls, 68560)[1].first().cpue_mean == 2.0


def test_report_tables(spark):
    df = spark.createDataFrame([("W", "large", 1234567.5, 12.4), ("E", "large", 2.5, 99.6)], "bed string, variable string, total double, cv double")
    got = report.print_table(df, ["bed"], {"N": ("total", 0), "CV": ("cv", 0)}, "bed", ["E", "W"])
    assert [tuple(r) for r in got.collect()] == [("E", "2", "100"), ("W", "1,234,568", "12")]
    totals = report.district_totals(df, "bed", {"west": ["W"]}, "total", "cv")
    assert {r.district: r.CV for r in totals.collect()} == {"west": 12.4, "NA": 99.6}
    span = report.survey_totals(df, ["E", "W"], "bed", ["total"], ["cv"]).first()
    assert (span.total, span.cv) == (1234570.0, 12.4)
