"""Resampling queries. The comparison SQL makes the same hashed draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base, draws_sql
from towline.catalog.base import query, tidy, tidy_sql
from towline.functions import units
from towline.operators import resampling as rs
from towline.operators.resampling import GOLDEN, POISSON_CUTS

REPS = units.REPLICATES
SEED = 20160414
MEASURES = ["large", "small", "all"]


def _rows(columns: str, source: str, strata: str, key: str) -> str:
    """Rows numbered from 0 in key order within the stratum."""
    return f"SELECT {strata}, {columns}, row_number() OVER (PARTITION BY {strata} ORDER BY {key}) - 1 AS i FROM {source}"


BOOT = f"""{base.DENSITIES},
rows AS MATERIALIZED ({_rows('area, large, small, "all"', "densities", "district, bed", "haul")}),
strata AS MATERIALIZED (SELECT district, bed, max(area) AS area, {draws_sql.base_hash(SEED, "district", "bed")} AS base,
  count(*) AS m, count(*) AS n FROM rows GROUP BY district, bed),
drawn AS ({draws_sql.draws("SELECT district, bed, area, base, m, n FROM strata", "district, bed, area", REPS)}),
replicates AS MATERIALIZED (
  SELECT d.district, d.bed, any_value(d.area) AS area, d.r, avg(w.large) AS large, avg(w.small) AS small, avg(w."all") AS "all"
  FROM drawn d JOIN rows w ON d.district = w.district AND d.bed = w.bed AND d.i = w.i GROUP BY d.district, d.bed, d.r),
boot AS (
  SELECT district, bed, 'large' AS variable, r AS replicate, large AS dbar, area * large AS total FROM replicates
  UNION ALL SELECT district, bed, 'small', r, small, area * small FROM replicates
  UNION ALL SELECT district, bed, 'all', r, "all", area * "all" FROM replicates)"""
SUMMARY_STATS = ("mean", "ll", "ul", "var", "cv")


def boot(spark, sf, method="exact", reps=REPS, **how):
    return rs.bootstrap(
        base.haul_densities(spark, sf),
        ["district", "bed"],
        "haul",
        MEASURES,
        base.bed_areas(spark, sf),
        reps=reps,
        seed=SEED,
        method=method,
        **how,
    )


@query(
    "b01_bootstrap_exact",
    tidy_sql(f"WITH {BOOT} SELECT district, bed, variable, replicate, dbar, total FROM boot", "dbar", "total"),
)
def b01(spark, sf):
    return tidy(boot(spark, sf))


@query(
    "b01_bootstrap_split",
    tidy_sql(f"WITH {BOOT} SELECT district, bed, variable, replicate, dbar, total FROM boot", "dbar", "total"),
)
def b01_split(spark, sf):
    """The same replicates from strata of many tiles."""
    return tidy(boot(spark, sf, tile_rows=50))


def _summary_sql(stat: str, suffix: str) -> str:
    return f"""avg({stat}) AS mean_{suffix}, quantile_cont({stat}, 0.025) AS ll_{suffix}, quantile_cont({stat}, 0.975) AS ul_{suffix},
      var_samp({stat}) AS var_{suffix}, 100 * stddev_samp({stat}) / avg({stat}) AS cv_{suffix}"""


@query(
    "b03_bootstrap_summary",
    tidy_sql(
        f"""WITH {BOOT} SELECT district, bed, variable, {_summary_sql('total', 'n')}, {_summary_sql('dbar', 'dbar')}
            FROM boot GROUP BY district, bed, variable""",
        *[f"{s}_{x}" for x in ("n", "dbar") for s in SUMMARY_STATS],
    ),
)
def b03(spark, sf):
    out = rs.bootstrap_summary(boot(spark, sf), ["district", "bed", "variable"], {"n": "total", "dbar": "dbar"})
    return tidy(out)


WEIGHTS = " + ".join(f"CASE WHEN (z >> 32) >= {c} THEN 1 ELSE 0 END" for c in POISSON_CUTS)
# Rows are hashed once, then once per replicate.
ROW_HASH = draws_sql.mixed(
    f"""SELECT haul, district, bed, area, large, small, "all",
        ((haul::HUGEINT + {SEED * GOLDEN % 2**64}::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS z
        FROM densities""",
    "haul, district, bed, area, large, small, \"all\"",
)
POISSON_DRAW = draws_sql.mixed(
    f"""SELECT district, bed, area, large, small, "all", r, ((h::HUGEINT + z::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS z
        FROM ({draws_sql.counter(f'SELECT district, bed, area, large, small, "all", z AS h, r FROM hashed, range({REPS}) t(r)', 'district, bed, area, large, small, "all", h, r', "r + 1")})""",
    'district, bed, area, large, small, "all", r',
)


@query(
    "b01_bootstrap_poisson",
    tidy_sql(
        f"""WITH {base.DENSITIES}, hashed AS MATERIALIZED ({ROW_HASH}),
            weighted AS (SELECT district, bed, area, large, small, "all", r, {WEIGHTS} AS w FROM ({POISSON_DRAW})),
            means AS (
              SELECT district, bed, max(area) AS area, r, sum(w * large) / sum(w) AS large, sum(w * small) / sum(w) AS small,
                     sum(w * "all") / sum(w) AS "all"
              FROM weighted GROUP BY district, bed, r)
            SELECT district, bed, variable, r AS replicate, dbar, area * dbar AS total
            FROM (UNPIVOT means ON large, small, "all" INTO NAME variable VALUE dbar)""",
        "dbar",
        "total",
    ),
)
def b01_poisson(spark, sf):
    return tidy(boot(spark, sf, "poisson"))


RATIO = f"""numbered AS (
  SELECT p_brand AS bed, 1 - l_discount AS ratio, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS animal, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
rows AS MATERIALIZED ({_rows("ratio", "numbered", "bed", "animal, l_suppkey, ratio")}),
strata AS MATERIALIZED (SELECT bed, {draws_sql.base_hash(SEED, "bed")} AS base, count(*) AS m, count(*) AS n FROM rows GROUP BY bed),
drawn AS ({draws_sql.draws("SELECT bed, base, m, n FROM strata", "bed", REPS)}),
replicates AS (SELECT d.bed, d.r AS replicate, avg(w.ratio) AS ratio FROM drawn d JOIN rows w ON d.bed = w.bed AND d.i = w.i
  GROUP BY d.bed, d.r)"""


def ratio_boot(spark, sf):
    line, part = base.read(spark, sf, "lineitem"), base.read(spark, sf, "part")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    ratio = 1 - F.col("l_discount")
    # Line numbers repeat within an order, so the rest of the record makes the key unique in effect.
    animal = F.struct(number.alias("number"), "l_suppkey", ratio.alias("ratio"))
    rows = line.join(part, line.l_partkey == part.p_partkey)
    rows = rows.select(F.col("p_brand").alias("bed"), ratio.alias("ratio"), animal.alias("animal"))
    return rs.bootstrap_ratio(rows, ["bed"], "animal", "ratio", REPS, SEED)


@query("b02_bootstrap_ratio", tidy_sql(f"WITH {RATIO} SELECT bed, replicate, ratio FROM replicates", "ratio"))
def b02(spark, sf):
    return tidy(ratio_boot(spark, sf))


@query(
    "b03_ratio_summary",
    tidy_sql(
        f"WITH {RATIO} SELECT bed, {_summary_sql('ratio', 'ratio')} FROM replicates GROUP BY bed",
        *[f"{s}_ratio" for s in SUMMARY_STATS],
    ),
)
def b03_ratio(spark, sf):
    return tidy(rs.bootstrap_summary(ratio_boot(spark, sf), ["bed"], {"ratio": "ratio"}))


# Bed area is the number of its station cells. A haul that caught nothing has no density, as a missing record.
STUDY = f"""{base.LOCATED}, {base.CATCH}, cells AS (SELECT bed, count(*)::DOUBLE AS area FROM stations GROUP BY bed),
tows AS (
  SELECT l.haul, l.district, l.bed, l.year, c.area, k.count / (l.effort * 0.00131663) AS s_count
  FROM located l JOIN cells c ON l.bed = c.bed LEFT JOIN (SELECT haul, sum(count) AS count FROM catch GROUP BY haul) k ON l.haul = k.haul),
rows AS MATERIALIZED ({_rows("area, s_count", "tows", "district, bed, year", "haul")}),
frame AS MATERIALIZED (SELECT district, bed, year, max(area) AS area, count(*) AS n FROM rows GROUP BY district, bed, year)"""


def cell_counts(spark, sf):
    return base.stations(spark, sf).groupBy("bed").agg(F.count(F.lit(1)).cast("double").alias("area"))


def study_rows(spark, sf):
    sums = base.catch(spark, sf).groupBy("haul").agg(F.sum("count").alias("count"))
    tows = base.located_hauls(spark, sf).join(sums, "haul", "left")
    return tows.withColumn("s_count", F.col("count") / (F.col("effort") * F.lit(units.DREDGE_WIDTH_NMI)))


STUDY_STRATA = ["district", "bed", "year"]


@query(
    "b04_resample_sizes",
    tidy_sql(
        f"""WITH {STUDY}, sized AS MATERIALIZED (
              SELECT *, {draws_sql.base_hash(SEED, "district", "bed", "year", "0.4")} AS base, round_even(area * 0.4, 0)::BIGINT AS m
              FROM frame),
            drawn AS ({draws_sql.draws("SELECT district, bed, year, base, m, n FROM sized", "district, bed, year", REPS)})
            SELECT d.district, d.bed, d.year, 0.4::DOUBLE AS design, any_value(d.n) AS n, any_value(d.m) AS m, d.r AS replicate,
                   coalesce(sum(w.s_count), 0) AS sum_s_count, count(w.s_count) AS cnt_s_count
            FROM drawn d JOIN rows w ON d.district = w.district AND d.bed = w.bed AND d.year = w.year AND d.i = w.i
            GROUP BY d.district, d.bed, d.year, d.r""",
        "sum_s_count",
    ),
)
def b04(spark, sf):
    sums = rs.resample(
        study_rows(spark, sf),
        STUDY_STRATA,
        "haul",
        ["s_count"],
        REPS,
        SEED,
        draws={0.4: F.bround(F.col("area") * 0.4)},
        attributes=cell_counts(spark, sf),
        on=["bed"],
    )
    return tidy(sums.drop("area"))


DESIGN = f"""{STUDY}, sized AS MATERIALIZED (
  SELECT *, {draws_sql.base_hash(SEED, "district", "bed", "year", "fraction")} AS base FROM (
    SELECT f.*, p.fraction, CASE WHEN p.fraction = 0.35 THEN floor(round_even(area, 0) * 0.35) ELSE round_even(area * p.fraction, 0) END::BIGINT AS m
    FROM frame f, (SELECT unnest([0.2, 0.3, 0.35, 0.4, 0.5]::DOUBLE[]) AS fraction) p)),
drawn AS ({draws_sql.draws("SELECT district, bed, year, area, fraction, base, m, n FROM sized", "district, bed, year, area, fraction", REPS)}),
replicates AS (
  SELECT d.district, d.bed, d.year, d.fraction, any_value(d.m) AS m, d.r, any_value(d.area) * avg(w.s_count) AS P
  FROM drawn d JOIN rows w ON d.district = w.district AND d.bed = w.bed AND d.year = w.year AND d.i = w.i
  GROUP BY d.district, d.bed, d.year, d.fraction, d.r HAVING count(w.s_count) = count(*)),
study AS MATERIALIZED (
  SELECT district, bed, year, fraction, any_value(m) AS m, avg(P) AS p_mean, stddev_samp(P) AS p_sd, var_samp(P) AS p_var
  FROM replicates GROUP BY district, bed, year, fraction)"""


def study(spark, sf):
    return rs.design_study(
        study_rows(spark, sf),
        STUDY_STRATA,
        "haul",
        "s_count",
        cell_counts(spark, sf),
        ["bed"],
        reps=REPS,
        seed=SEED,
        na_rm=True,
    )


@query(
    "b05_design_study",
    tidy_sql(f"WITH {DESIGN} SELECT * FROM study", "p_mean", "p_sd", "p_var"),
)
def b05(spark, sf):
    return tidy(study(spark, sf))


@query(
    "b06_compare_designs",
    tidy_sql(
        f"""WITH {DESIGN}, diffs AS (
              SELECT s.district, s.bed, s.fraction, avg(100 * abs((r.p_mean - s.p_mean) / nullif(r.p_mean, 0))) AS mean_diff,
                     avg(100 * abs((r.p_sd - s.p_sd) / nullif(r.p_sd, 0))) AS sd_diff
              FROM study s JOIN study r ON s.district = r.district AND s.bed = r.bed AND s.year = r.year AND r.fraction = 0.5
              WHERE s.fraction <> 0.5 GROUP BY s.district, s.bed, s.fraction)
            SELECT district, bed, fraction, 'mean' AS type, mean_diff AS value FROM diffs
            UNION ALL SELECT district, bed, fraction, 'sd', sd_diff FROM diffs""",
        "value",
    ),
)
def b06(spark, sf):
    return tidy(rs.compare_designs(study(spark, sf), STUDY_STRATA, ["year"]))


@query(
    "b07_seeded_hash",
    f"""WITH {base.STATIONS} SELECT station, {draws_sql.base_hash(SEED, "district", "bed", "station")} AS base FROM stations""",
)
def b07(spark, sf):
    keyed = rs.stratum_hash(SEED, ["district", "bed", "station"])
    return base.stations(spark, sf).select("station", keyed.alias("base"))


@query(
    "b08_replicate_numbers",
    f"""WITH {base.LOCATED} SELECT bed, {REPS}::BIGINT AS reps, 0::BIGINT AS first, {REPS - 1}::BIGINT AS last, count(*) AS draws
        FROM located GROUP BY bed""",
)
def b08(spark, sf):
    rows = base.located_hauls(spark, sf).select("bed", "haul", "effort")
    sums = rs.resample(rows, ["bed"], "haul", ["effort"], REPS, SEED)
    return sums.groupBy("bed").agg(
        F.count(F.lit(1)).alias("reps"),
        F.min("replicate").alias("first"),
        F.max("replicate").alias("last"),
        F.max("cnt_effort").alias("draws"),
    )
