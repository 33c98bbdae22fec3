"""Estimator queries: densities, expansions, catch rates, the design-based chain, harvest levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base
from towline.catalog.base import query, tidy, tidy_sql
from towline.catalog.join_queries import t_sql
from towline.functions import units
from towline.functions.scalar import precision_columns, swept_area
from towline.operators import design_based as db
from towline.operators import estimators as est
from towline.operators import joins
from towline.operators.cleaning import meat_ratio
from towline.operators.joins import complete_with_zero
from towline.operators.reshape import pivot_sum
from towline.plans.population import population_tables, used_tows
from towline.session import cut_lineage

STRATA = ["year", "district", "bed"]
MEASURES = ["large", "small", "all"]


@query(
    "e01_swept_area",
    f"WITH {base.HAULS} SELECT haul, effort * 0.00131663 * 0.83 AS ai FROM hauls",
)
def e01(spark, sf):
    area = swept_area("effort", units.DREDGE_WIDTH_NMI, units.DREDGE_EFFICIENCY)
    return base.hauls(spark, sf).select("haul", area.alias("ai"))


@query(
    "e02_density",
    tidy_sql(
        f"""WITH {base.DENSITIES} SELECT haul, bed, 'large' AS variable, large AS di FROM densities
            UNION ALL SELECT haul, bed, 'small', small FROM densities
            UNION ALL SELECT haul, bed, 'all', "all" FROM densities""",
        "di",
    ),
)
def e02(spark, sf):
    return tidy(base.haul_densities(spark, sf).unpivot(["haul", "bed"], MEASURES, "variable", "di"))


LONG = f"""{base.DENSITIES}, long AS (
  SELECT year, district, bed, area, 'large' AS variable, large AS di FROM densities
  UNION ALL SELECT year, district, bed, area, 'small', small FROM densities
  UNION ALL SELECT year, district, bed, area, 'all', "all" FROM densities),
moments AS (
  SELECT year, district, bed, variable, count(*) AS n, max(area) AS area, sum(di) / count(*) AS dbar,
         var_samp(di) AS var_dbar, var_samp(di) * (count(*) - 1) AS ss
  FROM long GROUP BY year, district, bed, variable),
estimates AS (
  SELECT *, 100 * sqrt(var_dbar) / nullif(dbar, 0) AS cv, area * dbar AS total,
         area * area * ss / nullif(n * (n - 1), 0) AS var_total,
         100 * sqrt(area * area * ss / nullif(n * (n - 1), 0)) / nullif(area * dbar, 0) AS cv_total,
         sqrt(area * area * ss / nullif(n * (n - 1), 0)) AS sd_total
  FROM moments)"""
ESTIMATE_COLUMNS = ("area", "dbar", "var_dbar", "cv", "ss", "total", "var_total", "cv_total", "sd_total")


def estimates(spark, sf):
    return est.expand_estimate(base.haul_densities(spark, sf), STRATA, MEASURES, base.bed_areas(spark, sf))


@query(
    "e03_expand_estimate",
    tidy_sql(
        f"""WITH {LONG} SELECT year, district, bed, variable, n, {', '.join(ESTIMATE_COLUMNS)} FROM estimates""",
        *ESTIMATE_COLUMNS,
    ),
)
def e03(spark, sf):
    return tidy(estimates(spark, sf))


CLAPPER = f"""{base.LOCATED}, {base.AREAS}, {base.CATCH},
dead AS (SELECT haul, sum(count) AS c, sum(weight) AS wt FROM catch WHERE cond = 'R' GROUP BY haul),
dense AS (
  SELECT l.year, l.district, l.bed, a.area, coalesce(d.c, 0) / (l.effort * 0.00131663 * 0.83) AS c,
         coalesce(d.wt, 0) / (l.effort * 0.00131663 * 0.83) AS wt
  FROM located l LEFT JOIN dead d ON l.haul = d.haul LEFT JOIN areas a ON l.bed = a.bed)"""


def clapper_density(spark, sf):
    frame = est.haul_frame(base.located_hauls(spark, sf), "effort")
    dead = base.catch(spark, sf).where(F.col("cond") == "R").groupBy("haul")
    dead = dead.agg(F.sum("count").alias("c"), F.sum("weight").alias("wt"))
    full = complete_with_zero(dead, frame, ["haul"], ["c", "wt"], how="frame")
    return est.add_density(full, ["c", "wt"], total=None)


def clapper_estimate(spark, sf, densities):
    return est.expand_estimate_wide(clapper_density(spark, sf), STRATA, densities, base.bed_areas(spark, sf))


def _wide(suffix: str) -> str:
    return f"""sum({suffix}) / count(*) AS dbar_{suffix}, var_samp({suffix}) AS var_dbar_{suffix},
      100 * sqrt(var_samp({suffix})) / nullif(avg({suffix}), 0) AS cv_{suffix}, var_samp({suffix}) * (count(*) - 1) AS ss_{suffix},
      max(area) * avg({suffix}) AS total_{suffix}, max(area) * max(area) * var_samp({suffix}) / count(*) AS var_total_{suffix},
      100 * sqrt(max(area) * max(area) * var_samp({suffix}) / count(*)) / nullif(max(area) * avg({suffix}), 0) AS cv_total_{suffix}"""


@query(
    "e04_clapper_estimate",
    tidy_sql(
        f"""WITH {CLAPPER} SELECT year, district, bed, count(*) AS n, max(area) AS area, {_wide('c')}, {_wide('wt')}
            FROM dense GROUP BY year, district, bed""",
        "area",
        *[f"{k}_{m}" for m in ("c", "wt") for k in ("dbar", "var_dbar", "cv", "ss", "total", "var_total", "cv_total")],
    ),
)
def e04(spark, sf):
    return tidy(clapper_estimate(spark, sf, {"c": "c", "wt": "wt"}))


CPUE = f"""{base.LOCATED}, {base.CATCH},
parts AS (
  SELECT haul, coalesce(sum(weight) FILTER (WHERE cond = 'A' AND size_class = 'F'), 0) AS t1,
         coalesce(sum(weight) FILTER (WHERE cond = 'A' AND size_class = 'O'), 0) AS t2,
         coalesce(sum(count) FILTER (WHERE cond = 'R' AND size_class = 'F'), 0) AS s1,
         coalesce(sum(count) FILTER (WHERE cond = 'R' AND size_class = 'O'), 0) AS s2
  FROM catch GROUP BY haul),
rates AS (
  SELECT l.haul, l.bed, coalesce(s1, 0) + coalesce(s2, 0) + CASE WHEN coalesce(t2, 0) > 0 THEN t1 * s2 / t2 ELSE 0 END AS s_tot,
         l.effort FROM located l LEFT JOIN parts p ON l.haul = p.haul WHERE l.status <> 'P')"""


def cpue(spark, sf):
    records = base.catch(spark, sf).withColumn("sample_type", F.when(F.col("size_class") == "F", 1).otherwise(2))
    used = base.located_hauls(spark, sf).where(F.col("status") != "P")
    return est.cpue(records, used, "haul", "bed", "effort", F.col("cond") == "R", F.col("cond") == "A")


@query(
    "e05_cpue_by_haul",
    tidy_sql(f"WITH {CPUE} SELECT haul, bed, s_tot, s_tot / effort AS s_cpm FROM rates", "s_tot", "s_cpm"),
)
def e05_haul(spark, sf):
    return tidy(cpue(spark, sf)[0].select("haul", "bed", "s_tot", "s_cpm"))


@query(
    "e05_cpue",
    tidy_sql(
        f"""WITH {CPUE} SELECT bed, avg(s_tot / effort) AS cpue_mean, stddev_samp(s_tot / effort) AS cpue_sd,
              100 * stddev_samp(s_tot / effort) / avg(s_tot / effort) AS cpue_cv, sum(s_tot) AS tot_catch FROM rates GROUP BY bed""",
        "cpue_mean",
        "cpue_sd",
        "cpue_cv",
        "tot_catch",
    ),
)
def e05(spark, sf):
    return tidy(cpue(spark, sf)[1])


# The design-based chain. A bed is a nation and a market segment; tow length is effort in thousands.
CHAIN = f"""{base.LOCATED}, {base.CATCH},
tows AS (
  SELECT l.district AS area, l.bed || '-' || l.segment AS bed, l.year, l.haul, l.effort / 1000 AS length,
         coalesce(c.count, 0) AS count, coalesce(c.weight, 0) AS weight
  FROM located l LEFT JOIN (SELECT haul, sum(count) AS count, sum(weight) AS weight FROM catch WHERE cond <> 'N' GROUP BY haul) c
    ON l.haul = c.haul WHERE l.status = 'F' AND l.year > 1995),
summary AS (
  SELECT area, bed, year, count(*) AS number_of_tows, sum(length) AS total_nm_towed, sum(count) AS raw_count,
         sum(weight) AS raw_wt_kg, sum(count * (1 / length)) AS count_per_nm, sum(weight * (1 / length)) AS wt_kg_per_nm,
         avg(count * (1 / length)) AS mean_count_per_nm, avg(weight * (1 / length)) AS mean_wt_kg_per_nm,
         var_samp(count * (1 / length)) AS var_of_count, var_samp(weight * (1 / length)) AS var_of_wt
  FROM tows GROUP BY area, bed, year),
frame AS (
  SELECT district AS area, bed || '-' || segment AS bed, sum(cell_area) AS sq_nm, count(*) AS big_n
  FROM stations GROUP BY district, bed, segment),
g AS (
  SELECT s.*, round(f.sq_nm::DECIMAL(18, 2), 1)::DOUBLE AS sq_nm, f.big_n, s.number_of_tows * 0.001316656::DOUBLE AS area_swept
  FROM summary s JOIN frame f ON s.area = f.area AND s.bed = f.bed),
h AS (
  SELECT *, 759.5 * mean_wt_kg_per_nm * sq_nm AS pop_wt_kg, 759.5 * mean_wt_kg_per_nm * sq_nm * 2.20462262 AS pop_wt_lb,
         759.5 * mean_count_per_nm * sq_nm AS pop_count,
         var_of_count / number_of_tows * (1 - number_of_tows / big_n) AS var_cbar_count,
         var_of_wt / number_of_tows * (1 - number_of_tows / big_n) AS var_cbar_wt
  FROM g),
i AS (
  SELECT h.*, CASE WHEN var_cbar_count >= 0 THEN t * sqrt(var_cbar_count) END AS ci_mean_count,
         CASE WHEN var_cbar_wt >= 0 THEN t * sqrt(var_cbar_wt) END AS ci_mean_wt,
         var_cbar_count * (sq_nm * 759.5) * (sq_nm * 759.5) AS var_pop_count,
         var_cbar_wt * (sq_nm * 759.5) * (sq_nm * 759.5) AS var_pop_wt
  FROM (SELECT *, {t_sql("number_of_tows")} AS t FROM h) h),
j AS (
  SELECT *, CASE WHEN var_pop_count >= 0 THEN t * sqrt(var_pop_count) END AS ci_pop_count,
         CASE WHEN var_pop_wt >= 0 THEN t * sqrt(var_pop_wt) END AS ci_pop_wt,
         CASE WHEN var_pop_count >= 0 THEN sqrt(var_pop_count) / nullif(pop_count, 0) END AS cv_count,
         CASE WHEN var_pop_wt >= 0 THEN sqrt(var_pop_wt) / nullif(pop_wt_kg, 0) END AS cv_wt
  FROM i),
k AS (
  SELECT l.year, lower(trim(' ' || upper(l.bed || '-' || l.segment))) AS bed,
         sum(li.l_extendedprice * (1 - li.l_discount)) / sum(li.l_extendedprice) AS mr_rate
  FROM lineitem li JOIN located l ON li.l_orderkey = l.haul WHERE li.l_linestatus = 'F' GROUP BY 1, 2),
l AS (
  SELECT j.* EXCLUDE (pop_wt_lb), k.mr_rate, j.mean_wt_kg_per_nm * 2.2046 AS mean_wt_lb_per_nm, j.pop_wt_kg * 2.2046 AS pop_wt_lb,
         j.pop_wt_kg * k.mr_rate AS meat_kg, j.pop_wt_kg * k.mr_rate * 2.20462262 AS meat_lb
  FROM j JOIN k ON k.bed = lower(trim(j.bed)) AND k.year = j.year)"""


def chain(spark, sf, once: bool = False):
    """Inputs of the population plan made from the test tables, in the survey's own schema.

    ``once`` writes the hauls with their strata first, of which the survey's hauls and recovery records are both made.
    """
    located = base.located_hauls(spark, sf)
    located = cut_lineage(located) if once else located
    bed = F.concat_ws("-", "bed", "segment")
    hauls = located.select(
        F.col("year").alias("YEAR"),
        F.col("priority").alias("PROJECT_CODE"),
        F.col("haul").alias("EVENT_ID"),
        F.col("district").alias("SURVEY_AREA"),
        bed.alias("BED"),
        F.col("station").alias("STATION_ID"),
        (F.col("effort") / 1000).alias("TOW_LENGTH_DESIGNATED"),
        F.when(F.col("status") == "F", "YES").otherwise("NO").alias("USED_IN_ESTIMATE"),
    )
    records = base.catch(spark, sf).select(
        F.col("haul").alias("EVENT_ID"),
        F.lit(850).alias("SPECIES_CODE"),
        F.when(F.col("cond") != "N", 1).otherwise(2).alias("CONDITION_CODE"),
        F.col("count").alias("COUNT"),
        F.col("weight").alias("SAMPLE_WT_KG"),
    )
    cells = base.stations(spark, sf).select(
        F.col("district").alias("SURVEY_AREA"), bed.alias("BED"), F.col("cell_area").alias("Area_Sq_NM")
    )
    line = base.read(spark, sf, "lineitem").where(F.col("l_linestatus") == "F")
    recovery = line.join(located, line.l_orderkey == located.haul).select(
        F.concat(F.lit(" "), F.upper(bed)).alias("BED"),
        F.concat(F.lit("Survey "), F.col("year")).alias("SURVEY_AND_YEAR"),
        F.col("l_extendedprice").alias("WHOLE_WT_KG"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("MEAT_WT_KG"),
    )
    return hauls, population_tables(hauls, records, cells, recovery, 850, 1)


def _chain_query(name: str, step: str, table: str, columns: tuple[str, ...], doubles: tuple[str, ...]):
    keys = "lower(area) AS area, lower(bed) AS bed, year"
    sql = tidy_sql(f"WITH {CHAIN} SELECT {keys}, {', '.join(columns)} FROM {step}", *doubles)

    @query(name, sql)
    def run(spark, sf):
        return tidy(chain(spark, sf)[1][table].select("area", "bed", "year", *columns))

    return run


@query(
    "e06_standardize",
    tidy_sql(
        f"""WITH {CHAIN} SELECT haul, count * (1 / length) AS st_count, weight * (1 / length) AS st_weight FROM tows""",
        "st_count",
        "st_weight",
    ),
)
def e06(spark, sf):
    tows = chain(spark, sf)[1]["tows"]
    made = est.standardize(tows, {"st_count": "count", "st_weight": "weight"}, "length")
    return tidy(made.select(F.col("EVENT_ID").alias("haul"), "st_count", "st_weight"))


SUMMARY = ("total_nm_towed", "raw_count", "raw_wt_kg", "count_per_nm", "wt_kg_per_nm", "mean_count_per_nm")
SUMMARY += ("mean_wt_kg_per_nm", "var_of_count", "var_of_wt")
_chain_query("e07_tow_summary", "summary", "summary", ("number_of_tows", *SUMMARY), SUMMARY)


@query(
    "e08_stratum_frame",
    tidy_sql(
        f"""WITH {base.STATIONS} SELECT district, bed, segment, sum(cell_area) AS sq_nm, count(*) AS big_n
            FROM stations GROUP BY district, bed, segment""",
        "sq_nm",
    ),
)
def e08(spark, sf):
    return tidy(db.stratum_frame(base.stations(spark, sf), ["district", "bed", "segment"], "cell_area"))


_chain_query("e09_area_swept", "g", "population", ("number_of_tows", "sq_nm", "big_n", "area_swept"), ("area_swept",))
POPULATION = ("pop_wt_kg", "pop_wt_lb", "pop_count")
_chain_query("e10_population_estimate", "h", "population", POPULATION, POPULATION)
FPC = ("var_cbar_count", "var_cbar_wt")
_chain_query("e11_var_mean_fpc", "h", "population", FPC, FPC)
INTERVAL = ("ci_mean_count", "ci_mean_wt", "var_pop_count", "var_pop_wt", "ci_pop_count", "ci_pop_wt", "cv_count", "cv_wt")
_chain_query("e12_t_interval", "j", "interval", ("t", *INTERVAL), INTERVAL)


@query(
    "e12_t_interval_large_strata",
    tidy_sql(
        f"""WITH {base.LOCATED}, per AS (SELECT district, count(*) AS n, var_samp(effort) AS v, avg(effort) AS m FROM located GROUP BY district)
            SELECT district, n, t, m, t * sqrt(v / n) AS half FROM (SELECT *, {t_sql("n")} AS t FROM per)""",
        "m",
        "half",
    ),
)
def e12_large(spark, sf):
    """Interval of the mean effort with a district as stratum: thousands of tows in each."""
    per = base.located_hauls(spark, sf).groupBy("district").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("effort").alias("v"), F.avg("effort").alias("m")
    )
    with_t = joins.with_t_quantile(per, "n").withColumn("half", F.col("t") * F.sqrt(F.col("v") / F.col("n")))
    return tidy(with_t.select("district", "n", "t", "m", "half"))


MEAT = ("mr_rate", "mean_wt_lb_per_nm", "pop_wt_lb", "meat_kg", "meat_lb")
_chain_query("e13_recovery_estimate", "l", "with_meat", MEAT, MEAT)


@query(
    "e14_used_tows",
    f"""WITH {base.LOCATED} SELECT year, haul AS event, bed || '-' || segment AS bed, station FROM located WHERE status = 'F'
        ORDER BY year, haul DESC, bed, station""",
)
def e14_used(spark, sf):
    used = used_tows(chain(spark, sf)[0])
    return used.select(
        F.col("YEAR").alias("year"), F.col("EVENT_ID").alias("event"), F.col("BED").alias("bed"), F.col("STATION_ID").alias("station")
    )


# Columns of the printed report: rounded numbers, and texts of numbers with two decimals, some of whole numbers.
REPORT_NUMBERS = {
    "sq_nm": "round_even(l.sq_nm, 2)",
    "total_nm_towed": "round_even(l.total_nm_towed, 2)",
    "area_swept": "round_even(l.area_swept, 6)",
    "raw_count": "l.raw_count",
    "wt_kg_per_nm": "round_even(l.wt_kg_per_nm, 1)",
    "mean_count_per_nm": "round_even(l.mean_count_per_nm, 2)",
    "mean_wt_kg_per_nm": "round_even(l.mean_wt_kg_per_nm, 1)",
    "mr_rate": "round_even(l.mr_rate, 3)",
    "density_m2": "round_even(l.pop_count / nullif(l.sq_nm * 3429904, 0), 3)",
    "avg_weight_g": "round_even(l.pop_wt_kg * 1000 / nullif(l.pop_count, 0), 0)",
}
REPORT_TEXTS = {
    **{c: f"round(l.{c}, 2)" for c in ("var_of_count", "var_of_wt", "ci_mean_wt", "pop_wt_kg", "pop_wt_lb", "var_cbar_count")},
    **{c: f"round(l.{c}, 2)" for c in ("var_cbar_wt", "var_pop_count", "var_pop_wt", "ci_pop_wt", "cv_wt", "meat_kg", "meat_lb")},
    **{c: f"round_even(l.{c}, 0)" for c in ("ci_mean_count", "pop_count", "ci_pop_count")},
    "cv_count": "round_even(l.cv_count, 2)",
}
REPORT = {**REPORT_NUMBERS, **REPORT_TEXTS}


@query(
    "e14_final_report",
    tidy_sql(
        f"""WITH {CHAIN} SELECT DISTINCT l.year, p.priority AS project_code, lower(l.area) AS area, lower(l.bed) AS bed, l.number_of_tows,
              {', '.join(f'({sql})::DOUBLE AS {c}' for c, sql in REPORT.items())}
            FROM l JOIN (SELECT DISTINCT district, bed || '-' || segment AS bed, year, priority FROM located
                         WHERE status = 'F') p ON p.district = l.area AND p.bed = l.bed AND p.year = l.year""",
        *REPORT,
    ),
)
def e14(spark, sf):
    """All columns of the report; texts are read back as numbers, so that both sides round alike."""
    report = chain(spark, sf, once=True)[1]["report"]
    texts = {c: F.replace(c, F.lit(","), F.lit("")).cast("double") for c in REPORT_TEXTS}
    numbers = {c: F.col(c).cast("double") for c in REPORT_NUMBERS}
    return tidy(report.withColumns(texts | numbers))


@query(
    "e15_catch_table",
    tidy_sql(
        f"""WITH {base.LOCATED}, {base.CATCH}, per AS (
              SELECT haul, sum(CASE WHEN size_class = 'F' THEN count ELSE 0 END) AS large,
                     sum(CASE WHEN size_class = 'O' THEN count ELSE 0 END) AS small,
                     sum(CASE WHEN size_class = 'F' THEN weight ELSE 0 END) AS large_g,
                     sum(CASE WHEN size_class = 'O' THEN weight ELSE 0 END) AS small_g
              FROM catch WHERE cond = 'A' GROUP BY haul)
            SELECT l.bed, sum(large) AS large_c, min(large) AS min_large, max(large) AS max_large, sum(small) AS small_c,
                   min(small) AS min_small, max(small) AS max_small, sum(large_g * 0.00220462) AS large_g_lb,
                   sum(large_g / 1000) AS large_g_kg, sum(small_g * 0.00220462) AS small_g_lb, sum(small_g / 1000) AS small_g_kg
            FROM located l JOIN per p ON l.haul = p.haul GROUP BY l.bed""",
        *("large_c", "min_large", "max_large", "small_c", "min_small", "max_small"),
        *("large_g_lb", "large_g_kg", "small_g_lb", "small_g_kg"),
    ),
)
def e15(spark, sf):
    live = base.catch(spark, sf).where(F.col("cond") == "A")
    counts = pivot_sum(live, ["haul"], "size_class", "count", base.CLASSES)
    grams = pivot_sum(live, ["haul"], "size_class", "weight", {k: f"{v}_g" for k, v in base.CLASSES.items()})
    hauls = base.located_hauls(spark, sf).select("haul", "bed")
    wide = hauls.join(counts, "haul", "left").join(grams, "haul", "left")
    return tidy(est.catch_table(wide, "bed", ["large", "small"], ["large_g", "small_g"]))


@query(
    "e16_meat_ratio",
    f"""WITH {base.INDIVIDUALS}, {base.HAULS} SELECT haul, height, meat / weight AS ratio FROM individuals
        WHERE size_class = 'F' AND stage <> 'R' AND haul IN (SELECT haul FROM hauls WHERE status = 'F')""",
)
def e16(spark, sf):
    animals = base.individuals(spark, sf).select(
        F.col("haul").alias("event"),
        "height",
        "weight",
        F.col("meat").alias("meat_weight"),
        F.lit(1).alias("species"),
        F.when(F.col("size_class") == "F", 1).otherwise(2).alias("size_class"),
        F.when(F.col("stage") == "R", 1).alias("clapper"),
    )
    used = base.hauls(spark, sf).where(F.col("status") == "F").select(F.col("haul").alias("event"))
    return meat_ratio(animals, used, 1).select(F.col("event").alias("haul"), "height", "ratio")


HARVEST = f"""{LONG}, {base.INDIVIDUALS},
wts AS (
  SELECT year, bed, avg(m) AS mean_wt, avg(r) AS mean_ratio FROM (
    SELECT l.haul, l.year, l.bed, avg(i.weight) AS m, avg(i.meat / i.weight) AS r FROM located l JOIN individuals i ON l.haul = i.haul
    GROUP BY l.haul, l.year, l.bed) GROUP BY year, bed),
joined AS (
  SELECT e.year, e.district, e.bed, w.mean_wt, w.mean_ratio, e.total AS mid, e.total - 2 * e.sd_total AS low,
         e.total + 2 * e.sd_total AS high
  FROM estimates e JOIN wts w ON e.year = w.year AND e.bed = w.bed WHERE e.variable = 'large')"""
LEVELS = ("ll", "meat", "ul", "ghl_05", "low_ghl_05", "high_ghl_05", "ghl_10", "low_ghl_10", "high_ghl_10")


def _levels_sql(low: str, mid: str, high: str) -> str:
    return f"""{low} AS ll, {mid} AS meat, {high} AS ul, {mid} * 0.05 AS ghl_05, {low} * 0.05 AS low_ghl_05,
      {high} * 0.05 AS high_ghl_05, {mid} * 0.10 AS ghl_10, {low} * 0.10 AS low_ghl_10, {high} * 0.10 AS high_ghl_10"""


def harvest_inputs(spark, sf):
    large = estimates(spark, sf).where(F.col("variable") == "large")
    animals = base.individuals(spark, sf).join(base.located_hauls(spark, sf).select("haul", "year", "bed"), "haul")
    animals = animals.withColumn("ratio", F.try_divide("meat", "weight"))
    hauls = animals.groupBy("haul", "year", "bed").agg(F.avg("weight").alias("m"), F.avg("ratio").alias("r"))
    means = hauls.groupBy("year", "bed").agg(F.avg("m").alias("mean_wt"), F.avg("r").alias("mean_ratio"))
    joined = large.join(means, ["year", "bed"])
    half = F.lit(2) * F.col("sd_total")
    return joined.withColumns({"mid": F.col("total"), "low": F.col("total") - half, "high": F.col("total") + half})


@query(
    "e17_number_harvest",
    tidy_sql(
        f"""WITH {HARVEST} SELECT year, bed, {_levels_sql(*[f'mean_ratio * {c} * mean_wt / 453.592' for c in ('low', 'mid', 'high')])}
            FROM joined""",
        *LEVELS,
    ),
)
def e17(spark, sf):
    ends = {"ll": "low", "meat": "mid", "ul": "high"}
    return tidy(est.number_harvest(harvest_inputs(spark, sf), "mean_ratio", "mean_wt", ends, keep=["year", "bed"]))


@query(
    "e18_weight_harvest",
    tidy_sql(
        f"""WITH {HARVEST} SELECT year, bed, {_levels_sql(*[f'mean_ratio * {c}' for c in ('low', 'mid', 'high')])} FROM joined""",
        *LEVELS,
    ),
)
def e18(spark, sf):
    ends = {"ll": "low", "meat": "mid", "ul": "high"}
    return tidy(est.weight_harvest(harvest_inputs(spark, sf), "mean_ratio", ends, keep=["year", "bed"]))


@query(
    "e19_clapper_share",
    tidy_sql(
        f"""WITH {LONG}, dead AS (SELECT haul, sum(count) AS c FROM catch WHERE cond = 'R' GROUP BY haul),
            dense AS (SELECT l.year, l.district, l.bed, a.area, coalesce(d.c, 0) / (l.effort * 0.00131663 * 0.83) AS c
              FROM located l LEFT JOIN dead d ON l.haul = d.haul LEFT JOIN areas a ON l.bed = a.bed),
            gone AS (SELECT year, district, bed, count(*) AS n, max(area) * avg(c) AS total_c FROM dense GROUP BY year, district, bed)
            SELECT g.year, g.bed, g.n, 100 * g.total_c / (e.total + g.total_c) AS percent_clap
            FROM (SELECT * FROM estimates WHERE variable = 'large') e
            RIGHT JOIN gone g ON e.year = g.year AND e.bed = g.bed AND e.district = g.district""",
        "percent_clap",
    ),
)
def e19(spark, sf):
    dead = clapper_estimate(spark, sf, {"c": "c"})
    live = estimates(spark, sf).where(F.col("variable") == "large").select(*STRATA, "total")
    joined = live.join(dead, STRATA, "right")
    return tidy(joined.select("year", "bed", "n", est.share_of_total("total_c", "total").alias("percent_clap")))


@query(
    "e20_precision_target",
    tidy_sql(
        f"""WITH {LONG} SELECT year, bed, n, cv_total, 0.20 * total AS mean_20, 0.20 * total / 2 AS half_mean_20
            FROM estimates WHERE variable = 'large'""",
        "cv_total",
        "mean_20",
        "half_mean_20",
    ),
)
def e20(spark, sf):
    large = estimates(spark, sf).where(F.col("variable") == "large").withColumns(precision_columns("total"))
    return tidy(large.select("year", "bed", "n", "cv_total", "mean_20", "half_mean_20"))
