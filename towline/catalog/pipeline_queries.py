"""Whole analyses: harvest levels from bootstrap intervals and ratios, dead shells, expanded sizes, printed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base, draws_sql
from towline.catalog.base import query, tidy, tidy_sql
from towline.catalog.estimator_queries import LEVELS, LONG, _levels_sql, estimates
from towline.catalog.resampling_queries import DESIGN, REPS, SEED, STUDY, _rows, _summary_sql
from towline.operators.estimators import haul_frame
from towline.operators.report import print_table, survey_totals
from towline.plans.biology import MEAT_LABELS, class_table, expanded_heights
from towline.plans.harvest import HarvestAnalysis
from towline.plans.sample_size import bed_areas, sample_size_tables, study_tows

STRATA = "year, district, bed"


def _means(name: str, values: tuple[str, ...], factor: str = "") -> str:
    """CTEs that draw the rows of ``<name>_rows`` within the strata; ``<name>_means`` has the mean of each value by replicate."""
    keep = f"{STRATA}, {factor}" if factor else STRATA
    more = f"max({factor}) AS {factor}, " if factor else ""
    times = f"any_value(d.{factor}) * " if factor else ""
    means = ", ".join(f"{times}avg(w.{v}) AS {v}" for v in values)
    keys = " AND ".join(f"d.{k} = w.{k}" for k in STRATA.split(", "))
    return f"""{name}_strata AS MATERIALIZED (
  SELECT {STRATA}, {more}{draws_sql.base_hash(SEED, *STRATA.split(", "))} AS base, count(*) AS m, count(*) AS n
  FROM {name}_rows GROUP BY {STRATA}),
{name}_drawn AS ({draws_sql.draws(f"SELECT {keep}, base, m, n FROM {name}_strata", keep, REPS)}),
{name}_means AS MATERIALIZED (
  SELECT {", ".join(f"d.{k}" for k in STRATA.split(", "))}, d.r, {means} FROM {name}_drawn d JOIN {name}_rows w ON {keys} AND d.i = w.i GROUP BY ALL)"""


# One row per haul, numbers and weights drawn together.
TOTALS = f"""{base.LOCATED}, {base.AREAS}, {base.CATCH},
sums AS (
  SELECT haul, sum(count) FILTER (WHERE size_class = 'F') AS number, sum(weight) FILTER (WHERE size_class = 'F') AS grams,
         sum(count) FILTER (WHERE cond = 'R') AS dead, sum(weight) FILTER (WHERE cond = 'R') AS dead_grams, avg(weight) AS mean_wt
  FROM catch GROUP BY haul),
tows AS (
  SELECT l.haul, l.year, l.district, l.bed, a.area, s.mean_wt, {", ".join(
      f"coalesce(s.{c}, 0) / (l.effort * 0.00131663 * 0.83) AS {c}" for c in ("number", "grams", "dead", "dead_grams"))}
  FROM located l LEFT JOIN sums s ON l.haul = s.haul LEFT JOIN areas a ON l.bed = a.bed),
haul_rows AS MATERIALIZED ({_rows("area, number, grams", "tows", STRATA, "haul")}),
{_means("haul", ("number", "grams"), "area")},
totals AS (
  SELECT {STRATA}, {_summary_sql("number", "n")}, {_summary_sql("grams * 0.00220462", "w")} FROM haul_means GROUP BY {STRATA})"""
RATIOS = f"""animals AS (
  SELECT l.year, l.district, l.bed, 1 - i.l_discount AS ratio, (i.l_orderkey * 8 + i.l_linenumber) * 1000000 + i.l_partkey AS animal, i.l_suppkey
  FROM lineitem i JOIN located l ON i.l_orderkey = l.haul),
animal_rows AS MATERIALIZED ({_rows("ratio", "animals", STRATA, "animal, l_suppkey, ratio")}),
{_means("animal", ("ratio",))},
ratios AS (SELECT {STRATA}, avg(ratio) AS mean_ratio FROM animal_means GROUP BY {STRATA})"""


def analysis(spark, sf):
    """Hauls with their records; line items are the records and the measured animals."""
    line = base.read(spark, sf, "lineitem")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    ratio = 1 - F.col("l_discount")
    frame = haul_frame(base.located_hauls(spark, sf), "effort").select("haul", "year", "district", "bed", "ai")
    records = frame.join(line, frame.haul == line.l_orderkey, "left").select(
        F.col("haul").alias("event"),
        "year",
        "district",
        "bed",
        "ai",
        (F.col("l_linestatus") == "F").alias("live"),
        (F.col("l_returnflag") == "R").alias("dead"),
        F.col("l_quantity").alias("count"),
        F.col("l_extendedprice").alias("grams"),
        ratio.alias("ratio"),
        F.struct(number.alias("number"), "l_suppkey", ratio.alias("ratio")).alias("animal"),
    )
    return HarvestAnalysis(records, base.bed_areas(spark, sf), reps=REPS, seed=SEED)


@query(
    "w01_number_harvest",
    tidy_sql(
        f"""WITH {TOTALS}, {RATIOS}, weights AS (SELECT {STRATA}, avg(mean_wt) AS mean_wt FROM tows GROUP BY {STRATA})
            SELECT {STRATA}, {_levels_sql(*[f'mean_ratio * {c} * mean_wt / 453.592' for c in ('ll_n', 'mean_n', 'ul_n')])}
            FROM totals JOIN ratios USING ({STRATA}) JOIN weights USING ({STRATA}) WHERE mean_wt IS NOT NULL""",
        *LEVELS,
    ),
)
def w01(spark, sf):
    return tidy(analysis(spark, sf).number_harvest())


@query(
    "w02_weight_harvest",
    tidy_sql(
        f"""WITH {TOTALS}, {RATIOS}
            SELECT {STRATA}, {_levels_sql(*[f'mean_ratio * {c}' for c in ('ll_w', 'mean_w', 'ul_w')])} FROM totals JOIN ratios USING ({STRATA})""",
        *LEVELS,
    ),
)
def w02(spark, sf):
    return tidy(analysis(spark, sf).weight_harvest())


@query(
    "w03_clapper_summary",
    tidy_sql(
        f"""WITH {TOTALS}, gone AS (
              SELECT {STRATA}, count(*) AS n, max(area) * avg(dead) AS total_c, max(area) * avg(dead_grams) * 0.00220462 AS total_lb
              FROM tows GROUP BY {STRATA})
            SELECT {STRATA}, g.n, 100 * total_c / nullif(mean_n + total_c, 0) AS percent_clap,
                   100 * total_lb / nullif(mean_w + total_lb, 0) AS percent_clap_wt
            FROM gone g LEFT JOIN totals USING ({STRATA})""",
        "percent_clap",
        "percent_clap_wt",
    ),
)
def w03(spark, sf):
    return tidy(analysis(spark, sf).clapper_share())


@query(
    "w04_class_table",
    f"""WITH {base.LOCATED}, {base.CATCH},
        seen AS (SELECT l.bed, CASE c.cond WHEN 'A' THEN 'Good' WHEN 'R' THEN 'Weak' END AS class FROM catch c JOIN located l ON c.haul = l.haul),
        counts AS (
          SELECT b.bed, v.class, count(s.class) AS n FROM (SELECT DISTINCT bed FROM seen WHERE class IS NOT NULL) b
          CROSS JOIN (VALUES ('Good'), ('Weak')) v(class) LEFT JOIN seen s ON s.bed = b.bed AND s.class = v.class GROUP BY ALL)
        SELECT bed, class, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY bed), 2) AS value FROM counts
        UNION ALL SELECT bed, 'n', sum(n)::DOUBLE FROM counts GROUP BY bed""",
)
def w04(spark, sf):
    """Meat classes of all records by bed, with the row of counts; records of no class are left out."""
    code = F.when(F.col("cond") == "A", 1).when(F.col("cond") == "R", 2)
    bio = base.catch(spark, sf).join(base.located_hauls(spark, sf).select("haul", "bed"), "haul").withColumn("code", code)
    return class_table(bio, "code", "bed", MEAT_LABELS)


# The study on tow rules: one district under another name, designated lengths that differ from the field's by up to 14 %.
FAR = "ASIA"
_DESIGNATED = "l.effort * (1 + l.haul % 3 * 0.07)"
TOW_STUDY = STUDY.replace("l.district,", f"CASE WHEN l.district = '{FAR}' THEN 'Far' ELSE l.district END AS district,").replace(
    "(l.effort *", f"(CASE WHEN abs(l.effort - {_DESIGNATED}) > l.effort * 0.10 THEN l.effort ELSE {_DESIGNATED} END *"
)


@query(
    "w05_sample_size_study",
    tidy_sql(
        f"""WITH {DESIGN.replace(STUDY, TOW_STUDY)}
            SELECT district AS area_name, bed, year, fraction, m, p_mean, p_sd, p_var FROM study""",
        "p_mean",
        "p_sd",
        "p_var",
    ),
)
def w05(spark, sf):
    """Used tows by the rule of the two lengths, standardised counts, and the precision of each design."""
    located = base.located_hauls(spark, sf)
    hauls = located.select(
        F.col("year").alias("YEAR"),
        F.col("haul").alias("EVENT_ID"),
        F.col("district").alias("SURVEY_AREA"),
        F.concat(F.lit(" "), "bed").alias("BED"),
        F.col("effort").alias("TOW_LENGTH_FIELD"),
        (F.col("effort") * (1 + F.col("haul") % 3 * 0.07)).alias("TOW_LENGTH_DESIGNATED"),
        F.lit("YES").alias("USED_IN_ESTIMATE"),
    )
    records = base.catch(spark, sf).select(
        F.col("haul").alias("EVENT_ID"),
        F.lit(850).alias("SPECIES_CODE"),
        F.lit(1).alias("CONDITION_CODE"),
        F.col("count").alias("COUNT"),
        F.col("weight").alias("SAMPLE_WT_KG"),
    )
    area = F.when(F.col("district") == FAR, "Far").otherwise(F.col("district"))
    cells = base.stations(spark, sf).select(area.alias("SURVEY_AREA"), F.col("bed").alias("BED"), F.lit(1.0).alias("Area_Sq_NM"))
    tows = study_tows(hauls, records, {FAR: "Far"}, 850)
    return tidy(sample_size_tables(tows, bed_areas(cells), REPS, SEED, na_rm=True)["study"])


@query(
    "w06_expanded_heights",
    f"""WITH {base.LOCATED}, {base.INDIVIDUALS}, {base.CATCH},
        seen AS (
          SELECT l.bed, i.haul, i.size_class, round(i.height * 10)::BIGINT AS tenths
          FROM individuals i JOIN located l ON i.haul = l.haul WHERE i.stage <> 'R'),
        caught AS (SELECT haul, size_class, sum(count)::BIGINT AS total FROM catch WHERE cond <> 'R' GROUP BY ALL),
        bins AS (SELECT bed, haul, size_class, tenths, count(*) AS measured FROM seen GROUP BY ALL),
        sized AS (SELECT b.*, total, (sum(measured) OVER (PARTITION BY haul, size_class))::BIGINT AS m FROM bins b JOIN caught USING (haul, size_class)),
        needed AS (SELECT *, CASE WHEN total > 0 AND m > 1 AND total - m > 1 THEN total - m ELSE 0 END AS need FROM sized),
        placed AS (
          SELECT *, need * measured // m AS base,
                 row_number() OVER (PARTITION BY haul, size_class ORDER BY need * measured % m DESC, tenths) AS place,
                 need - sum(need * measured // m) OVER (PARTITION BY haul, size_class) AS rest
          FROM needed)
        SELECT bed, size_class, tenths // 10 AS bin, sum(measured)::BIGINT AS measured,
               sum(base + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS added
        FROM placed GROUP BY ALL""",
)
def w06(spark, sf):
    """Size distribution of each bed and class in whole units: animals measured, and those added up to the catch."""
    animals = base.individuals(spark, sf).select(
        F.col("haul").alias("event"),
        F.lit(850).alias("species"),
        F.when(F.col("stage") == "R", 1).alias("clapper"),
        "size_class",
        "height",
    )
    records = base.catch(spark, sf).select(
        F.col("haul").alias("event"), F.lit(850).alias("species"), F.when(F.col("cond") == "R", 2).otherwise(1).alias("cond"), "size_class", "count"
    )
    hauls = base.located_hauls(spark, sf).select(F.col("haul").alias("event"), "bed")
    counts = expanded_heights(animals, records, hauls, 850)["counts"]
    bins = counts.groupBy("bed", "size_class", F.expr("bin_units div 10").alias("bin"))
    return bins.agg(F.sum("measured").alias("measured"), F.sum("added").alias("added"))


# Beds in the order of the printed table; the others follow without a place.
PRINTED = ("CANADA", "BRAZIL", "PERU", "ARGENTINA", "KENYA", "JAPAN")
_TEXT = "format('{{:,.{digits}f}}', round_even({value}, {digits}))"


@query(
    "w07_printed_estimates",
    f"""WITH {LONG} SELECT year, bed, variable, {_TEXT.format(value="total", digits=0)} AS "Abundance",
          {_TEXT.format(value="total - 2 * sd_total", digits=0)} AS "Lower", {_TEXT.format(value="total + 2 * sd_total", digits=0)} AS "Upper",
          {_TEXT.format(value="cv", digits=1)} AS "CV"
        FROM estimates WHERE sd_total IS NOT NULL AND total > 0""",
)
def w07(spark, sf):
    """The estimates of all beds and years as they are printed."""
    half = F.lit(2) * F.col("sd_total")
    found = estimates(spark, sf).where("sd_total IS NOT NULL AND total > 0")
    found = found.withColumns({"low": F.col("total") - half, "high": F.col("total") + half})
    numbers = {"Abundance": ("total", 0), "Lower": ("low", 0), "Upper": ("high", 0), "CV": ("cv", 1)}
    return print_table(found, ["year", "bed", "variable"], numbers, "bed", PRINTED)


@query(
    "w08_survey_totals",
    tidy_sql(
        f"""WITH {LONG} SELECT sum(total) AS total, min(total - 2 * sd_total) AS low, max(total + 2 * sd_total) AS high
            FROM estimates WHERE bed IN {PRINTED}""",
        "total",
        "low",
        "high",
    ),
)
def w08(spark, sf):
    """Total over the printed beds and the range of their intervals."""
    half = F.lit(2) * F.col("sd_total")
    ends = estimates(spark, sf).withColumns({"low": F.col("total") - half, "high": F.col("total") + half})
    return tidy(survey_totals(ends, PRINTED, "bed", ["total"], ["low"], ["high"]))
