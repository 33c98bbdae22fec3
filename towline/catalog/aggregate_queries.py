"""Aggregation and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base
from towline.catalog.base import query, tidy, tidy_sql
from towline.functions import aggregates as agg
from towline.operators import reshape
from towline.operators.estimators import mean_of_means, sample_sizes
from towline.operators.ordering import group_quantiles
from towline.operators.report import district_totals


@query(
    "a01_count",
    tidy_sql(
        f"""WITH {base.LOCATED}, {base.AREAS} SELECT l.bed, count(*) AS n, any_value(a.area) AS area
            FROM located l LEFT JOIN areas a ON l.bed = a.bed GROUP BY l.bed""",
        "area",
    ),
)
def a01(spark, sf):
    return tidy(sample_sizes(base.located_hauls(spark, sf), base.bed_areas(spark, sf), "bed"))


# Catch by station: a class that a haul lacks is null, so strict and lenient aggregates differ.
BY_HAUL = f"""WITH {base.HAULS}, {base.CATCH}, nulls AS (
  SELECT h.haul, h.station, h.priority, h.year, sum(CASE WHEN c.size_class = 'F' THEN c.count END) AS large,
         sum(CASE WHEN c.size_class = 'O' THEN c.count END) AS small
  FROM hauls h LEFT JOIN catch c ON h.haul = c.haul GROUP BY ALL)"""


def by_haul(spark, sf):
    large = F.when(F.col("size_class") == "F", F.col("count"))
    small = F.when(F.col("size_class") == "O", F.col("count"))
    sums = base.catch(spark, sf).groupBy("haul").agg(F.sum(large).alias("large"), F.sum(small).alias("small"))
    return base.hauls(spark, sf).select("haul", "station", "priority", "year").join(sums, "haul", "left")


@query(
    "a02_sum_lenient",
    f"{BY_HAUL} SELECT station, year, coalesce(sum(large), 0) AS large FROM nulls GROUP BY station, year",
)
def a02(spark, sf):
    return by_haul(spark, sf).groupBy("station", "year").agg(agg.sum0("large").alias("large"))


@query(
    "a03_sum_strict",
    f"""{BY_HAUL} SELECT station, year, CASE WHEN count(large) = count(*) THEN sum(large) END AS large
        FROM nulls GROUP BY station, year""",
)
def a03(spark, sf):
    return by_haul(spark, sf).groupBy("station", "year").agg(agg.sum_strict("large").alias("large"))


@query(
    "a04_conditional_sums",
    tidy_sql(
        f"""WITH {base.CATCH} SELECT haul, coalesce(sum(weight) FILTER (WHERE cond = 'A' AND size_class = 'F'), 0) AS t1,
              coalesce(sum(weight) FILTER (WHERE cond = 'A' AND size_class = 'O'), 0) AS t2,
              coalesce(sum(count) FILTER (WHERE cond = 'R' AND size_class = 'F'), 0) AS s1,
              coalesce(sum(count) FILTER (WHERE cond = 'R' AND size_class = 'O'), 0) AS s2
            FROM catch GROUP BY haul""",
        "t1",
        "t2",
        "s1",
        "s2",
    ),
)
def a04(spark, sf):
    one, two = F.col("size_class") == "F", F.col("size_class") == "O"
    rest, target = F.col("cond") == "A", F.col("cond") == "R"
    sums = base.catch(spark, sf).groupBy("haul").agg(
        agg.sum_where("weight", rest & one).alias("t1"),
        agg.sum_where("weight", rest & two).alias("t2"),
        agg.sum_where("count", target & one).alias("s1"),
        agg.sum_where("count", target & two).alias("s2"),
    )
    return tidy(sums)


@query(
    "a05_means",
    tidy_sql(
        f"""{BY_HAUL} SELECT station, avg(large) AS lenient, CASE WHEN count(large) = count(*) THEN avg(large) END AS strict
            FROM nulls GROUP BY station""",
        "lenient",
        "strict",
    ),
)
def a05(spark, sf):
    return tidy(
        by_haul(spark, sf)
        .groupBy("station")
        .agg(F.avg("large").alias("lenient"), agg.mean_strict("large").alias("strict"))
    )


@query(
    "a06_variance",
    tidy_sql(
        f"""WITH {base.LOCATED} SELECT bed, year, var_samp(effort) AS var, stddev_samp(effort) AS sd FROM located GROUP BY bed, year""",
        "var",
        "sd",
    ),
)
def a06(spark, sf):
    return tidy(
        base.located_hauls(spark, sf)
        .groupBy("bed", "year")
        .agg(F.var_samp("effort").alias("var"), F.stddev_samp("effort").alias("sd"))
    )


@query(
    "a07_min_max",
    f"WITH {base.LOCATED} SELECT bed, min(effort) AS low, max(effort) AS high FROM located GROUP BY bed",
)
def a07(spark, sf):
    per = base.located_hauls(spark, sf).groupBy("bed")
    return per.agg(F.min("effort").alias("low"), F.max("effort").alias("high"))


@query(
    "a08_quantiles",
    tidy_sql(
        """SELECT l_returnflag, 0.025::DOUBLE AS prob, quantile_cont(l_extendedprice, 0.025) AS value FROM lineitem GROUP BY 1
           UNION ALL SELECT l_returnflag, 0.5, quantile_cont(l_extendedprice, 0.5) FROM lineitem GROUP BY 1
           UNION ALL SELECT l_returnflag, 0.975, quantile_cont(l_extendedprice, 0.975) FROM lineitem GROUP BY 1""",
        "value",
    ),
)
def a08(spark, sf):
    lines = base.read(spark, sf, "lineitem")
    return tidy(group_quantiles(lines, ["l_returnflag"], "l_extendedprice", (0.025, 0.5, 0.975), "value"))


@query(
    "a09_cv",
    tidy_sql(
        f"""WITH {base.LOCATED} SELECT bed, 100 * stddev_samp(effort) / avg(effort) AS cv, stddev_samp(effort) / avg(effort) AS ratio
            FROM located GROUP BY bed""",
        "cv",
        "ratio",
    ),
)
def a09(spark, sf):
    per = base.located_hauls(spark, sf).groupBy("bed")
    return tidy(per.agg(agg.cv("effort").alias("cv"), agg.cv("effort", percent=False).alias("ratio")))


@query(
    "a10_sum_of_squares",
    tidy_sql(
        f"WITH {base.LOCATED} SELECT bed, year, var_samp(effort) * (count(*) - 1) AS ss FROM located GROUP BY bed, year",
        "ss",
    ),
)
def a10(spark, sf):
    return tidy(base.located_hauls(spark, sf).groupBy("bed", "year").agg(agg.sum_squares("effort").alias("ss")))


@query(
    "a11_mean_of_means",
    tidy_sql(
        f"""WITH {base.LOCATED}, {base.CATCH}, m AS (SELECT l.haul, l.bed, avg(c.weight) AS m FROM located l JOIN catch c
            ON l.haul = c.haul GROUP BY l.haul, l.bed) SELECT bed, avg(m) AS mean_wt FROM m GROUP BY bed""",
        "mean_wt",
    ),
)
def a11(spark, sf):
    joined = base.catch(spark, sf).join(base.located_hauls(spark, sf).select("haul", "bed"), "haul")
    return tidy(mean_of_means(joined, ["haul", "bed"], ["bed"], "weight", "mean_wt"))


@query(
    "a12_ratio_of_sums",
    tidy_sql(
        f"WITH {base.INDIVIDUALS} SELECT brand, sum(meat) / sum(weight) AS rate FROM individuals GROUP BY brand", "rate"
    ),
)
def a12(spark, sf):
    return tidy(base.individuals(spark, sf).groupBy("brand").agg(agg.ratio_of_sums("meat", "weight").alias("rate")))


@query(
    "a13_group_by_expression",
    f"""WITH {base.HAULS} SELECT right('Survey ' || year, 4) AS year, count(*) AS n FROM hauls
        GROUP BY right('Survey ' || year, 4)""",
)
def a13(spark, sf):
    text = F.concat(F.lit("Survey "), F.col("year"))
    return base.hauls(spark, sf).groupBy(F.right(text, F.lit(4)).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a14_having",
    f"""WITH {base.HAULS} SELECT status, year, count(*) AS n, max(haul) AS last FROM hauls
        GROUP BY status, year HAVING status = 'F' AND year > 1996""",
)
def a14(spark, sf):
    per = base.hauls(spark, sf).groupBy("status", "year").agg(F.count(F.lit(1)).alias("n"), F.max("haul").alias("last"))
    return per.where((F.col("status") == "F") & (F.col("year") > 1996))


@query("a15_distinct", f"WITH {base.LOCATED} SELECT DISTINCT district, bed, year, status FROM located")
def a15(spark, sf):
    return base.located_hauls(spark, sf).select("district", "bed", "year", "status").distinct()


@query("a16_pivot_sum", f"WITH {base.CLASS_COUNTS} SELECT * FROM class_counts")
def a16(spark, sf):
    return base.class_counts(spark, sf)


@query(
    "a17_melt",
    f"""WITH {base.CLASS_COUNTS} SELECT haul, 'large' AS variable, large AS value FROM class_counts
        UNION ALL SELECT haul, 'small', small FROM class_counts
        UNION ALL SELECT haul, 'all', large + small FROM class_counts""",
)
def a17(spark, sf):
    wide = base.class_counts(spark, sf).withColumn("all", F.col("large") + F.col("small"))
    return reshape.melt(wide, ["haul"], ["large", "small", "all"])


CROSSTAB = f"""WITH {base.LOCATED}, {base.CATCH},
seen AS (SELECT l.bed, nullif(c.cond, 'N') AS cond FROM located l JOIN catch c ON l.haul = c.haul),
counts AS (SELECT b.bed, v.cond, count(s.cond) AS n FROM (SELECT DISTINCT bed FROM seen WHERE cond IS NOT NULL) b
  CROSS JOIN (SELECT DISTINCT cond FROM seen WHERE cond IS NOT NULL) v
  LEFT JOIN seen s ON s.bed = b.bed AND s.cond = v.cond GROUP BY b.bed, v.cond)"""


def crosstab(spark, sf, levels=None):
    seen = base.catch(spark, sf).join(base.located_hauls(spark, sf).select("haul", "bed"), "haul")
    return reshape.crosstab(seen.withColumn("cond", F.nullif("cond", F.lit("N"))), "cond", ["bed"], levels)


@query("a18_crosstab", f"{CROSSTAB} SELECT bed, cond, n FROM counts")
def a18(spark, sf):
    return crosstab(spark, sf)


@query(
    "a18_crosstab_many_classes",
    """WITH seen AS (SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS record FROM lineitem)
       SELECT f.l_returnflag, v.record, count(s.record) AS n FROM (SELECT DISTINCT l_returnflag FROM seen) f
       CROSS JOIN (SELECT DISTINCT record FROM seen) v LEFT JOIN seen s ON s.l_returnflag = f.l_returnflag AND s.record = v.record
       GROUP BY ALL""",
)
def a18_many(spark, sf):
    """A class for nearly every row of the table."""
    line = base.read(spark, sf, "lineitem").withColumn("record", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return reshape.crosstab(line, "record", ["l_returnflag"])


@query(
    "a18_crosstab_compound",
    f"""WITH {base.LOCATED}, {base.CATCH}, seen AS (
          SELECT l.bed || ' ' || monthname(l.date) AS bed_month, c.cond FROM located l JOIN catch c ON l.haul = c.haul
          WHERE c.cond IN ('A', 'R'))
        SELECT b.bed_month, v.cond, count(s.cond) AS n FROM (SELECT DISTINCT bed_month FROM seen) b
        CROSS JOIN (VALUES ('A'), ('R')) v(cond) LEFT JOIN seen s ON s.bed_month = b.bed_month AND s.cond = v.cond
        GROUP BY ALL""",
)
def a18_compound(spark, sf):
    located = base.located_hauls(spark, sf)
    located = located.select("haul", F.concat_ws(" ", "bed", F.date_format("date", "MMMM")).alias("bed_month"))
    return reshape.crosstab(base.catch(spark, sf).join(located, "haul"), "cond", ["bed_month"], ["A", "R"])


PERCENT = f"""{CROSSTAB}, percents AS (
  SELECT bed, cond, n, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY bed), 2) AS percent FROM counts)"""


@query("a19_column_percent", f"{PERCENT} SELECT bed, cond, n, percent FROM percents")
def a19(spark, sf):
    return reshape.col_percent(crosstab(spark, sf, ["A", "R"]), ["bed"])


@query(
    "a20_margin",
    f"""{PERCENT} SELECT bed, cond, percent AS value FROM percents
        UNION ALL SELECT bed, 'n', sum(n)::DOUBLE FROM counts GROUP BY bed""",
)
def a20(spark, sf):
    return reshape.with_margin(reshape.col_percent(crosstab(spark, sf, ["A", "R"]), ["bed"]), "cond", ["bed"])


GROUPED = ["NATION_0", "NATION_1", "NATION_2", "NATION_3"]


@query(
    "a21_rollup_districts",
    tidy_sql(
        f"""WITH {base.LOCATED}, per AS (SELECT bed, year, sum(effort) AS total, 100 * stddev_samp(effort) / avg(effort) AS cv
              FROM located GROUP BY bed, year)
            SELECT year, CASE WHEN bed IN ('NATION_0', 'NATION_1') THEN 'north'
                     WHEN bed IN ('NATION_2', 'NATION_3') THEN 'south' ELSE 'NA' END AS district,
                   sum(total) AS N, avg(cv) AS CV
            FROM per GROUP BY 1, 2""",
        "N",
        "CV",
    ),
)
def a21(spark, sf):
    per = base.located_hauls(spark, sf).groupBy("bed", "year")
    per = per.agg(F.sum("effort").alias("total"), agg.cv("effort").alias("cv"))
    return tidy(district_totals(per, "bed", {"north": GROUPED[:2], "south": GROUPED[2:]}, "total", "cv", ["year"]))


@query(
    "a22_whole_table",
    tidy_sql(
        f"""WITH {base.CLASS_COUNTS} SELECT sum(large + small) AS caught, min(large) AS min_l, max(large) AS max_l,
              min(small) AS min_s, max(small) AS max_s, count(*) AS n FROM class_counts""",
        "caught",
    ),
)
def a22(spark, sf):
    return tidy(
        base.class_counts(spark, sf).agg(
            F.sum(F.col("large") + F.col("small")).alias("caught"),
            F.min("large").alias("min_l"),
            F.max("large").alias("max_l"),
            F.min("small").alias("min_s"),
            F.max("small").alias("max_s"),
            F.count(F.lit(1)).alias("n"),
        )
    )
