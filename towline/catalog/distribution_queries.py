"""Distribution queries: expanded sizes, histograms, curves, fits, tests, plotting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base
from towline.catalog.base import query, tidy, tidy_sql
from towline.catalog.estimator_queries import LONG, estimates
from towline.operators import distributions as dist
from towline.operators.report import number_text

# Caught per haul and class is the summed count; measured are the line items.
ALLOCATE = f"""{base.INDIVIDUALS}, {base.CATCH},
totals AS (SELECT haul, size_class, sum(count)::BIGINT AS total FROM catch GROUP BY haul, size_class),
bins AS (
  SELECT haul, size_class, floor(round(height * 10))::BIGINT AS bin_units, count(*) AS measured
  FROM individuals GROUP BY ALL),
sized AS (
  SELECT b.*, t.total, (sum(b.measured) OVER (PARTITION BY b.haul, b.size_class))::BIGINT AS m
  FROM bins b JOIN totals t ON b.haul = t.haul AND b.size_class = t.size_class),
needed AS (SELECT *, CASE WHEN total > 0 AND m > 1 AND total - m > 1 THEN total - m ELSE 0 END AS need FROM sized),
shared AS (SELECT *, need * measured // m AS base, need * measured % m AS rem FROM needed),
allocated AS (
  SELECT haul, size_class, bin_units, bin_units / 10 AS bin, measured,
         base + CASE WHEN row_number() OVER (PARTITION BY haul, size_class ORDER BY rem DESC, bin_units)
                     <= need - sum(base) OVER (PARTITION BY haul, size_class) THEN 1 ELSE 0 END AS added
  FROM shared)"""
KEYS = ["haul", "size_class"]


def lengths(spark, sf):
    totals = base.catch(spark, sf).groupBy(*KEYS).agg(F.sum("count").cast("bigint").alias("total"))
    return base.individuals(spark, sf).select(*KEYS, "height"), totals


@query(
    "d01_allocate_lengths",
    f"WITH {ALLOCATE} SELECT haul, size_class, bin_units, bin, measured, added::BIGINT AS added FROM allocated",
)
def d01(spark, sf):
    measured, totals = lengths(spark, sf)
    return dist.allocate_lengths(measured, totals, KEYS, "height", "total")


@query(
    "d01_expand_lengths",
    f"""WITH {ALLOCATE}, grown AS (
          SELECT haul, size_class, round(height * 10)::BIGINT AS h, 1::BIGINT AS k, false AS added FROM individuals
          UNION ALL SELECT haul, size_class, bin_units, added::BIGINT, true FROM allocated WHERE added > 0)
        SELECT haul, size_class, added, sum(k)::BIGINT AS n, sum(h * k)::BIGINT AS height_sum FROM grown GROUP BY ALL""",
)
def d01_rows(spark, sf):
    measured, totals = lengths(spark, sf)
    rows = dist.expand_lengths(measured, totals, KEYS, "height", "total")
    tenths = F.round(F.col("height") * 10).cast("bigint")
    return rows.groupBy(*KEYS, "added").agg(F.count(F.lit(1)).alias("n"), F.sum(tenths).alias("height_sum"))


@query(
    "d02_reconcile_totals",
    f"""WITH {ALLOCATE}, e AS (SELECT haul, size_class, sum(measured + added)::BIGINT AS expanded FROM allocated GROUP BY haul, size_class)
        SELECT coalesce(e.haul, t.haul) AS haul, coalesce(e.size_class, t.size_class) AS size_class,
               coalesce(e.expanded, 0) AS expanded, coalesce(t.total, 0) AS caught,
               coalesce(e.expanded, 0) - coalesce(t.total, 0) AS difference
        FROM e FULL JOIN totals t ON e.haul = t.haul AND e.size_class = t.size_class""",
)
def d02(spark, sf):
    measured, totals = lengths(spark, sf)
    counts = dist.allocate_lengths(measured, totals, KEYS, "height", "total")
    return dist.reconcile_totals(counts, totals, KEYS, F.col("measured") + F.col("added"), "total")


@query(
    "d03_histogram_width",
    f"""WITH {base.INDIVIDUALS}, h AS (SELECT brand, floor(height / 1)::BIGINT AS bin, count(*) AS n FROM individuals GROUP BY ALL),
        g AS (SELECT brand, unnest(range(min(bin), max(bin) + 1)) AS bin FROM h GROUP BY brand)
        SELECT g.brand, g.bin, 0.0::DOUBLE + g.bin AS low, coalesce(h.n, 0) AS n FROM g LEFT JOIN h USING (brand, bin)""",
)
def d03(spark, sf):
    return dist.histogram(base.individuals(spark, sf), "height", ["brand"], width=1.0)


@query(
    "d03_histogram_bins",
    tidy_sql(
        """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
           , h AS (
             SELECT l_returnflag, least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n
             FROM lineitem, r GROUP BY ALL),
           g AS (SELECT l_returnflag, unnest(range(50)) AS bin FROM lineitem GROUP BY l_returnflag)
           SELECT g.l_returnflag, g.bin, r.lo + g.bin * ((r.hi - r.lo) / 50) AS low, coalesce(h.n, 0) AS n
           FROM g CROSS JOIN r LEFT JOIN h ON g.l_returnflag = h.l_returnflag AND g.bin = h.bin""",
        "low",
    ),
)
def d03_bins(spark, sf):
    return tidy(dist.histogram(base.read(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], bins=50))


@query(
    "d04_density_grid",
    tidy_sql(
        """WITH q AS (SELECT l_returnflag AS g, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
                stddev_samp(l_extendedprice) AS sd,
                quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1),
             s AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * n ** (-0.2) AS bw FROM q),
             cells AS (SELECT s.*, least(floor((l_extendedprice - lo) / (hi - lo) * 256), 255) AS cell, count(*) AS c
               FROM lineitem JOIN s ON l_returnflag = g GROUP BY ALL)
           SELECT g AS l_returnflag, p AS point, lo + p * (hi - lo) / 127 AS x,
                  sum(c * exp(-0.5 * ((lo + p * (hi - lo) / 127 - (lo + (cell + 0.5) * (hi - lo) / 256)) / bw) ** 2)
                      / (n * bw * sqrt(2 * pi()))) AS density
           FROM cells, range(128) t(p) GROUP BY g, p, lo, hi""",
        "x",
        "density",
    ),
)
def d04(spark, sf):
    return tidy(dist.density_grid(base.read(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query(
    "d05_log_log_fit",
    tidy_sql(
        f"""WITH {base.INDIVIDUALS} SELECT brand, count(*) AS n, regr_slope(ln(meat), ln(weight)) AS slope,
              regr_intercept(ln(meat), ln(weight)) AS intercept, regr_r2(ln(meat), ln(weight)) AS r2
            FROM individuals WHERE meat > 0 AND weight > 0 GROUP BY brand""",
        "slope",
        "intercept",
        "r2",
    ),
)
def d05(spark, sf):
    return tidy(dist.log_log_fit(base.individuals(spark, sf), "meat", "weight", ["brand"]))


KS = f"""{base.INDIVIDUALS},
ties AS (
  SELECT brand, weight AS x, count(*) FILTER (WHERE stage = 'A') AS c1, count(*) FILTER (WHERE stage = 'R') AS c2
  FROM individuals WHERE stage IN ('A', 'R') GROUP BY brand, weight),
steps AS (
  SELECT brand, sum(c1) OVER w AS r1, sum(c2) OVER w AS r2, sum(c1) OVER (PARTITION BY brand) AS n1,
         sum(c2) OVER (PARTITION BY brand) AS n2
  FROM ties WINDOW w AS (PARTITION BY brand ORDER BY x)),
dist AS (
  SELECT brand, n1::BIGINT AS n1, n2::BIGINT AS n2, max(abs(r1::DOUBLE / n1 - r2::DOUBLE / n2)) AS d
  FROM steps GROUP BY brand, n1, n2)"""


@query(
    "d06_ks_two_sample",
    tidy_sql(
        f"""WITH {KS} SELECT brand, n1, n2, d, greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101),
              lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * d * d * n1 * n2 / (n1 + n2))))))::DOUBLE AS p_value
            FROM dist""",
        "d",
        "p_value",
    ),
)
def d06(spark, sf):
    return tidy(dist.ks_two_sample(base.individuals(spark, sf), ["brand"], "stage", "weight", "A", "R"))


@query(
    "d07_min_group_size",
    f"""WITH {base.HAULS} SELECT haul, station FROM hauls QUALIFY count(*) OVER (PARTITION BY station) > 11""",
)
def d07(spark, sf):
    return dist.min_group_size(base.hauls(spark, sf).select("haul", "station"), ["station"], 11)


@query(
    "d08_interval_table",
    tidy_sql(
        f"""WITH {LONG} SELECT year, bed, variable, total / 1e6 AS point, (total - 2 * sd_total) / 1e6 AS ymin,
              (total + 2 * sd_total) / 1e6 AS ymax FROM estimates""",
        "point",
        "ymin",
        "ymax",
    ),
)
def d08(spark, sf):
    half = F.lit(2) * F.col("sd_total")
    ends = estimates(spark, sf).withColumns({"ll": F.col("total") - half, "ul": F.col("total") + half})
    return tidy(dist.interval_table(ends, ["year", "bed", "variable"], {"point": "total", "ymin": "ll", "ymax": "ul"}))


@query(
    "r01_report_table",
    f"""WITH {base.LOCATED} SELECT bed, format('{{:,.0f}}', round_even(max(effort), 0)) AS top,
          format('{{:,.1f}}', round_even(min(effort), 1)) AS low, count(*) AS n FROM located GROUP BY bed""",
)
def r01(spark, sf):
    per = base.located_hauls(spark, sf).groupBy("bed")
    return per.agg(
        number_text(F.max("effort")).alias("top"), number_text(F.min("effort"), 1).alias("low"), F.count(F.lit(1)).alias("n")
    )
