"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base
from towline.catalog.base import query, tidy, tidy_sql, whole
from towline.operators import joins

# Published two-tailed 95 % quantiles of t, cut after six decimals, for samples of 2 to 30.
T_95 = (
    12.706204, 4.302652, 3.182446, 2.776445, 2.570581, 2.446911, 2.364624, 2.306004, 2.262157, 2.228138,
    2.200985, 2.178812, 2.160368, 2.144786, 2.131449, 2.119905, 2.109815, 2.100922, 2.093024, 2.085963,
    2.079613, 2.073873, 2.068657, 2.063898, 2.059538, 2.055529, 2.051830, 2.048407, 2.045229,
)


def t_sql(n: str) -> str:
    """95 % quantile for a sample of size ``n``: published value up to 30, beyond it the expansion in 1 / (n - 1)."""
    z, v = "1.959963984540054::DOUBLE", f"({n} - 1)::DOUBLE"
    terms = (
        ((1, 3), (1, 1)),
        ((5, 5), (16, 3), (3, 1)),
        ((3, 7), (19, 5), (17, 3), (-15, 1)),
        ((79, 9), (776, 7), (1482, 5), (-1920, 3), (-945, 1)),
        ((27, 11), (339, 9), (930, 7), (-1782, 5), (-765, 3), (17955, 1)),
    )
    parts = [
        f"({' + '.join(f'{c} * pow({z}, {p})' for c, p in term)}) / ({d} * pow({v}, {k + 1}))"
        for k, (term, d) in enumerate(zip(terms, (4, 96, 384, 92160, 368640)))
    ]
    cut = f"floor(1e6 * ({z} + {' + '.join(parts)})) / 1e6"
    return f"(CASE WHEN {n} < 2 THEN NULL WHEN {n} <= 30 THEN ({list(T_95)})[{n} - 1]::DOUBLE ELSE {cut} END)"


@query(
    "j01_left_join",
    f"""WITH {base.HAULS}, {base.CLASS_COUNTS}
        SELECT h.haul, h.year, c.large, c.small FROM hauls h LEFT JOIN class_counts c ON h.haul = c.haul""",
)
def j01(spark, sf):
    return base.hauls(spark, sf).join(base.class_counts(spark, sf), ["haul"], "left").select("haul", "year", "large", "small")


@query(
    "j02_right_join",
    f"""WITH {base.CLASS_COUNTS}, {base.STATIONS}, {base.HAULS}
        SELECT s.bed, s.station, h.haul FROM hauls h RIGHT JOIN stations s ON h.station = s.station""",
)
def j02(spark, sf):
    made = base.hauls(spark, sf).select("haul", "station")
    return made.join(base.stations(spark, sf), "station", "right").select("bed", "station", "haul")


USED = "used AS (SELECT haul, year, priority FROM hauls WHERE status = 'F')"


@query(
    "j03_complete_zero_full",
    f"""WITH {base.HAULS}, {base.CLASS_COUNTS}, {USED}
        SELECT coalesce(u.haul, c.haul) AS haul, u.year, u.priority, coalesce(c.large, 0) AS large, coalesce(c.small, 0) AS small
        FROM used u FULL JOIN class_counts c ON u.haul = c.haul""",
)
def j03(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F").select("haul", "year", "priority")
    return joins.complete_with_zero(base.class_counts(spark, sf), used, ["haul"], ["large", "small"])


@query(
    "j03_complete_zero_frame",
    f"""WITH {base.HAULS}, {base.CLASS_COUNTS}, {USED}
        SELECT u.haul, u.year, u.priority, coalesce(c.large, 0) AS large, coalesce(c.small, 0) AS small
        FROM used u LEFT JOIN class_counts c ON u.haul = c.haul""",
)
def j03_frame(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F").select("haul", "year", "priority")
    return joins.complete_with_zero(base.class_counts(spark, sf), used, ["haul"], ["large", "small"], "frame")


@query(
    "j04_merge_keep_left",
    f"""WITH {base.CATCH}, {base.HAULS} SELECT c.haul, h.priority, c.size_class, c.count
        FROM catch c LEFT JOIN (SELECT * FROM hauls WHERE status = 'F') h ON c.haul = h.haul""",
)
def j04(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F").select("haul", "priority")
    return base.catch(spark, sf).join(used, "haul", "left").select("haul", "priority", "size_class", "count")


@query(
    "j05_inner_join",
    f"""WITH {base.HAULS}, {base.CLASS_COUNTS}
        SELECT h.haul, h.effort, c.large, c.small FROM hauls h JOIN class_counts c ON h.haul = c.haul WHERE h.status = 'F'""",
)
def j05(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F")
    return used.join(base.class_counts(spark, sf), "haul").select("haul", "effort", "large", "small")


YEARLY = f"""{base.LOCATED}, per AS (SELECT bed, year, count(*) AS n, sum(effort) AS effort FROM located GROUP BY bed, year)"""


def yearly(spark, sf):
    return base.located_hauls(spark, sf).groupBy("bed", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("effort").alias("effort"))


@query(
    "j06_two_keys",
    tidy_sql(
        f"""WITH {YEARLY}, used AS (SELECT bed, year, count(*) AS n_used FROM located WHERE status = 'F' GROUP BY bed, year)
            SELECT p.bed, p.year, p.n, p.effort, u.n_used FROM per p JOIN used u ON p.bed = u.bed AND p.year = u.year""",
        "effort",
    ),
)
def j06(spark, sf):
    used = base.located_hauls(spark, sf).where(F.col("status") == "F")
    used = used.groupBy("bed", "year").agg(F.count(F.lit(1)).alias("n_used"))
    return tidy(yearly(spark, sf).join(used, ["bed", "year"]).select("bed", "year", "n", "effort", "n_used"))


@query(
    "j07_three_way",
    tidy_sql(
        f"""WITH {YEARLY}, {base.AREAS} SELECT p.bed, p.year, p.n, any_value(a.area) AS area, count(*) AS big_n
            FROM areas a JOIN per p ON a.bed = p.bed JOIN stations s ON p.bed = s.bed
            GROUP BY p.bed, p.year, p.n""",
        "area",
    ),
)
def j07(spark, sf):
    frame = base.stations(spark, sf).groupBy("bed").agg(F.sum("cell_area").alias("area"), F.count(F.lit(1)).alias("big_n"))
    return tidy(yearly(spark, sf).join(frame, "bed").select("bed", "year", "n", "area", "big_n"))


@query(
    "j08_semi_join",
    f"""WITH {base.CATCH}, {base.HAULS} SELECT haul, size_class, count FROM catch
        WHERE haul IN (SELECT haul FROM hauls WHERE status = 'F')""",
)
def j08(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F").select("haul")
    return base.catch(spark, sf).join(used, "haul", "left_semi").select("haul", "size_class", "count")


@query(
    "j09_haul_to_individuals",
    f"""WITH {base.HAULS}, {base.INDIVIDUALS}
        SELECT h.haul, h.year, i.height, i.meat / i.weight AS ratio FROM hauls h LEFT JOIN individuals i ON h.haul = i.haul
        WHERE i.meat / i.weight > 0.95""",
)
def j09(spark, sf):
    ratio = F.try_divide("meat", "weight")
    joined = base.hauls(spark, sf).join(base.individuals(spark, sf), "haul", "left")
    return joined.withColumn("ratio", ratio).where(F.col("ratio") > 0.95).select("haul", "year", "height", "ratio")


MONTHLY = f"""{base.LOCATED}, per AS (SELECT bed, year, CAST(month(date) AS BIGINT) AS month, count(*) AS n
              FROM located GROUP BY bed, year, month(date))"""


def monthly(spark, sf):
    located = base.located_hauls(spark, sf).withColumn("month", F.month("date").cast("bigint"))
    return located.groupBy("bed", "year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j10_t_quantile",
    f"""WITH {MONTHLY} SELECT bed, year, month, n, {t_sql("n")} AS t FROM per""",
)
def j10(spark, sf):
    return joins.with_t_quantile(monthly(spark, sf), "n")


@query(
    "j10_t_quantile_extended",
    f"""WITH {YEARLY} SELECT bed, year, n, {t_sql("n")} AS t FROM per""",
)
def j10_extended(spark, sf):
    per = yearly(spark, sf).drop("effort")
    return joins.with_t_quantile(per, "n")


@query(
    "j11_lookup_sum",
    tidy_sql(
        f"""WITH {base.HAULS}, {base.CATCH} SELECT h.haul,
          coalesce((SELECT sum(c.count) FROM catch c WHERE c.haul = h.haul AND c.cond = 'A'), 0) AS count,
          coalesce((SELECT sum(c.weight) FROM catch c WHERE c.haul = h.haul AND c.cond = 'A'), 0) AS weight
        FROM hauls h WHERE h.status = 'F'""",
        "count",
        "weight",
    ),
)
def j11(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F").select("haul")
    wanted = {"count": "count", "weight": "weight"}
    return tidy(joins.lookup_sum(used, base.catch(spark, sf), ["haul"], wanted, F.col("cond") == "A"))


@query(
    "j12_align_results",
    tidy_sql(
        f"""WITH {base.LOCATED}, per AS (SELECT bed, year, status, avg(effort) AS m FROM located GROUP BY bed, year, status)
            SELECT a.bed, a.year, 100 * abs((a.m - b.m) / a.m) AS diff FROM per a JOIN per b ON a.bed = b.bed AND a.year = b.year
            WHERE a.status = 'F' AND b.status = 'O'""",
        "diff",
    ),
)
def j12(spark, sf):
    per = base.located_hauls(spark, sf).groupBy("bed", "year", "status").agg(F.avg("effort").alias("m"))
    ref = per.where(F.col("status") == "F").drop("status")
    other = per.where(F.col("status") == "O").select("bed", "year", F.col("m").alias("other"))
    joined = ref.join(other, ["bed", "year"])
    return tidy(joined.select("bed", "year", (F.abs((F.col("m") - F.col("other")) / F.col("m")) * 100).alias("diff")))


@query(
    "j13_normalised_key",
    f"""WITH {base.LOCATED}, {base.AREAS} SELECT l.haul, l.bed, CAST(printf('%.8e', a.area * {base.NUDGE}::DOUBLE) AS DOUBLE) AS area
        FROM located l JOIN areas a ON lower(trim(l.bed)) = lower(trim(' ' || upper(a.bed) || ' '))""",
)
def j13(spark, sf):
    noisy = base.bed_areas(spark, sf).withColumn("bed", F.concat(F.lit(" "), F.upper("bed"), F.lit(" ")))
    noisy = noisy.withColumn("area", base.significant("area"))
    joined = joins.join_on_normalised(base.located_hauls(spark, sf), noisy, ["bed"])
    return joined.select("haul", "bed", "area")


@query(
    "j14_replicates",
    f"""WITH {base.HAULS} SELECT priority, r::BIGINT AS replicate, count(*) AS n, max(haul) AS last
        FROM hauls, range(50) t(r) GROUP BY priority, r""",
)
def j14(spark, sf):
    per = base.hauls(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.max("haul").alias("last"))
    return whole(joins.replicates(per, 50))
