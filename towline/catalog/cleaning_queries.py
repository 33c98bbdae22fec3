"""Projection, filter and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from towline.catalog import base
from towline.catalog.base import query, whole
from towline.functions import scalar
from towline.operators import cleaning


@query(
    "p01_project_rename",
    """SELECT l_orderkey AS event, l_partkey AS species, l_suppkey AS station, CAST(l_linenumber AS BIGINT) AS number,
              l_quantity AS count, l_extendedprice AS weight, l_returnflag AS cond, l_linestatus AS size_class
       FROM lineitem""",
)
def p01(spark, sf):
    columns = {
        "event": "l_orderkey",
        "species": "l_partkey",
        "station": "l_suppkey",
        "number": "l_linenumber",
        "count": "l_quantity",
        "weight": "l_extendedprice",
        "cond": "l_returnflag",
        "size_class": "l_linestatus",
    }
    return whole(cleaning.project(base.read(spark, sf, "lineitem"), columns))


@query(
    "p02_drop_columns",
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer",
)
def p02(spark, sf):
    return whole(base.read(spark, sf, "customer").drop("c_mktsegment"))


@query(
    "p03_computed_column",
    """SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS meat,
              l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross
       FROM lineitem""",
)
def p03(spark, sf):
    meat = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = base.read(spark, sf, "lineitem").withColumn("meat", meat)
    return lines.withColumn("gross", F.col("meat") * (1 + F.col("l_tax"))).select(
        "l_orderkey", "l_partkey", "meat", "gross"
    )


@query(
    "p04_filter_conjunction",
    f"WITH {base.CATCH} SELECT haul, count, weight FROM catch WHERE size_class = 'F' AND cond = 'A'",
)
def p04(spark, sf):
    records = base.catch(spark, sf)
    return records.where((F.col("size_class") == "F") & (F.col("cond") == "A")).select("haul", "count", "weight")


@query(
    "p05_filter_not_equal",
    f"WITH {base.HAULS} SELECT haul, status, effort FROM hauls WHERE status <> 'P'",
)
def p05(spark, sf):
    return base.hauls(spark, sf).where(F.col("status") != "P").select("haul", "status", "effort")


@query(
    "p06_null_predicate",
    f"""WITH {base.HAULS}, {base.CLASS_COUNTS}
        SELECT h.haul, h.year FROM hauls h LEFT JOIN class_counts c ON h.haul = c.haul WHERE c.large IS NULL""",
)
def p06(spark, sf):
    joined = base.hauls(spark, sf).join(base.class_counts(spark, sf), "haul", "left")
    return joined.where(F.col("large").isNull()).select("haul", "year")


@query(
    "p07_membership",
    f"WITH {base.HAULS} SELECT haul, priority FROM hauls WHERE priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
)
def p07(spark, sf):
    return base.hauls(spark, sf).where(F.col("priority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select("haul", "priority")


@query(
    "p08_disjunction",
    f"WITH {base.CATCH} SELECT haul, cond, count FROM catch WHERE cond = 'A' OR count > 45",
)
def p08(spark, sf):
    return base.catch(spark, sf).where((F.col("cond") == "A") | (F.col("count") > 45)).select("haul", "cond", "count")


@query(
    "p09_range",
    f"WITH {base.HAULS} SELECT haul, year, effort FROM hauls WHERE year > 1995 AND effort > 0 AND effort <= 250000",
)
def p09(spark, sf):
    kept = base.hauls(spark, sf).where((F.col("year") > 1995) & (F.col("effort") > 0) & (F.col("effort") <= 250000))
    return kept.select("haul", "year", "effort")


LEFT_COUNTS = f"""WITH {base.HAULS}, {base.CLASS_COUNTS},
joined AS (SELECT h.haul, h.priority, c.large, c.small FROM hauls h LEFT JOIN class_counts c ON h.haul = c.haul)"""


def left_counts(spark, sf):
    joined = base.hauls(spark, sf).join(base.class_counts(spark, sf), "haul", "left")
    return joined.select("haul", "priority", "large", "small")


@query("p10_drop_incomplete", f"{LEFT_COUNTS} SELECT * FROM joined WHERE large IS NOT NULL AND small IS NOT NULL")
def p10(spark, sf):
    return left_counts(spark, sf).dropna("any")


@query(
    "p11_zero_fill_all",
    f"{LEFT_COUNTS} SELECT haul, priority, coalesce(large, 0) AS large, coalesce(small, 0) AS small FROM joined",
)
def p11(spark, sf):
    return cleaning.zero_fill(left_counts(spark, sf), ["large", "small"])


@query("p12_zero_fill_named", f"{LEFT_COUNTS} SELECT haul, priority, coalesce(large, 0) AS large, small FROM joined")
def p12(spark, sf):
    return cleaning.zero_fill(left_counts(spark, sf), ["large"])


@query(
    "p13_recode",
    f"""WITH {base.HAULS} SELECT haul, CASE status WHEN 'F' THEN 'used' WHEN 'O' THEN 'open' ELSE status END AS status
        FROM hauls""",
)
def p13(spark, sf):
    return cleaning.recode(base.hauls(spark, sf), "status", {"F": "used", "O": "open"}).select("haul", "status")


@query(
    "p13_recode_table",
    f"""WITH {base.LOCATED} SELECT haul, district AS bed FROM located""",
)
def p13_table(spark, sf):
    nation, region = base.read(spark, sf, "nation"), base.read(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")
    return cleaning.recode(base.located_hauls(spark, sf), "bed", names).select("haul", "bed")


@query(
    "p14_bucket",
    f"""WITH {base.HAULS} SELECT haul, CASE WHEN priority = '1-URGENT' THEN 'top'
          WHEN priority IN ('2-HIGH', '3-MEDIUM') THEN 'mid' ELSE 'NA' END AS grp FROM hauls""",
)
def p14(spark, sf):
    grp = scalar.bucket_label("priority", {"top": ["1-URGENT"], "mid": ["2-HIGH", "3-MEDIUM"]}, "NA")
    return base.hauls(spark, sf).select("haul", grp.alias("grp"))


@query(
    "p15_reconcile",
    """SELECT l_orderkey, l_partkey, CASE WHEN abs(l_quantity - l_linenumber * 6) > l_quantity * 0.10 THEN l_quantity
              ELSE l_linenumber * 6 END AS tow
       FROM lineitem""",
)
def p15(spark, sf):
    planned = F.col("l_linenumber") * F.lit(6.0)
    tow = scalar.reconcile("l_quantity", planned, 0.10)
    return base.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", tow.alias("tow"))


@query(
    "p16_guarded_division",
    f"""{LEFT_COUNTS} SELECT haul, CASE WHEN small > 0 THEN large / small ELSE 0 END AS ratio FROM joined""",
)
def p16(spark, sf):
    return left_counts(spark, sf).select("haul", scalar.guarded_div("large", "small").alias("ratio"))


@query(
    "p17_duplicates",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem
       QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
def p17(spark, sf):
    found = cleaning.find_duplicates(base.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return whole(found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query(
    "p18_label",
    "SELECT s_suppkey, n_name AS bed, s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
def p18(spark, sf):
    named = cleaning.label(
        base.read(spark, sf, "supplier"), "s_nationkey", base.read(spark, sf, "nation"), "n_nationkey", "n_name", "bed"
    )
    return named.select("s_suppkey", "bed", "s_acctbal")
