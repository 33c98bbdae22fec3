"""Sources, sinks, staging, ordering, unions and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from towline.catalog import base
from towline.catalog.base import query, tidy, tidy_sql, whole
from towline.functions import scalar, units
from towline.operators.reshape import domain_order
from towline.session import checkpoint_folder
from towline.sources import read_lookup, read_table, stage, write_table


@query(
    "s01_read_table",
    "SELECT l_orderkey, l_quantity, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem WHERE l_returnflag = 'R'",
)
def s01(spark, sf):
    lines = read_table(spark, f"{sf}/lineitem.parquet").where(F.col("l_returnflag") == "R")
    return lines.select("l_orderkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ship_date"))


@query(
    "s02_reread_results",
    f"""WITH {base.LOCATED}, {base.AREAS}, per AS (SELECT bed, year, count(*) AS hauls FROM located GROUP BY bed, year)
        SELECT p.bed, p.year, p.hauls, round(a.area, 2) AS area FROM per p JOIN areas a ON p.bed = a.bed""",
)
def s02(spark, sf):
    """Two result tables are written, one as CSV and one as parquet, read back and put together."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    write_table(base.located_hauls(spark, sf).groupBy("bed", "year").agg(F.count(F.lit(1)).alias("hauls")), f"{folder}/samples")
    write_table(base.bed_areas(spark, sf), f"{folder}/areas.parquet", fmt="parquet")
    samples = read_table(spark, f"{folder}/samples", "bed STRING, year BIGINT, hauls BIGINT")
    areas = read_table(spark, f"{folder}/areas.parquet", "bed STRING, area DOUBLE")
    return samples.join(areas, "bed").withColumn("area", F.round("area", 2))


@query(
    "s03_write_table",
    f"""WITH {base.LOCATED} SELECT bed, year, count(*) AS hauls FROM located GROUP BY bed, year""",
)
def s03(spark, sf):
    out = base.located_hauls(spark, sf).groupBy("bed", "year").agg(F.count(F.lit(1)).alias("hauls"))
    path = f"{checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"
    write_table(out, path)
    return read_table(spark, path, "bed STRING, year BIGINT, hauls BIGINT")


@query(
    "s04_stage_materialized",
    f"""WITH {base.HAULS} SELECT year, priority, count(*) AS hauls FROM hauls WHERE status = 'F' GROUP BY year, priority""",
)
def s04(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F").select("year", "priority", "haul")
    stage(used, "used_hauls", materialize=True)
    return spark.sql("SELECT year, priority, count(*) AS hauls FROM used_hauls GROUP BY year, priority")


@query(
    "s05_stage_view",
    tidy_sql(f"WITH {base.STATIONS} SELECT bed, sum(cell_area) AS area FROM stations GROUP BY bed", "area"),
)
def s05(spark, sf):
    stage(base.bed_areas(spark, sf), "bed_areas")
    return tidy(spark.sql("SELECT bed, area FROM bed_areas"))


@query(
    "s06_lookup",
    "SELECT c_custkey, n_name AS bed FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def s06(spark, sf):
    nations = read_lookup(spark, f"{sf}/nation.parquet", None, "n_nationkey")
    customers = base.read(spark, sf, "customer")
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.select("c_custkey", F.col("n_name").alias("bed"))


@query(
    "o01_order_by_mixed",
    f"""WITH {base.HAULS} SELECT year, haul, priority, station FROM hauls WHERE status = 'F'
        ORDER BY year, haul DESC, priority, station""",
)
def o01(spark, sf):
    used = base.hauls(spark, sf).where(F.col("status") == "F")
    return used.select("year", "haul", "priority", "station").orderBy("year", F.desc("haul"), "priority", "station")


@query(
    "o02_order_by_group",
    f"""WITH {base.LOCATED} SELECT year, bed, count(*) AS n FROM located GROUP BY year, bed ORDER BY year, bed""",
)
def o02(spark, sf):
    counted = base.located_hauls(spark, sf).groupBy("year", "bed").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("year", "bed")


PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "o03_domain_order",
    f"""WITH {base.HAULS} SELECT priority, count(*) AS n,
          CASE priority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4
          WHEN '1-URGENT' THEN 5 END::BIGINT AS ord
        FROM hauls GROUP BY priority ORDER BY ord""",
)
def o03(spark, sf):
    counted = base.hauls(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return whole(domain_order(counted, "priority", PRIORITY_ORDER)).orderBy("ord")


@query(
    "u01_union",
    f"""WITH {base.CATCH} SELECT cond, 'count' AS measure, max(count) AS top FROM catch GROUP BY cond
        UNION ALL SELECT cond, 'weight', max(weight) FROM catch GROUP BY cond""",
)
def u01(spark, sf):
    records = base.catch(spark, sf)
    parts = [
        records.groupBy("cond").agg(F.lit(m).alias("measure"), F.max(m).alias("top")) for m in ("count", "weight")
    ]
    return parts[0].unionByName(parts[1]).select("cond", "measure", "top")


@query(
    "u02_union_missing_columns",
    f"""WITH {base.HAULS} SELECT priority, NULL AS type, count(*) AS n FROM hauls WHERE status = 'O' GROUP BY priority
        UNION ALL SELECT priority, 'used' AS type, count(*) FROM hauls WHERE status = 'F' GROUP BY priority""",
)
def u02(spark, sf):
    per = base.hauls(spark, sf).groupBy("priority", "status").agg(F.count(F.lit(1)).alias("n"))
    plain = per.where(F.col("status") == "O").drop("status")
    typed = per.where(F.col("status") == "F").drop("status").withColumn("type", F.lit("used"))
    return plain.unionByName(typed, allowMissingColumns=True).select("priority", "type", "n")


@query(
    "f01_text_functions",
    """SELECT p_partkey, replace(p_name, ' ', '') AS squeezed, lower(trim(' ' || upper(p_name) || ' ')) AS norm,
              p_brand || ' ' || p_type AS pasted, right(p_brand, 4) AS tail, 'n=' || p_size AS tag
       FROM part""",
)
def f01(spark, sf):
    part = base.read(spark, sf, "part")
    noisy = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))
    return part.select(
        "p_partkey",
        scalar.strip_spaces("p_name").alias("squeezed"),
        scalar.norm_key(noisy).alias("norm"),
        F.concat_ws(" ", "p_brand", "p_type").alias("pasted"),
        scalar.trailing("p_brand", 4).alias("tail"),
        F.concat(F.lit("n="), F.col("p_size")).alias("tag"),
    )


@query(
    "f02_date_functions",
    """SELECT o_orderkey, strptime(strftime(o_orderdate, '%m-%d-%Y'), '%m-%d-%Y')::DATE AS date,
              CAST(year(o_orderdate) AS BIGINT) AS year, monthname(o_orderdate) AS month,
              o_orderpriority || ' ' || monthname(o_orderdate) AS bed_month
       FROM orders""",
)
def f02(spark, sf):
    text = F.date_format("o_orderdate", "MM-dd-yyyy")
    dated = base.read(spark, sf, "orders").withColumn("date", scalar.parse_date(text))
    month = scalar.month_name("date")
    return whole(
        dated.select(
            "o_orderkey",
            "date",
            F.year("date").alias("year"),
            month.alias("month"),
            F.concat_ws(" ", F.col("o_orderpriority"), month).alias("bed_month"),
        )
    )


@query(
    "f03_numeric_functions",
    f"""SELECT c_custkey, abs(c_acctbal) AS a, sqrt(abs(c_acctbal)) AS root, c_acctbal * c_acctbal AS square,
              CAST(printf('%.8e', ln(abs(c_acctbal) + 1) * {base.NUDGE}::DOUBLE) AS DOUBLE) AS log,
              round_even(c_acctbal, 0) AS whole, CAST(round(c_acctbal::DECIMAL(18,2), 1) AS DOUBLE) AS tenth
       FROM customer""",
)
def f03(spark, sf):
    c = F.col("c_acctbal")
    return base.read(spark, sf, "customer").select(
        "c_custkey",
        F.abs(c).alias("a"),
        F.sqrt(F.abs(c)).alias("root"),
        (c * c).alias("square"),
        base.significant(F.ln(F.abs(c) + 1)).alias("log"),
        scalar.half_even(c).alias("whole"),
        scalar.one_decimal(c).alias("tenth"),
    )


@query(
    "f04_number_text",
    """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS standard, format('{:,.0f}', round_even(o_totalprice, 0)) AS big,
              CAST(replace(format('{:,.2f}', o_totalprice), ',', '') AS DOUBLE) AS back
       FROM orders""",
)
def f04(spark, sf):
    text = scalar.standard_text("o_totalprice")
    return base.read(spark, sf, "orders").select(
        "o_orderkey",
        text.alias("standard"),
        F.format_number(scalar.half_even("o_totalprice"), 0).alias("big"),
        scalar.parse_standard(text).alias("back"),
    )


@query(
    "f05_unit_constants",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, l_quantity * 0.00220462 AS lb_per_gram,
              l_quantity * 2.2046 AS lb_short, l_quantity * 2.20462262 AS lb_long, l_quantity / 453.592 AS lb_meat
       FROM lineitem""",
)
def f05(spark, sf):
    q = F.col("l_quantity")
    return whole(
        base.read(spark, sf, "lineitem").select(
            "l_orderkey",
            F.col("l_linenumber").alias("line"),
            "l_partkey",
            (q * units.POUNDS_PER_GRAM).alias("lb_per_gram"),
            (q * units.POUNDS_PER_KG_SHORT).alias("lb_short"),
            (q * units.POUNDS_PER_KG_LONG).alias("lb_long"),
            (q / units.GRAMS_PER_POUND).alias("lb_meat"),
        )
    )


@query(
    "g01_group_apply",
    tidy_sql(
        f"""WITH {base.HAULS} SELECT station, count(*) AS n, median(effort) AS mid FROM hauls GROUP BY station""", "mid"
    ),
)
def g01(spark, sf):
    per = base.hauls(spark, sf).groupBy("station")
    return tidy(per.agg(F.count(F.lit(1)).alias("n"), F.median("effort").alias("mid")))
