"""The engine's tables seen on the star-schema test tables: banks, campaigns, labels, rendered Turkish text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.query import campaign_status
from ..session import broadcast_small, table

AS_OF = "1998-06-15"


def banks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("bank_code"), F.concat(F.lit("Bank of "), "n_name").alias("bank_name"))


def campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as campaigns: dates go missing with the order's priority, the category with its status."""
    orders, customers, nations = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(broadcast_small(nations), customers["c_nationkey"] == nations["n_nationkey"])
    start, p = F.to_date("o_orderdate"), F.col("o_orderpriority")
    out = joined.select(
        F.col("o_orderkey").alias("campaign_id"),
        F.col("n_name").alias("bank_code"),
        F.concat(F.lit("slug-"), F.col("o_orderkey").cast("string")).alias("external_slug"),
        F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"),
        F.concat_ws(" ", "c_mktsegment", "o_orderstatus").alias("description"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("o_orderstatus") != "F", F.col("c_mktsegment")).alias("category"),
        F.when(p != "4-NOT SPECIFIED", start).alias("start_date"),
        F.when(~p.isin("4-NOT SPECIFIED", "5-LOW"), F.date_add(start, 45)).alias("end_date"),
        F.concat(F.lit("https://bank.example/kampanya/"), F.col("o_orderkey").cast("string")).alias("source_url"),
        F.col("o_totalprice").alias("amount"),
    )
    return out.withColumn("status", campaign_status(F.col("start_date"), F.col("end_date"), F.lit(AS_OF).cast("date")))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Line flags as the labels of two axes."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.array(F.struct(F.lit("flag").alias("axis"), F.col("l_returnflag").alias("value")), F.struct(F.lit("line").alias("axis"), F.col("l_linestatus").alias("value"))).alias("x"))
    rows = li.select(F.col("l_orderkey").alias("campaign_id"), F.explode("x").alias("x")).select("campaign_id", "x.*").distinct()
    return rows.withColumn("confidence", F.when(F.col("axis") == "flag", F.lit(0.9)).otherwise(F.lit(0.4)).cast("decimal(4,3)")).withColumn("source", F.lit("keyword"))


def tr_number(c: Column, digits: int = 2) -> Column:
    return F.translate(F.format_number(c, digits), ",.", ".,")


def tr_day_month(c: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(c).cast("string"), F.element_at(F.array(*[F.lit(m) for m in V.MONTHS]), F.month(c)))


def tr_date(c: Column) -> Column:
    return F.concat_ws(" ", tr_day_month(c), F.year(c).cast("string"))


SQL_CAMPAIGNS = f"""campaigns AS (
    SELECT o_orderkey AS campaign_id, n_name AS bank_code, 'slug-' || o_orderkey AS external_slug, o_orderpriority || ' ' || c_name AS title,
           c_mktsegment || ' ' || o_orderstatus AS description, c_mktsegment AS segment, CASE WHEN o_orderstatus <> 'F' THEN c_mktsegment END AS category,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) END AS start_date,
           CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN CAST(o_orderdate AS DATE) + 45 END AS end_date,
           'https://bank.example/kampanya/' || o_orderkey AS source_url, o_totalprice AS amount,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown'
                WHEN o_orderpriority <> '5-LOW' AND CAST(o_orderdate AS DATE) + 45 < DATE '{AS_OF}' THEN 'expired'
                WHEN CAST(o_orderdate AS DATE) > DATE '{AS_OF}' THEN 'upcoming' ELSE 'active' END AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SQL_LABELS = """labels_ AS (
    SELECT DISTINCT l_orderkey AS campaign_id, 'flag' AS axis, l_returnflag AS value FROM lineitem
    UNION SELECT DISTINCT l_orderkey, 'line', l_linestatus FROM lineitem)"""
