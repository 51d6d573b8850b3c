"""Relational queries over the star tables: one of each kind of join, aggregate, window and limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.plans.registry import registry
from lucerna.sources.readers import table

QUERIES, ORACLE_SQL, query = registry()


@query("star_revenue_by_region", """
    SELECT r_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def star_revenue_by_region(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyer = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    x = per_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("r_name").agg(F.sum("n").alias("n_lines"), F.round(F.sum("v"), 2).alias("revenue"))


@query("star_semi", """
    SELECT CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def star_semi(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, d, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("star_anti", """
    SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_idle FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = 0) GROUP BY c_mktsegment""")
def star_anti(spark: SparkSession, d: str) -> DataFrame:
    idle = table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderkey % 4 = 0").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.count("*").alias("n_idle"))


@query("star_rollup", """
    SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def star_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return x.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("star_window", """
    SELECT o_custkey, o_orderkey, rank, round(running, 2) AS running FROM (
        SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rank, sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS running
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE rank <= 3""")
def star_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"), F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return x.where("rank <= 3").withColumn("running", F.round("running", 2))


@query("star_topk", """
    SELECT p_partkey, p_brand, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY p_partkey, p_brand ORDER BY sum(l_extendedprice) DESC, p_partkey LIMIT 20""")
def star_topk(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    top = sums.orderBy(F.desc("v"), "l_partkey").limit(20)
    return top.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_brand", F.round("v", 2).alias("value"))
