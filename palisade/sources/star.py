"""The star-schema tables as the draft domain's logical inputs, in Spark and in SQL.

Picks come from orders or from lines, prospects from parts, standings from suppliers,
game logs from events. Each binding has a SQL twin for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import number_rows
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", F.col("c_mktsegment").alias("league"), F.col("r_name").alias("nationality"))
    )


def order_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, year, month, overall_pick, n, round, team, position, league, nationality, ppg, css_rank, age of every order."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    sizes = orders.groupBy("year").agg(F.count("*").alias("n"))
    orders = number_rows(orders, ["year"], F.col("o_orderdate"), [F.col("o_orderkey")], "overall_pick")
    orders = number_rows(orders, ["year"], F.floor(F.col("o_totalprice") / 100), [F.desc("o_totalprice"), F.col("o_orderkey")], "price_rank", descending=True)
    rows = orders.join(F.broadcast(sizes), "year").join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), "year", F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 32).cast("int").alias("team"),
        F.col("o_orderpriority").alias("position"), "league", "nationality", (F.col("o_totalprice") / 100000).alias("ppg"),
        "o_orderstatus", "overall_pick", "n", "price_rank",
    )
    picks = rows.select(
        "id", "year", "month", "overall_pick", "n", F.expr("CAST((7 * overall_pick + n - 1) DIV n AS int)").alias("round"), "team", "position",
        "league", "nationality", "ppg", F.when(F.col("o_orderstatus") != "P", F.col("price_rank")).alias("css_rank"),
        F.round(17.8 + F.col("id") % 450 / 365.25, 2).alias("age"),
    )
    return written(picks, "picks")


ORDER_PICKS = """
order_rows AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(o_custkey % 32 AS INT) AS team,
         o_orderpriority AS position, c_mktsegment AS league, r_name AS nationality, o_totalprice / 100000 AS ppg, o_orderstatus,
         CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS INT) AS overall_pick,
         count(*) OVER (PARTITION BY year(o_orderdate)) AS n,
         CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS price_rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), picks AS (
  SELECT id, year, month, overall_pick, n, CAST((7 * overall_pick + n - 1) // n AS INT) AS round, team, position, league, nationality, ppg,
         CASE WHEN o_orderstatus <> 'P' THEN price_rank END AS css_rank, round(17.8::DOUBLE + (id % 450) / 365.25::DOUBLE, 2) AS age
  FROM order_rows
)"""


def line_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gm, year, round, position, league, nationality of every line. Orders meet their customers first, and lines take the words of their part last, so that
    lines are shuffled twice and without those words."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("gm"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("round"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("position"), F.col("p_brand").alias("league"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _customers(spark, sf_dir).select("c_custkey", "nationality")
    of_order = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nationality")
    return (
        line.join(of_order, line.l_orderkey == of_order.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select("gm", "year", "round", "position", "league", "nationality")
    )


LINE_PICKS = """
lines AS (
  SELECT l_suppkey AS gm, CAST(year(l_shipdate) AS INT) AS year, l_linenumber AS round, p_type AS position, p_brand AS league, r_name AS nationality
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, position, league, ppg, css_ranking (null for a tenth), price of every part."""
    part = table(spark, sf_dir, "part")
    ranked = number_rows(part, [], F.floor("p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], "place", descending=True)
    return ranked.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("position"), F.col("p_brand").alias("league"),
        (F.col("p_size") / 10).alias("ppg"), F.when(F.col("p_size") % 10 != 0, F.col("place")).alias("css_ranking"), F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


PROSPECTS = """
prospects AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS position, p_brand AS league, p_size / 10.0 AS ppg,
         CASE WHEN p_size % 10 <> 0 THEN CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INT) END AS css_ranking,
         p_size AS size, p_retailprice AS price
  FROM part
)"""
