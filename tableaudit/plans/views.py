"""Input tables for the registered queries.

The driver tables have no nulls, blanks or planted outliers, so the audit
queries run on *dirty views*: the whole table, every row kept, with
deterministic dirt injected by ``CASE`` expressions on the key and a second
copy of some rows. Each view exists twice with equal results: as a Spark
DataFrame builder and as SQL text the DuckDB oracle runs (``*_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _every(key: Column, m: int) -> Column:
    return key % m == 0


def _copies(df: DataFrame, n: Column) -> DataFrame:
    """Repeat each row ``n`` times (1 or 2 here); no row is dropped."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).drop("__copy")


# ---------------------------------------------------------------------------
# dirty_orders: six columns, nulls, blanks, zeros, planted outliers, copies
# ---------------------------------------------------------------------------

def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(
        k,
        F.when(_every(k, 7), None).otherwise(F.col("o_custkey")).alias("cust"),
        F.when(_every(k, 11), None).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(_every(k, 17), None).when(_every(k, 23), F.lit(0.0))
         .when(_every(k, 101), F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")).alias("reading"),
        F.when(_every(k, 13), F.lit("   ")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(_every(k, 5), None).otherwise(F.col("o_orderdate")).alias("order_date"),
        F.when(_every(k, 29), 2).otherwise(1).alias("__n"),
    )
    return _copies(base, F.col("__n")).drop("__n")


DIRTY_ORDERS_SQL = """
dirty_orders_base AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0.0::DOUBLE
         WHEN o_orderkey % 101 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS reading,
    CASE WHEN o_orderkey % 13 = 0 THEN '   ' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS order_date,
    CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 1 END AS n_copies
  FROM orders),
dirty_orders AS (
  SELECT o_orderkey, cust, status, reading, priority, order_date
  FROM (SELECT *, unnest(range(n_copies)) AS copy_no FROM dirty_orders_base))"""

# Validity ranges a user supplied for dirty_orders (the T4 input).
DIRTY_ORDERS_BOUNDS = {"reading": {"min_bound": 1000.0, "max_bound": 600000.0,
                                   "description": "order value"}}


# ---------------------------------------------------------------------------
# dirty_lineitem: the bench table (about 600,000 rows at sf0.1)
# ---------------------------------------------------------------------------

def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    base = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(_every(k, 19), None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(_every(k, 97), F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax",
        F.when(_every(k, 31), F.lit(" ")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        F.when(_every(k, 43), None).otherwise(F.col("l_shipdate")).alias("l_shipdate"),
        F.when(_every(k, 37), 2).otherwise(1).alias("__n"),
    )
    return _copies(base, F.col("__n")).drop("__n")


DIRTY_LINEITEM_SQL = """
dirty_lineitem_base AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 19 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
    l_discount, l_tax,
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 31 = 0 THEN ' ' ELSE l_returnflag END AS l_returnflag,
    l_linestatus,
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 43 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate,
    CASE WHEN (l_orderkey * 8 + l_linenumber) % 37 = 0 THEN 2 ELSE 1 END AS n_copies
  FROM lineitem),
dirty_lineitem AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM (SELECT *, unnest(range(n_copies)) AS copy_no FROM dirty_lineitem_base))"""

DIRTY_LINEITEM_BOUNDS = {"l_quantity": {"min_bound": 1.0, "max_bound": 50.0, "description": "units"},
                         "l_discount": {"min_bound": 0.0, "max_bound": 0.08, "description": "share"}}


# ---------------------------------------------------------------------------
# clean views without dirt
# ---------------------------------------------------------------------------

def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order date and part price: dates for durations, a
    derived amount correlated with quantity for interactions."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_type")
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey))
    return j.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                    (F.col("l_quantity") * 1.0 * F.col("p_retailprice")).alias("amount"),
                    "p_type", "o_orderdate", "l_shipdate")


ORDER_LINES_SQL = """
order_lines AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
         l_quantity * 1.0 * p_retailprice AS amount, p_type, o_orderdate, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
