"""The memory graph over the input tables: who orders what, where from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import table

NOW = "2024-02-01 00:00:00"

#: The same tables for SQL.
SQL = """
nodes AS (
  SELECT 'c' || c_custkey AS node, 'entity' AS node_type, c_name AS label FROM customer UNION ALL SELECT 's' || s_suppkey, 'entity', s_name FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'topic', p_name FROM part UNION ALL SELECT 'n' || n_nationkey, 'entity', n_name FROM nation UNION ALL SELECT 'o' || o_orderkey, 'event', o_orderpriority FROM orders),
edges AS (
  SELECT 'oc' || o_orderkey AS edge_id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'mentioned_by' AS edge_type, 0.9::DOUBLE AS weight, 1.0::DOUBLE AS confidence FROM orders
  UNION ALL SELECT 'op' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, 'p' || l_partkey, 'related_to', 1 - l_discount, 0.5::DOUBLE + l_tax FROM lineitem
  UNION ALL SELECT 'ps' || l_orderkey || '.' || l_linenumber, 'p' || l_partkey, 's' || l_suppkey, 'depends_on', l_quantity / 50, 1 - l_tax FROM lineitem
  UNION ALL SELECT 'sn' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'related_to', 0.5::DOUBLE, 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'cn' || c_custkey, 'c' || c_custkey, 'n' || c_nationkey, 'related_to', 0.5::DOUBLE, 1.0::DOUBLE FROM customer),
flat AS (SELECT source AS src, target AS dst, weight AS s FROM edges UNION ALL SELECT target, source, weight FROM edges),
adj AS (SELECT src, dst, max(s) AS strength FROM flat GROUP BY 1, 2)"""


def _id(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def nodes(spark, d) -> DataFrame:
    """(node, node_type, label)"""
    one = lambda name, letter, key, kind, label: table(spark, d, name).select(_id(letter, key).alias("node"), F.lit(kind).alias("node_type"), F.col(label).alias("label"))
    out = one("customer", "c", "c_custkey", "entity", "c_name")
    for rest in (("supplier", "s", "s_suppkey", "entity", "s_name"), ("part", "p", "p_partkey", "topic", "p_name"), ("nation", "n", "n_nationkey", "entity", "n_name"), ("orders", "o", "o_orderkey", "event", "o_orderpriority")):
        out = out.unionByName(one(*rest))
    return out


def edges(spark, d) -> DataFrame:
    """(edge_id, source, target, edge_type, weight, confidence)"""
    def one(df, edge_id, source, target, kind, weight, confidence):
        return df.select(edge_id.alias("edge_id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), weight.alias("weight"), confidence.alias("confidence"))

    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    line = lambda p: F.concat(F.lit(p), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    half, whole = F.lit(0.5), F.lit(1.0)
    out = one(orders, _id("oc", "o_orderkey"), _id("o", "o_orderkey"), _id("c", "o_custkey"), "mentioned_by", F.lit(0.9), whole)
    out = out.unionByName(one(li, line("op"), _id("o", "l_orderkey"), _id("p", "l_partkey"), "related_to", 1 - F.col("l_discount"), 0.5 + F.col("l_tax")))
    out = out.unionByName(one(li, line("ps"), _id("p", "l_partkey"), _id("s", "l_suppkey"), "depends_on", F.col("l_quantity") / 50, 1 - F.col("l_tax")))
    out = out.unionByName(one(table(spark, d, "supplier"), _id("sn", "s_suppkey"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "related_to", half, whole))
    return out.unionByName(one(table(spark, d, "customer"), _id("cn", "c_custkey"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "related_to", half, whole))


#: Nodes as recall needs them: an order's date tells when it was said, its lines how often it was used.
RICH_SQL = SQL + """,
used AS (SELECT 'o' || l_orderkey AS node, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'p' || l_partkey, count(*) FROM lineitem GROUP BY 1),
dated AS (SELECT 'o' || o_orderkey AS node, o_orderdate AS at, o_orderstatus AS st FROM orders),
rich AS (SELECT nodes.node, node_type, label, coalesce(dated.at, TIMESTAMP '1998-01-01') AS created_at, coalesce(used.n, 0) AS access_count, CASE node_type WHEN 'event' THEN 0.5::DOUBLE WHEN 'topic' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  CASE WHEN st = 'F' THEN dated.at END AS valid_from, CASE WHEN st = 'F' THEN dated.at + INTERVAL 365 DAY END AS valid_until, CASE WHEN st = 'P' THEN dated.at + INTERVAL 30 DAY END AS invalidated_at
  FROM nodes LEFT JOIN dated USING (node) LEFT JOIN used USING (node))"""


def rich(spark, d) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    used = li.groupBy(_id("o", "l_orderkey").alias("node")).agg(F.count("*").alias("n")).unionByName(li.groupBy(_id("p", "l_partkey").alias("node")).agg(F.count("*").alias("n")))
    dated = o.select(_id("o", "o_orderkey").alias("node"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("st"))
    joined = nodes(spark, d).join(dated, "node", "left").join(used, "node", "left")
    day = lambda n: F.col("at") + F.expr(f"interval {n} days")
    return joined.select(
        "node", "node_type", "label", F.coalesce("at", F.lit("1998-01-01").cast("timestamp")).alias("created_at"), F.coalesce("n", F.lit(0)).alias("access_count"),
        F.when(F.col("node_type") == "event", 0.5).when(F.col("node_type") == "topic", 0.8).otherwise(1.0).alias("confidence"),
        F.when(F.col("st") == "F", F.col("at")).alias("valid_from"), F.when(F.col("st") == "F", day(365)).alias("valid_until"), F.when(F.col("st") == "P", day(30)).alias("invalidated_at"),
    )


#: Chains of orders: each derives from the same customer's order before it.
DERIVED_SQL = "derived AS (SELECT 'o' || o_orderkey AS source, 'o' || p AS target FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NOT NULL)"


def derived(spark, d) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, d, "orders").withColumn("p", before).where("p is not null")
    return rows.select(_id("o", "o_orderkey").alias("source"), _id("o", "p").alias("target"), F.lit("derived_from").alias("edge_type"), F.lit(1.0).alias("weight"))
