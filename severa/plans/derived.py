"""The graph that the driver's tables give: customers, orders, suppliers, nations and regions.

customer -> order costs 1, order -> supplier 3 a row (returned rows with a high discount), supplier -> nation and
nation -> region are fixed. Building customers are entries of weight 1, regions targets. The cyclic form adds
supplier -> order edges of cost 2, the ringed one a fixed ring over each region's nations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.functions.durable import written
from severa.operators.instance import Instance, all_nodes, merged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def raw_edges(spark: SparkSession, sf_dir: str, cyclic: bool = False, ringed: bool = False) -> DataFrame:
    def rows(name, where, src, dst, cost):
        t = table(spark, sf_dir, name)
        t = t.where(where) if where else t
        return t.select(src.alias("src"), dst.alias("dst"), F.lit(cost).cast("long").alias("cost"), F.lit(cost is not None).alias("deletable"))

    parts = [
        rows("orders", None, _named("c", "o_custkey"), _named("o", "o_orderkey"), 1),
        rows("lineitem", "l_discount >= 0.09D and l_returnflag = 'R'", _named("o", "l_orderkey"), _named("s", "l_suppkey"), 3),
        rows("supplier", None, _named("s", "s_suppkey"), _named("n", "s_nationkey"), None),
        rows("nation", None, _named("n", "n_nationkey"), _named("r", "n_regionkey"), None),
    ]
    if cyclic:
        parts.append(rows("lineitem", "l_discount >= 0.09D and l_returnflag = 'A'", _named("s", "l_suppkey"), _named("o", "l_orderkey"), 2))
    if ringed:
        n = table(spark, sf_dir, "nation")
        a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("b"))
        after = a.join(b, "n_regionkey").where("b > a").groupBy("a").agg(F.min("b").alias("b"))
        first = n.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("a"), F.min("n_nationkey").alias("b")).where("a <> b").select("a", "b")
        ring = after.union(first)
        parts.append(ring.select(_named("n", "a").alias("src"), _named("n", "b").alias("dst"), F.lit(None).cast("long").alias("cost"), F.lit(False).alias("deletable")))
    return reduce(DataFrame.union, parts)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(_named("c", "c_custkey").alias("node"), F.lit(1.0).alias("entry_weight"), F.lit(0.0).alias("target_value"))
    r = table(spark, sf_dir, "region").select(_named("r", "r_regionkey").alias("node"), F.lit(0.0).alias("entry_weight"), (5 + 5 * (F.col("r_regionkey") % 3)).cast("double").alias("target_value"))
    return c.union(r)


def instance(spark: SparkSession, sf_dir: str, cyclic: bool = False, ringed: bool = False) -> Instance:
    edges = written(merged(raw_edges(spark, sf_dir, cyclic, ringed)), "merged")
    return Instance(all_nodes(edges, annotations(spark, sf_dir)), edges, "derived")


def sql(cyclic: bool = False, ringed: bool = False) -> str:
    """The same graph as common table expressions: raw, medges, nodes, inodes, iedges, ent, tgt."""
    back = "UNION ALL SELECT 's' || l_suppkey, 'o' || l_orderkey, 2, true FROM lineitem WHERE l_discount >= 0.09 AND l_returnflag = 'A'" if cyclic else ""
    ring = """
  UNION ALL SELECT 'n' || a.n_nationkey, 'n' || min(b.n_nationkey), NULL, false FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey GROUP BY a.n_nationkey
  UNION ALL SELECT 'n' || max(n_nationkey), 'n' || min(n_nationkey), NULL, false FROM nation GROUP BY n_regionkey HAVING count(*) > 1""" if ringed else ""
    return f"""
WITH RECURSIVE raw(src, dst, cost, deletable) AS (
  SELECT 'c' || o_custkey, 'o' || o_orderkey, 1, true FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 3, true FROM lineitem WHERE l_discount >= 0.09 AND l_returnflag = 'R'
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, NULL, false FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL, false FROM nation
  {back}{ring}),
medges AS MATERIALIZED (
  SELECT src, dst, CAST(CASE WHEN bool_and(deletable) THEN sum(cost) END AS BIGINT) AS cost, bool_and(deletable) AS deletable, count(*) AS multiplicity
  FROM raw WHERE src <> dst GROUP BY src, dst),
annot AS (
  SELECT 'c' || c_custkey AS node, 1.0::DOUBLE AS entry_weight, 0.0::DOUBLE AS target_value FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'r' || r_regionkey, 0.0, (5 + 5 * (r_regionkey % 3))::DOUBLE FROM region),
nodes AS MATERIALIZED (
  SELECT coalesce(e.node, a.node) AS node, coalesce(entry_weight, 0) AS entry_weight, coalesce(target_value, 0) AS target_value
  FROM (SELECT src AS node FROM medges UNION SELECT dst FROM medges) e FULL JOIN annot a ON e.node = a.node),
inodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY node) - 1 AS node_id, * FROM nodes),
iedges AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY s.node_id, d.node_id) - 1 AS edge_id, s.node_id AS src, d.node_id AS dst, CASE WHEN deletable THEN cost ELSE 0 END AS cost, deletable
  FROM medges m JOIN inodes s ON m.src = s.node JOIN inodes d ON m.dst = d.node),
ent AS MATERIALIZED (SELECT node_id, entry_weight AS weight FROM inodes WHERE entry_weight > 0),
tgt AS MATERIALIZED (SELECT node_id, target_value AS value FROM inodes WHERE target_value > 0)"""
