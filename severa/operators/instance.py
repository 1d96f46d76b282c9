"""A graph instance as DataFrames, its dense index, its rules and the projections on its edges.

nodes: node (label), entry_weight, target_value (0 where neither), and any attributes.
edges: src, dst (labels), cost (null: fixed), deletable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from severa.functions import relations
from severa.functions.durable import written


class InvalidInstance(ValueError):
    """An instance or an import that breaks a rule."""


@dataclass(frozen=True)
class Instance:
    nodes: DataFrame
    edges: DataFrame
    name: str = ""
    meta: dict = field(default_factory=dict)

    def entries(self) -> DataFrame:
        return self.nodes.where("entry_weight > 0").select("node", F.col("entry_weight").alias("weight"))

    def targets(self) -> DataFrame:
        return self.nodes.where("target_value > 0").select("node", F.col("target_value").alias("value"))


def merged(rows: DataFrame) -> DataFrame:
    """One edge for each ordered pair of rows (src, dst, cost, deletable): costs add, one fixed row fixes the edge.

    Self-loops go. multiplicity is the number of rows. Sums combine before the shuffle.
    """
    pairs = rows.where("src <> dst").groupBy("src", "dst").agg(F.sum("cost").alias("cost"), F.bool_and("deletable").alias("deletable"), F.count("*").alias("multiplicity"))
    return pairs.select("src", "dst", F.when(F.col("deletable"), F.col("cost")).cast("long").alias("cost"), "deletable", "multiplicity")


def all_nodes(edges: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """Endpoints of edges and annotated nodes, weights 0 where there are none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if annotated is None:
        return ends.select("node", F.lit(0.0).alias("entry_weight"), F.lit(0.0).alias("target_value"))
    return ends.join(annotated, "node", "full").select("node", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("entry_weight", "target_value")], *[c for c in annotated.columns if c not in ("node", "entry_weight", "target_value")])


def violations(instance: Instance) -> DataFrame:
    """(rule, subject): what breaks the rules of a valid instance; empty if it is valid."""
    n, e = instance.nodes, instance.edges
    both = n.where("entry_weight > 0 and target_value > 0").select(F.lit("entry is a target").alias("rule"), F.col("node").alias("subject"))
    low = n.where("entry_weight < 0 or target_value < 0").select(F.lit("weight is negative"), "node")
    cost = e.where("deletable and (cost is null or cost <= 0)").select(F.lit("cost is no positive integer"), F.concat_ws("->", "src", "dst"))
    loops = e.where("src = dst").select(F.lit("self-loop"), F.concat_ws("->", "src", "dst"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(n, "node", "left_anti").select(F.lit("edge end is no node"), "node")
    return both.union(low).union(cost).union(loops).union(ends)


def validated(instance: Instance) -> Instance:
    found = violations(instance).orderBy("rule", "subject").limit(5).collect()
    if found:
        raise InvalidInstance("; ".join(f"{r.rule}: {r.subject}" for r in found))
    return instance


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a dense number from 0 in order. A range partitioning and the partitions' counts number all rows, so that
    no single task holds them."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # as many rows as partitions
    return dealt.join(F.broadcast(counts), "_part").withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_part", "_before")


@dataclass(frozen=True)
class Indexed:
    """nodes: node_id, label, entry_weight, target_value, members. edges: edge_id, src, dst (ids), cost (0 if fixed),
    deletable, orig (the edge ids of the instance it was made from)."""

    nodes: DataFrame
    edges: DataFrame

    def entries(self) -> DataFrame:
        return self.nodes.where("entry_weight > 0").select("node_id", F.col("entry_weight").alias("weight"))

    def targets(self) -> DataFrame:
        return self.nodes.where("target_value > 0").select("node_id", F.col("target_value").alias("value"))


def indexed(instance: Instance) -> Indexed:
    """Dense node ids in label order, edge ids in order of (src, dst)."""
    n = written(_numbered(instance.nodes.select("node", "entry_weight", "target_value"), ["node"], "node_id"), "nodes")
    src = n.select(F.col("node").alias("src_label"), F.col("node_id").alias("src"))
    dst = n.select(F.col("node").alias("dst_label"), F.col("node_id").alias("dst"))
    e = instance.edges.select(F.col("src").alias("src_label"), F.col("dst").alias("dst_label"), "cost", "deletable").join(src, "src_label").join(dst, "dst_label")
    e = _numbered(e.select("src", "dst", F.when(F.col("deletable"), F.col("cost")).otherwise(F.lit(0)).cast("long").alias("cost"), "deletable"), ["src", "dst"], "edge_id")
    e = written(e.select("edge_id", "src", "dst", "cost", "deletable", F.array("edge_id").alias("orig")), "edges")
    return Indexed(n.select("node_id", F.col("node").alias("label"), "entry_weight", "target_value", F.array("node").alias("members")), e)


def alive(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("edge_id"), "edge_id", "left_anti")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "deletable")


def cost_of(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """One row, cost: the sum over removed edges. Raises if one of them can't be removed."""
    met = edges.join(removed.select("edge_id").distinct(), "edge_id")
    return met.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.coalesce(F.bool_and("deletable"), F.lit(True)).alias("_ok")).select(
        F.when(F.col("_ok"), F.col("cost")).otherwise(F.raise_error(F.lit("an edge that can't be removed is among the removed"))).cast("long").alias("cost")
    )


def affordable(gains: DataFrame, edges: DataFrame, removed: DataFrame, remaining: int) -> DataFrame:
    """Edges of positive gain that can be removed for what remains and aren't removed yet: edge_id, gain, cost."""
    return edges.where("deletable").where(F.col("cost") <= remaining).join(removed.select("edge_id"), "edge_id", "left_anti").join(gains.where("gain > 0"), "edge_id").select("edge_id", "gain", "cost")


def from_relations(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges of typed relations (src, dst, etype) between known nodes (node, tier0, wellknown, primary_group).

    Equal (src, dst, etype) count once; types of a pair add their costs, and one that can't be removed fixes the edge.
    """
    kept = rows.where("src <> dst").dropDuplicates(["src", "dst", "etype"])
    s = nodes.select(F.col("node").alias("src"), F.col("tier0").alias("_tier0"), F.col("primary_group").alias("_primary"))
    d = nodes.select(F.col("node").alias("dst"), F.upper("wellknown").alias("_wellknown"))
    met = kept.join(s, "src").join(d, "dst")
    free = relations.deletable(F.col("etype"), F.col("_wellknown"), F.col("_primary"), F.col("dst"), F.col("_tier0"))
    typed = met.select("src", "dst", "etype", free.alias("deletable"), F.when(free, relations.default_cost(F.col("etype"))).alias("cost"))
    pairs = typed.groupBy("src", "dst").agg(F.sort_array(F.collect_set("etype")).alias("etypes"), F.sum("cost").alias("cost"), F.bool_and("deletable").alias("deletable"))
    return pairs.select("src", "dst", F.when(F.col("deletable"), F.col("cost")).cast("long").alias("cost"), "deletable", "etypes")


def paired(rows: DataFrame) -> DataFrame:
    """Relations with each pair's two replication rights as one DCSync, and either right alone left out."""
    rights = rows.where(F.col("etype").isin(*relations.REPLICATION)).groupBy("src", "dst").agg(F.count_distinct("etype").alias("n"))
    both = rights.where("n = 2").select("src", "dst", F.lit("DCSync").alias("etype"))
    return rows.where(~F.col("etype").isin(*relations.REPLICATION)).select("src", "dst", "etype").unionByName(both)
