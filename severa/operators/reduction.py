"""Reductions that keep every budget's optimum, as relabelling joins and grouped sums.

The kernels have the same rules for graphs that fit in a task; these work on graphs that don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from severa.functions.durable import written
from severa.operators.instance import Indexed
from severa.operators.reach import relevant


def _put(graph: Indexed) -> Indexed:
    return Indexed(written(graph.nodes, "nodes"), written(graph.edges, "edges"))


def prune(graph: Indexed) -> Indexed:
    """R1: only nodes on ways from entries to targets, and the edges between them."""
    keep = written(relevant(graph), "relevant")
    e = graph.edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return _put(Indexed(graph.nodes.join(keep, "node_id", "left_semi"), e))


def contract(graph: Indexed, reps: DataFrame) -> Indexed:
    """Merges each node into its representative: reps (node_id, rep), others stand for themselves.

    Weights and values add, members join; edges between merged nodes go, parallel ones add their costs and original
    edges, and one fixed edge fixes them. Edge ids are the smallest of those merged.
    """
    of = reps.select("node_id", "rep")
    n = graph.nodes.join(of, "node_id", "left").withColumn("rep", F.coalesce("rep", "node_id"))
    label = F.min_by("label", "node_id").alias("label") if "label" in graph.nodes.columns else F.lit(None).alias("label")
    nodes = n.groupBy(F.col("rep").alias("node_id")).agg(label, F.sum("entry_weight").alias("entry_weight"), F.sum("target_value").alias("target_value"), F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))
    s, t = (of.select(F.col("node_id").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("src", "dst"))
    e = graph.edges.join(s, "src", "left").join(t, "dst", "left").withColumn("src", F.coalesce("src_rep", "src")).withColumn("dst", F.coalesce("dst_rep", "dst"))
    e = e.where("src <> dst").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"), F.sum("cost").alias("cost"), F.bool_and("deletable").alias("deletable"), F.array_sort(F.flatten(F.collect_list("orig"))).alias("orig"))
    edges = e.select("edge_id", "src", "dst", F.when(F.col("deletable"), F.col("cost")).otherwise(F.lit(0)).cast("long").alias("cost"), "deletable", "orig")
    return _put(Indexed(nodes, edges))


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after every label went along edges (src, dst) as far as smaller ones let it."""
    while True:
        sent = labels.join(edges, labels["node"] == edges["src"]).select(F.col("dst").alias("node"), "label")
        after = written(sent.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty()
        labels = after
        if moved:
            return labels


def fixed_components(graph: Indexed) -> DataFrame:
    """(node_id, rep) of nodes that fixed edges connect strongly with others; rep is the smallest of them.

    Rounds of colouring: every node takes the smallest label that reaches it; of a colour, what reaches the node that
    gave it, inside the colour, is that node's component. It leaves, and the rest goes on.
    """
    edges = written(graph.edges.where("not deletable").select("src", "dst"), "fixed")
    found = None
    while True:
        # only nodes with edges on both sides can be on a cycle
        ends = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        ends = written(ends, "ends")
        kept = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
        kept = written(kept.select("src", "dst"), "fixed")
        if kept.isEmpty():
            break
        if kept.count() < edges.count():
            edges = kept
            continue
        colour = _spread(written(ends.select("node", F.col("node").alias("label")), "labels"), edges)
        a = colour.select(F.col("node").alias("src"), F.col("label").alias("src_label"))
        b = colour.select(F.col("node").alias("dst"), F.col("label").alias("dst_label"))
        inner = written(edges.join(a, "src").join(b, "dst").where("src_label = dst_label").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inner")
        # backwards from each colour's own node; a node's label is smaller than its id unless the colour is its own
        seed = colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label"))
        member = _spread(written(seed, "labels"), inner).where("label = 0").select("node")
        group = written(colour.join(member, "node").select(F.col("node").alias("node_id"), F.col("label").alias("rep")), "component")
        found = group if found is None else found.union(group)
        gone = group.select(F.col("node_id").alias("node"))
        edges = written(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "fixed")
    if found is None:
        return graph.nodes.select("node_id", F.col("node_id").alias("rep")).limit(0)
    large = found.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    return found.join(large, "rep", "left_semi").select("node_id", "rep")


def twins(graph: Indexed) -> DataFrame:
    """(node_id, rep) by R3: no targets, all edges out fixed, and to the same nodes as others."""
    outs = graph.edges.groupBy("src").agg(F.bool_or("deletable").alias("loose"), F.sort_array(F.collect_set("dst")).alias("to")).where("not loose")
    plain = graph.nodes.where("target_value <= 0").select(F.col("node_id").alias("src"))
    outs = outs.join(plain, "src", "left_semi").select("src", F.col("to"), F.xxhash64("to").alias("h"))
    firsts = outs.groupBy("h", "to").agg(F.min("src").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return outs.join(firsts, ["h", "to"]).select(F.col("src").alias("node_id"), "rep")


def lone(graph: Indexed, inward: bool) -> DataFrame:
    """(node_id, rep) by R4: nodes without weight and value whose only edge in (or out) is fixed, merged along it.

    Chains are followed by pointer doubling; after R2 there is no fixed cycle for them to run in.
    """
    here, there = ("dst", "src") if inward else ("src", "dst")
    one = graph.edges.groupBy(F.col(here).alias("node_id")).agg(F.count("*").alias("n"), F.bool_or("deletable").alias("loose"), F.min(there).alias("rep")).where("n = 1 and not loose")
    plain = graph.nodes.where("entry_weight <= 0 and target_value <= 0").select("node_id")
    parent = written(one.join(plain, "node_id", "left_semi").select("node_id", "rep"), "parent")
    while True:
        up = parent.select(F.col("node_id").alias("rep"), F.col("rep").alias("up"))
        after = written(parent.join(up, "rep", "left").select("node_id", F.coalesce("up", "rep").alias("rep")), "parent")
        if after.join(parent.withColumnRenamed("rep", "was"), "node_id").where("rep <> was").isEmpty():
            return after
        parent = after


def reduce(graph: Indexed, rules=("R1", "R2", "R3", "R4")) -> Indexed:
    """R1 once, then R2 to R4 until none applies; each that does leaves fewer nodes."""
    if "R1" in rules:
        graph = prune(graph)
    steps = {"R2": [fixed_components], "R3": [twins], "R4": [lambda g: lone(g, True), lambda g: lone(g, False)]}
    changed = True
    while changed:
        changed = False
        for rule, makes in steps.items():
            for make in makes if rule in rules else []:
                while not (reps := written(make(graph).where("node_id <> rep"), "reps")).isEmpty():
                    graph, changed = contract(graph, reps), True
                    if rule != "R3":
                        break
    return graph


def original_edges(graph: Indexed, chosen: DataFrame) -> DataFrame:
    """edge_id of the original edges that chosen reduced edges (edge_id) stand for."""
    return graph.edges.join(chosen.select("edge_id"), "edge_id", "left_semi").select(F.explode("orig").alias("edge_id")).distinct()
