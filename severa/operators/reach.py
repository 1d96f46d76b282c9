"""Reachability, residual risk and distances, for many targets and removal scenarios at once.

State rows are (scenario, target, node, depth). One round expands the frontiers of all scenarios and targets, so the
number of rounds is the depth of the graph, whatever the number of questions.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from severa.functions.durable import counted, written
from severa.operators.instance import Indexed

#: Rounds after which the pieces of the state become one table again.
COMPACT = 16
#: Starts that share a row of state.
BITS = 63


def expand(seed: DataFrame, edges: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """All (scenario, target, node, depth) that are reached from seed (scenario, target, node) along edges (src, dst, edge_id).

    removed (scenario, edge_id) are missing in their scenario. depth is the number of edges of a shortest path. Each
    round is a join of the last frontier with the edges, a distinct and an anti-join with what is known; it is written,
    so a lost executor costs a round at most. It ends with an empty frontier, after as many rounds as it takes. Edges
    that have a scenario or a target are there for that one alone.
    """
    keys = ["scenario", "target", "node"]
    frontier = written(seed.select(*keys).distinct().withColumn("depth", F.lit(0)), "frontier")
    pieces = [frontier]
    own = [c for c in keys[:2] if c in edges.columns]
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"), "edge_id", *own)
    for depth in count(1):
        step = frontier.select(*keys).join(e, ["node", *own])
        if removed is not None:
            step = step.join(removed.select("scenario", "edge_id"), ["scenario", "edge_id"], "left_anti")
        seen = reduce(DataFrame.union, pieces)
        step = step.select("scenario", "target", F.col("_next").alias("node")).distinct().join(seen, keys, "left_anti")
        frontier, n = counted(step.withColumn("depth", F.lit(depth)), "frontier")
        if not n:
            return reduce(DataFrame.union, pieces)
        pieces.append(frontier)
        if len(pieces) > COMPACT:
            pieces = [written(reduce(DataFrame.union, pieces), "reach", tuple(pieces[:-1]))]


def weights_that_reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, total): of every node that starts (node_id, weight) reach, the sum of the weights of those that do.

    Starts stand in blocks of BITS, and a node's state is a set of bits for each block that reaches it: a row stands for
    up to BITS pairs, and a round joins only the sets that grew, or-s them by node and keeps what is new.
    """
    order = Window.orderBy("node_id")  # starts are few beside nodes; only their ids and weights are numbered
    placed = written(starts.select("node_id", "weight", (F.row_number().over(order) - 1).alias("_n")), "starts")
    block, bit = F.floor(F.col("_n") / BITS).cast("long").alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_n") % BITS).cast("int"))
    fresh = written(placed.select(block, F.col("node_id").alias("node"), bit.alias("bits")), "fresh")
    state = fresh
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
    while True:
        sent = fresh.join(e, "node").groupBy("block", F.col("_next").alias("node")).agg(F.bit_or("bits").alias("bits"))
        known = state.select("block", "node", F.col("bits").alias("had"))
        grown = sent.join(known, ["block", "node"], "left").select("block", "node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits"))
        after, n = counted(grown.where("bits <> 0"), "fresh")
        if not n:
            break
        state = written(state.union(after).groupBy("block", "node").agg(F.bit_or("bits").alias("bits")), "bits", () if state is fresh else (state,))
        fresh = after
    weights = placed.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("_n", "weight"))).alias("all"))
    held = lambda x: F.call_function("bit_get", F.col("bits"), (x["_n"] % BITS).cast("int")) == 1
    total = F.aggregate(F.filter("all", held), F.lit(0.0), lambda acc, x: acc + x["weight"])
    return state.join(weights, "block").groupBy("node").agg(F.sum(total).alias("total"))


def scenarios_of(df: DataFrame) -> DataFrame:
    return df.select("scenario").distinct()


def _only(graph: Indexed) -> DataFrame:
    return graph.nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("scenario"))


def reach(starts: DataFrame, edges: DataFrame, backward: bool = False) -> DataFrame:
    """node_id and depth of all that any of starts (node_id) reaches, starts included."""
    way = edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges.select("edge_id", "src", "dst")
    seed = starts.select(F.lit(0).cast("long").alias("scenario"), F.lit(0).cast("long").alias("target"), F.col("node_id").alias("node"))
    return expand(seed, way).select(F.col("node").alias("node_id"), "depth")


def target_reach(graph: Indexed, scenarios: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, target, node, depth): the nodes that reach each target, itself included, by scenario."""
    scenarios = _only(graph) if scenarios is None else scenarios
    # few scenarios and targets by their nature; their product is the number of questions
    seed = graph.targets().select(F.col("node_id").alias("target"), F.col("node_id").alias("node")).join(scenarios)
    return expand(seed, graph.edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")), removed)


def pairs(graph: Indexed, reached: DataFrame) -> DataFrame:
    """(scenario, target, entry, depth, weight, value) of entries that reach a target."""
    e = graph.entries().select(F.col("node_id").alias("node"), "weight")
    t = graph.targets().select(F.col("node_id").alias("target"), "value")
    return reached.join(e, "node").join(t, "target").select("scenario", "target", F.col("node").alias("entry"), "depth", "weight", "value")


def risk_by_target(graph: Indexed, reached: DataFrame | None = None) -> DataFrame:
    """(scenario, target, value, reach_weight, risk) of targets that an entry reaches."""
    reached = target_reach(graph) if reached is None else reached
    return pairs(graph, reached).groupBy("scenario", "target", "value").agg(F.sum("weight").alias("reach_weight"), F.sum(F.col("weight") * F.col("value")).alias("risk"))


def risk(graph: Indexed, scenarios: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, risk), a row for each scenario; 0 where no entry reaches a target."""
    scenarios = _only(graph) if scenarios is None else scenarios
    found = pairs(graph, target_reach(graph, scenarios, removed)).groupBy("scenario").agg(F.sum(F.col("weight") * F.col("value")).alias("risk"))
    return scenarios.join(found, "scenario", "left").select("scenario", F.coalesce("risk", F.lit(0.0)).alias("risk"))


def metrics(graph: Indexed, scenarios: DataFrame, removed: DataFrame) -> DataFrame:
    """(scenario, risk, risk0, risk_ratio, reach_pair_frac, mean_dist).

    The ratio is to the risk without removals (null if that is 0), the fraction is of all entry-target pairs, and the
    mean distance counts edges over the pairs that are left (null without any). The unremoved graph runs as one more
    scenario of the same rounds.
    """
    base = graph.nodes.sparkSession.range(1).select(F.lit(-1).cast("long").alias("scenario"))
    found = pairs(graph, target_reach(graph, scenarios.select("scenario").union(base), removed))
    told = written(found.groupBy("scenario").agg(F.sum(F.col("weight") * F.col("value")).alias("risk"), F.count("*").alias("n"), F.avg("depth").alias("mean_dist")), "metrics")
    whole = told.where("scenario = -1").select(F.col("risk").alias("risk0"))
    total = graph.entries().agg(F.count("*").alias("ne")).join(graph.targets().agg(F.count("*").alias("nt"))).select((F.col("ne") * F.col("nt")).alias("all"))
    one = total.join(whole, F.lit(True), "left")
    out = scenarios.select("scenario").join(told, "scenario", "left").join(F.broadcast(one))  # one row
    r, r0 = F.coalesce("risk", F.lit(0.0)), F.coalesce("risk0", F.lit(0.0))
    return out.select("scenario", r.alias("risk"), r0.alias("risk0"), F.when(r0 > 0, r / r0).alias("risk_ratio"), F.when(F.col("all") > 0, F.coalesce("n", F.lit(0)) / F.col("all")).alias("reach_pair_frac"), "mean_dist")


def uncuttable(graph: Indexed, sinks: DataFrame) -> DataFrame:
    """node_id of all that reach sinks (node_id) along fixed edges alone."""
    return reach(sinks, graph.edges.where("not deletable"), backward=True).select("node_id")


def relevant(graph: Indexed) -> DataFrame:
    """node_id of nodes on a way from an entry to a target.

    Both directions share the rounds of one loop: 2 id stands for a node as entries reach it, 2 id + 1 for a node as
    targets are reached from it.
    """
    e, zero = graph.edges, F.lit(0).cast("long")
    ways = e.select("edge_id", (F.col("src") * 2).alias("src"), (F.col("dst") * 2).alias("dst")).union(e.select("edge_id", F.col("dst") * 2 + 1, F.col("src") * 2 + 1))
    seed = graph.entries().select((F.col("node_id") * 2).alias("node")).union(graph.targets().select(F.col("node_id") * 2 + 1))
    state = expand(seed.select(zero.alias("scenario"), zero.alias("target"), "node"), ways)
    return state.groupBy(F.shiftright("node", 1).alias("node_id")).agg(F.count("*").alias("n")).where("n = 2").select("node_id")


def scenario_gains(graph: Indexed, candidates: DataFrame) -> DataFrame:
    """(edge_id, gain) of candidates (edge_id): the exact drop in risk if that edge alone is removed.

    Every candidate is a scenario of one batch of rounds, and the independent way to what the dominator kernel
    computes. A scenario's state is what may change in it: with a shortest-path tree to each target, only the nodes
    whose tree path has the candidate can lose the target. Those of them that have another edge out, to a node that
    keeps it, keep it too, and so do, round by round, those before them. The state grows with nodes times their
    distance from a target, not with candidates times nodes.
    """
    picked = written(candidates.select("edge_id").distinct(), "picked")
    reached = target_reach(graph).select("target", "node", "depth")
    there = lambda c, depth: reached.select("target", F.col("node").alias(c), F.col("depth").alias(depth))
    ways = graph.edges.select("edge_id", "src", "dst").join(there("src", "_from"), "src").join(there("dst", "_to"), ["target", "dst"])
    ways = written(ways.select("target", "edge_id", "src", "dst", (F.col("_to") + 1 == F.col("_from")).alias("_near")), "ways")
    tree = ways.where("_near").groupBy("target", "src").agg(F.min(F.struct("edge_id", "dst")).alias("up"))
    tree = written(tree.select("target", F.col("up.dst").alias("src"), F.col("src").alias("dst"), F.col("up.edge_id").alias("edge_id")), "tree")
    scenario = F.col("edge_id").alias("scenario")
    unsure = expand(tree.join(picked, "edge_id", "left_semi").select(scenario, "target", F.col("dst").alias("node")), tree).select("scenario", "target", "node")
    others = unsure.join(ways.withColumnRenamed("src", "node"), ["target", "node"]).where("edge_id <> scenario")
    also = unsure.select("scenario", "target", F.col("node").alias("dst"), F.lit(True).alias("_unsure"))
    others = others.join(also, ["scenario", "target", "dst"], "left").select("scenario", "target", F.col("dst").alias("src"), F.col("node").alias("dst"), "edge_id", F.col("_unsure").isNotNull().alias("_unsure"))
    others = written(others, "others")
    keeping = expand(others.where("not _unsure").select("scenario", "target", F.col("dst").alias("node")), others.where("_unsure"))
    lost = unsure.join(keeping, ["scenario", "target", "node"], "left_anti").withColumn("depth", F.lit(0))
    gain = pairs(graph, lost).groupBy(F.col("scenario").alias("edge_id")).agg(F.sum(F.col("weight") * F.col("value")).alias("gain"))
    return picked.join(gain, "edge_id", "left").select("edge_id", F.coalesce("gain", F.lit(0.0)).alias("gain"))


def hub_scores(graph: Indexed, most: int = 10) -> DataFrame:
    """(node_id, score): the top hubs by entry weight that reaches them times target value that they reach.

    Entries and targets are no hubs; ties go to the smaller id. Two batches of rounds: from the entries forward and
    from the targets backward.
    """
    into = weights_that_reach(graph.entries(), graph.edges).withColumnRenamed("total", "w")
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = weights_that_reach(graph.targets().withColumnRenamed("value", "weight"), back).withColumnRenamed("total", "v")
    plain = graph.nodes.where("entry_weight <= 0 and target_value <= 0").select(F.col("node_id").alias("node"))
    score = into.join(out, "node").join(plain, "node", "left_semi").select(F.col("node").alias("node_id"), (F.col("w") * F.col("v")).alias("score"))
    return score.where("score > 0").orderBy(F.desc("score"), "node_id").limit(most)
