"""Queries on the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.functions.durable import written
from severa.operators import instance as inst
from severa.operators import reach, reduction
from severa.plans import derived
from severa.plans.derived import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(statement: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return keep


def graph(spark: SparkSession, d: str, **kw) -> inst.Indexed:
    return inst.indexed(derived.instance(spark, d, **kw))


#: Removed edges of the what-if queries: every order edge whose id is 0 modulo 3, in scenario 1; modulo 5, in scenario 2.
def removed(g: inst.Indexed) -> DataFrame:
    e = g.edges.where("deletable")
    one = lambda k, n: e.where(F.col("edge_id") % n == 0).select(F.lit(k).cast("long").alias("scenario"), "edge_id")
    return one(1, 3).union(one(2, 5))


def scenarios(g: inst.Indexed) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(0,), (1,), (2,)], "scenario long")


REMOVED = """,
rem AS MATERIALIZED (
  SELECT 1::BIGINT AS scenario, edge_id FROM iedges WHERE deletable AND edge_id % 3 = 0 UNION ALL SELECT 2, edge_id FROM iedges WHERE deletable AND edge_id % 5 = 0),
scen AS (SELECT unnest([0, 1, 2])::BIGINT AS scenario)"""
BACKWARD = """,
tr AS MATERIALIZED (WITH RECURSIVE w(target, node) AS (
  SELECT node_id, node_id FROM tgt UNION SELECT w.target, e.src FROM w JOIN iedges e ON e.dst = w.node) SELECT * FROM w)"""
FORWARD = """,
fw AS MATERIALIZED (WITH RECURSIVE w(node) AS (SELECT node_id FROM ent UNION SELECT e.dst FROM w JOIN iedges e ON e.src = w.node) SELECT * FROM w)"""
SCENARIO_REACH = """,
sr AS MATERIALIZED (WITH RECURSIVE w(scenario, target, node) AS (
  SELECT scenario, node_id, node_id FROM scen, tgt
  UNION SELECT w.scenario, w.target, e.src FROM w JOIN iedges e ON e.dst = w.node
  WHERE NOT EXISTS (SELECT 1 FROM rem r WHERE r.scenario = w.scenario AND r.edge_id = e.edge_id)) SELECT * FROM w)"""


@query(sql() + "SELECT src, dst, cost, deletable, multiplicity FROM medges")
def agg03_merge_parallel_edges(spark, d):
    return inst.merged(derived.raw_edges(spark, d))


@query(sql() + "SELECT node, entry_weight, target_value FROM nodes")
def src02_nodes_of_edges_and_annotations(spark, d):
    return derived.instance(spark, d).nodes


@query(sql() + "SELECT node_id, node AS label, entry_weight, target_value FROM inodes")
def prj01_dense_node_ids(spark, d):
    return graph(spark, d).nodes.drop("members")


@query(sql() + "SELECT edge_id, src, dst, cost, deletable FROM iedges")
def prj01_dense_edge_ids(spark, d):
    return graph(spark, d).edges.drop("orig")


@query(sql() + REMOVED + " SELECT edge_id, src, dst, cost FROM iedges ANTI JOIN (SELECT * FROM rem WHERE scenario = 1) r USING (edge_id)")
def prj02_alive_edges(spark, d):
    g = graph(spark, d)
    return inst.alive(g.edges, removed(g).where("scenario = 1")).select("edge_id", "src", "dst", "cost")


@query(sql() + " SELECT edge_id, dst AS src, src AS dst, cost, deletable FROM iedges")
def prj03_reversed_edges(spark, d):
    return inst.reversed_edges(graph(spark, d).edges)


@query(sql() + REMOVED + " SELECT CAST(sum(cost) AS BIGINT) AS cost FROM iedges JOIN rem USING (edge_id) WHERE scenario = 1")
def prj04_cost_of_removed(spark, d):
    g = graph(spark, d)
    return inst.cost_of(g.edges, removed(g).where("scenario = 1"))


@query(sql() + BACKWARD + FORWARD + """
SELECT edge_id, src, dst, cost, deletable FROM iedges
WHERE src IN (SELECT node FROM fw) AND dst IN (SELECT node FROM fw) AND src IN (SELECT node FROM tr) AND dst IN (SELECT node FROM tr)""")
def prj05_relevant_edges(spark, d):
    g = graph(spark, d)
    keep = written(reach.relevant(g), "relevant")
    e = g.edges.drop("orig")
    return e.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


@query(sql() + " SELECT edge_id, src, dst FROM iedges WHERE NOT deletable")
def prj06_fixed_edges(spark, d):
    return graph(spark, d).edges.where("not deletable").select("edge_id", "src", "dst")


@query(sql() + REMOVED + """
SELECT edge_id, (edge_id % 7)::DOUBLE AS gain, cost FROM iedges
WHERE deletable AND edge_id % 7 > 0 AND cost <= 2 AND edge_id NOT IN (SELECT edge_id FROM rem WHERE scenario = 1)""")
def prj07_affordable_edges(spark, d):
    g = graph(spark, d)
    gains = g.edges.select("edge_id", (F.col("edge_id") % 7).cast("double").alias("gain"))
    return inst.affordable(gains, g.edges, removed(g).where("scenario = 1"), 2)


BAD = """,
bn AS (SELECT node, entry_weight, CASE WHEN node = 'c1' OR node LIKE 'n%' THEN 3.0 ELSE target_value END AS target_value FROM nodes),
be AS (SELECT src, dst, CASE WHEN src LIKE 'o%1' THEN 0 ELSE cost END AS cost, deletable FROM medges UNION ALL SELECT 'zz', 'zz', 1, true)
SELECT 'entry is a target' AS rule, node AS subject FROM bn WHERE entry_weight > 0 AND target_value > 0
UNION ALL SELECT 'cost is no positive integer', src || '->' || dst FROM be WHERE deletable AND coalesce(cost, 0) <= 0
UNION ALL SELECT 'self-loop', 'zz->zz' UNION ALL SELECT 'edge end is no node', 'zz'"""


@query(sql() + BAD)
def val01_violations(spark, d):
    i = derived.instance(spark, d)
    value = F.when((F.col("node") == "c1") | F.col("node").startswith("n"), 3.0).otherwise(F.col("target_value"))
    nodes = i.nodes.withColumn("target_value", value)
    edges = i.edges.select("src", "dst", F.when(F.col("src").rlike("^o.*1$"), F.lit(0)).otherwise(F.col("cost")).cast("long").alias("cost"), "deletable")
    loop = spark.createDataFrame([("zz", "zz", 1, True)], "src string, dst string, cost long, deletable boolean")
    return inst.violations(inst.Instance(nodes, edges.union(loop)))


@query(sql() + " SELECT edge_id, s.node AS src_label, t.node AS dst_label FROM iedges e JOIN inodes s ON e.src = s.node_id JOIN inodes t ON e.dst = t.node_id")
def join03_labels_of_edges(spark, d):
    g = graph(spark, d)
    s = g.nodes.select(F.col("node_id").alias("src"), F.col("label").alias("src_label"))
    t = g.nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label"))
    return g.edges.join(s, "src").join(t, "dst").select("edge_id", "src_label", "dst_label")


@query(sql() + BACKWARD + " SELECT node_id, weight FROM ent WHERE node_id IN (SELECT node FROM tr)")
def join04_entries_that_reach(spark, d):
    g = graph(spark, d)
    return g.entries().join(reach.target_reach(g).select(F.col("node").alias("node_id")), "node_id", "left_semi")


@query(sql() + REMOVED + " SELECT edge_id, cost FROM iedges WHERE deletable AND edge_id NOT IN (SELECT edge_id FROM rem)")
def join05_edges_never_removed(spark, d):
    g = graph(spark, d)
    return g.edges.where("deletable").join(removed(g), "edge_id", "left_anti").select("edge_id", "cost")


@query(sql() + " SELECT (SELECT count(*) FROM ent) * (SELECT count(*) FROM tgt) AS pairs")
def join06_entry_target_pairs(spark, d):
    g = graph(spark, d)
    return g.entries().agg(F.count("*").alias("a")).join(g.targets().agg(F.count("*").alias("b"))).select((F.col("a") * F.col("b")).alias("pairs"))


@query(sql() + BACKWARD + " SELECT coalesce(sum(weight * value), 0) AS risk FROM tr JOIN ent ON tr.node = ent.node_id JOIN tgt ON tr.target = tgt.node_id")
def agg01_residual_risk(spark, d):
    return reach.risk(graph(spark, d)).select("risk")


@query(sql() + BACKWARD + FORWARD + """,
inward AS (WITH RECURSIVE w(entry, node) AS (SELECT node_id, node_id FROM ent UNION SELECT w.entry, e.dst FROM w JOIN iedges e ON e.src = w.node) SELECT node, sum(weight) AS w FROM w JOIN ent ON entry = node_id GROUP BY node),
outof AS (SELECT node, sum(value) AS v FROM tr JOIN tgt ON target = node_id GROUP BY node)
SELECT node_id, w * v AS score FROM inward JOIN outof USING (node) JOIN inodes ON node = node_id WHERE entry_weight = 0 AND target_value = 0 AND w * v > 0 ORDER BY score DESC, node_id LIMIT 10""")
def agg05_top02_hub_scores(spark, d):
    return reach.hub_scores(graph(spark, d))


@query(sql(cyclic=True) + FORWARD + " SELECT node AS node_id FROM fw")
def gr01_reach_from_entries(spark, d):
    g = graph(spark, d, cyclic=True)
    return reach.reach(g.entries(), g.edges).select("node_id")


@query(sql(cyclic=True) + BACKWARD + " SELECT target, node FROM tr")
def gr02_target_reach(spark, d):
    return reach.target_reach(graph(spark, d, cyclic=True)).select("target", "node")


@query(sql() + BACKWARD + """
SELECT t.node_id AS target, inodes.node AS label, value, sum(weight) AS reach_weight, sum(weight * value) AS risk
FROM tr JOIN ent ON tr.node = ent.node_id JOIN tgt t ON tr.target = t.node_id JOIN inodes ON inodes.node_id = t.node_id GROUP BY ALL""")
def gr03_risk_by_target(spark, d):
    g = graph(spark, d)
    keep = written(reach.relevant(g), "relevant")
    e = g.edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    small = inst.Indexed(g.nodes.join(keep, "node_id", "left_semi"), written(e, "edges"))
    told = reach.risk_by_target(small)
    return told.join(g.nodes.select(F.col("node_id").alias("target"), "label"), "target").select("target", "label", "value", "reach_weight", "risk")


DISTANCES = """,
sd AS MATERIALIZED (WITH RECURSIVE w(scenario, target, node, depth) AS (
  SELECT scenario, node_id, node_id, 0 FROM scen, tgt
  UNION SELECT w.scenario, w.target, e.src, w.depth + 1 FROM w JOIN iedges e ON e.dst = w.node
  WHERE NOT EXISTS (SELECT 1 FROM rem r WHERE r.scenario = w.scenario AND r.edge_id = e.edge_id)) SELECT scenario, target, node, min(depth) AS depth FROM w GROUP BY ALL),
mp AS (SELECT scenario, sum(weight * value) AS risk, count(*) AS n, avg(depth) AS mean_dist FROM sd JOIN ent ON sd.node = ent.node_id JOIN tgt ON sd.target = tgt.node_id GROUP BY scenario)
SELECT scen.scenario, coalesce(risk, 0) AS risk, r0.risk AS risk0, coalesce(mp.risk, 0) / r0.risk AS risk_ratio,
       coalesce(n, 0) / ((SELECT count(*) FROM ent) * (SELECT count(*) FROM tgt)) AS reach_pair_frac, mean_dist
FROM scen LEFT JOIN mp USING (scenario) CROSS JOIN (SELECT risk FROM mp WHERE scenario = 0) r0"""


@query((sql() + REMOVED + DISTANCES).replace("coalesce(risk, 0) AS risk,", "coalesce(mp.risk, 0) AS risk,"))
def gr04_agg08_metrics(spark, d):
    g = graph(spark, d)
    return reach.metrics(g, scenarios(g), removed(g))


@query(sql(cyclic=True) + REMOVED + SCENARIO_REACH + """
SELECT scen.scenario, coalesce(sum(weight * value), 0) AS risk FROM scen LEFT JOIN (SELECT * FROM sr JOIN ent ON sr.node = ent.node_id JOIN tgt ON sr.target = tgt.node_id) x USING (scenario) GROUP BY scen.scenario""")
def gr03_what_if_risk(spark, d):
    g = graph(spark, d, cyclic=True)
    return reach.risk(g, scenarios(g), removed(g))


@query(sql() + """,
w AS (WITH RECURSIVE w(node) AS (SELECT node_id FROM tgt UNION SELECT e.src FROM w JOIN iedges e ON e.dst = w.node WHERE NOT deletable) SELECT * FROM w)
SELECT node AS node_id FROM w""")
def gr05_uncuttable(spark, d):
    g = graph(spark, d)
    return reach.uncuttable(g, g.targets())


@query(sql(cyclic=True) + BACKWARD + FORWARD + " SELECT node AS node_id FROM fw WHERE node IN (SELECT node FROM tr)")
def gr11_set05_relevant_nodes(spark, d):
    return reach.relevant(graph(spark, d, cyclic=True))


CANDIDATES = BACKWARD + FORWARD + """,
cand AS MATERIALIZED (SELECT edge_id FROM iedges WHERE deletable AND src IN (SELECT node FROM fw) AND dst IN (SELECT node FROM tr)),
gr AS MATERIALIZED (WITH RECURSIVE w(cand, target, node) AS (
  SELECT edge_id, node_id, node_id FROM cand, tgt UNION SELECT w.cand, w.target, e.src FROM w JOIN iedges e ON e.dst = w.node WHERE e.edge_id <> w.cand) SELECT * FROM w),
after AS (SELECT cand, sum(weight * value) AS risk FROM gr JOIN ent ON gr.node = ent.node_id JOIN tgt ON gr.target = tgt.node_id GROUP BY cand),
r0 AS (SELECT sum(weight * value) AS risk FROM tr JOIN ent ON tr.node = ent.node_id JOIN tgt ON tr.target = tgt.node_id),
gain AS (SELECT edge_id, r0.risk - coalesce(after.risk, 0) AS gain FROM cand CROSS JOIN r0 LEFT JOIN after ON cand = edge_id)"""


@query(sql() + CANDIDATES + " SELECT edge_id, gain FROM gain")
def gr09_gains_by_scenarios(spark, d):
    g = reduction.prune(graph(spark, d))
    return reach.scenario_gains(g, g.edges.where("deletable").select("edge_id"))


@query(" UNION ".join(["SELECT DISTINCT * FROM (" + sql() + " SELECT edge_id FROM iedges WHERE deletable AND edge_id % 3 = 0)", "SELECT DISTINCT * FROM (" + sql() + " SELECT edge_id FROM iedges WHERE deletable AND edge_id % 5 = 0)"]))
def set02_union_of_edge_sets(spark, d):
    r = removed(graph(spark, d))
    return r.where("scenario = 1").select("edge_id").union(r.where("scenario = 2").select("edge_id")).distinct()


@query(sql() + REMOVED + " SELECT edge_id, cost FROM iedges WHERE edge_id IN (SELECT edge_id FROM rem WHERE scenario = 1) AND edge_id NOT IN (SELECT edge_id FROM rem WHERE scenario = 2)")
def set03_difference_of_edge_sets(spark, d):
    g = graph(spark, d)
    r = removed(g)
    more = r.where("scenario = 1").select("edge_id").exceptAll(r.where("scenario = 2").select("edge_id"))
    return g.edges.select("edge_id", "cost").join(more, "edge_id", "left_semi")


@query(sql() + " SELECT node_id FROM ent INTERSECT SELECT node_id FROM tgt")
def set04_entries_that_are_targets(spark, d):
    g = graph(spark, d)
    return g.entries().select("node_id").intersect(g.targets().select("node_id"))


@query(sql() + " SELECT string_agg(src, ',' ORDER BY src) AS twins, outs FROM (SELECT src, string_agg(dst, ',' ORDER BY dst) AS outs FROM medges GROUP BY src HAVING NOT bool_or(deletable)) GROUP BY outs HAVING count(*) > 1")
def set06_gr13_twins(spark, d):
    outs = derived.instance(spark, d).edges.groupBy("src").agg(F.bool_or("deletable").alias("any"), F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("outs")).where("not any")
    return outs.groupBy("outs").agg(F.sort_array(F.collect_set("src")).alias("t")).where("size(t) > 1").select(F.array_join("t", ",").alias("twins"), "outs")


@query(sql() + """,
rep AS (SELECT node_id, CASE WHEN node LIKE 's%' THEN min(node_id) FILTER (node LIKE 's%') OVER () ELSE node_id END AS rep FROM inodes),
merged AS (SELECT min(edge_id) AS first, list(edge_id) AS all_ids FROM iedges JOIN rep a ON src = a.node_id JOIN rep b ON dst = b.node_id WHERE a.rep <> b.rep GROUP BY a.rep, b.rep)
SELECT DISTINCT unnest(all_ids) AS edge_id FROM merged WHERE first % 11 = 0""")
def gr16_original_edges_of_merged(spark, d):
    """All suppliers as one node; the original edges of merged edges."""
    g = graph(spark, d)
    s = g.nodes.where(F.col("label").startswith("s"))
    least = written(s.agg(F.min("node_id").alias("rep")), "rep")
    small = reduction.contract(g, s.select("node_id").join(F.broadcast(least)))  # one row
    return reduction.original_edges(small, small.edges.where(F.col("edge_id") % 11 == 0))
