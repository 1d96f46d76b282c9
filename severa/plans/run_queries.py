"""Queries on kernels, reductions, strategies, runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from severa.functions.durable import written
from severa.operators import reach, reduction, report, runs
from severa.plans.derived import sql, table
from severa.plans.graph_queries import BACKWARD, CANDIDATES, graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(statement: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return keep


def pruned(spark, d, **kw):
    return reduction.prune(graph(spark, d, **kw))


@query(sql() + CANDIDATES + " SELECT edge_id, gain FROM gain WHERE gain > 0")
def gr08_gr09_gains_by_dominators(spark, d):
    return runs.gains(runs.packed(pruned(spark, d), "derived")).select("edge_id", "gain")


@query(sql() + CANDIDATES + " SELECT edge_id, gain, cost FROM gain JOIN iedges USING (edge_id) WHERE gain > 0 ORDER BY gain / cost DESC, gain DESC, edge_id LIMIT 1")
def top01_best_edge(spark, d):
    g = pruned(spark, d)
    found = runs.gains(runs.packed(g, "derived")).join(g.edges.select("edge_id", "cost"), "edge_id")
    return found.orderBy(F.desc(F.col("gain") / F.col("cost")), F.desc("gain"), "edge_id").select("edge_id", "gain", "cost").limit(1)


FIXED_SCC = """,
fx AS MATERIALIZED (SELECT src, dst FROM iedges WHERE NOT deletable),
cl AS (WITH RECURSIVE w(a, b) AS (SELECT src, dst FROM fx UNION SELECT w.a, fx.dst FROM w JOIN fx ON w.b = fx.src) SELECT * FROM w)
SELECT x.a AS node_id, min(x.b) AS rep FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1"""


@query(sql(ringed=True) + FIXED_SCC)
def gr12_fixed_components(spark, d):
    return reduction.fixed_components(graph(spark, d, ringed=True))


@query(sql() + """,
o AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS outs FROM iedges GROUP BY src HAVING NOT bool_or(deletable)),
m AS (SELECT src, min(src) OVER (PARTITION BY outs) AS rep, count(*) OVER (PARTITION BY outs) AS n FROM o WHERE src NOT IN (SELECT node_id FROM tgt))
SELECT src AS node_id, rep FROM m WHERE n > 1""")
def gr13_twin_representatives(spark, d):
    return reduction.twins(graph(spark, d))


@query(sql() + """,
rep AS (SELECT node_id, CASE WHEN node LIKE 's%' THEN min(node_id) FILTER (node LIKE 's%') OVER () ELSE node_id END AS rep FROM inodes)
SELECT a.rep AS src, b.rep AS dst, CASE WHEN bool_and(deletable) THEN sum(cost) ELSE 0 END::BIGINT AS cost, bool_and(deletable) AS deletable, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS orig
FROM iedges JOIN rep a ON src = a.node_id JOIN rep b ON dst = b.node_id WHERE a.rep <> b.rep GROUP BY a.rep, b.rep""")
def agg06_gr15_merge_nodes(spark, d):
    """All suppliers as one node."""
    g = graph(spark, d)
    s = g.nodes.where(F.col("label").startswith("s"))
    least = written(s.agg(F.min("node_id").alias("rep")), "rep")
    e = reduction.contract(g, s.select("node_id").join(F.broadcast(least))).edges  # one row
    return e.select("src", "dst", "cost", "deletable", F.array_join(F.transform("orig", lambda x: x.cast("string")), ",").alias("orig"))


@query(sql(ringed=True) + """,
tr AS MATERIALIZED (WITH RECURSIVE w(target, node) AS (SELECT node_id, node_id FROM tgt UNION SELECT w.target, e.src FROM w JOIN iedges e ON e.dst = w.node) SELECT * FROM w)
SELECT coalesce(sum(weight * value), 0) AS risk FROM tr JOIN ent ON tr.node = ent.node_id JOIN tgt ON tr.target = tgt.node_id""")
def gr10_gr14_risk_of_reduced(spark, d):
    """R1 to R4 to the end on the ringed graph; the reduced graph's risk is the whole graph's."""
    return reach.risk(reduction.reduce(graph(spark, d, ringed=True))).select("risk")


@query(sql() + BACKWARD + """,
o AS (SELECT i.edge_id, i.cost FROM iedges i JOIN inodes n ON i.src = n.node_id WHERE n.entry_weight > 0 AND i.dst IN (SELECT node FROM tr))
SELECT 'derived' AS instance, CAST(sum(cost) AS BIGINT) AS value, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS edges FROM o""")
def gr06_gr07_global_cut(spark, d):
    """An order lies on its customer's one edge, of cost 1, and on edges of 3 or more: the cut is the former, of all orders on a way."""
    found = runs.global_cuts(runs.packed(pruned(spark, d), "derived"))
    return found.select("instance", "value", F.array_join(F.transform("edges", lambda x: x.cast("string")), ",").alias("edges"))


@query(sql() + CANDIDATES + """,
lost AS (WITH RECURSIVE w(node) AS (SELECT node_id FROM tgt UNION SELECT e.src FROM w JOIN iedges e ON e.dst = w.node WHERE NOT deletable) SELECT * FROM w)
SELECT count(*) AS still_connected FROM ent WHERE node_id IN (SELECT node FROM lost)""")
def gr07_entries_after_global_cut(spark, d):
    """After the cut only entries that fixed edges connect reach a target."""
    g = pruned(spark, d)
    cut = runs.global_cuts(runs.packed(g, "derived")).select(F.lit(0).cast("long").alias("scenario"), F.explode("edges").alias("edge_id"))
    left = reach.target_reach(g, removed=written(cut, "cut")).select(F.col("node").alias("node_id")).distinct()
    return g.entries().join(left, "node_id", "left_semi").agg(F.count("*").alias("still_connected"))


GREEDY = sql() + CANDIDATES + """,
one AS (SELECT edge_id, gain FROM gain JOIN iedges USING (edge_id) WHERE gain > 0 ORDER BY gain / cost DESC, gain DESC, edge_id LIMIT 1)
SELECT r0.risk - one.gain AS risk FROM r0, one"""


@query(GREEDY)
def alg_a_first_round(spark, d):
    """Greedy with the budget of one edge of cost 1: λ's smallest fraction."""
    return runs.run(runs.packed(pruned(spark, d), "derived"), ("A",), (0.000001,), bound=False).select("risk")


#: Raw results of the shape of FIXTURES.md F5, from order lines: five datasets of two groups, three budgets, five strategies.
def raw_results(spark, d):
    k = F.col("l_orderkey")
    line = table(spark, d, "lineitem").groupBy((k % 5).alias("a"), (F.col("l_linenumber") % 3).alias("b"), (F.col("l_suppkey") % 5).alias("c")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("p"))
    alg = F.element_at(F.array(*[F.lit(x) for x in ("A", "B2", "C", "D", "LB")]), (F.col("c") + 1).cast("int"))
    return line.select(
        F.concat(F.lit("g"), (F.col("a") % 2).cast("string"), F.lit("_s"), F.col("a").cast("string")).alias("dataset"), ((F.col("b") + 1) / 4).alias("budget_frac"), alg.alias("alg"),
        (F.col("n") * 10).alias("n"), F.col("n").alias("red_n"), F.when(alg != "LB", (F.col("n") % 7).cast("string")).otherwise("").alias("cost"), (F.col("b") * 8).alias("budget"),
        F.lit(1024.0).alias("risk0"), (F.col("n") % 64 * 16).cast("double").alias("risk"), (F.col("n") % 64 / 64).alias("risk_ratio"), (F.col("n") % 8 / 8).alias("time"),
        F.when(F.col("n") % 4 != 0, F.col("n") % 16 / 16).alias("reach_pair_frac"), F.when(F.col("n") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("n") % 9).cast("double")).alias("mean_dist"),
        F.when(alg == "C", F.when(F.col("n") % 2 == 0, "optimal").otherwise("feasible")).otherwise("").alias("status"),
    )


RAW = """
WITH base AS (SELECT l_orderkey % 5 AS a, l_linenumber % 3 AS b, l_suppkey % 5 AS c, count(*) AS n FROM lineitem GROUP BY ALL),
raw AS (SELECT 'g' || (a % 2) || '_s' || a AS dataset, (b + 1) / 4.0::DOUBLE AS budget_frac, ['A', 'B2', 'C', 'D', 'LB'][CAST(c AS INT) + 1] AS alg, n * 10 AS n, n AS red_n,
  CASE WHEN c <> 4 THEN n % 7 END AS cost, b * 8 AS budget, 1024.0::DOUBLE AS risk0, (n % 64 * 16)::DOUBLE AS risk, (n % 64) / 64.0::DOUBLE AS risk_ratio, (n % 8) / 8.0::DOUBLE AS time,
  CASE WHEN n % 4 <> 0 THEN (n % 16) / 16.0::DOUBLE END AS reach_pair_frac, CASE WHEN n % 3 <> 0 THEN (n % 9)::DOUBLE END AS mean_dist,
  CASE WHEN c = 2 THEN CASE WHEN n % 2 = 0 THEN 'optimal' ELSE 'feasible' END ELSE '' END AS status FROM base),
gaps AS (
  SELECT r.*, regexp_extract(r.dataset, '^(.*)_s(\\d+)$', 1) AS "group", CAST(regexp_extract(r.dataset, '^(.*)_s(\\d+)$', 2) AS INT) AS seed, cost / nullif(budget, 0)::DOUBLE AS cost_over_budget,
    CASE WHEN r.alg = 'LB' THEN NULL WHEN o.s > 0 THEN (o.s - (risk0 - risk)) / o.s WHEN o.s = 0 THEN 0 END AS gap_opt,
    CASE WHEN r.alg = 'LB' THEN NULL WHEN l.s > 0 THEN (l.s - (risk0 - risk)) / l.s WHEN l.s = 0 THEN 0 END AS gap_lb
  FROM raw r LEFT JOIN (SELECT dataset, budget_frac, risk0 - risk AS s FROM raw WHERE alg = 'C' AND status = 'optimal') o USING (dataset, budget_frac)
  LEFT JOIN (SELECT dataset, budget_frac, risk0 - risk AS s FROM raw WHERE alg = 'LB') l USING (dataset, budget_frac)),
summ AS (
  SELECT "group", budget_frac, alg, avg(risk_ratio) AS risk_ratio_mean, stddev_samp(risk_ratio) AS risk_ratio_std, avg(time) AS time_mean, stddev_samp(time) AS time_std,
    avg(cost_over_budget) AS cost_over_budget_mean, stddev_samp(cost_over_budget) AS cost_over_budget_std, avg(gap_opt) AS gap_opt_mean, stddev_samp(gap_opt) AS gap_opt_std,
    avg(gap_lb) AS gap_lb_mean, stddev_samp(gap_lb) AS gap_lb_std, avg(reach_pair_frac) AS reach_pair_frac_mean, stddev_samp(reach_pair_frac) AS reach_pair_frac_std,
    avg(mean_dist) AS mean_dist_mean, stddev_samp(mean_dist) AS mean_dist_std, count(*) AS runs, avg(n) AS n_mean, avg(red_n) AS red_n_mean FROM gaps GROUP BY ALL)
"""


def _grouped(raw):
    group, seed = runs.name_parts(F.col("dataset"))
    return raw.withColumn("group", group).withColumn("seed", seed)


def _rounded(df):
    return df.select(*[F.round(c, 11).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql_rounded(columns: str, exact: str) -> str:
    return ", ".join(exact.split() + [f"round({c}, 11) AS {c}" for c in columns.split()])


@query(RAW + 'SELECT DISTINCT dataset, "group", seed FROM gaps')
def run02_names(spark, d):
    return _grouped(raw_results(spark, d)).select("dataset", "group", "seed").distinct()


@query(RAW + "SELECT dataset, alg, " + _sql_rounded("budget_frac gap_opt gap_lb", "") + " FROM gaps")
def run03_join01_join02_gaps(spark, d):
    return _rounded(report.with_gaps(raw_results(spark, d)).select("dataset", "alg", "budget_frac", "gap_opt", "gap_lb"))


@query(RAW + "SELECT dataset, alg, " + _sql_rounded("budget_frac cost_over_budget", "") + " FROM gaps")
def run04_cost_over_budget(spark, d):
    return _rounded(report.with_cost_share(raw_results(spark, d)).select("dataset", "alg", "budget_frac", "cost_over_budget"))


STATS = " ".join(f"{m}_{x}" for m in report.METRICS for x in ("mean", "std"))


@query(RAW + 'SELECT "group", alg, runs, ' + _sql_rounded(f"budget_frac {STATS} n_mean red_n_mean", "") + " FROM summ")
def agg02_summary(spark, d):
    return _rounded(report.summary(_grouped(raw_results(spark, d))))


def _sql_pm(c: str, places: int) -> str:
    return f"CASE WHEN {c}_mean IS NULL THEN '–' WHEN {c}_std IS NULL THEN printf('%.{places}f', {c}_mean) ELSE printf('%.{places}f ± %.{places}f', {c}_mean, {c}_std) END"


@query(RAW + f"""SELECT "group", budget_frac, alg, '| ' || budget_frac || ' | ' || alg || ' | ' || {_sql_pm("risk_ratio", 3)} || ' | ' || {_sql_pm("gap_opt", 3)} || ' | ' || {_sql_pm("gap_lb", 3)} || ' | ' || {_sql_pm("time", 2)} || ' | ' || runs || ' |' AS line FROM summ""")
def snk03_top07_markdown(spark, d):
    return report.markdown(report.summary(_grouped(raw_results(spark, d))))


@query(RAW + "SELECT dataset AS instance, " + _sql_rounded("budget_frac", "") + ", alg FROM raw WHERE NOT (alg = 'A' AND budget_frac = 0.25) AND NOT (dataset = 'g0_s0' AND alg = 'D')")
def snk02_runs_left_to_do(spark, d):
    raw = raw_results(spark, d)
    done = raw.where("alg = 'A' and budget_frac = 0.25").union(raw.where("dataset = 'g0_s0' and alg = 'D'"))
    return runs.left_to_do(raw.select(F.col("dataset").alias("instance"), "budget_frac", "alg"), done)


@query(RAW + "SELECT dataset, alg, budget, extra FROM (SELECT dataset, alg, budget, NULL::BIGINT AS extra FROM raw WHERE alg = 'A' UNION ALL SELECT dataset, alg, budget, red_n FROM raw WHERE alg = 'D')")
def set01_concatenated_results(spark, d):
    raw = raw_results(spark, d)
    return report.concatenated(raw.where("alg = 'A'").select("dataset", "alg", "budget"), raw.where("alg = 'D'").select("dataset", "alg", "budget", F.col("red_n").alias("extra")))


@query(RAW + 'SELECT "group", alg, ' + _sql_rounded("budget_frac", "") + ", round(risk_ratio_mean, 11) AS y, round(risk_ratio_std, 11) AS err, round(n_mean, 11) AS n_mean FROM summ")
def snk04_plot_risk(spark, d):
    return _rounded(report.plot_risk(report.summary(_grouped(raw_results(spark, d)))))


@query(RAW + """, h AS (SELECT "group", count(gap_opt_mean) > 0 AS has FROM summ WHERE alg NOT IN ('LB', 'C') GROUP BY "group")
SELECT "group", alg, budget_frac, CASE WHEN has THEN 'gap_opt' ELSE 'gap_lb' END AS metric, round(CASE WHEN has THEN gap_opt_mean ELSE gap_lb_mean END, 11) AS y, round(CASE WHEN has THEN gap_opt_std ELSE gap_lb_std END, 11) AS err
FROM summ JOIN h USING ("group") WHERE alg NOT IN ('LB', 'C')""")
def snk04_plot_gap(spark, d):
    return _rounded(report.plot_gap(report.summary(_grouped(raw_results(spark, d)))))


@query(RAW + 'SELECT alg, "group", round(n_mean, 11) AS n_mean, round(time_mean, 11) AS y, round(coalesce(time_std, 0), 11) AS err FROM summ WHERE budget_frac = 0.5 AND alg <> \'LB\'')
def snk04_plot_time(spark, d):
    return _rounded(report.plot_time(report.summary(_grouped(raw_results(spark, d))), 0.5))


@query(RAW + 'SELECT "group", alg, ' + _sql_rounded("budget_frac", "") + ", round(risk_ratio_mean, 11) AS y, round(risk_ratio_std, 11) AS err, round(n_mean, 11) AS n_mean FROM summ WHERE alg = 'D' AND false")
def snk04_plot_ablation(spark, d):
    """D alone is no ablation: the table is empty."""
    return _rounded(report.plot_ablation(report.summary(_grouped(raw_results(spark, d)))))
