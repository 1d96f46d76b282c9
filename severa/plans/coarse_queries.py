"""Strategies, cuts and bounds on a graph so small that SQL can go through every removal.

Order statuses (entries) -> return flags -> line statuses (targets), from all orders and all their lines: an edge for each
pair that occurs, its cost by how often. One edge is fixed. The statements try all sets of removable edges.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from severa.functions.durable import written
from severa.operators import instance as inst
from severa.operators import runs, strategies
from severa.plans.derived import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
FRACTIONS = (0.25, 0.5, 0.75, 1.0)


def query(statement: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = statement
        return f

    return keep


def instance(spark, d, entries=None) -> inst.Instance:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    pairs = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"))
    a = pairs.select(name("s", "o_orderstatus").alias("src"), name("f", "l_returnflag").alias("dst"), (1 + F.col("n") % 11).alias("cost"), F.lit(True).alias("deletable"))
    b = line.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    fixed = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    b = b.select(name("f", "l_returnflag"), name("t", "l_linestatus"), F.when(~fixed, 1 + F.col("n") % 7), ~fixed)
    edges = written(inst.merged(a.union(b)), "coarse")
    e = orders.groupBy("o_orderstatus").agg((1 + F.count("*") % 5).cast("double").alias("w")).select(name("s", "o_orderstatus").alias("node"), F.col("w").alias("entry_weight"), F.lit(0.0).alias("target_value"))
    e = e if entries is None else e.where(F.col("node").isin(entries))
    t = line.select("l_linestatus").distinct().select(name("t", "l_linestatus"), F.lit(0.0), F.when(F.col("l_linestatus") == "F", 10.0).otherwise(5.0))
    return inst.Instance(inst.all_nodes(edges, e.union(t)), edges, "coarse_s1")


def packed(spark, d):
    return written(runs.packed(inst.indexed(instance(spark, d)), "coarse_s1"), "packed")


#: e: the edges, bit: that of a removable one; m: every removal's cost and risk; lam; b: budgets.
REMOVALS = """
WITH RECURSIVE raw AS (
  SELECT 's' || o_orderstatus AS src, 'f' || l_returnflag AS dst, 1 + count(*) % 11 AS cost, true AS deletable FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
  UNION ALL SELECT 'f' || l_returnflag, 't' || l_linestatus, 1 + count(*) % 7, NOT (l_returnflag = 'N' AND l_linestatus = 'O') FROM lineitem GROUP BY l_returnflag, l_linestatus),
node AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY node) - 1 AS id, node FROM (SELECT src AS node FROM raw UNION SELECT dst FROM raw UNION SELECT 's' || o_orderstatus FROM orders)),
ent AS MATERIALIZED (SELECT 's' || o_orderstatus AS src, CAST(1 + count(*) % 5 AS DOUBLE) AS w FROM orders GROUP BY o_orderstatus),
tgt AS MATERIALIZED (SELECT DISTINCT 't' || l_linestatus AS dst, CASE WHEN l_linestatus = 'F' THEN 10.0 ELSE 5.0 END::DOUBLE AS v FROM lineitem),
e AS MATERIALIZED (
  SELECT src, dst, CASE WHEN deletable THEN cost ELSE 0 END AS cost, deletable, row_number() OVER (ORDER BY a.id, b.id) - 1 AS edge_id,
    CASE WHEN deletable THEN 1::BIGINT << CAST(sum(CASE WHEN deletable THEN 1 ELSE 0 END) OVER (ORDER BY a.id, b.id) - 1 AS INT) ELSE 0 END AS bit
  FROM raw JOIN node a ON src = a.node JOIN node b ON dst = b.node),
path AS MATERIALIZED (SELECT x.src AS s, x.dst AS f, y.dst AS t, w, v, x.bit | y.bit AS need FROM e x JOIN e y ON x.dst = y.src JOIN ent ON ent.src = x.src JOIN tgt ON tgt.dst = y.dst),
mask AS MATERIALIZED (SELECT unnest(range(0, (SELECT 1::BIGINT << CAST(count(*) AS INT) FROM e WHERE deletable))) AS mask),
price AS MATERIALIZED (SELECT mask, CAST(coalesce(sum(cost) FILTER (mask & bit > 0), 0) AS BIGINT) AS cost FROM mask, e GROUP BY mask),
m AS MATERIALIZED (
  SELECT price.mask, price.cost, coalesce(r.risk, 0) AS risk, coalesce(r.n, 0) AS n FROM price LEFT JOIN (
    SELECT mask, sum(w * v) AS risk, count(*) AS n FROM (SELECT DISTINCT mask, s, t, w, v FROM mask JOIN path ON mask & need = 0) GROUP BY mask) r ON price.mask = r.mask),
r0 AS (SELECT risk AS risk0 FROM m WHERE mask = 0),
lam AS (SELECT min(cost) AS lam FROM m WHERE risk = 0),
b AS MATERIALIZED (SELECT frac AS budget_frac, CAST(greatest(1, floor(frac * lam)) AS BIGINT) AS budget FROM lam, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS frac)),
best AS MATERIALIZED (SELECT budget_frac, min(risk) AS optimum FROM b JOIN m ON cost <= budget GROUP BY budget_frac)"""

#: From a removal `seed` (budget_frac, mask): the best single edge again and again.
GREEDY = """,
g(budget_frac, mask) AS (
  SELECT budget_frac, mask FROM seed
  UNION ALL
  SELECT budget_frac, mask FROM (
    SELECT g.budget_frac, now.mask | e.bit AS mask, row_number() OVER (PARTITION BY g.budget_frac ORDER BY (now.risk - after.risk) / e.cost DESC, now.risk - after.risk DESC, edge_id) AS place
    FROM g JOIN b ON b.budget_frac = g.budget_frac JOIN m now ON now.mask = g.mask JOIN e ON e.deletable AND now.mask & e.bit = 0 AND now.cost + e.cost <= b.budget
    JOIN m after ON after.mask = now.mask | e.bit WHERE after.risk < now.risk) WHERE place = 1),
done AS (SELECT budget_frac, max(cost) AS cost, min(risk) AS risk, min(n) AS n FROM g JOIN m USING (mask) GROUP BY budget_frac)"""
SEED_A = ", seed AS (SELECT budget_frac, 0::BIGINT AS mask FROM b)"
#: Each target's cheapest cut, of equals that nearest to the entries; taken in order of what it protects by its cost.
SEED_B2 = """,
apart AS (
  SELECT t, v, c.mask, c.cost, (SELECT count(DISTINCT dst) FROM e x WHERE src LIKE 's%' AND x.bit & c.mask = 0) AS beyond
  FROM tgt JOIN (SELECT DISTINCT t FROM path) p ON p.t = tgt.dst CROSS JOIN price c WHERE NOT EXISTS (SELECT 1 FROM path q WHERE q.t = p.t AND q.need & c.mask = 0)),
cut AS (SELECT t, arg_min(mask, cost * 100 + beyond) AS mask, min(cost) AS cost, any_value(v) * (SELECT sum(w) FROM (SELECT DISTINCT s, w FROM path q WHERE q.t = apart.t)) AS worth FROM apart GROUP BY t),
ordered AS (SELECT *, row_number() OVER (ORDER BY worth / cost DESC, worth DESC, t) AS k FROM cut),
first_cut AS (SELECT budget_frac, budget, CASE WHEN cost <= budget THEN mask ELSE 0 END AS mask FROM b, ordered WHERE k = 1),
seed AS (
  SELECT budget_frac, CASE WHEN o.mask IS NOT NULL AND both_.cost <= budget THEN both_.mask ELSE f.mask END AS mask
  FROM first_cut f LEFT JOIN ordered o ON o.k = 2 LEFT JOIN price both_ ON both_.mask = f.mask | o.mask)"""


def _told(spark, d, alg, bound=False):
    return runs.run(packed(spark, d), (alg,) if alg else (), FRACTIONS, bound=bound)


@query(REMOVALS + SEED_A + GREEDY + " SELECT budget_frac, budget, cost, risk FROM done JOIN b USING (budget_frac)")
def alg_a_greedy(spark, d):
    """Every round of the greedy, to its end."""
    return _told(spark, d, "A").select("budget_frac", "budget", "cost", "risk")


@query(REMOVALS + " SELECT budget_frac, budget, CASE WHEN lam <= budget THEN lam ELSE 0 END AS cost, CASE WHEN lam <= budget THEN 0.0::DOUBLE ELSE risk0 END AS risk FROM b, lam, r0")
def alg_b1_global_cut(spark, d):
    return _told(spark, d, "B1").select("budget_frac", "budget", "cost", "risk")


@query(REMOVALS + SEED_B2 + GREEDY + " SELECT budget_frac, budget, cost, risk FROM done JOIN b USING (budget_frac)")
def alg_b2_top03_target_cuts(spark, d):
    return _told(spark, d, "B2").select("budget_frac", "budget", "cost", "risk")


@query(REMOVALS + " SELECT budget_frac, budget, optimum AS risk, 'optimal' AS status FROM b JOIN best USING (budget_frac)")
def alg_c_exact(spark, d):
    return _told(spark, d, "C").select("budget_frac", "budget", "risk", "status")


ABLATIONS = ("D", "D-noreduce", "D-nohub", "D-noLP", "D-noLS", "D-ratio")


ONE_ENTRY = REMOVALS.replace("FROM orders GROUP BY o_orderstatus),\ntgt", "FROM orders GROUP BY o_orderstatus HAVING o_orderstatus = 'P'),\ntgt")


@query(ONE_ENTRY + " SELECT budget_frac, budget, optimum AS risk, 'optimal' AS status FROM b JOIN best USING (budget_frac)")
def alg_f_subsets_of_one_entry(spark, d):
    """One entry: the sets of targets that the budget reaches."""
    rows = written(runs.packed(inst.indexed(instance(spark, d, ["sP"])), "coarse_s1"), "packed")
    return runs.run(rows, ("F",), FRACTIONS, bound=False).select("budget_frac", "budget", "risk", "status")


#: A region is cut off as a whole, or any of its nations are: the best gain by cost, region by region.
TREE = """
WITH RECURSIVE nat AS MATERIALIZED (
  SELECT n_nationkey AS n, n_regionkey AS r, 1 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) % 5 AS cost, (1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) % 7)::DOUBLE AS v FROM nation),
reg AS MATERIALIZED (SELECT r, 3 + sum(cost) % 7 AS cost, sum(v) AS v, sum(cost) AS all_cost, row_number() OVER (ORDER BY r) AS k FROM nat GROUP BY r),
sub(r, n, cost, gain) AS (
  SELECT r, -1, 0::HUGEINT, 0.0::DOUBLE FROM reg
  UNION ALL SELECT s.r, nat.n, s.cost + nat.cost, s.gain + nat.v FROM sub s JOIN nat ON nat.r = s.r AND nat.n > s.n),
options AS MATERIALIZED (SELECT r, cost, max(gain) AS gain FROM (SELECT r, cost, gain FROM sub UNION ALL SELECT r, cost, v FROM reg) GROUP BY r, cost),
lam AS (SELECT sum(least(cost, all_cost)) AS lam, sum(v) AS risk0 FROM reg),
b AS MATERIALIZED (SELECT frac AS budget_frac, CAST(greatest(1, floor(frac * lam)) AS BIGINT) AS budget, risk0 FROM lam, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS frac)),
spent(k, cost, gain) AS (
  SELECT 0::BIGINT, 0::HUGEINT, 0.0::DOUBLE
  UNION ALL SELECT reg.k, s.cost + o.cost, max(s.gain + o.gain) FROM spent s JOIN reg ON reg.k = s.k + 1 JOIN options o ON o.r = reg.r GROUP BY reg.k, s.cost + o.cost)
SELECT budget_frac, budget, risk0 - max(gain) AS risk, 'optimal' AS status FROM b JOIN spent ON cost <= budget WHERE k = (SELECT count(*) FROM reg) GROUP BY budget_frac, budget, risk0"""


@query(TREE)
def alg_e_tree(spark, d):
    """One entry -> regions -> nations, the targets: a tree."""
    count = lambda t, by, base: F.coalesce(F.col(t), F.lit(0)) % by + base
    many = lambda t, c: table(spark, d, t).groupBy(F.col(c).alias("n_nationkey")).agg(F.count("*").alias(t))
    nat = table(spark, d, "nation").join(many("supplier", "s_nationkey"), "n_nationkey", "left").join(many("customer", "c_nationkey"), "n_nationkey", "left")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nat = written(nat.select(name("n", "n_nationkey").alias("n"), name("r", "n_regionkey").alias("r"), count("supplier", 5, 1).alias("cost"), count("customer", 7, 1).cast("double").alias("v")), "nations")
    edges = nat.groupBy("r").agg((F.sum("cost") % 7 + 3).alias("cost")).select(F.lit("root").alias("src"), F.col("r").alias("dst"), "cost", F.lit(True).alias("deletable"))
    edges = written(inst.merged(edges.union(nat.select("r", "n", "cost", F.lit(True)))), "tree")
    ends = spark.createDataFrame([("root", 1.0, 0.0)], "node string, entry_weight double, target_value double").union(nat.select("n", F.lit(0.0), "v"))
    rows = written(runs.packed(inst.indexed(inst.Instance(inst.all_nodes(edges, ends), edges, "tree_s1")), "tree_s1"), "packed")
    return runs.run(rows, ("E",), FRACTIONS, bound=False).select("budget_frac", "budget", "risk", "status")


@query(REMOVALS + f" SELECT alg, budget_frac, budget, optimum, true AS holds FROM b JOIN best USING (budget_frac), (SELECT unnest({list(ABLATIONS)!r}) AS alg)")
def alg_d_gr17_ablations(spark, d):
    """Hub-cut and its ablations keep to the budget and stay between the optimum, found by C, and the risk without removals."""
    told = written(runs.run(packed(spark, d), (*ABLATIONS, "C"), FRACTIONS, bound=False), "runs")
    best = told.where("alg = 'C'").select("budget_frac", F.col("risk").alias("optimum"))
    holds = (F.col("cost") <= F.col("budget")) & (F.col("risk") >= F.col("optimum") - 1e-9) & (F.col("risk") <= F.col("risk0") + 1e-9)
    return told.where("alg <> 'C'").join(best, "budget_frac").select("alg", "budget_frac", "budget", "optimum", holds.alias("holds"))


@query(REMOVALS + " SELECT budget_frac, budget, risk0, optimum, true AS holds FROM b JOIN best USING (budget_frac), r0")
def bnd01_lp_bound(spark, d):
    """The bound is at most the optimum."""
    told = written(runs.run(packed(spark, d), ("C",), FRACTIONS), "runs")
    best = told.where("alg = 'C'").select("budget_frac", F.col("risk").alias("optimum"))
    return told.where("alg = 'LB'").join(best, "budget_frac").select("budget_frac", "budget", "risk0", "optimum", (F.col("risk") <= F.col("optimum") + 1e-6).alias("holds"))


@query(REMOVALS + " SELECT lam AS value, true AS separates FROM lam")
def gr06_gr07_global_cut_of_all(spark, d):
    """The cheapest removal that leaves no pair, and whether the edges that the flow names are one."""
    rows = packed(spark, d)
    found = written(runs.global_cuts(rows), "cut")
    gone = found.select(F.explode("edges").alias("id"), F.lit(True).alias("gone"))
    left = rows.where("kind = 'n'").unionByName(rows.where("kind = 'e'").join(gone, "id", "left").where("gone is null").drop("gone"))
    return found.select("value").join(runs.prepared(written(left, "left")).agg(F.count("*").alias("n"))).select("value", (F.col("n") == 0).alias("separates"))


def _sql_cuts(edges: str) -> str:
    return f"(SELECT string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) FROM e WHERE bit & {edges} > 0)"


@query(REMOVALS + SEED_B2 + f" SELECT DISTINCT {_sql_cuts('cut.mask')} AS edges FROM cut")
def agg07_distinct_offers(spark, d):
    """The cuts that hub-cut is offered on the whole budget, without its hubs: each set of edges once."""
    g = packed(spark, d)
    net, ids = runs._net(g.toPandas())  # a dozen edges
    offers = strategies.cut_offers(net, net.whole(), int(net.cost.sum()), float("inf"), {}, most_hubs=0)
    return spark.createDataFrame([(",".join(map(str, sorted(ids[c].tolist()))),) for c in offers], "edges string")


@query(REMOVALS + SEED_B2 + GREEDY + """,
a AS (SELECT budget_frac, 'B2' AS alg, cost, risk, n FROM done UNION ALL SELECT budget_frac, 'B1', CASE WHEN lam <= budget THEN lam ELSE 0 END, CASE WHEN lam <= budget THEN 0 ELSE risk0 END, CASE WHEN lam <= budget THEN 0 ELSE (SELECT n FROM m WHERE mask = 0) END FROM b, lam, r0)
SELECT 'coarse_s1' AS dataset, 'coarse' AS "group", 1 AS seed, (SELECT count(*) FROM node) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e WHERE deletable) AS m_deletable,
  (SELECT count(*) FROM ent) AS n_entries, (SELECT count(*) FROM tgt) AS n_targets, lam::DOUBLE AS lambda, budget_frac, budget, alg, a.cost, risk0, risk, risk / risk0 AS risk_ratio,
  a.n / ((SELECT count(*) FROM ent) * (SELECT count(*) FROM tgt)) AS reach_pair_frac, CASE WHEN a.n > 0 THEN 2.0 END::DOUBLE AS mean_dist
FROM a JOIN b USING (budget_frac), lam, r0""")
def run01_batch(spark, d):
    told = runs.run(packed(spark, d), ("B1", "B2"), FRACTIONS, bound=False)
    return told.drop("time", "red_time", "red_n", "red_m", "removed", "status")


@query(REMOVALS + " SELECT alg, budget_frac FROM b, (SELECT unnest(['A', 'B1']) AS alg) WHERE alg = 'B1' OR budget_frac > 0.5")
def snk02_rows_of_a_run_that_was_killed(spark, d):
    """Rows are kept one by one; the next run finds what is left to do."""
    from severa.functions.durable import fresh_folder

    rows, folder = packed(spark, d), fresh_folder(spark, "kept")
    runs.run(rows, ("A",), FRACTIONS[:2], bound=False, keep=folder).write.format("noop").mode("overwrite").save()
    return runs.run(rows, ("A", "B1"), FRACTIONS, bound=False, done=runs.finished(spark, folder)).select("alg", "budget_frac")
