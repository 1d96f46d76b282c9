"""Batches of instances, budgets and strategies, run side by side as grouped maps."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.functions.durable import written
from severa.operators import kernels, strategies
from severa.operators.instance import Indexed
from severa.operators.kernels import Net

#: A graph as rows of one table: nodes (kind n: a is the id) and edges (kind e: a -> b, id the edge's).
PACKED = "instance string, kind string, id long, a long, b long, cost long, free boolean, w double, v double"
FRACTIONS = (0.05, 0.1, 0.25, 0.5, 0.75)
#: C is skipped for reduced graphs of more nodes.
EXACT_NODES = 3000


def packed(graph: Indexed, name: str) -> DataFrame:
    """graph as rows of PACKED. A kernel holds one instance whole, so this is the place of reduced graphs."""
    none = lambda t: F.lit(None).cast(t)
    nodes = graph.nodes.select(F.lit(name).alias("instance"), F.lit("n").alias("kind"), F.col("node_id").alias("id"), F.col("node_id").alias("a"), none("long").alias("b"), none("long").alias("cost"), none("boolean").alias("free"), F.col("entry_weight").alias("w"), F.col("target_value").alias("v"))
    edges = graph.edges.select(F.lit(name), F.lit("e"), F.col("edge_id"), F.col("src"), F.col("dst"), F.col("cost"), F.col("deletable"), none("double"), none("double"))
    return nodes.union(edges)


def _net(rows: pd.DataFrame) -> tuple[Net, np.ndarray]:
    """The net of an instance's rows, and the edge ids by its edges. Node ids may have gaps."""
    n = rows[rows.kind == "n"].sort_values("id")
    e = rows[rows.kind == "e"].sort_values("id")
    ids = n.id.to_numpy(np.int64)
    at = lambda c: np.searchsorted(ids, e[c].to_numpy(np.int64))
    return Net.of(len(ids), at("a"), at("b"), e.cost.fillna(0).to_numpy(np.int64), e.free.to_numpy(bool), n.w.to_numpy(float), n.v.to_numpy(float)), e.id.to_numpy(np.int64)


def _distances(net: Net, there: np.ndarray) -> tuple[int, float]:
    """(entry-target pairs that are connected, the sum of their distances in edges)."""
    back = kernels.backward(net, there)
    pairs, total = 0, 0.0
    for t in net.targets():
        depth = np.full(net.n, -1)
        depth[t], front, d = 0, np.array([t]), 0
        while len(front):
            d += 1
            met = np.unique(np.concatenate([back.next[back.at[u] : back.at[u + 1]] for u in front]))
            front = met[depth[met] < 0]
            depth[front] = d
        got = depth[net.entries()]
        pairs += int((got >= 0).sum())
        total += float(got[got >= 0].sum())
    return pairs, total


def gains(packed_rows: DataFrame) -> DataFrame:
    """(instance, edge_id, gain) of every removable edge with a gain, from dominator trees: a group per instance and target.

    Each target's tree is a task of its own; gains add over targets.
    """
    targets = packed_rows.where("kind = 'n' and v > 0").select("instance", F.col("id").alias("target"))
    # a target's task needs the whole instance: rows are sent once per target
    sent = packed_rows.join(targets, "instance").withColumn("v", F.when(F.col("id") == F.col("target"), F.col("v")).otherwise(F.when(F.col("kind") == "n", F.lit(0.0))))

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        net, ids = _net(rows)
        gain = kernels.gains(net)
        some = np.flatnonzero(gain > 0)
        return pd.DataFrame({"instance": key[0], "edge_id": ids[some], "gain": gain[some]})

    found = sent.groupBy("instance", "target").applyInPandas(one, "instance string, edge_id long, gain double")
    return found.groupBy("instance", "edge_id").agg(F.sum("gain").alias("gain"))


def cuts(packed_rows: DataFrame, problems: DataFrame) -> DataFrame:
    """(instance, problem, value, edges, sources) of min-cut problems (instance, problem, sources, sinks), a task each."""
    # an instance's rows are sent once per problem, the ends of a problem once, beside them
    keys = ["instance", "problem"]
    sent = packed_rows.join(problems.select(*keys), "instance")

    def one(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        told = {c: [] for c in ("instance", "problem", "value", "edges", "counted")}
        if len(rows):
            net, ids = _net(rows)
            nodes = rows[rows.kind == "n"].sort_values("id").id.to_numpy(np.int64)
            at = lambda c: np.searchsorted(nodes, np.asarray(asked[c].iloc[0], np.int64))
            value, cut, used = kernels.min_cut(net, at("sources"), at("sinks"))
            told = {"instance": [key[0]], "problem": [key[1]], "value": [value], "edges": [np.sort(ids[cut]).tolist()], "counted": [nodes[used].tolist()]}
        return pd.DataFrame(told)

    ends = problems.select(*[F.col(c).alias(f"_{c}") for c in keys], "sources", "sinks")
    return sent.groupBy(*keys).cogroup(ends.groupBy(*[f"_{c}" for c in keys])).applyInPandas(one, "instance string, problem string, value long, edges array<long>, counted array<long>")


def global_cuts(packed_rows: DataFrame) -> DataFrame:
    """(instance, problem `global`, value, edges, counted): λ and its cut of each instance."""
    ends = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.col("id"))))
    problems = packed_rows.where("kind = 'n'").groupBy("instance").agg(ends("w").alias("sources"), ends("v").alias("sinks"))
    return cuts(packed_rows, problems.select("instance", F.lit("global").alias("problem"), "sources", "sinks"))


#: A result row; sample in FIXTURES.md.
RAW = (
    "dataset string, group string, seed int, n long, m long, m_deletable long, n_entries long, n_targets long, red_n long, red_m long, red_time double, lambda double, "
    "budget_frac double, budget long, alg string, time double, cost long, risk0 double, risk double, risk_ratio double, reach_pair_frac double, mean_dist double, status string, removed array<long>"
)


def name_parts(c):
    """(group, seed) of an instance's name: `group_s7` is group and 7; other names are groups of their own, seed 0."""
    fits = c.rlike(r"^.*_s\d+$")
    return F.when(fits, F.regexp_extract(c, r"^(.*)_s(\d+)$", 1)).otherwise(c), F.when(fits, F.regexp_extract(c, r"^(.*)_s(\d+)$", 2).try_cast("int")).otherwise(F.lit(0))


def budget_of(frac: float, lam: float) -> int:
    return max(1, int(frac * lam)) if lam and np.isfinite(lam) else 0


def left_to_do(runs: DataFrame, done: DataFrame) -> DataFrame:
    """runs (instance, budget_frac, alg) without those that results (dataset, budget_frac, alg) have."""
    return runs.join(done.select(F.col("dataset").alias("instance"), "budget_frac", "alg"), ["instance", "budget_frac", "alg"], "left_anti")


PREPARED = "instance string, risk0 double, lambda double, red_n long, red_m long, red_time double"


def prepared(packed_rows: DataFrame) -> DataFrame:
    """What all runs of an instance share, found once for each that has a risk: its risk, λ and the reduced graph's size."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        net, _ = _net(rows)
        began = time.perf_counter()
        small = kernels.reduce(net)
        took = time.perf_counter() - began
        return pd.DataFrame({"instance": [key[0]], "risk0": [kernels.risk(net)], "lambda": [float(kernels.global_cut(net)[0])], "red_n": [small.net.n], "red_m": [small.net.m], "red_time": [took]})

    return packed_rows.groupBy("instance").applyInPandas(one, PREPARED).where("risk0 > 0")


def _keep(folder: str, row: dict) -> None:
    """Writes a result row to a file of its own, under its own name once it is whole."""
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    name = hashlib.sha1(f"{row['dataset']}|{row['budget_frac']}|{row['alg']}".encode()).hexdigest()
    plain = {k: v.item() if isinstance(v, np.generic) else v for k, v in row.items()}
    temporary = f"{top}/_{name}-{uuid.uuid4().hex}"  # readers pass over such names
    with store.open_output_stream(temporary) as f:
        f.write(json.dumps(plain).encode() + b"\n")
    store.move(temporary, f"{top}/{name}.json")


def run(packed_rows: DataFrame, algs=("A", "B2", "C", "D"), fracs=FRACTIONS, bound: bool = True, done: DataFrame | None = None, seconds: float | None = None, exact_nodes: int = EXACT_NODES, keep: str | None = None) -> DataFrame:
    """Raw result rows (RAW) of every instance, budget and strategy, and the bound as LB; each its own task.

    Budgets are fractions of the instance's λ, at least 1, or 0 where λ is 0. Instances without risk give no rows,
    nor does C where the reduced graph is large. done (dataset, budget_frac, alg) are left out: a run can resume. With
    keep, a folder that driver and executors share, every row is a file there as soon as it is found; finished() reads
    them, also those of a run that was killed. seconds limits C; it proves its optimum if there is no limit.
    """
    unknown = set(algs) - set(strategies.STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    spark = packed_rows.sparkSession
    todo = spark.createDataFrame([(float(f), a) for f in fracs for a in (*algs, *(["LB"] if bound else []))], "budget_frac double, alg string")
    shared = written(prepared(packed_rows), "prepared")
    runs = shared.join(F.broadcast(todo)).where(~((F.col("alg") == "C") & (F.col("red_n") > exact_nodes)))  # a few rows an instance
    if done is not None:
        runs = left_to_do(runs, done)

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        name, frac, alg = key
        net, ids = _net(rows)
        told = rows.iloc[0]
        risk0 = float(told.risk0)
        budget = budget_of(frac, float(told["lambda"]))
        row = {"dataset": name, "n": net.n, "m": net.m, "m_deletable": int(net.free.sum()), "n_entries": len(net.entries()), "n_targets": len(net.targets()), "red_n": int(told.red_n), "red_m": int(told.red_m), "red_time": float(told.red_time), "lambda": float(told["lambda"]), "budget_frac": frac, "budget": budget, "alg": alg, "risk0": risk0}
        began = time.perf_counter()
        if alg == "LB":
            low, _ = kernels.lp_bound(kernels.reduce(net).net, budget)
            row |= {"time": time.perf_counter() - began, "risk": low, "risk_ratio": low / risk0, "status": "certified", "removed": []}
        else:
            solve = strategies.STRATEGIES[alg]
            there, notes = strategies.exact(net, budget, seconds) if alg == "C" else solve(net, budget)
            row |= {"time": time.perf_counter() - began}
            cost = net.spent(there)
            if cost > budget:
                raise AssertionError(f"{alg} spent {cost} of {budget}")
            pairs, far = _distances(net, there)
            left = kernels.risk(net, there)
            row |= {"cost": cost, "risk": left, "risk_ratio": left / risk0, "reach_pair_frac": pairs / (len(net.entries()) * len(net.targets())), "mean_dist": far / pairs if pairs else None, "status": notes.get("status", ""), "removed": ids[~there].tolist()}
        if keep:
            _keep(keep, row)
        return pd.DataFrame({c: [row.get(c)] for c in RAW_NAMES})

    sent = packed_rows.join(runs, "instance")
    schema = ", ".join(x for x in RAW.split(", ") if x.split()[0] not in ("group", "seed"))
    return _grouped(sent.groupBy("instance", "budget_frac", "alg").applyInPandas(one, schema))


def _grouped(told: DataFrame) -> DataFrame:
    group, seed = name_parts(F.col("dataset"))
    return told.withColumn("group", group).withColumn("seed", seed).select(*[x.split()[0] for x in RAW.split(", ")])


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """The result rows that runs kept in folder, of runs that ended and of runs that were killed."""
    schema = ", ".join(x for x in RAW.split(", ") if x.split()[0] not in ("group", "seed"))
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    return _grouped(spark.read.schema(schema).json(folder))


RAW_NAMES = [x.split()[0] for x in RAW.split(", ") if x.split()[0] not in ("group", "seed")]


def append(results: DataFrame, path: str) -> None:
    """Adds result rows to a Parquet table, which a later run reads as `done`."""
    results.write.mode("append").parquet(path)


def notes(results: DataFrame) -> str:
    return json.dumps({r.status: r["count"] for r in results.groupBy("status").count().collect()})
