"""Runs, reductions and the command line on Spark, against the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from severa import __main__ as cli
from severa.operators import instance as inst
from severa.operators import kernels, reach, reduction, runs
from test_kernels import make


def frames(spark, net):
    nodes = spark.createDataFrame([(i, str(i), float(net.w[i]), float(net.v[i]), [str(i)]) for i in range(net.n)], "node_id long, label string, entry_weight double, target_value double, members array<string>")
    edges = spark.createDataFrame([(e, int(net.src[e]), int(net.dst[e]), int(net.cost[e]), bool(net.free[e]), [e]) for e in range(net.m)], "edge_id long, src long, dst long, cost long, deletable boolean, orig array<long>")
    return inst.Indexed(nodes, edges)


@pytest.mark.parametrize("seed", [3, 11])
def test_reduction_keeps_risk_of_removals(spark, seed):
    net = make(seed)
    g = frames(spark, net)
    small = reduction.reduce(g)
    rng = np.random.default_rng(seed)
    chosen = [(int(r.edge_id),) for r in small.edges.where("deletable").collect() if rng.random() < 0.5]
    picked = spark.createDataFrame(chosen, "edge_id long")
    gone = [r.edge_id for r in reduction.original_edges(small, picked).collect()]
    there = net.whole()
    there[gone] = False
    removed = picked.select(F.lit(0).cast("long").alias("scenario"), "edge_id")
    assert reach.risk(small, removed=removed).first().risk == pytest.approx(kernels.risk(net, there))
    assert inst.cost_of(small.edges, picked).first().cost == net.spent(there)


def test_gains_agree(spark):
    net = make(5, n=10, p=0.3, most_free=30)
    g = frames(spark, net)
    want = {e: x for e, x in enumerate(kernels.gains(net)) if x > 0}
    got = {r.edge_id: r.gain for r in runs.gains(runs.packed(g, "x")).collect()}
    assert got == pytest.approx(want)
    other = {r.edge_id: r.gain for r in reach.scenario_gains(g, g.edges.where("deletable")).collect() if r.gain > 0}
    assert other == pytest.approx(want)


def test_cost_of_fixed_edges_fails(spark):
    g = frames(spark, make(1))
    with pytest.raises(Exception, match="can't be removed"):
        inst.cost_of(g.edges, g.edges.where("not deletable").select("edge_id")).collect()


def test_runs_and_resume(spark, tmp_path):
    packed = runs.packed(frames(spark, make(8)), "net_s8")
    first = runs.run(packed, ("A", "C"), (0.5,), bound=True)
    rows = {r.alg: r for r in first.collect()}
    assert set(rows) == {"A", "C", "LB"} and rows["C"].status == "optimal" and rows["A"].group == "net" and rows["A"].seed == 8
    assert rows["LB"].risk <= rows["C"].risk + 1e-6 <= rows["A"].risk + 2e-6
    runs.append(first, f"file://{tmp_path}/raw")
    again = runs.run(packed, ("A", "D"), (0.5,), bound=True, done=spark.read.parquet(f"file://{tmp_path}/raw"))
    assert [r.alg for r in again.collect()] == ["D"]


@pytest.mark.parametrize("bits", [63, 2])
def test_weights_by_sets_of_bits(spark, monkeypatch, bits):
    monkeypatch.setattr(reach, "BITS", bits)
    net = make(9, n=14, p=0.25, n_entries=6, n_targets=3)
    g = frames(spark, net)
    ahead = kernels.forward(net, net.whole())
    want = sum(net.w[s] * ahead.swept([s]) for s in net.entries())
    got = {r.node: r.total for r in reach.weights_that_reach(g.entries(), g.edges).collect()}
    assert got == pytest.approx({i: x for i, x in enumerate(want) if x > 0})


def test_rows_are_kept_as_they_are_found(spark, tmp_path):
    packed, folder = runs.packed(frames(spark, make(8)), "net_s8"), f"file://{tmp_path}/rows"
    runs.run(packed, ("A", "B1"), (0.5,), bound=True, keep=folder).write.format("noop").mode("overwrite").save()
    assert len(list((tmp_path / "rows").glob("*.json"))) == 3
    assert sorted(r.alg for r in runs.finished(spark, folder).collect()) == ["A", "B1", "LB"]
    (tmp_path / "rows" / "_half-written").write_text('{"alg":')
    again = runs.run(packed, ("A", "D"), (0.5,), bound=True, done=runs.finished(spark, folder), keep=folder)
    assert [r.alg for r in again.collect()] == ["D"] and runs.finished(spark, folder).count() == 4


def test_command_line(spark, tmp_path):
    cli.main(["generate", "layered", "--n", "60", "--seeds", "1", "--out", f"{tmp_path}/in"])
    cli.main(["run", f"{tmp_path}/in/layered_60_s1", "--algs", "A,B1", "--fracs", "0.5", "--lp-bound", "--out", f"{tmp_path}/raw"])
    cli.main(["run", f"{tmp_path}/in/layered_60_s1", "--algs", "A,B1", "--fracs", "0.5", "--lp-bound", "--resume", "--out", f"{tmp_path}/raw"])
    assert spark.read.parquet(f"file://{tmp_path}/raw").count() == 3
    cli.main(["plot", f"{tmp_path}/raw", "--out", f"{tmp_path}/plots"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/plots/risk.csv").count() == 3
    cli.main(["aggregate", f"{tmp_path}/raw", "--out", f"{tmp_path}/summary"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/summary.csv").count() == 3
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/summary.md").collect()]
    assert len(lines) == 3 and all(x.startswith("| 0.5 | ") for x in lines)


def test_ends_of_cuts_stand_beside_rows(spark):
    """No row of the graph has the lists of sources and sinks, which are as long as the graph has entries and targets."""
    found = runs.global_cuts(runs.packed(frames(spark, make(8)), "x"))
    plan = found._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join" in line]
    assert "FlatMapCoGroups" in plan.toString() and joins and "sources" not in "".join(joins)
    value, _, _ = kernels.global_cut(make(8))
    assert found.first().value == value


@pytest.mark.parametrize("seed", [2, 4])
def test_gains_of_scenarios_keep_what_may_change(spark, monkeypatch, seed):
    """With cycles too; the state has rows of nodes below a candidate, not candidates times nodes."""
    net = make(seed, n=12, p=0.3, most_free=40)
    g, sizes, plain = frames(spark, net), [], reach.expand
    monkeypatch.setattr(reach, "expand", lambda *a: [sizes.append((out := plain(*a)).count()), out][1])
    got = {r.edge_id: r.gain for r in reach.scenario_gains(g, g.edges.where("deletable")).collect()}
    want = kernels.gains(net)
    assert got == pytest.approx({e: float(want[e]) for e in np.flatnonzero(net.free).tolist()})
    assert max(sizes[1:]) < int(net.free.sum()) * sizes[0] / 2
