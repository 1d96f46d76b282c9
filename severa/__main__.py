"""Command line: run strategies, aggregate and plot results, generate instances, convert and prepare exports."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _uri(path: str) -> str:
    import os

    return path if "://" in path else f"file://{os.path.abspath(path)}"


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    from severa.functions import durable
    from severa.operators import instance, reduction, runs
    from severa.sources import csv_graph

    packed = None
    for folder in sorted(set(a.data)):
        graph = instance.indexed(csv_graph.load(spark, _uri(folder)))
        rows = runs.packed(reduction.prune(graph) if a.prune else graph, folder.rstrip("/").rsplit("/", 1)[-1])
        packed = rows if packed is None else packed.union(rows)
    rows = _uri(f"{a.out}.rows")  # each as soon as it is found
    if not a.resume:
        durable.remove(spark, rows)
    done = runs.finished(spark, rows) if a.resume else None
    limit = a.ip_time_limit if a.ip_time_limit > 0 else None
    runs.run(packed, tuple(x for x in a.algs.split(",") if x), tuple(float(x) for x in a.fracs.split(",")), a.lp_bound, done, limit, a.ip_max_nodes, rows).write.format("noop").mode("overwrite").save()
    runs.finished(spark, rows).write.mode("overwrite").parquet(_uri(a.out))


def _plot(spark: SparkSession, a: argparse.Namespace) -> None:
    from severa.operators import report

    table = report.summary(report.concatenated(*[spark.read.parquet(_uri(p)) for p in a.raw])).cache()
    made = {"risk": report.plot_risk(table), "gap": report.plot_gap(table), "time": report.plot_time(table, a.frac), "ablation": report.plot_ablation(table)}
    for name, df in made.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(_uri(f"{a.out}/{name}.csv"))


def _prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    from severa.sources import generators

    made = [generators.prepare(spark, _uri(a.path), _uri(a.out), seed, a.share) for seed in generators.seeds_of(a.seeds)]
    spark.createDataFrame(made).coalesce(1).write.mode("overwrite").option("header", True).csv(_uri(f"{a.out}/manifest.csv"))


def _aggregate(spark: SparkSession, a: argparse.Namespace) -> None:
    from severa.operators import report

    table = report.summary(report.concatenated(*[spark.read.parquet(_uri(p)) for p in a.raw])).cache()
    table.orderBy("group", "budget_frac", "alg").coalesce(1).write.mode("overwrite").option("header", True).csv(_uri(f"{a.out}.csv"))
    report.markdown(table).select("line").coalesce(1).write.mode("overwrite").text(_uri(f"{a.out}.md"))


def _generate(spark: SparkSession, a: argparse.Namespace) -> None:
    from severa.sources import csv_graph, generators

    for seed in generators.seeds_of(a.seeds):
        if a.family == "layered":
            made = generators.layered(spark, a.n, seed)
        elif a.family == "two_routes":
            ends = spark.range(a.n * a.n).select((F.col("id") % a.n).alias("a"), F.floor(F.col("id") / a.n).cast("long").alias("b"))
            made = generators.two_routes(ends.where((F.col("a") < F.col("b")) & (generators.uniform(seed, F.col("a"), F.col("b")) < a.p)), f"two_routes_{a.n}_s{seed}")
        else:
            made = generators.typed(spark, generators.Config(users=a.n, groups=max(1, a.n // 5), computers=max(1, a.n // 2), seed=seed))
        csv_graph.save(made, _uri(f"{a.out}/{made.name}"))


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    from severa.sources import csv_graph, json_graph

    given = lambda path, default: {r.node: r.value for r in csv_graph.mapping(spark, _uri(path), default).collect()} if path else None
    tier0 = list(given(a.tier0, 1.0)) if a.tier0 else None
    wellknown = json.load(open(a.wellknown)) if a.wellknown else None
    got = json_graph.load(spark, _uri(a.path), entry_weight=given(a.entries, 1.0), target_value=given(a.targets, 1.0), tier0=tier0, wellknown=wellknown)
    csv_graph.save(got.instance, _uri(a.out))
    print(json.dumps(got.statistics))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="severa")
    sub = p.add_subparsers(required=True)
    run = sub.add_parser("run")
    run.add_argument("data", nargs="+")
    run.add_argument("--algs", default="A,B2,C,D")
    run.add_argument("--fracs", default="0.05,0.1,0.25,0.5,0.75")
    run.add_argument("--ip-time-limit", type=float, default=300, help="seconds for C; 0: until its optimum is proven")
    run.add_argument("--ip-max-nodes", type=int, default=3000)
    run.add_argument("--lp-bound", action="store_true")
    run.add_argument("--resume", action="store_true")
    run.add_argument("--prune", action="store_true", help="drop nodes off every way from an entry to a target first; n and m are then of what is left")
    run.add_argument("--out", required=True)
    run.set_defaults(do=_run)
    agg = sub.add_parser("aggregate")
    agg.add_argument("raw", nargs="+")
    agg.add_argument("--out", required=True)
    agg.set_defaults(do=_aggregate)
    plot = sub.add_parser("plot", help="tables of what the published plots show")
    plot.add_argument("raw", nargs="+")
    plot.add_argument("--frac", type=float, default=0.5)
    plot.add_argument("--out", required=True)
    plot.set_defaults(do=_plot)
    gen = sub.add_parser("generate")
    gen.add_argument("family", choices=["typed", "layered", "two_routes"])
    gen.add_argument("--n", type=int, default=1000)
    gen.add_argument("--p", type=float, default=0.2)
    gen.add_argument("--seeds", default="0-4")
    gen.add_argument("--out", required=True)
    gen.set_defaults(do=_generate)
    pre = sub.add_parser("prepare", help="annotate an export by policy, a seed at a time")
    pre.add_argument("path")
    pre.add_argument("--seeds", default="1-5")
    pre.add_argument("--share", type=float, default=0.1)
    pre.add_argument("--out", required=True)
    pre.set_defaults(do=_prepare)
    con = sub.add_parser("convert")
    con.add_argument("path")
    for name in ("entries", "targets", "tier0", "wellknown"):
        con.add_argument(f"--{name}")
    con.add_argument("--out", required=True)
    con.set_defaults(do=_convert)
    a = p.parse_args(args)
    a.do(SparkSession.builder.appName("severa").getOrCreate(), a)


if __name__ == "__main__":
    main()
