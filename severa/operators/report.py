"""Reports on raw results: gaps, summaries, plot tables and Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("risk_ratio", "time", "cost_over_budget", "gap_opt", "gap_lb", "reach_pair_frac", "mean_dist")


def concatenated(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def number(c: Column) -> Column:
    """c as a double; what is no number, or not one (NaN), is null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def with_gaps(raw: DataFrame) -> DataFrame:
    """raw with gap_opt, to C where that is optimal, and gap_lb, to the bound: the share of the protectable risk that is
    not protected; 0 where nothing is protectable, null without a reference and for the bound itself."""
    key = ["dataset", "budget_frac"]
    saved = (F.col("risk0") - F.col("risk")).alias("saved")
    opt = raw.where("alg = 'C' and status = 'optimal'").select(*key, saved.alias("saved_opt"))
    low = raw.where("alg = 'LB'").select(*key, saved.alias("saved_lb"))

    def gap(best: str) -> Column:
        told = F.when(F.col(best) > 0, (F.col(best) - F.col("saved")) / F.col(best)).when(F.col(best) == 0, F.lit(0.0))
        return F.when(F.col("alg") != "LB", told)

    out = raw.select("*", saved).join(opt, key, "left").join(low, key, "left")
    return out.select(*[out[c] for c in raw.columns], gap("saved_opt").alias("gap_opt"), gap("saved_lb").alias("gap_lb"))


def with_cost_share(raw: DataFrame) -> DataFrame:
    return raw.withColumn("cost_over_budget", number(F.col("cost")) / F.when(F.col("budget") != 0, F.col("budget")))


def summary(raw: DataFrame) -> DataFrame:
    """Means and sample standard deviations of METRICS by group, budget and strategy; also runs, n_mean and red_n_mean.

    Nulls and NaNs don't count; a single value has no deviation.
    """
    told = with_cost_share(with_gaps(raw))
    for c in METRICS:
        told = told.withColumn(c, number(F.col(c)))
    both = [f(c).alias(f"{c}_{n}") for c in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return told.groupBy("group", "budget_frac", "alg").agg(*both, F.count("*").alias("runs"), F.avg("n").alias("n_mean"), F.avg("red_n").alias("red_n_mean"))


def _pm(c: str, places: int) -> Column:
    # halves go to the even digit
    mean, std = (F.format_string(f"%.{places}f", F.bround(f"{c}_{x}", places)) for x in ("mean", "std"))
    return F.when(F.col(f"{c}_mean").isNull(), "–").when(F.col(f"{c}_std").isNull(), mean).otherwise(F.concat(mean, F.lit(" ± "), std))


def markdown(table: DataFrame) -> DataFrame:
    """(group, budget_frac, alg, line): a summary's rows as Markdown, to be put in that order."""
    cells = [F.col("budget_frac").cast("string"), F.col("alg"), _pm("risk_ratio", 3), _pm("gap_opt", 3), _pm("gap_lb", 3), _pm("time", 2), F.col("runs").cast("string")]
    return table.select("group", "budget_frac", "alg", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).orderBy("group", "budget_frac", "alg")


def plot_risk(table: DataFrame) -> DataFrame:
    return table.select("group", "alg", "budget_frac", F.col("risk_ratio_mean").alias("y"), F.col("risk_ratio_std").alias("err"), "n_mean")


def plot_ablation(table: DataFrame) -> DataFrame:
    """plot_risk() of D and its ablations; empty unless there are two of them."""
    some = table.where("alg = 'D' or alg like 'D-%'")
    kinds = some.agg(F.count_distinct("alg").alias("kinds"))
    return plot_risk(some.join(F.broadcast(kinds)).where("kinds > 1"))  # one row


def plot_gap(table: DataFrame) -> DataFrame:
    """The gap to the optimum of groups that have one, else the gap to the bound."""
    some = table.where("alg not in ('LB', 'C')")
    has = some.groupBy("group").agg((F.count("gap_opt_mean") > 0).alias("has"))
    pick = lambda x: F.when(F.col("has"), F.col(f"gap_opt_{x}")).otherwise(F.col(f"gap_lb_{x}"))
    return some.join(has, "group").select("group", "alg", "budget_frac", F.when(F.col("has"), "gap_opt").otherwise("gap_lb").alias("metric"), pick("mean").alias("y"), pick("std").alias("err"))


def plot_time(table: DataFrame, frac: float) -> DataFrame:
    return table.where((F.col("budget_frac") == frac) & (F.col("alg") != "LB")).select("alg", "group", "n_mean", F.col("time_mean").alias("y"), F.coalesce("time_std", F.lit(0.0)).alias("err"))
