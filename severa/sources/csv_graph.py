"""Instance folders of CSV files: edges.csv, nodes.csv and an optional meta.json."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from severa.functions.relations import truthy
from severa.operators.instance import Instance, InvalidInstance, all_nodes, merged, validated


def _read(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    kept = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select(*kept)


def edge_rows(raw: DataFrame) -> DataFrame:
    """Text rows (src, dst, cost, deletable) -> typed rows: trimmed ids, costs cut to whole numbers, a missing or false
    deletable is fixed, and a fixed row's cost doesn't count. A removable row without a cost that is a number is an error."""
    number = F.trim("cost").try_cast("double")
    free = truthy(F.col("deletable"))
    wrong = F.raise_error(F.concat(F.lit("no cost: "), F.coalesce(F.col("src"), F.lit("")), F.lit("->"), F.coalesce(F.col("dst"), F.lit(""))))
    cost = F.when(free, F.when(number.isNull(), wrong.cast("long")).otherwise(number.cast("long")))
    return raw.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), cost.alias("cost"), free.alias("deletable"))


def node_rows(raw: DataFrame) -> DataFrame:
    """Text rows (node, entry_weight, target_value) -> trimmed ids and weights, blanks 0; repeated nodes keep the largest."""
    number = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    rows = raw.select(F.trim("node").alias("node"), number("entry_weight").alias("entry_weight"), number("target_value").alias("target_value"))
    return rows.groupBy("node").agg(F.max("entry_weight").alias("entry_weight"), F.max("target_value").alias("target_value"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, folder: str, name: str | None = None) -> Instance:
    """The instance in folder. Without nodes.csv there are neither entries nor targets. It is validated."""
    folder = folder.rstrip("/")
    if not _exists(spark, f"{folder}/edges.csv"):
        raise InvalidInstance(f"no edges.csv in {folder}")
    edges = merged(edge_rows(_read(spark, f"{folder}/edges.csv", ("src", "dst", "cost", "deletable"))))
    annotated = node_rows(_read(spark, f"{folder}/nodes.csv", ("node", "entry_weight", "target_value"))) if _exists(spark, f"{folder}/nodes.csv") else None
    meta = {}
    if _exists(spark, f"{folder}/meta.json"):
        meta = json.loads(spark.read.text(f"{folder}/meta.json", wholetext=True).first().value)
    return validated(Instance(all_nodes(edges, annotated), edges, name or folder.rsplit("/", 1)[-1], meta))


def save(instance: Instance, folder: str) -> None:
    """Writes the instance: edges (a blank cost and 0 where fixed), all nodes, and meta if there is any."""
    spark = instance.nodes.sparkSession
    e = instance.edges.select("src", "dst", F.when(F.col("deletable"), F.col("cost").cast("string")).alias("cost"), F.col("deletable").cast("int").alias("deletable"))
    write = lambda df, name: df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}")
    write(e, "edges.csv")
    blank = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string")).alias(c)
    write(instance.nodes.select("node", blank("entry_weight"), blank("target_value")), "nodes.csv")
    if instance.meta:
        row = spark.createDataFrame([(json.dumps(instance.meta, default=str),)], T.StructType([T.StructField("value", T.StringType())]))
        row.coalesce(1).write.mode("overwrite").text(f"{folder}/meta.json")


def mapping(spark: SparkSession, path: str, default: float) -> DataFrame:
    """(node, value) of a JSON object, or of lines `id`, `id,value` or `id<TAB>value`; # begins a comment."""
    whole = spark.read.text(path, wholetext=True)
    if whole.select(F.try_parse_json("value").isNotNull() & F.col("value").startswith("{")).first()[0]:
        pairs = whole.select(F.explode(F.from_json("value", "map<string,double>")).alias("node", "value"))
        return pairs.select("node", "value")
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = F.split("line", "[,\t]", 2)
    value = F.try_element_at(parts, F.lit(2))
    return lines.select(F.trim(parts[0]).alias("node"), F.coalesce(F.trim(value).try_cast("double"), F.lit(default)).alias("value"))
