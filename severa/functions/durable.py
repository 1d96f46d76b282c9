"""Tables written to the folder that driver and executors share: they cut the lineage of loops and survive lost executors.

All that a session writes lies in one folder of its own, which goes when the session ends; loops and stages remove
what they have done with before that.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_folders: set[str] = set()
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, one JVM (as in tests) takes a temporary folder; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='severa-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A name in the session's folder that no one has."""
    top = f"{shared_folder(spark)}/severa-{spark.sparkContext.applicationId}"
    if top not in _folders:
        store, path = _store(spark, top)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _folders.add(top)
    made = f"{top}/{what}-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", ()):
        scope.append(made)
    return made


def remove(spark: SparkSession, folder: str) -> None:
    store, path = _store(spark, folder)
    store.delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what was written inside it, for steps whose result is written before they end."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", ()), made]
    try:
        yield
    finally:
        _scopes.open = [s for s in _scopes.open if s is not made]
        for folder in made:
            remove(spark, folder)


def counted(df: DataFrame, what: str = "table", instead: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, int]:
    """written(), and the number of its rows as the writers saw it: no job counts them again."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), what, instead)
    return out, seen.get["n"]


def written(df: DataFrame, what: str = "table", instead: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df as a Parquet table, read back. The written tables in instead, which nothing needs any more, are removed."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for old in instead:
        if old in _paths:
            remove(spark, _paths.pop(old))
    return out
