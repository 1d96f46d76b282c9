"""Decisions by a row's place in its files, row keys, and tables that go when they are done with."""

import os

import pytest
from pyspark.sql import functions as F

from severa.functions import durable
from severa.llm import common


def frame(spark, n=50):
    return spark.createDataFrame([(i, f"t{i}", "x", {"a": i % 2}) for i in range(n)], "doc_id long, _at string, _n string, m map<string,int>").repartition(3)


@pytest.mark.parametrize("blocks, bits", [(2048, 16), (0, 16), (2048, 2), (0, 1)])
def test_decided(spark, tmp_path, monkeypatch, blocks, bits):
    monkeypatch.setattr(common, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(common, "BLOCK_BITS", bits)
    frame(spark).write.parquet(f"file://{tmp_path}/t")
    for docs in (spark.read.parquet(f"file://{tmp_path}/t"), frame(spark), spark.read.parquet(f"file://{tmp_path}/t").where("doc_id > 9")):
        rows = common.placed(docs)
        told = rows.where("_in.doc_id % 5 < 2").select("_file", rows["_at"], (F.col("_in.doc_id") % 5).alias("n"))
        got = common.decided(rows, told, 7).select("_n", *common.rows_of(docs).__getitem__(slice(0, 1))).collect()
        assert len(got) == docs.count()
        assert all(n == (i % 5 if i % 5 < 2 else 7) for n, i in got)
    assert common.decided(rows, told.limit(0), 7).where("_n = 7").count() == 40


def test_row_key(spark):
    docs = frame(spark, 4).union(frame(spark, 1))
    assert docs.select(common.row_key(docs, *docs.columns).alias("k")).distinct().count() == 4


def test_tables_go(spark):
    local = lambda df: df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    one = durable.written(spark.range(3))
    here = local(one)
    assert os.path.exists(here)
    durable.written(one.where("id > 0"), instead=(one,))
    assert not os.path.exists(here)
    with durable.scratch(spark):
        inner = local(durable.written(spark.range(3)))
        assert os.path.exists(inner)
    assert not os.path.exists(inner)


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_folder(Session())
