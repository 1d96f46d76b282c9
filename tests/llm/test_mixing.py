import re

import pytest
from pyspark.sql import functions as F

from severa.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, most=3):
    """Targets by the rule's own words: share by weight, cap, reshare the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: 0.0 for s in names}
    free, left = set(names), float(total)
    while free and left > 1e-9:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


def check(docs, got, near=True):
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water(sizes)
    by = {}
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    for s, rows in by.items():
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert abs(sum(r.copies for r in rows) - rate * len(rows)) <= 1
        if near:
            assert abs(sum(r.taken for r in rows) - want[s]) <= 0.15 * want[s] + max(r.size for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, copy int, size int")


def rows(n=900):
    return [(i, "w " * (3 + i * 7919 % 97), ["a", "b", "é", None, "B"][min(4, i % 7)]) for i in range(n)]


@pytest.mark.parametrize("slice_rows", [200, 5])
def test_targets_and_copies(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = rows() + [(5000, None, "a"), (5001, "", "z"), (5002, None, "zz"), (None, "some words", "a"), (3, "w w", "a"), (3, "w w", "a"), (6000, "w " * 20000, "b")]
    got = mixing.report(frame(spark, docs)).collect()
    check(docs, got)
    again = mixing.report(frame(spark, docs[::-1]).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_slices_do_not_change_the_order(spark, monkeypatch):
    key = lambda r: (r.doc_id, r.taken)
    want = sorted(map(key, mixing.report(frame(spark, rows())).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)  # the root of 900 rows, 30, is more
    assert sorted(map(key, mixing.report(frame(spark, rows())).collect())) == want


def test_mix(spark):
    docs = rows(200)
    got = mixing.mix(frame(spark, docs)).collect()
    taken = {r.doc_id: r.copies for r in mixing.report(frame(spark, docs)).collect()}
    assert got[0].__fields__ == ["doc_id", "text", "source", "copy", "size", "copy_2"]
    assert sorted((r.doc_id, r.copy_2) for r in got) == sorted((i, k + 1) for i, n in taken.items() for k in range(n))
    assert mixing.mix(frame(spark, docs).limit(0)).count() == 0
    assert mixing.report(frame(spark, docs).limit(0)).count() == 0
    assert [r.taken for r in mixing.report(frame(spark, [(1, None, None)])).collect()] == [0]


def test_rows_without_ids(spark):
    docs = [(None if i % 3 else 7, "w " * (1 + i % 5), "a" if i % 9 else "b") for i in range(6000)]
    got = mixing.report(frame(spark, docs).repartition(8)).collect()
    check([(None, t, s) for _, t, s in docs], got)


def test_hot_ids_are_dealt_out(spark, monkeypatch):
    """The largest group that one window sorts, of 40,000 rows whose id is null."""
    from pyspark.sql import Window

    seen = []
    monkeypatch.setattr(mixing.Window, "partitionBy", lambda *c, f=Window.partitionBy: (seen.append(c), f(*c))[1])
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("id"), F.lit("a").alias("source"), F.lit(5).cast("long").alias("size"), (F.col("id") % 16).cast("int").alias("part"), F.col("id").alias("k"))
    got = mixing.copies(docs)
    assert got.count() == 40_000
    assert ("rank", "_class", "_slice", "_cell", "_part") in seen
    assert got.groupBy("part").agg(F.sum("copies").alias("n")).where("n <> 2500").count() == 0


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sizes = {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = water(sizes)
    for r in queries.op2_mixing(spark, d).collect():
        assert r.size == size(docs[r.doc_id].text)
        assert r.target == pytest.approx(want[docs[r.doc_id].source])
