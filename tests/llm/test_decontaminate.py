import hashlib
import random
import re

import pytest

from severa.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(len(w), n)
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, met = set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    met |= windows[x]
        ids = sorted(map(str, met))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, words string"), spark.createDataFrame(items, "item_id long, text string")


def test_random(spark):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["a", "B", "ç", "É", "x1"]) + rng.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(i, make(rng.choice([3, 5, 8, 9, 10, 11, 14, 20]))) for i in range(40)] + [(100, ""), (101, None), (102, "..."), (103, make(12)), (103, make(12))]
    docs = [(i, make(rng.randint(0, 60))) for i in range(150)]
    docs += [(200 + i, make(5) + " " + (t or "").upper() + " " + make(4)) for i, t in items if i > 10]
    docs += [(900, None), (901, ""), (902, "!!"), (903, make(3000)), (904, docs[3][1]), (904, docs[3][1])]
    d, b = frames(spark, docs, items)
    assert sorted(map(tuple, decontaminate.report(d, b).collect())) == sorted(brute(docs, items))
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_, bad in brute(docs, items) if not bad)


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "one two"), (2, None)], [(1, "one two")])
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, decontaminate.report(d, b.limit(0)).collect())) == [(1, 2, 0, 0, none, False), (2, 0, 0, 0, none, False)]
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert [r.doc_id for r in decontaminate.clean(d, b).collect()] == [2]


def test_shuffled_probe(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SET_ROWS", 0)
    docs, items = [(1, "q a b c d"), (2, "a b")], [(5, "a b c"), (6, "b")]
    assert sorted(map(tuple, decontaminate.report(*frames(spark, docs, items)).collect())) == sorted(brute(docs, items))


@pytest.mark.parametrize("window", [1, 3, 32, 40])
@pytest.mark.parametrize("rows", [0, 2_000_000])
def test_windows_of_any_length(spark, monkeypatch, window, rows):
    monkeypatch.setattr(decontaminate, "SET_ROWS", rows)
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(rng.choice([2, 20, 45, 90]))) for i in range(12)]
    docs = [(i, text(30) + " " + items[i % 12][1] + " " + text(20)) for i in range(20)] + [(50, None), (51, text(25))]
    d, b = frames(spark, docs, items)
    assert sorted(map(tuple, decontaminate.report(d, b, window=window).collect())) == sorted(brute(docs, items, window))
    assert sorted(r.doc_id for r in decontaminate.clean(d, b, window=window).collect()) == sorted(i for i, *_, bad in brute(docs, items, window) if not bad)


def test_a_window_of_many_items(spark):
    shared = "one two three four five six seven eight nine ten"
    items = [(i, f"{shared} x{i} y{i}") for i in range(10_000)]
    docs = [(1, shared), (2, f"a {shared} b {shared}"), (3, "one two"), (4, f"{shared} x7 y7")]
    d, b = frames(spark, docs, items)
    assert sorted(map(tuple, decontaminate.report(d, b).collect())) == sorted(brute(docs, items))


def test_shuffled_probe_of_long_texts(spark, monkeypatch):
    """Without a broadcast, words don't travel with every window: the time stays near the broadcast's."""
    import time

    rng = random.Random(1)
    docs = [(i, " ".join(str(rng.randrange(5000)) for _ in range(20_000))) for i in range(8)]
    d, b = frames(spark, docs, [(1, " ".join(docs[3][1].split()[50:80])), (2, "none of these ten words is in any of the texts at all")])
    took = {}
    for rows in (2_000_000, 0, 2_000_000, 0):  # the first two warm up
        monkeypatch.setattr(decontaminate, "SET_ROWS", rows)
        began = time.perf_counter()
        assert [r.n_hit for r in decontaminate.report(d, b).orderBy("doc_id").collect()] == [0, 0, 0, 30, 0, 0, 0, 0]
        took[rows] = time.perf_counter() - began
    assert took[0] <= 2 * took[2_000_000] + 1


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert sorted(map(tuple, queries.op10_decontamination(spark, d).collect())) == sorted(want)
