import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from severa.llm import simhash
from severa.llm.components import connected_components


def plain(text, k=3):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """[(id, fingerprint)] -> {id: component}, by comparing all pairs."""
    ids = [i for i, _ in rows]
    fp = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: least[find(k)] for k in range(len(rows))}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "Two words", "a b c", "É é Ab\x0bcd\x0cE F g", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.simhash64(None if text is None else text.encode()) == plain(text)


@pytest.mark.parametrize("piece", [1, 5, 40])
def test_fingerprint_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text in ("", "  ", "One", "Two words", "a b c", " a  b c d ", "x y z é " * 30, "w" * 100 + " a b"):
        for k in (1, 3):
            assert simhash.simhash64(text.encode(), k) == plain(text, k)


def test_links_lose_none(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randint(0, 6)):
            q = p
            for _ in range(rng.randint(1, 5)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
            p = q if rng.random() < 0.5 else p
    prints |= {0, 1, (1 << 64) - 1, (1 << 63)}
    rows = [(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in prints]
    found = simhash.links(spark.createDataFrame(rows, "fingerprint long")).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in found)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = brute(sorted((f, f & (2**64 - 1)) for (f,) in rows))
    assert {f: got.get(f, f) for (f,) in rows} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_long_chains(spark):
    names = list(range(2000))
    random.Random(3).shuffle(names)
    edges = list(zip(names, names[1:])) + [(5000 + i, 5001 + i) for i in range(700)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(2000)}, **{5000 + i: 5000 for i in range(701)}}


@pytest.mark.parametrize("radius", [1, 2])
def test_links_of_smaller_radius(spark, radius):
    rng = random.Random(7)
    prints = sorted({5, 8, 12, 13, *(rng.getrandbits(6) for _ in range(30)), *(rng.getrandbits(9) << 20 for _ in range(60))})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), radius).collect()
    assert all(bin(a ^ b).count("1") <= radius for a, b in found)
    near = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= radius]
    groups = [{r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()} for pairs in (found, near)]
    assert groups[0] == groups[1]
    if radius == 1:
        few = simhash.links(spark.createDataFrame([(p,) for p in (5, 8, 12, 13)], "fingerprint long"), radius).collect()
        assert {frozenset(x) for x in few} == {frozenset((12, 13)), frozenset((5, 13)), frozenset((8, 12))}


def test_edge_rows(spark):
    long = "word " * 20000
    rows = [(3, None, 1), (2, "", 1), (None, " ", 1), (7, "Some text of a few words", 1), (7, "Some text of a few words", 1), (9, "some TEXT of a few words", 2), (5, long, 3), (None, "alone here today with nobody", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, 2), (7, 7), (7, 7), (9, 7), (5, 5), (None, None)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(2, ""), (5, long), (7, "Some text of a few words")]
    assert kept.count() == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_takes_any_columns(spark):
    rows = [(1, "a b c d", {"k": 1}, 5), (1, "a b c d", {"k": 1}, 5), (2, "a b c d", None, 6), (3, None, {}, 7), (None, "", {}, 8), (4, "q r s t", {}, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _in map<string,int>, _at int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r._at) for r in kept.collect()) == [(1, "a b c d", 5), (3, None, 7), (4, "q r s t", 9)]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows)
    got = queries.op1_simhash(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", want[i]) for i, f in rows)
