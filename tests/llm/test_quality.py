import random
import re

import numpy as np

from severa.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {g for g in grams if grams.count(g) > 1}
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def texts():
    rng = random.Random(2)
    out = [None, "", " \n ", "#\n#\n #", "é x\x85y\x1c z", "a b c d e f g h " * 3, "x " * 9, "x " * 8]
    for _ in range(300):
        out.append("".join(rng.choice(["a", "b", "É", "*", "<"]) + rng.choice([" ", " ", "\n", "\t", ""]) for _ in range(rng.randint(0, 80))))
    return out


def test_statistics():
    for t in texts():
        assert quality.statistics_of(None if t is None else t.encode()) == brute(t), t


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (2000, 5)), rng.normal(8, 1, (40, 5))])
    good = np.arange(len(x)) < 2000
    forest = quality.grow(x)
    score = forest.score(x)
    assert score[~good].min() > np.quantile(score[good], 0.95)
    cut = quality.calibrate(forest, x, good)
    assert (score[good] > cut).mean() <= quality.LOST_GOOD and (score[~good] > cut).mean() > 0.8


def walk(forest, row):
    """A row's score, split by split."""
    total = 0.0
    for at in forest.roots.tolist():
        while forest.feature[at] >= 0:
            at = int(forest.below[at] if row[forest.feature[at]] < forest.cut[at] else forest.above[at])
        total += forest.length[at]
    return 2.0 ** -(total / len(forest.roots) / forest.typical)


def test_range_beyond_the_rows():
    x = np.column_stack([np.random.default_rng(3).normal(0, 1, 500), np.zeros(500)])
    forest = quality.grow(x, np.array([-4.0, 0.0]), np.array([4.0, 3.0]))
    ordinary, strange = forest.score(np.array([[0.0, 0.0], [0.0, 2.5]]))
    assert strange > ordinary + 0.1 and abs(walk(forest, (0.0, 2.5)) - strange) < 1e-12


def test_catches_bad_and_keeps_good(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(25, 200))) for _ in range(600)]
    bad = [" ".join(word() + "###" for _ in range(rng.randint(25, 200))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(0, 660, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert len([i for i in kept if i < 600]) >= 590 and not [i for i in kept if i >= 600]


def test_long_text(spark):
    rows = [(1, "one two three four five six seven eight nine ten " * 200_000), (2, " ".join(map(str, range(300_000))))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, _id int")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (2_000_000, 2_000_000, False)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].kept) == (300_000, 0, True)


def test_edges(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:30])] + [(None, "w " * 30, 1), (3, "q " * 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, _id int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r[c] for c in quality.STATS)) for r in got) == sorted((i is None, i or 0, brute(t)) for i, t, _ in rows)
    assert all(r.kept is (not r.base_failed) for r in got)
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op7_quality(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        n, *rest = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
    stats = spark.createDataFrame([(r.doc_id, *[r[c] for c in quality.STATS]) for r in got], "_id long, " + ", ".join(f"{c} long" for c in quality.STATS))
    forest = quality.fit(stats, spark.read.parquet(f"{d}/labels.parquet"))
    for r in got:
        x = quality.features(np.array([[r[c] for c in quality.STATS]]))[0]
        assert r.kept == (not r.base_failed and walk(forest, x) <= forest.threshold)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    told = [(labels[r.doc_id], r.kept) for r in got if labels.get(r.doc_id) is not None and not r.base_failed]
    assert sum(kept for q, kept in told if q) >= 0.98 * sum(q > 0 for q, _ in told)
    assert sum(not kept for q, kept in told if not q) >= 0.7 * sum(q == 0 for q, _ in told)
