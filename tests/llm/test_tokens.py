import numpy as np
import pytest

from severa.llm import tokens


def put(folder, name, ids):
    folder.mkdir(exist_ok=True)
    np.array(ids, tokens.WIDTH).tofile(folder / name)


def brute(ids, sep):
    out, first = [], 0
    for i, x in enumerate(ids):
        if x == sep:
            out.append((len(out), first, i - first, True))
            first = i + 1
    return out + ([(len(out), first, len(ids) - first, False)] if first < len(ids) else [])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan(spark, tmp_path, block):
    rng = np.random.default_rng(3)
    files = {f"f{k}.bin": rng.choice([7, 8, 9], n, p=p) for k, (n, p) in enumerate([(200, [0.9, 0.05, 0.05]), (50, [0.2, 0.2, 0.6]), (40, [0.5, 0.5, 0]), (1, [0, 0, 1]), (1, [1, 0, 0])])}
    for name, ids in files.items():
        put(tmp_path / "t", name, ids)
    put(tmp_path / "t", "empty.bin", [])
    got = tokens.scan(spark, f"file://{tmp_path}/t", separator=9, block_bytes=block).collect()
    want = [(name, *x) for name, ids in files.items() for x in brute(ids.tolist(), 9)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_blocks_are_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    put(tmp_path / "t", "a.bin", list(range(84)))
    seen = []
    monkeypatch.setattr(tokens, "dealt", lambda *a, f=tokens.dealt: (seen.append(f(*a)), seen[-1])[1])
    tokens.scan(spark, f"file://{tmp_path}/t", separator=9, block_bytes=2).count()
    assert seen[0].select(F.spark_partition_id().alias("p")).distinct().count() > 40


def test_separator_has_to_be_free(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (7, 1 << 16):
        with pytest.raises(Exception, match="separator"):
            tokens.write(docs, tokens.fresh_folder(spark, "x"), separator=bad)


def test_no_files(spark, tmp_path):
    assert tokens.scan(spark, f"file://{tmp_path}/none").count() == 0


def test_cut_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole number"):
        tokens.scan(spark, f"file://{tmp_path}")


def test_count(spark):
    rows = [(1, "Hello there, it's 2024!", "q"), (2, None, "q"), (3, "", "q"), (None, "é ü 😀", "q"), (5, "word " * 20000, "q"), (5, "a", "q"), (5, "a", "q"), (6, "<|endoftext|>", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ordinal string")
    encoding = tokens._encoding(tokens.VOCABULARY)
    want = sorted((str(i), len(encoding.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.count(docs).collect()) == want
    assert tokens.count(docs.limit(0)).count() == 0


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.001"
    encoding = tokens._encoding(tokens.VOCABULARY)
    want = sorted((r.doc_id, len(encoding.encode_ordinary(r.text or ""))) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op9_tokens(spark, d).collect())) == want
