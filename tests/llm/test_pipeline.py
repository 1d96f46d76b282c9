"""run() against a brute-force version of its stages on the smallest tables."""

import zlib

import pytest
import test_decontaminate
import test_langid
import test_mixing
import test_pii
import test_simhash

import corpus_pipeline

D = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for start, _, end, kind in test_pii.brute(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = docs.collect()
    told = test_langid.plain_bayes([(r.doc_id, r.text, r.lang) for r in rows], [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows])
    kept = [r for k, r in enumerate(rows) if told[k][0] != "und" and told[k][1] >= 0.5]
    group = test_simhash.brute([(r.doc_id, test_simhash.plain(r.text)) for r in kept])
    kept = [r for r in kept if group[r.doc_id] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, *_, hit in test_decontaminate.brute([(r.doc_id, r.text) for r in kept], items) if hit}
    want = {r.doc_id: (masked(r.text), r.lang, r.source, len(masked(r.text))) for r in kept if r.doc_id not in bad}

    got = corpus_pipeline.run(spark, D)
    assert got.columns == [*docs.columns, "copy"]
    found = got.collect()
    copies = {}
    for r in found:
        assert (r.text, r.lang, r.source, r.n_chars) == want[r.doc_id]
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 3 for x in copies.values())
    sizes, rows = {}, {}
    for text, _, source, _ in want.values():
        sizes[source] = sizes.get(source, 0) + test_mixing.size(text)
        rows[source] = rows.get(source, 0) + 1
    for source, target in test_mixing.water(sizes).items():
        taken = sum(len(x) for i, x in copies.items() if want[i][2] == source)
        assert abs(taken - target / sizes[source] * rows[source]) <= 1


ROWS = [
    (1, "the cat and the dog went to the house of the king", "en", "a", 49, {"k": 1}, 3, "x"), (1, "the cat and the dog went to the house of the king", "en", "a", 49, {"k": 1}, 3, "x"),
    (2, "der Hund und die Katze gehen in das Haus des Konigs", "de", None, 51, None, 4, None), (3, None, "en", "a", 0, {}, 5, "y"), (4, "", "de", "b", 0, {}, 6, "y"), (5, "123 !!", None, "b", 6, {}, 7, "y"),
    (None, "the horse and the bird write to me@mail.example of the house", None, "b", 60, {}, 8, "y"), (7, "the word and " * 30_000, "en", "b", 390_000, {}, 9, "z"), (8, "einig " * 3 + "die Stadt und der Wald", "de", "a", 40, {}, 1, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, copy int, _in string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, name, stage):
    """Nulls, repeats, ties, empty and long texts, extra columns with clashing names and types, and no rows at all."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = stage(spark, docs, D)
    assert got.columns == [*docs.columns, *(["copy_2"] if name == "mixing" else [])]
    rows = got.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    texts = {r.text for r in rows}
    if name == "language":
        assert {None, "", "123 !!"}.isdisjoint(texts) and len(rows) >= 5
    elif name == "near_duplicates":  # one of the repeated rows, one of the rows without words
        assert ids == ["1", "2", "3", "5", "7", "8", "None"]
    elif name == "decontamination":
        assert len(rows) == len(ROWS)
    elif name == "personal_data":
        assert len(rows) == len(ROWS) and [r.text for r in rows if r.doc_id is None] == ["the horse and the bird write to [EMAIL] of the house"] and None in texts
    else:
        assert all(1 <= r.copy_2 <= 3 for r in rows)
    assert stage(spark, docs.limit(0), D).count() == 0


def test_run_on_no_documents(spark, tmp_path):
    spark.read.parquet(f"{D}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").limit(0).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
