import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from severa.llm import warc


def brute(pages):
    rows = [(p, (h or "").encode()) for p, _, h in pages]
    most = {}
    for p, b in rows:
        if len(b) >= 1000:
            most[b] = max([x for x in (most.get(b), p) if x is not None], default=None)
    out = []
    for p, b in rows:
        ref = most.get(b)
        again = ref is not None and p != ref and sum(x == b for _, x in rows) > 1
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


PAGES = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 999), (4, "u\r\nWARC-Type: fake", "x" * 999), (5, "http://é/", None), (6, "", ""),
    (7, "h", "WARC/1.1\r\n\r\n\nWARC/1.0\nContent-Length: 3\r\n\r\n"), (8, "h", "é\r\n" * 800), (9, "h", "é\r\n" * 800), (None, "h", "é\r\n" * 800), (9, "h", "\n" * 5000), (11, "h", "y\x00z\x1c" * 200000), (None, None, "q" * 3000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    pages = frame(spark, PAGES)
    index, folder = warc.archive(pages)
    got = warc.read(index, folder)
    assert digest(got) == brute(PAGES)
    payloads = sorted(r.payload for r in got.collect() if r.payload is not None)
    assert payloads == sorted((h or "").encode() for (p, _, h), t in zip(PAGES, [next(b[3] for b in brute(PAGES) if b[0] == p and b[2] == hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in PAGES]) if t == "response")


def test_members_and_sidecar(spark, tmp_path):
    index, folder = warc.archive(frame(spark, PAGES), f"file://{tmp_path}/out")
    found = 0
    for path in (tmp_path / "out").glob("*.warc.gz"):
        data = path.read_bytes()
        for line in open(f"{path}{warc.SIDECAR}"):
            x = json.loads(line)
            record = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            found += 1
    assert found == len(PAGES) == index.count()


def test_small_spans(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN_BYTES", 64)
    index, folder = warc.archive(frame(spark, PAGES))
    assert warc.spans(index).count() > 3
    assert digest(warc.read(index, folder)) == brute(PAGES)


def test_reading_takes_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN_BYTES", 64)
    index, folder = warc.archive(frame(spark, PAGES))
    tasks = warc.read(index, folder).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= min(8, warc.spans(index).count() // 2)


def test_reading_takes_time_by_records(spark):
    """A span of four times the records takes about four times as long."""
    import time

    took = []
    for n in (1000, 4000, 16000):
        pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.lit("x" * 1500)).alias("html"))
        index, folder = warc.archive(pages.coalesce(1))
        assert warc.spans(index).count() == 1
        began = time.perf_counter()
        assert warc.read(index, folder).drop("payload").count() == n
        took.append(time.perf_counter() - began)
    assert took[2] - took[0] < 8 * max(took[1] - took[0], 0.3)


def test_truncated(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(record))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").count()


def test_empty(spark):
    index, folder = warc.archive(frame(spark, PAGES).limit(0))
    assert warc.read(index, folder).count() == 0


def test_query(spark):
    from severa.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    assert digest(queries.op4_warc(spark, d)) == brute(rows)
