"""WARC archives: writing them, normalising whole-file gzip streams to one member a record, and reading by index.

Archives are written by Spark's text writer, whose gzip stream is one member for the whole file. The normaliser
inflates each such stream once, in order and in bounded memory, rewrites every record as a member of its own, and
writes a sidecar with every record's offset, so that any range of records can be read alone.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.llm.common import dealt, fresh_folder, written

#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 1000
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes that one reading task takes, about.
SPAN_BYTES = 16 << 20
LEVEL = 3
SIDECAR = ".index.jsonl"

INDEX = "archive string, record long, offset long, length long, type string, page_id long"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null. Controls and spaces are percent-encoded, so that a value stays one line."""
    safe = F.regexp_replace(value, "[\\x00-\\x20\\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def with_referents(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, html (null: empty), payload_bytes, payload_digest, referent.

    referent is the largest page_id with an equal payload of at least LEAST_SHARED bytes; equal are payloads with the
    same SHA-1 and size. Largest ids combine before the shuffle, and only payloads that two rows share are joined back.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    told = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    slim = told.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("referent"), F.count("*").alias("n"))
    shared = written(slim.where("n > 1").drop("n"), "shared")
    return told.join(shared, ["payload_digest", "payload_bytes"], "left")


def records(pages: DataFrame) -> DataFrame:
    """with_referents() rows -> page_id and record, a whole WARC record as text, without its last line feed."""
    revisit = F.col("referent").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("referent"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record_id = F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:>"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("referent")), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(head, block, F.lit("\r\n\r")).alias("record"))


def write(pages: DataFrame, folder: str, per_file: int = 50_000) -> None:
    """Writes the records of pages as .gz files, each one gzip stream of at most per_file records.

    The writer ends every row with a line feed, which is a record's last byte.
    """
    records(pages).select("record").write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(folder)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn: str | None) -> int | None:
    """The page id in <urn:page:N>; none in any other identifier."""
    number = urn[10:-1] if urn and urn.startswith("<urn:page:") and urn.endswith(">") else ""
    return int(number) if number.lstrip("-").isdigit() else None


def _cut(buffer: bytearray, at: int) -> tuple[int, dict[str, str]] | None:
    """The end of the record at a place of the buffer, and its headers; None if it isn't all there."""
    end = buffer.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    headers = _headers(bytes(buffer[at:end]))
    upto = end + 4 + int(headers["content-length"]) + 4
    return (upto, headers) if upto <= len(buffer) else None


class _Archive:
    """A normalised archive that is being written, and its sidecar. Both get their names when they are complete."""

    def __init__(self, folder: str, source: str):
        self.store, top = fs.FileSystem.from_uri(folder)
        name = posixpath.basename(source).split(".")[0]
        self.path = f"{top}/{name}-{hashlib.sha1(source.encode()).hexdigest()[:8]}.warc.gz"
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.store.create_dir(top, recursive=True)
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.index: list[tuple] = []
        self.offset = 0

    def add(self, record: bytes, headers: dict[str, str]) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.index.append((self.path, len(self.index), self.offset, len(member), headers.get("warc-type"), _page(headers.get("warc-record-id"))))
        self.offset += len(member)

    def close(self) -> list[tuple]:
        self.out.close()
        with self.store.open_output_stream(self.temporary + SIDECAR, compression=None) as f:
            for row in self.index:
                f.write((json.dumps(dict(zip(("record", "offset", "length", "type", "page_id"), row[1:]))) + "\n").encode())
        # another attempt of the same task writes the same bytes; the last rename stands
        self.store.move(self.temporary + SIDECAR, self.path + SIDECAR)
        self.store.move(self.temporary, self.path)
        return self.index


def normalise(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Rewrites every whole-file gzip stream of WARC records in folder to out; returns the index of all records.

    Each file is inflated once, as a stream of lines in order, by one task; at most a record and a batch of lines are
    held. Any .gz file is read so, of one member or of many. A file that ends inside a record raises an error.
    Attempts write under names of their own and rename at the end, so a lost executor leaves no half archive.
    """
    lines = spark.read.option("lineSep", "\n").text(folder).select("*", "_metadata.file_path")
    # the path is told only where a file may begin
    rows = lines.select(F.col("value").cast("binary").alias("value"), F.when(F.col("value").startswith("WARC/"), F.col("file_path")).alias("path"))

    def rewritten(batches):
        archive, source, buffer = None, None, bytearray()

        def drained():
            at = 0
            while at < len(buffer) and (cut := _cut(buffer, at)):
                archive.add(bytes(buffer[at : cut[0]]), cut[1])
                at = cut[0]
            del buffer[:at]

        def closed():
            drained()
            if buffer:
                raise ValueError(f"{source} ends inside a record")
            index = archive.close()
            columns = [pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            return [pa.RecordBatch.from_arrays(columns, names=["archive", "record", "offset", "length", "type", "page_id"])] if index else []

        for batch in batches:
            paths = batch.column(1).to_pylist()
            values = batch.column(0).to_pylist()
            start = 0
            for i, path in enumerate(paths):
                if path is not None and path != source:
                    if archive:
                        buffer += b"".join(v + b"\n" for v in values[start:i])
                        yield from closed()
                    archive, source, start = _Archive(out, path), path, i
                    buffer.clear()
            buffer += b"".join(v + b"\n" for v in values[start:])
            if archive:
                drained()
        if archive:
            yield from closed()

    return written(rows.mapInArrow(rewritten, INDEX), "index")


def spans(index: DataFrame) -> DataFrame:
    """Ranges of whole records of about SPAN_BYTES: archive, first (offset) and lengths, those of its members in order."""
    part = F.floor(F.col("offset") / SPAN_BYTES).alias("part")
    members = F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members")
    return index.groupBy("archive", part).agg(members).select("archive", F.col("members")[0]["offset"].alias("first"), F.col("members.length").alias("lengths"))


def read(index: DataFrame, folder: str) -> DataFrame:
    """Reads the archives in folder back, each range of records by its offsets: one row per record, checked against its digest.

    page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit, which has none; its
    size and digest are those it names).
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def told(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(path) as f:
                    data = f.read_at(sum(lengths), first)
                rows, held, at = [], 0, 0
                for length in lengths:  # the index tells where each member ends
                    try:
                        record = bytearray(zlib.decompress(data[at : at + length], 31))
                    except zlib.error as e:
                        raise ValueError(f"{path}: a member is cut off") from e
                    at += length
                    _, headers = _cut(record, 0)
                    block = bytes(record[record.find(b"\r\n\r\n") + 4 : -4])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    size = int(_headers(http)["content-length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append((_page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to")), payload if kind == "response" else None))
                    held += len(payload)
                    if held > SPAN_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    ranges = written(spans(index), "spans")
    return dealt(ranges, "archive", "first").mapInArrow(told, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def archive(pages: DataFrame, out: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages (page_id, url, html) as normalised archives; their index and folder.

    Payloads of any length are whole records; a task holds the one it works on and, reading, a range of SPAN_BYTES. Nulls: html is an empty payload, url leaves the target out, page_id an identifier without a number. Rows that
    repeat a page_id are records of their own. Other columns are ignored; an empty table gives no archive.
    """
    spark = pages.sparkSession
    whole = fresh_folder(spark, "whole")
    out = out or fresh_folder(spark, "warc")
    write(with_referents(pages), whole)
    index = normalise(spark, whole, out)
    store, path = fs.FileSystem.from_uri(whole)
    store.delete_dir(path)
    return index, out
