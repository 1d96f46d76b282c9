"""Token counts from flat token files: a vectorised separator scan, stitched across blocks with a prefix scan."""

from __future__ import annotations

import base64
import functools
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from severa.llm.common import dealt, fresh_folder, written

#: The vocabulary's place is a parameter; the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before merging: contractions, letters, digits, other characters and white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SEPARATOR = 50256
WIDTH = "<u2"
BLOCK_BYTES = 8 << 20


@functools.cache
def _encoding(vocabulary: str):
    import tiktoken

    store, path = _store(vocabulary)
    with store.open_input_stream(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Writes the documents' tokens to flat files in folder, a file per task, a separator after each document.

    The files hold nothing but little-endian 16-bit identifiers. Returns the manifest: file, ordinal (the document's
    place in it) and the id. A task writes under a name of its own and renames at the end, so that a lost
    executor's work is written again whole. Null texts have no tokens.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def flat(batches):
        encoding = _encoding(vocabulary)
        if not encoding.n_vocab <= separator < 1 << 16:
            raise ValueError(f"separator {separator} has to be beyond the {encoding.n_vocab} tokens of the vocabulary and within 16 bits")
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        path = f"{top}/tokens-{TaskContext.get().partitionId():05d}.bin"
        temporary = f"{top}/_{uuid.uuid4().hex}"
        n = 0
        end = np.array([separator], WIDTH).tobytes()
        with store.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for data in batch.column(1):
                    tokens = encoding.encode_ordinary(data.as_py() or "")
                    out.write(np.array(tokens, WIDTH).tobytes() + end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([posixpath.basename(path)] * batch.num_rows, pa.string()), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "id"]
                )
                n += batch.num_rows
        if n:
            store.move(temporary, path)
        else:
            store.delete_file(temporary)

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("id", slim.schema["id"].dataType)])
    return written(slim.mapInArrow(flat, schema), "manifest")


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of all .bin files in folder: path, first (token) and tokens. Only names and sizes are read."""
    store, top = _store(folder)
    found = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.extension == "bin" and f.size]
    width = np.dtype(WIDTH).itemsize
    if bad := next((p for p, size in found if size % width), None):
        raise ValueError(f"{bad} isn't a whole number of tokens")
    step = max(1, block_bytes // width)
    files = spark.createDataFrame([(p, size // width) for p, size in found], "path string, total long")
    cut = files.select("path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(step).cast("long"))).alias("first"))
    return cut.select("path", "first", F.least(F.lit(step), F.col("total") - F.col("first")).alias("tokens"))


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the flat files in folder: file, ordinal, first (its first token), n_tokens and ended.

    Each block is read and searched on its own, as one vector comparison. Then a prefix scan over the blocks'
    summaries (separators, and the last one's place) gives every block the number of documents before it and where
    its first document began, maybe blocks before. Tokens after a file's last separator are a document that has not
    ended. A document may have no tokens. No files: no rows.
    """
    width = np.dtype(WIDTH).itemsize

    def searched(batches):
        store, _ = _store(folder)
        for batch in batches:
            for path, first, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(tokens * width, first * width), WIDTH)
                at = np.flatnonzero(data == separator) + first
                last = int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([first]), pa.array([tokens]), pa.array([len(at)]), pa.array([last], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                    names=["path", "first", "tokens", "n", "last", "at"],
                )

    whole = written(blocks(spark, folder, block_bytes), "blocks")
    found = dealt(whole, "path", "first").mapInArrow(searched, "path string, first long, tokens long, n long, last long, at array<long>")
    found = written(found, "separators")
    here = Window.partitionBy("path").orderBy("first")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "path", "first", "tokens", "last",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"),
        F.lead("first").over(here).isNull().alias("final"),
    )
    carried = written(carried, "carried")
    joined = carried.where("last is not null").drop("tokens", "last", "final").join(found.select("path", "first", "at"), ["path", "first"])
    starts = F.concat(F.array("open"), F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda x: x + 1))
    spans = F.arrays_zip(starts.alias("begins"), F.col("at").alias("ends"))
    ended = joined.select("path", "documents", F.posexplode(spans).alias("k", "span")).select(
        "path", (F.col("documents") + F.col("k")).alias("ordinal"), F.col("span.begins").alias("first"), (F.col("span.ends") - F.col("span.begins")).alias("n_tokens"), F.lit(True).alias("ended")
    )
    # of the last block, what no separator ends
    own = F.greatest(F.col("open"), F.coalesce(F.col("last") + 1, F.lit(0)))
    rest = carried.where("final").select("path", "documents", "first", own.alias("begins"), (F.col("first") + F.col("tokens") - own).alias("n_tokens"))
    counts = found.select("path", "first", "n")
    rest = rest.where("n_tokens > 0").join(counts, ["path", "first"]).select("path", (F.col("documents") + F.col("n")).alias("ordinal"), F.col("begins").alias("first"), "n_tokens", F.lit(False).alias("ended"))
    return ended.union(rest).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "ordinal", "first", "n_tokens", "ended")


def count(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs: its id, n_tokens and its place (file, ordinal) in flat files that are written here and scanned.

    Null and empty texts have no tokens. Repeated rows come back repeated. An empty table gives an empty one. Other
    columns are ignored.
    """
    folder = fresh_folder(docs.sparkSession, "tokens")
    manifest = write(docs, folder, id_column, text, vocabulary)
    told = scan(docs.sparkSession, folder)
    return manifest.join(told, ["file", "ordinal"]).select(F.col("id").alias(id_column), "n_tokens", "file", "ordinal")
