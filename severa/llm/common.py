"""What the operators share: row keys, size-checked broadcasts, and decisions on rows by their place in a table's files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from severa.functions.durable import fresh_folder, remove, scratch, shared_folder, written  # noqa: F401

#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: 2^BLOCK_BITS rows of a file share a block of decisions, a byte each, and the blocks that may be broadcast: 128 MB.
BLOCK_BITS = 16
BROADCAST_BLOCKS = 2048
#: Pieces of work up to which each is a task, and those beyond that share one.
TASKS = 2000
PIECES_A_TASK = 16


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (BROADCAST_ROWS), counted here; else df, to be joined by a shuffle.

    df has to be cheap to count: a written table or an aggregate.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(pieces: DataFrame, *key: str) -> DataFrame:
    """pieces, a written table of rows that each stand for much work (a range of a file to read), dealt out by key: a task
    for each, or for PIECES_A_TASK of them where there are thousands. An explicit number, as few small rows would else become one task."""
    n = pieces.count()
    return pieces.repartition(max(1, n if n <= TASKS else TASKS + (n - TASKS) // PIECES_A_TASK), *key)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame, *columns: str) -> Column:
    """A key of a row's content in these columns of df, 128 bits as text. A null differs from every value; maps count as JSON."""
    parts = []
    for c in columns:
        col = F.col(f"`{c}`")
        parts += [col.isNull(), col if _hashable(df.schema[c].dataType) else F.to_json(F.struct(col))]
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(i), *parts)) for i in (1, 2)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested(docs: DataFrame, **made: Column) -> DataFrame:
    """docs' rows in one column, beside columns that can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), *[c.alias(name) for name, c in made.items()])


def rows_of(docs: DataFrame) -> list[Column]:
    """docs' columns, out of nested()'s column."""
    return [F.col("_in")[c].alias(c) for c in docs.columns]


def placed(docs: DataFrame, **made: Column) -> DataFrame:
    """nested() rows with their place: _file, a hash of their file's path, and _at, their number in the file.

    A plain scan of Parquet files has such places by itself, whatever is selected from it later; anything else is
    written first. So a row is the same row in every pass, and after a lost executor.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "rows")
    try:
        at = docs.metadataColumn("_metadata")
        return nested(docs, _file=F.xxhash64(at["file_path"]), _at=at["row_index"], **made)
    except AnalysisException:  # files of another format have no row numbers
        docs = written(docs, "rows")
        at = docs.metadataColumn("_metadata")
        return nested(docs, _file=F.xxhash64(at["file_path"]), _at=at["row_index"], **made)


def decided(rows: DataFrame, told: DataFrame, default: int) -> DataFrame:
    """placed() rows with _n: the digit that told (_file, _at, n) has for the row, else default.

    The digits of 2^BLOCK_BITS places of a file are one text. These blocks, a byte a row, are broadcast up to
    BROADCAST_BLOCKS, so that no text is shuffled; more are joined by a shuffle.
    """
    inside, block = F.col("_at").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int"), F.shiftright("_at", BLOCK_BITS).alias("_block")
    digit = F.struct(inside.alias("at"), F.col("n").cast("string").alias("n"))
    listed = told.groupBy("_file", block).agg(F.array_sort(F.collect_list(digit)).alias("s"))
    last = lambda i: F.when(i > 0, F.get("s", i - 1)["at"]).otherwise(F.lit(-1))
    pieces = F.transform("s", lambda x, i: F.concat(F.repeat(F.lit(str(default)), x["at"] - last(i) - 1), x["n"]))
    blocks = written(listed.select("_file", "_block", F.array_join(pieces, "").cast("binary").alias("_digits")), "blocks")
    met = rows.withColumn("_block", block).join(small(blocks, BROADCAST_BLOCKS), ["_file", "_block"], "left")
    one = F.substring("_digits", inside + 1, F.lit(1)).cast("string")
    return met.withColumn("_n", F.coalesce(F.nullif(one, F.lit("")).cast("int"), F.lit(default))).drop("_block", "_digits")
