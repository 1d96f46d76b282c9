"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.llm.common import decided, placed, rows_of, small, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows that one window of the prefix sum holds, about: the square root of all rows, and so many at least. There are
#: then about as many slices as a slice has rows, and either level of the prefix sum stays small.
SLICE_ROWS = 200


def n_words(text: Column) -> Column:
    """The number of maximal runs without ASCII white space; null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, size) -> source, source_size, rank and target.

    Sources in code point order, null last, weigh weights, repeating, and share the sum of sizes. A target stops at
    most times its source's size and the excess goes to the others by weight until none is above: sources are filled
    in order of size by weight, and the rest share what is left at the first place where no next one is above.
    """
    one = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(one))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_room = Window.orderBy(F.col("size") / F.col("weight"), "rank")
    behind = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    step = ranked.select(
        "*",
        F.sum("size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("size").over(behind), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(behind), F.lit(0)).alias("full_weight"),
    )
    # what a unit of weight gets if all sources behind are full
    step = step.withColumn("each", (F.col("total") - most * F.col("full")).cast("double") / (F.col("weights") - F.col("full_weight")).cast("double"))
    step = step.withColumn("fits", F.col("each") * F.col("weight") <= most * F.col("size"))
    level = F.min_by(F.when(F.col("fits"), F.col("each")), F.when(F.col("fits"), F.struct(F.col("size") / F.col("weight"), F.col("rank")))).over(everything)
    step = step.withColumn("level", level)
    target = F.least(F.col("level") * F.col("weight"), (most * F.col("size")).cast("double"))
    return step.select("source", F.col("size").alias("source_size"), "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def _size_class(size: Column) -> Column:
    """Eight classes an octave, in order of size: the number's bit length, then its three bits below the first."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.call_function("shiftright", size, (bits - 4).cast("int")) % 8).cast("int")


def copies(sizes: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (id, source, size, part and any others) with source_size, target and copies, the number of times the mix takes the row.

    Systematic sampling: in each source all documents expect target / source size copies; their prefix sum, plus an
    offset drawn once for the source, crosses as many integers as the document has copies, at most `most`. Documents
    stand in order of size class and hash, so that each class is taken in proportion. The prefix sum has two levels:
    a document's place in its cell, and the documents before its cell. Cells are slices of the hashes; they depend on
    the counts and on the row alone, hold about as many rows as there are cells, and a lost executor finds the same
    again. An id that many rows share, or that many lack, would fill a slice: it becomes cells of its own, one for each
    of the input's parts, which a part's rows bound. The offset and the order come from md5 of seed, source and id:
    reruns agree.
    """
    df = sizes.withColumn("_drawn", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")))
    df = df.withColumn("_class", _size_class(F.col("size"))).withColumn("_at", F.conv(F.substring("_drawn", 1, 8), 16, 10).cast("long"))
    classes = written(df.groupBy("source", "_class").agg(F.count("*").alias("rows"), F.sum("size").alias("size")), "classes")
    told = written(targets(classes.groupBy("source").agg(F.sum("size").alias("size")), weights, most), "targets")
    slice_rows = max(SLICE_ROWS, int((classes.agg(F.sum("rows")).first()[0] or 0) ** 0.5))
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / slice_rows)).cast("long")
    plan = told.alias("t").join(classes.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:source:"), F.coalesce(F.col("t.source"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    plan = written(plan.select(F.col("t.source").alias("of"), F.col("c._class").alias("of_class"), slices.alias("slices"), "source_size", "target", offset.alias("offset"), "rank"), "plan")
    here = df.join(small(plan), df["source"].eqNullSafe(plan["of"]) & (df["_class"] == plan["of_class"])).drop("of", "of_class")
    here = here.withColumn("_slice", F.floor(F.col("_at") * F.col("slices") / F.lit(4294967296.0)).cast("long"))
    key = ["rank", "_class", "_slice"]
    full = written(here.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 4 * slice_rows).drop("rows"), "full")
    heavy = here.join(small(full), key, "left_semi").groupBy(*key, "_drawn").agg(F.count("*").alias("rows")).where(F.col("rows") > slice_rows)
    # each has more than slice_rows rows, so there are at most as many as cells
    heavy = written(heavy.groupBy(*key).agg(F.array_sort(F.collect_list("_drawn")).alias("heavy")), "heavy")
    none = F.lit(0).cast("long")
    if heavy.isEmpty():
        here = here.withColumn("_cell", none).withColumn("_part", none)
    else:  # by hash: the rows before a heavy one, its own, those between it and the next
        here = here.join(small(heavy), key, "left")
        own = F.coalesce(F.array_contains("heavy", F.col("_drawn")), F.lit(False))
        behind = F.coalesce(F.size(F.filter("heavy", lambda x: x < F.col("_drawn"))), F.lit(0))
        here = here.withColumn("_cell", (2 * behind + own.cast("int")).cast("long")).withColumn("_part", F.when(own, F.col("part")).otherwise(none)).drop("heavy")
    key += ["_cell", "_part"]
    before = Window.partitionBy("rank").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, -1)
    counts = here.groupBy(*key).agg(F.count("*").alias("rows"))
    starts = written(counts.select(*key, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")), "starts")
    here = here.join(small(starts), key)
    others = [c for c in sizes.columns if c not in ("id", "source", "size", "part")]
    inside = Window.partitionBy(*key).orderBy("_drawn", "size", "part", *others)
    here = here.withColumn("place", F.col("before") + F.row_number().over(inside))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    upto = lambda place: F.floor(rate * place.cast("double") + F.col("offset"))
    taken = upto(F.col("place")) - upto(F.col("place") - 1)
    return here.select(*sizes.columns, "source_size", "target", taken.cast("long").alias("copies"))


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """Per row of docs: id, size, source_size, target, taken (its words times its copies), source and copies.

    Null texts have size 0, null sources are a source of their own, last in order. Repeated rows are drawn each on
    its own. Sources without a word have target 0 and give nothing. An empty table gives an empty one. Texts are read
    once, whole; after that only sizes move.
    """
    sizes = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.spark_partition_id().alias("part"))
    got = copies(written(sizes, "sizes"), seed)
    return got.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: each document's row once per copy, with all its columns; documents with no copy are left out.

    A last column numbers a document's copies from 1. It is called copy, or, if docs has that, the first of copy_2, copy_3
    and so on that docs hasn't. Sizes are taken in one pass over the texts and decisions come back by a row's place in
    its file, so that texts are not shuffled.
    """
    rows = placed(docs)
    value = lambda c: F.col("_in")[c]
    sizes = rows.select(value(id_column).alias("id"), value(source).alias("source"), n_words(value(text)).alias("size"), F.spark_partition_id().alias("part"), "_file", F.col("_at").alias("_row"))
    told = copies(written(sizes, "sizes"), seed).select("_file", F.col("_row").alias("_at"), F.col("copies").alias("n"))
    got = decided(rows, told, 0).where("_n > 0")
    name = next(x for x in ("copy", *(f"copy_{i}" for i in range(2, len(docs.columns) + 3))) if x not in docs.columns)
    return got.select(*rows_of(docs), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias(name))
