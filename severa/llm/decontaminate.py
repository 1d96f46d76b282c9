"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every training window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.llm.common import decided, placed, rows_of, small, written

WINDOW = 10
#: Windows of the test set that may be broadcast, and bytes of their words; beyond, the probe is a shuffled join.
SET_ROWS = 2_000_000
SET_BYTES = 256 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: maximal runs of a-z, 0-9 and all beyond ASCII. Null: none."""
    whole = F.coalesce(text, F.lit(""))
    # lower() also changes letters beyond ASCII, so it serves texts without any
    low = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df with column words -> for each length L an array h{L}, its i-th element a hash of L and the L words from i.

    Hashes of 1, 2, 4, 8 and more words are built from each other, so that each costs one step a word.
    """
    powers = [1 << k for k in range(max(lengths, default=1).bit_length())]
    out = df.withColumn("p1", F.transform("words", lambda w: F.xxhash64(w)))

    def joined(a: str, b: str, skip: int, length: int, mark: Column | None = None) -> Column:
        n = F.greatest(F.size("words") - (length - 1), F.lit(0))
        made = (lambda x, y: F.xxhash64(x, y)) if mark is None else (lambda x, y: F.xxhash64(mark, x, y))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(skip + 1), n), made)

    def marked(mark: Column):
        return lambda x: F.xxhash64(mark, x)

    for half in powers[:-1]:
        out = out.withColumn(f"p{2 * half}", joined(f"p{half}", f"p{half}", half, 2 * half))
    for length in lengths:
        largest = 1 << (length.bit_length() - 1)
        if largest == length:
            out = out.withColumn(f"h{length}", F.transform(f"p{length}", marked(F.lit(length))))
        else:  # two overlapping powers cover the window
            out = out.withColumn(f"h{length}", joined(f"p{largest}", f"p{largest}", length - largest, length, F.lit(length)))
    return out.drop(*[f"p{k}" for k in powers])


def test_windows(items: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows of the test items, distinct by item: item, length and window (its words, space-joined).

    An item of fewer words than window, but not none, is one window; items without words have none.
    """
    spelt = items.select(F.col(id_column).alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    one = spelt.withColumn("length", length).select("item", "words", "length", starts.alias("start"))
    return one.select("item", "length", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("window")).distinct()


def hits(docs: DataFrame, pairs: DataFrame, keep: list[str], text: str = "text", every: bool = True) -> DataFrame:
    """docs' rows with windows of pairs (test_windows(), written): the columns keep, n_words, spans (first word and length) and
    windows, distinct each. With every, rows without any come back too, both empty.

    The windows are hashed and, up to SET_ROWS and SET_BYTES, broadcast: every window of every document probes them in
    one stage, and a hit is verified on its words there; only hits, and a mark of each document, are shuffled. Beyond,
    a window's hash and place are shuffled, without any words; hits come together by row, which verifies all its own at once.
    """
    found = written(pairs.select("length", "window").distinct(), "windows")
    lengths = sorted(r.length for r in found.select("length").distinct().collect())  # at most window values
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], words(F.col(text)).alias("words"))
    kept = [f"_k{i}" for i in range(len(keep))]
    named = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    none = [F.array().cast("array<struct<start:int,length:int>>").alias("spans"), F.array().cast("array<string>").alias("windows")]
    if not lengths:
        return rows.where(F.lit(every)).select(*named, F.size("words").alias("n_words"), *none)
    spelt = _with_hashes(found.withColumn("words", F.split("window", " ")), lengths)
    chosen = F.coalesce(*[F.when(F.col("length") == k, F.element_at(f"h{k}", 1)) for k in lengths])
    probes = written(spelt.select(chosen.alias("hash"), F.col("length").alias("of_length"), "window"), "probes")
    size = probes.agg(F.count("*").alias("n"), F.sum(F.octet_length("window")).alias("bytes")).first()
    fits = size.n <= SET_ROWS and size.bytes <= SET_BYTES
    if not fits:
        rows = written(rows, "spelt")
    # the arrays of the lengths stand one after the other, behind a document's mark: a place tells its length and first word
    place, before = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("length")), F.lit(1)
    for k in lengths:
        place = F.when(F.col("_at") >= before, F.struct((F.col("_at") - before).alias("start"), F.lit(k).alias("length"))).otherwise(place)
        before = before + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    hashes = F.concat(F.array(F.lit(0).cast("long")), *[F.col(f"h{k}") for k in lengths])
    spread = _with_hashes(rows, lengths).select("_row", *kept, "words", F.size("words").alias("n_words"), F.posexplode(hashes).alias("_at", "_hash"))
    same = lambda at, window: F.array_join(F.slice("words", at["start"] + 1, at["length"]), " ") == window
    if fits:
        mark = docs.sparkSession.createDataFrame([(0, 0, "")], probes.schema)  # its window has no words, so no other is equal
        table = written(probes.union(mark), "probes") if every else probes
        met = spread.join(F.broadcast(table), spread["_hash"] == table["hash"]).withColumn("place", place)
        is_mark = (F.col("of_length") == 0) & (F.col("_at") == 0)
        is_hit = (F.col("of_length") > 0) & (F.col("place.length") == F.col("of_length")) & same(F.col("place"), F.col("window"))
        met = met.where(is_mark | is_hit).select("_row", *kept, "n_words", F.when(~is_mark, F.col("place")).alias("place"), F.when(~is_mark, F.col("window")).alias("window"))
        told = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in kept], F.first("n_words").alias("n_words"), F.collect_set("place").alias("spans"), F.collect_set("window").alias("windows"))
        return told.select(*named, "n_words", "spans", "windows")
    met = spread.where("_at > 0").select("_row", "_hash", place.alias("place")).join(probes, F.col("_hash") == F.col("hash")).where("place.length = of_length")
    maybe = met.groupBy("_row").agg(F.collect_list(F.struct("place", "window")).alias("maybe"))
    true = F.filter("maybe", lambda x: same(x["place"], x["window"]))
    told = rows.join(written(maybe, "maybe"), "_row", "left" if every else "inner").select(*kept, F.size("words").alias("n_words"), true.alias("true"))
    told = told.select(*named, "n_words", F.coalesce(F.transform("true", lambda x: x["place"]), none[0]).alias("spans"), F.coalesce(F.array_distinct(F.transform("true", lambda x: x["window"])), none[1]).alias("windows"))
    return told if every else told.where(F.size("spans") > 0)


def covered(spans: str = "spans") -> Column:
    """The number of distinct words inside spans."""
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(s["upto"], end).alias("upto"), (s["n"] + F.greatest(end - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), state, step, lambda s: s["n"])


def _items_of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """sets (of, windows) -> of, n_items and items_sha256, where there is an item. Windows and items meet as pairs, never as
    lists of lists; an item counts once however many of its windows a set has."""
    items = pairs.where("item is not null").select(F.col("item").cast("string").alias("item"), "window")
    met = sets.select("of", F.explode("windows").alias("window")).join(items, "window").select("of", "item").distinct()
    told = met.groupBy("of").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return told.select("of", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def report(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: its id, n_words, n_hit (words inside any occurrence), n_items, items_sha256 and contaminated.

    Null and empty texts have no words and no hits. Repeated rows come back repeated. Without items nothing is hit.
    Other columns of either table are ignored; a null item id counts as no item, though its windows hit. Texts of any
    length are taken whole. Documents with the same windows, such as copies, share the search for their items.
    """
    pairs = written(test_windows(items, item_id, item_text, window), "pairs")
    met = hits(docs, pairs, [id_column], text)
    of = F.when(F.size("windows") > 0, F.sha2(F.array_join(F.array_sort("windows"), "\n").cast("binary"), 256))
    met = written(met.select(F.col(id_column).alias("_id"), F.col("n_words").cast("long").alias("n_words"), covered().cast("long").alias("n_hit"), of.alias("of"), F.when(F.size("windows") > 0, F.col("windows")).alias("windows")), "hits")
    found = met.where("of is not null")
    told = written(_items_of(found.dropDuplicates(["of"]).select("of", "windows"), pairs), "items")
    no_item = F.sha2(F.lit("").cast("binary"), 256)
    hit = found.join(small(told), "of", "left").select("_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", no_item).alias("items_sha256"), F.lit(True).alias("contaminated"))
    clear = met.where("of is null").select("_id", "n_words", "n_hit", F.lit(0).cast("long"), no_item, F.lit(False))
    return hit.union(clear).withColumnRenamed("_id", id_column)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold an occurrence of a test window; all columns, clean rows as they were.

    Null and empty texts stay. Only the places of contaminated rows come back to the texts, which aren't shuffled.
    """
    rows = placed(docs)
    pairs = written(test_windows(items, item_id, item_text, window), "pairs")
    bad = hits(rows.select("_file", "_at", F.col("_in")[text].alias("_text")), pairs, ["_file", "_at"], "_text", every=False)
    return decided(rows, bad.select("_file", "_at", F.lit(0).alias("n")), 1).where("_n = 1").select(*rows_of(docs))
