"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2^BITS hash buckets for the n-grams of all ORDERS together; the model has that many rows and a column per language.
BITS = 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Code points whose n-grams are taken at once, of one text or of many, and cells of n-grams by languages.
CHUNK = 1 << 16
CELLS = 1 << 23
#: Languages whose counts a learning task holds before it passes them on: 0.5 MB each.
HELD_LANGUAGES = 64


@functools.cache
def _letters() -> np.ndarray:
    """By code point: the code point of the lower-cased letter, or a space for all that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(low) if len(low := c.lower()) == 1 else cp
    return table


def _codes(data: bytes) -> np.ndarray:
    """Lower-cased letters of a text, each run of other characters one space, a space at either end."""
    if data.isascii():
        cps = np.frombuffer(data, np.uint8)
    else:
        cps = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = _letters()[cps]
    blank = low == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    out = np.full(int(keep.sum()) + 2, 32, np.uint32)
    out[1:-1] = low[keep]
    return out[:-1] if out[-2] == 32 else out


def _grams(codes: np.ndarray, row: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of every order that start in codes before upto, within a row, with a letter at their
    start or end; sorted by row for each order alone."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for n in ORDERS:
        here = codes[: upto + n - 1]
        if len(here) < n:
            continue
        h = np.full(len(here) - n + 1, (0x9E3779B9 * n) & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ here[i : len(h) + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        some = ((here[: len(h)] != 32) | (here[n - 1 :] != 32)) & (row[: len(h)] == row[n - 1 : len(h) + n - 1])
        rows.append(row[: len(h)][some])
        found.append(h[some] >> np.uint32(32 - BITS))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _pieces(texts):
    """(row, bucket) of the n-grams of a column of texts, CHUNK code points at a time: many short texts, or a piece of a long one."""
    held, rows, n = [], [], 0

    def flushed():
        return _grams(np.concatenate(held), np.concatenate(rows), n)

    for i, data in enumerate(texts):
        data = data.as_py()
        codes = _codes(data) if data else np.zeros(0, np.uint32)
        if not (codes != 32).any():
            continue
        if len(codes) > CHUNK:
            for at in range(0, len(codes), CHUNK):
                part = codes[at : at + CHUNK + max(ORDERS) - 1]
                if (part[:CHUNK] != 32).any():
                    yield _grams(part, np.full(len(part), i), min(CHUNK, len(codes) - at))
            continue
        held.append(codes)
        rows.append(np.full(len(codes), i))
        n += len(codes)
        if n >= CHUNK:
            yield flushed()
            held, rows, n = [], [], 0
    if n:
        yield flushed()


def _judged(texts, model) -> tuple[list[str], list[float]]:
    """The language and score of each of a column of texts.

    A batch is a sparse matrix: a row per text, an entry per n-gram. Its product with the log-probabilities is a gather
    of their rows and a sum by text. Only texts with letters have n-grams.
    """
    names, weights = model or ([], None)
    total, seen = np.zeros((len(texts), max(1, len(names)))), np.zeros(len(texts), bool)
    for rows, buckets in _pieces(texts) if names else ():
        step = max(1, CELLS // len(names))
        cuts = {0, len(rows), *range(0, len(rows), step), *(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist()}
        cuts = sorted(cuts)  # a row's n-grams, for each order alone, no more at once than CELLS allows
        for at, upto in zip(cuts, cuts[1:]):
            entries = weights.take(buckets[at:upto], axis=0).astype(np.float64)
            total[rows[at]] += np.einsum("ij->j", entries)
        seen[rows] = True
    if not names:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    total += weights[-1]
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    best, score = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
    return [names[k] if s else UNDETERMINED for k, s in zip(best.tolist(), seen.tolist())], np.where(seen, score, 0.0).tolist()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray] | None:
    """(languages, log-probabilities by bucket and language, the last row the log prior), or None without a letter to learn from.

    Counts cover all rows with a language and a text. Every task sums its n-grams by language, passes on the cells that
    aren't zero whenever it holds HELD_LANGUAGES, and Spark sums them. The model, which comes to the driver, has 2^BITS
    cells of 4 bytes a language; the number of languages has no limit.
    """
    slim = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))

    def passed(sums):
        for name, cells in sums.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(cells[at])], names=["lang", "bucket", "n"])

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            of, names, seen = names.indices.to_numpy(), names.dictionary.to_pylist(), np.zeros(batch.num_rows, bool)
            for rows, buckets in _pieces(batch.column(1)):
                lang = of[rows].astype(np.uint16)  # a batch has fewer rows; so few bits sort fast
                order = np.argsort(lang, kind="stable")
                lang = lang[order]
                new = np.unique(rows[~seen[rows]])
                seen[new] = True
                for k, part in zip(np.unique(lang).tolist(), np.split(buckets[order], np.flatnonzero(lang[1:] != lang[:-1]) + 1)):
                    if names[k] not in sums:
                        if len(sums) >= HELD_LANGUAGES:
                            yield from passed(sums)
                            sums = {}
                        sums[names[k]] = np.zeros((1 << BITS) + 1, np.int64)
                    cells = sums[names[k]]
                    cells[-1] += (of[new] == k).sum()  # texts, each in its first piece
                    if len(part) < 4096:
                        np.add.at(cells, part, 1)
                    else:
                        cells[:-1] += np.bincount(part, minlength=1 << BITS)
        yield from passed(sums)

    cells = slim.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = cells.toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    if not names:
        return None
    counts = np.zeros(((1 << BITS) + 1, len(names)))
    column = {x: i for i, x in enumerate(names)}
    counts[table["bucket"].to_numpy(), [column[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    grams = counts[:-1] + 0.5
    prior = counts[-1] + 1.0
    return names, np.vstack([np.log(grams / grams.sum(axis=0)), np.log(prior / prior.sum())]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, id_columns: list[str], text: str = "text") -> DataFrame:
    """id columns, lang_pred and score (the posterior of lang_pred, 0 to 1) of every row, from its whole text alone.

    A text that is null or has no letter is `und` with score 0; so is any text where there is no model. Ties go to
    the language first in code point order.
    """
    slim = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(id_columns)], F.col(text).cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of proven size: 2^BITS rows

    def scored(batches):
        for batch in batches:
            best, score = _judged(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = T.StructType([*slim.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    told = slim.mapInArrow(scored, schema)
    return told.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(id_columns)], "lang_pred", "score")


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of docs: its id, held_out, lang_pred and score; learned from the rows that are not held out.

    Null languages aren't learned from. An empty table gives an empty one. Other columns are ignored.
    """
    model = train(docs.where(~held_out(id_column)), text, lang)
    told = predict(docs.withColumn("_held", held_out(id_column)), model, [id_column, "_held"], text)
    return told.select(id_column, F.col("_held").alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.5, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those whose language can't be told: no letters, or a posterior below least."""
    model = train(docs.where(~held_out(id_column)), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def kept(batches):
        for batch in batches:
            best, score = _judged(batch.column(at).cast(pa.binary()), shared.value)
            yield batch.filter(pa.array([b != UNDETERMINED and s >= least for b, s in zip(best, score)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
