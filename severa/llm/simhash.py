"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from severa.llm.common import decided, placed, rows_of, written
from severa.llm.components import connected_components

SEED = 42
SIGN = 1 << 63
#: Bytes of a text whose shingles are hashed at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def simhash64(data: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a whole UTF-8 text as an unsigned integer; 0 for a text without words.

    A-Z are lower-cased, words are maximal runs without ASCII white space, shingles are space-joined words,
    repeats included. A bit is 1 if set in over half the shingles' hashes.
    """
    if not data:
        return 0
    n, over = 0, np.zeros(64, np.int64)
    for words in _pieces(data.lower(), shingle):
        hashes = _shingle_hashes(words, shingle, seed)
        n += len(hashes)
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > n, bitorder="little").view(np.uint64)[0])


def _pieces(data: bytes, shingle: int):
    """The words of a text in pieces of about PIECE bytes; each piece begins with the last words of the one before, so
    that every shingle is in one piece. A text of fewer words than a shingle is one piece, one without words none."""
    at, words, whole = 0, [], False
    while at < len(data):
        space = SPACE.search(data, at + PIECE)
        upto = space.start() if space else len(data)
        words += data[at:upto].split()  # of bytes: at ASCII white space only, as wanted
        at = upto
        if len(words) >= shingle:
            yield words
            whole, words = True, words[len(words) - shingle + 1 :]
    if words and not whole:
        yield words


def _shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The hashes of the shingles of words; one of them all if they are fewer than a shingle has."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    spans = zip((ends + 1 - lengths).tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter([digest(joined[a:b], seed) for a, b in spans], np.uint64, len(words) - shingle + 1)


def fingerprints(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = 3) -> DataFrame:
    """id columns and fingerprint (a signed long) of every row; null and empty texts have fingerprint 0."""
    slim = docs.select(*id_columns, F.col(text).cast("binary").alias("_text"))
    fields = slim.drop("_text").schema.fields
    names = [*(f.name for f in fields), "fingerprint"]

    def hashed(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.fromiter((simhash64(x.as_py(), shingle) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=names)

    return slim.mapInArrow(hashed, T.StructType([*fields, T.StructField("fingerprint", T.LongType())]))


def _longs(values: list[int]) -> Column:
    """A literal array of 64-bit patterns."""
    return F.expr("array(" + ",".join(f"cast('{v - (1 << 64) if v >= SIGN else v}' as bigint)" for v in values) + ")")


def _block_masks(blocks: int, radius: int) -> list[int]:
    """Of every choice of blocks - radius blocks, the bits. Two fingerprints within radius agree on one choice."""
    at = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << at[i + 1]) - 1) ^ ((1 << at[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def crowded(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """The distinct fingerprints that share a choice of blocks with another one: a superset of all that have a link.

    It only spares lonely fingerprints the balls. A choice of 3 blocks of 6 has 32 bits: beyond 10^9 fingerprints
    raise blocks (8: 56 keys of 40 bits), results stay the same.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(_one(m))) for i, m in enumerate(_block_masks(blocks, radius))])
    keyed = prints.select("fingerprint", F.explode(keys).alias("key"))
    # a key's smallest and largest fingerprint combine before the shuffle; a written table on either side of the join lets Spark split it
    shared = keyed.groupBy("key").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).where("lo <> hi").select("key")
    return keyed.join(shared, "key", "left_semi").select("fingerprint").distinct()


def _one(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= SIGN else value).cast("long")


def links(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Distinct fingerprints (column fingerprint) -> links (a, b) that connect what is within radius (1 to 3) bits.

    Every fingerprint emits its ball: all variants within 1 bit and, for radius 3, those of even parity also all
    variants with 2 changed bits in one half. Two fingerprints at distance 1 or 2 meet at distance 1 from each.
    At distance 3 their parities differ, two of the three bits lie in one half, and the even one meets the odd one
    there. In a variant's bucket all members are linked to the smallest that is within 1 bit of the variant (for
    radius 1, to the variant's own fingerprint): at most 3 bits apart, which is verified. A bucket of n gives n - 1 links, never all pairs, and no link is lost:
    two members within radius that meet in a bucket are connected through its centre.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius has to be 1, 2 or 3")
    near = [0, *(1 << i for i in range(64))]
    far = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)] if radius == 3 else []
    crowd = written(crowded(prints, radius, blocks), "crowd")
    odd = F.expr("bit_count(fingerprint) % 2 = 1")
    emitted = crowd.select("fingerprint", F.explode(F.when(odd, _longs(near)).otherwise(_longs(near + far))).alias("mask")).select(
        "fingerprint",
        F.expr("fingerprint ^ mask").alias("variant"),
        F.expr(f"case when bit_count(mask) <= {min(radius - 1, 1)} then fingerprint end").alias("inner"),
    )
    centre = F.min("inner").over(Window.partitionBy("variant"))
    pairs = emitted.select(F.col("fingerprint").alias("a"), centre.alias("b")).where(f"a <> b and bit_count(a ^ b) <= {radius}")
    return pairs.groupBy("a", "b").agg(F.lit(True).alias("linked")).select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, blocks: int = 6) -> DataFrame:
    """One row per row of docs: its id, fingerprint (long) and component_id, the smallest id reachable by links.

    Texts with equal fingerprints are linked, also the zero fingerprints of null, empty and blank texts.
    A null id takes part and never becomes a component_id unless its component has null ids only. Repeated
    rows come back repeated. An empty table gives an empty one. Other columns of docs, whatever their names,
    are ignored. Copies are grouped by fingerprint before any link is sought, so a group of copies of any
    size is one node.
    """
    slim = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    prints = written(fingerprints(slim, ("_id",), "_text", shingle), "prints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("_id").alias("smallest")), "nodes")
    roots = connected_components(links(nodes.select("fingerprint"), radius, blocks))
    placed = written(nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")), "placed")
    least = written(placed.groupBy("root").agg(F.min("smallest").alias("component_id")), "least")
    named = written(placed.join(least, "root").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select(F.col("_id").alias(id_column), "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, blocks: int = 6) -> DataFrame:
    """docs with one row of each component, with all its columns: that with the smallest id, a null id last.

    Among rows with the same id the first by its place in docs' files stays; so rows that repeat are one row. Null and
    empty texts are copies of each other. Only the places of rows that go come back to the texts, which aren't shuffled.
    """
    rows = placed(docs)
    rank = F.struct(F.col("_in")[id_column].isNull().alias("absent"), F.col("_in")[id_column].alias("id"), F.col("_file").alias("file"), F.col("_at").alias("at"))
    member = near_duplicates(rows.select(rank.alias("_rank"), F.col("_in")[text].alias("_text")), "_rank", "_text", radius, shingle, blocks)
    gone = member.where("_rank <> component_id").select(F.col("_rank.file").alias("_file"), F.col("_rank.at").alias("_at"), F.lit(0).alias("n"))
    return decided(rows, gone, 1).where("_n = 1").select(*rows_of(docs))


def hexadecimal(column: str) -> Column:
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
