"""Quality rules: rule statistics of whole texts, judged by base rules and an isolation forest."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from severa.llm.common import written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
RUN = 8
#: The forest: TREES trees, each of SAMPLE rows and at most DEPTH splits deep. It and its threshold are fitted on at most
#: FIT_ROWS labelled rows, those with the smallest hash of their id: the bound of what comes to the driver.
TREES, SAMPLE, DEPTH, FIT_ROWS = 100, 256, 20, 50_000
#: Of the labelled good rows that pass the base rules and didn't grow the forest, the threshold lets at most this share go.
LOST_GOOD = 0.005
SEED = 7


def repeated_words(ids: np.ndarray, run: int = RUN) -> int:
    """The words inside windows of run words that are found twice or more; ids: an integer for each word, equal for equal words.

    Windows get exact numbers by doubling: pairs of words, pairs of pairs, and so on. No hash is trusted.
    """
    n = len(ids) - run + 1
    if n < 2:
        return 0
    size = 1
    while size < run:
        step = min(size, run - size)
        joined = ids[: len(ids) - step].astype(np.int64) * (int(ids.max()) + 1) + ids[step:]
        _, ids = np.unique(joined, return_inverse=True)
        size += step
    twice = np.bincount(ids)[ids] > 1
    marks = np.zeros(n + run, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + run, -1)
    return int((np.cumsum(marks) > 0).sum())


def statistics_of(data: bytes | None) -> tuple[int, ...]:
    """STATS of a whole UTF-8 text; a null text has none of anything."""
    words = data.split() if data else []  # at ASCII white space
    if not words:
        return (0, 0, len(data) - len(data.translate(None, SYMBOLS)) if data else 0, 0, 0)
    # code points: all bytes but those that continue a character
    raw = np.frombuffer(b"".join(words), np.uint8)
    chars = len(raw) - int(((raw & 0xC0) == 0x80).sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []  # strip: the same white space
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    repeats = repeated_words(ids) if len(number) < len(words) else 0
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeats)


def statistics(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """id columns and STATS (long) of every row."""
    slim = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(id_columns)], F.col(text).cast("binary").alias("_text"))

    def told(batches):
        for batch in batches:
            found = [statistics_of(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *STATS])

    schema = T.StructType([*slim.drop("_text").schema.fields, *[T.StructField(c, T.LongType()) for c in STATS]])
    out = slim.mapInArrow(told, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(id_columns)], *STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features(stats: np.ndarray) -> np.ndarray:
    """Of rows of STATS: the word count's logarithm, the mean word length, and the rules' counts per word. Those are near
    0 nearly everywhere; their cube roots set none apart from few, as random cuts have to."""
    n = np.maximum(stats[:, 0], 1).astype(np.float64)
    return np.column_stack([np.log2(n), stats[:, 1] / n, *[np.cbrt(stats[:, k] / n) for k in (2, 3, 4)]])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1: a leaf), cut, child for below and for not below, and a leaf's path length."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    typical: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ^ -(mean path / the typical path): near 1 for anomalies, below 0.5 for what is ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                here = at[inner]
                low = x[rows[inner], self.feature[here]] < self.cut[here]
                at[inner] = np.where(low, self.below[here], self.above[here])
            total += self.length[at]
        return 2.0 ** -(total / max(1, len(self.roots)) / self.typical)


def _expected(n: float) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """An isolation forest on the rows of x: random splits of random features.

    A split is drawn over all that is left of the feature's range, which begins as low to high (the rows' own, if not
    given), and not only over the rows that are there: so also what lies where no row does is cut off, after few splits.
    """
    rng = np.random.default_rng(seed)
    if not len(x):
        return Forest(*[np.zeros(0, int)] * 6, typical=1.0)
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, low: np.ndarray, high: np.ndarray, at: int) -> int:
        open_ = np.flatnonzero(high > low)
        me = len(nodes)
        if at >= depth or len(rows) < 2 or not len(open_):
            nodes.append([-1, 0.0, 0, 0, at + _expected(len(rows))])
            return me
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, 0, 0, 0.0])
        below = rows[:, f] < cut
        under, over = high.copy(), low.copy()
        under[f] = over[f] = cut
        nodes[me][2] = split(rows[below], low, under, at + 1)
        nodes[me][3] = split(rows[~below], over, high, at + 1)
        return me

    low = x.min(axis=0) if low is None else low
    high = x.max(axis=0) if high is None else high
    roots = [split(x[rng.choice(len(x), min(sample, len(x)), replace=False)], low, high, 0) for _ in range(trees)]
    table = np.array(nodes)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), max(_expected(min(sample, len(x))), 1e-9))


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, lost_good: float = LOST_GOOD) -> float:
    """The score above which a row goes: of all cuts that lose at most lost_good of the good rows, the one that tells
    bad from good best (bad rows caught less good rows lost, as shares), midway to the next score; 1, which keeps all,
    if none tells any. Rows of one score have one verdict."""
    score = forest.score(x)
    best, at = 0.0, 1.0
    goods, bads = np.sort(score[good]), np.sort(score[~good])
    if not len(goods) or not len(bads):
        return at
    cuts = np.unique(score)
    for cut, after in zip(cuts, cuts[1:]):
        lost = 1 - np.searchsorted(goods, cut, "right") / len(goods)
        caught = 1 - np.searchsorted(bads, cut, "right") / len(bads)
        if lost <= lost_good and caught - lost > best:
            best, at = caught - lost, float(cut + after) / 2
    return at


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", quality: str = "quality", rows: int = FIT_ROWS) -> Forest:
    """A forest on labelled rows of stats (_id and STATS) that pass the base rules, at most rows of them, and its threshold.

    Every other row grows the forest, of which the good ones alone (all, if none is): anomalies are what differs from
    them. The rest calibrate the threshold, so no row is judged by a forest that it grew.
    """
    told = labels.where(F.col(quality).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_of"), F.col(quality).alias("_quality"))
    chosen = F.broadcast(told.orderBy(F.xxhash64("_of"), "_of", "_quality").limit(rows))  # at most FIT_ROWS rows of two numbers
    sample = stats.where(~base_failed()).join(chosen, stats["_id"] == chosen["_of"]).select(*STATS, "_quality", "_of")
    # repeated ids may make it larger than what was chosen
    table = sample.orderBy(F.xxhash64("_of"), *STATS, "_quality").limit(rows).toArrow()
    x = features(np.column_stack([table[c].to_numpy() for c in STATS]).reshape(-1, len(STATS)))
    if len(x) < 2:
        return grow(x[:0])
    good = table["_quality"].to_numpy() > 0
    grows = np.arange(len(x)) % 2 == 0
    forest = grow(x[grows & good] if (grows & good).any() else x[grows], x.min(axis=0), x.max(axis=0))
    return replace(forest, threshold=calibrate(forest, x[~grows], good[~grows]))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: its id, STATS, base_failed, kept and score.

    Null and empty texts have no words and fail the base rules. Kept is false for what fails them, else whether the
    forest's score is at most the threshold; without labels of both kinds nothing else goes. Repeated rows come back
    repeated; an empty table gives an empty one; other columns of either table are ignored. Texts of any length are
    judged whole; a task holds one text's words at a time.
    """
    stats = written(statistics(docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")), ("_id",), "_text"), "stats")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, id_column))  # of proven size: TREES trees of SAMPLE rows

    def scored(batches):
        forest = shared.value
        for batch in batches:
            x = features(np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in STATS]))
            score = forest.score(x) if len(forest.roots) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score <= forest.threshold)], names=[*batch.schema.names, "score", "ordinary"])

    schema = T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("ordinary", T.BooleanType())])
    told = stats.mapInArrow(scored, schema)
    return told.select(F.col("_id").alias(id_column), *STATS, base_failed().alias("base_failed"), (~base_failed() & F.col("ordinary")).alias("kept"), "score")
