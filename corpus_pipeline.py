"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last adds ``copy``, the number of a document's copy in the mix (``copy_2`` and so on where
docs has a column of that name). Columns beyond those of ``documents`` pass through, of whatever type. Null, empty and
letterless texts go with the first stage; rows that repeat are one row after the second; an empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from severa.llm import decontaminate, langid, mixing, pii, simhash
from severa.llm.common import fresh_folder, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without letters, or with no language over an even chance."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    return pii.mask(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row for each copy of a document that is taken."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_sources),
]

#: SQL can't express language ID, SimHash groups or masking: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each returns is written to the shared folder and read as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"stage-{name}")
        with scratch(spark):  # what a stage writes on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
