"""Corpus pipeline: quality, near duplicates, benchmark passages, mixture, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor;
between stages the rows are written as Parquet in the cluster's shared folder.
The last stage returns what the token files hold, the others the columns of
``documents``. Of no documents every stage makes no rows; further columns are handed on up to the last
stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableaudit.llm import decontaminate, mixing, orcstore, quality, simhash
from tableaudit.llm.common import drop, shared_path, step_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier scores at its threshold or above; null and empty texts are judged by its bias alone."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group; texts without words (null and empty ones) are a group."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that hold no benchmark window; texts without words hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them; a null source is a source, rows without words weigh nothing."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, read back from the token files; null and empty texts have the end id alone."""
    return orcstore.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: SQL can express neither the trained classifier nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written before the next begins; what it stashed on the way, and the rows
    of the stage before, are dropped then: at most two stages' rows are kept at a time."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        label = name.split()[0].lower()
        path = shared_path(spark, label)
        with step_folder(spark, label):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
