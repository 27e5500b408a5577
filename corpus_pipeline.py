"""Corpus pipeline: five stages over ``documents``, each by one operator.

Each stage works on all rows that the one before it kept. The classifiers learn
from the labelled training rows of ``documents`` that are still there. Stages set
the session's Arrow batches to BATCH_ROWS rows, as whole texts pass through them.

Cases, as the operators have them: a null text is an empty one; rows of a null or
repeated doc_id are judged each for itself, and of a class of near duplicates one
row stays; ties go to the least doc_id, then the least text; an empty table gives
no rows; all columns of documents, whatever their names, reach the last stage,
which gives its own.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from pactum.llm import decontamination, minhash_forest, packing, quality, toxicity
from pactum.llm.common import materialize, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.3 go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays."""
    return minhash_forest.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item, or all of a shorter item, go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in training sequences."""
    return packing.pack(docs)


#: Rows of one Arrow batch between the JVM and Python.
BATCH_ROWS = 2000


def _bounded(stage):
    """The stage with batches of BATCH_ROWS rows: executor memory holds a few of them at once on either side."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _bounded(_toxicity)),
    ("quality", _bounded(_quality)),
    ("near_duplicates", _bounded(_near_duplicates)),
    ("decontamination", _bounded(_decontamination)),
    ("packing", _bounded(_packing)),
]

#: Trained models and token ids are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
