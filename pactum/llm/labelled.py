"""Bounded labelled samples, calibration and scoring plans shared by the classifiers.

Training rows are those whose crc32(doc_id as text) mod 5 is not 0. A sample
takes a set number of ids of either label, least hash first, from the labels
alone and then fetches their texts, one an id and within a set number of bytes;
only those texts reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactum.llm.common import fields, set_aside, sliced

#: Longer texts stay out of the training sample (never out of scoring), so that its bytes have a bound too.
LONGEST_SAMPLE_TEXT = 64 << 10
#: Bytes of all sampled texts; ids of greater hash than those that fit are left out.
SAMPLE_BYTES = 96 << 20


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, ones: int, zeros: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """(texts, labels) of at most ``ones`` and ``zeros`` training rows, in the order of their ids' hashes.

    Null labels and ids are left out; of repeated labels of an id the greatest
    counts, of its texts the least.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    )
    chosen = known.filter("y = 1").orderBy("h", "doc_id").limit(ones).unionByName(known.filter("y = 0").orderBy("h", "doc_id").limit(zeros))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") <= LONGEST_SAMPLE_TEXT)
    # The chosen ids have a fixed bound, so this side may be broadcast whatever the corpus.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "y").agg(F.min("text").alias("text"))
    # A running sum over the bounded sample alone.
    size = F.sum(F.octet_length("text")).over(W.orderBy("h", "doc_id"))
    rows = found.withColumn("size", size).filter(F.col("size") <= most_bytes).select("h", "doc_id", "y", "text").toPandas().sort_values(["h", "doc_id"])
    return [t.encode() for t in rows["text"]], rows["y"].to_numpy(np.int64)


def every_fourth(y: np.ndarray) -> np.ndarray:
    """Whether each row is a fourth one of its label: those calibrate, the others train."""
    out = np.zeros(len(y), bool)
    for v in (0, 1):
        out[np.flatnonzero(y == v)[3::4]] = True
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights, and last the intercept, of a ridge-penalised logistic regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * len(y) * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def chance(z) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, scorer, column: str = "score") -> DataFrame:
    """docs with a score for each whole text; scorer: makes, once in a task, a function from bytes to a chance.

    A column of docs that is called like the score's stays, under a free name.
    """
    docs = set_aside(docs, (column,))

    def run(batches):
        import pyarrow as pa

        score = scorer()
        for batch in sliced(batches, size=2 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(score(t)) for t in texts], pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, f"{fields(docs)}, `{column}` double")


def verdicts(docs: DataFrame, scorer, cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), scorer)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
