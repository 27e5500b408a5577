"""Harmonic packing of token documents into sequences of at most C tokens.

Class m of the harmonic partition holds pieces of floor(C / m) tokens, and each
of its sequences takes exactly floor(C / length) of them, so a piece's rank in
its class alone fixes its sequence and offset: workers fill their pieces
independently once prefix sums over (task, class) counts have given each task
its first rank. A document longer than C yields full pieces first; what remains
is cut greedily, the largest class length that fits each time, which leaves
about three pieces a document. The last, partly filled sequence of each class
is no sequence: its fewer than floor(C / length) pieces (a number that depends
on C alone, not on the input) are packed together best-fit decreasing.

Cases: a null text is empty and has the end id alone; rows with equal doc_id are
packed each for itself; null doc_ids stay null; an empty table gives no rows;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm import bpe
from pactum.llm.common import materialize, sliced, table

CAPACITY = 2048
END_ID = 1
_PIECE = "task int, rank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens, each the length of a class."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Class-length pieces of all documents, ranked within (task, class); with_ids: also their ids."""
    path = vocabulary or bpe.vocabulary_path()
    schema = _PIECE + (", ids array<int>" if with_ids else "")

    def encode(batches):
        import pyarrow as pa

        task, ranks, coder, cuts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), bpe.encoder(path), {}
        for batch in sliced(batches):
            ids, offsets = coder.encode(batch.column("text").fill_null("").to_pylist(), end)
            wide = memoryview(ids.astype("<u4")).cast("B")
            owner, start, length, crc = [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                n = b - a
                if n not in cuts:
                    cuts[n] = cut(n, capacity)
                at = 0
                for size in cuts[n]:
                    owner.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(wide[4 * (a + at) : 4 * (a + at + size)]))
                    at += size
            owner, length = np.array(owner, np.int64), np.array(length, np.int64)
            order = np.argsort(length, kind="stable")
            sizes, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(ranks[sizes], n)
            ranks[sizes] += n
            columns = {
                "task": pa.array(np.full(len(length), task), pa.int32()), "rank": rank, "doc_id": batch.column("doc_id").take(pa.array(owner)),
                "start": pa.array(start, pa.int64()), "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": np.diff(offsets)[owner],
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def _rest(capacity: int):
    def pack(pdf):
        """Best-fit decreasing of the bounded remainder; sequence numbers from 0."""
        pdf = pdf.sort_values(["length", "doc_id", "start", "task", "rank"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        room: list[tuple[int, int]] = []  # free tokens, sequence
        used, sequence, offset = [], np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for i, n in enumerate(pdf["length"].tolist()):
            k = bisect_left(room, (n, -1))
            if k == len(room):
                s, free = len(used), capacity
                used.append(0)
            else:
                free, s = room.pop(k)
            sequence[i], offset[i] = s, used[s]
            used[s] += n
            if free > n:
                insort(room, (free - n, s))
        pdf["sequence_id"], pdf["offset"] = sequence, offset
        return pdf

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; see the module for cases."""
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, vocabulary, capacity, end, with_ids), "pieces")
    counts = cut_up.groupBy("length", "task").agg(F.count("*").alias("n"))
    # Prefix sums in two steps, so that no task holds the counts of all tasks: within blocks of tasks, then over blocks.
    block = F.floor(F.col("task") / 1024)
    from pyspark.sql import Window as W

    in_block = W.partitionBy("length", "block").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.withColumn("block", block).groupBy("length", "block").agg(F.sum("n").alias("bn"))
    over = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("length")
    blocks = blocks.select("length", "block", F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("before"), F.sum("bn").over(whole).alias("in_class"))
    firsts = (
        counts.withColumn("block", block)
        .join(blocks, ["length", "block"])
        .select("length", "task", (F.col("before") + F.coalesce(F.sum("n").over(in_block), F.lit(0))).alias("first"), "in_class")
    )
    firsts = materialize(firsts, "firsts")
    # Classes are at most 2 sqrt(C): their first sequence numbers are a constant-size table.
    base, rows = 0, []
    for r in sorted(firsts.groupBy("length").agg(F.max("in_class").alias("n")).collect(), key=lambda r: -r.length):
        rows.append((r.length, base))
        base += r.n // (capacity // r.length)
    classes = spark.createDataFrame(rows, "length long, base long")
    per = F.expr(f"{capacity} div length")
    placed = (
        cut_up.join(firsts, ["length", "task"])
        .join(F.broadcast(classes), "length")
        .withColumn("at", F.col("first") + F.col("rank"))
        .withColumn("full", F.expr(f"in_class div ({capacity} div length)") * per)
    )
    columns = [c for c in cut_up.columns if c not in ("task", "rank")]
    done = placed.filter("at < full").select(
        *columns, (F.col("base") + F.expr(f"at div ({capacity} div length)")).alias("sequence_id"), (F.expr(f"at % ({capacity} div length)") * F.col("length")).alias("offset")
    )
    left = placed.filter("at >= full").select(*cut_up.columns)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cut_up.schema.fields)}, sequence_id long, offset long"
    tail = left.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: _rest(capacity)(pdf), schema).select(*columns, (F.col("sequence_id") + F.lit(base)).alias("sequence_id"), "offset")
    return done.unionByName(tail)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
