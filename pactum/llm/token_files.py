"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Layout of one shard ``shard-<k>``:

* ``.ids``  - ids of its documents one after another, unsigned little-endian,
  16 bits while the vocabulary has at most 65,536 ids, else 32 bits;
* ``.docs`` - signed 64-bit doc_id of each document (null: the least value);
* ``.idx``  - signed 64-bit offset of each document's first id and the end of
  the last, counted in ids over *all* shards.

Shards follow the ascending order of doc_id and hold some 64 MB of text (rows of one
doc_id and text stay together). A task writes its ids and counts,
prefix sums over the shards' totals give each shard's base, and a second task
per shard turns counts into offsets. Files are written under a name of their
task attempt and renamed, so a repeated attempt replaces its own work only.

Cases: a null text counts as empty and has the end id alone; rows with equal
doc_id keep one entry each, ordered by text hash, then text; null doc_ids come
first; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm import bpe
from pactum.llm.common import filesystem, materialize, ranged, shared_dir, sliced, table

END_ID = 2
_NULL_ID = np.iinfo(np.int64).min
_SHARDS = "shard int, n_docs long, n_ids long, width int, folder string"


def _put(folder: str, name: str, chunks, attempt: int) -> None:
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{attempt}"
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, f"{path}/{name}")


class Mapped:
    """A file of the format as an array that is read by slices: memory-mapped where the folder is a local or mounted one, else by ranges of bytes."""

    def __init__(self, folder: str, name: str, dtype):
        from pyarrow.fs import LocalFileSystem

        fs, path = filesystem(folder)
        self.dtype = np.dtype(dtype)
        size = fs.get_file_info(f"{path}/{name}").size
        self.length, self.array, self.source = size // self.dtype.itemsize, None, None
        if isinstance(fs, LocalFileSystem):
            self.array = np.memmap(f"{path}/{name}", self.dtype, "r") if size else np.zeros(0, self.dtype)
        else:
            self.source = fs.open_input_file(f"{path}/{name}")

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(self.length)
        if self.array is not None:
            return np.array(self.array[start:stop])
        return np.frombuffer(self.source.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def mapped(folder: str, name: str, dtype) -> np.ndarray:
    """A whole file of the format as an array, memory-mapped where it can be."""
    own = Mapped(folder, name, dtype)
    return own[:] if own.array is None else own.array


def write(docs: DataFrame, vocabulary: str | None = None, end: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode all documents into shards; one row a shard: shard, n_docs, n_ids, width, folder, base."""
    spark = docs.sparkSession
    path, folder = vocabulary or bpe.vocabulary_path(), folder or shared_dir(spark, "ids")

    def encode(batches):
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        counts, ids_of, totals = [], [], [0, 0]
        coder = bpe.encoder(path)

        def chunks():
            for batch in sliced(batches):
                ids, offsets = coder.encode(batch.column("text").fill_null("").to_pylist(), end)
                counts.append(np.diff(offsets))
                ids_of.append(batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False))
                totals[0] += batch.num_rows
                totals[1] += len(ids)
                yield ids.tobytes()

        name = f"shard-{shard:06d}"
        import pyarrow as pa

        _put(folder, f"{name}.ids", chunks(), attempt)
        if not totals[0]:
            return
        _put(folder, f"{name}.docs", (x.astype("<i8").tobytes() for x in ids_of), attempt)
        _put(folder, f"{name}.idx", (x.astype("<i8").tobytes() for x in counts), attempt)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [totals[0]], "n_ids": [totals[1]], "width": pa.array([coder.dtype.itemsize], pa.int32()), "folder": [folder]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ranged(texts, F.octet_length("text"), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = materialize(ordered.mapInArrow(encode, _SHARDS), "id-shards")
    # One row a shard, whatever the documents: their totals' prefix sums are the bases.
    rows, base = [], 0
    for r in sorted(shards.collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.n_docs, r.n_ids, r.width, r.folder, base))
        base += r.n_ids
    out = spark.createDataFrame(rows, _SHARDS + ", base long").repartition(max(1, len(rows)))

    def finish(batches):
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for r in batch.to_pylist():
                name = f"shard-{r['shard']:06d}"
                # The counts stay in their own file until the offsets are whole, so this can run again.
                counts = Mapped(r["folder"], f"{name}.idx", "<i8")[:]
                if len(counts) == r["n_docs"]:
                    offsets = r["base"] + np.concatenate([[0], np.cumsum(counts)])
                    _put(r["folder"], f"{name}.idx", [offsets.astype("<i8").tobytes()], attempt)
            yield batch

    return materialize(out.mapInArrow(finish, out.schema), "id-index")


def read(shards: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                name = f"shard-{r['shard']:06d}"
                ids, docs, index = (Mapped(r["folder"], f"{name}.{kind}", d) for kind, d in (("ids", f"<u{r['width']}"), ("docs", "<i8"), ("idx", "<i8")))
                for a in range(0, len(docs), 1000):
                    at = index[a : min(a + 1000, len(docs)) + 1]
                    local = at - r["base"]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                    d = docs[a : a + 1000]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, mask=d == _NULL_ID), "start": at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.repartition(max(1, spark.sparkContext.defaultParallelism), "shard").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
