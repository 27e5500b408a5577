"""Shared folders, table access and small numeric helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pactum.sources.shared import materialize, shared_dir

__all__ = ["bounded", "fields", "filesystem", "free_name", "materialize", "mix64", "own_columns", "random64", "ranged", "ranges", "set_aside", "shared_dir", "sliced", "table", "utf8", "whole_groups"]

#: Tables of ids with at most so many rows may be broadcast.
BROADCAST_ROWS = 500_000


def bounded(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids for one side of a join: broadcast while it is small by count, else left to a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(ids) if ids.count() <= most else ids


def ranged(df: DataFrame, size, *keys, target: int = 64 << 20) -> DataFrame:
    """df dealt into ranges of keys: as many as the session's shuffles have, more where a range would have over ``target`` bytes.

    size: the bytes of a row, a column.
    """
    from pyspark.sql import functions as F

    total = df.agg(F.sum(size)).first()[0] or 0
    n = -(-total // target)
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(n, *keys)
    return df.repartitionByRange(*keys)


def free_name(taken: list[str], name: str) -> str:
    """name with underscores put before it until no column is called so, in any case of letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with own columns of these names called by free ones, so that an operator's columns can take the names."""
    taken, made = list(docs.columns), {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in made:
            other = free_name([*taken, *names], c)
            docs = docs.withColumnRenamed(c, other)
            taken.append(other)
    return docs


def own_columns(docs: DataFrame) -> list:
    """The columns of docs, whatever characters their names hold."""
    from pyspark.sql import functions as F

    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def fields(docs: DataFrame) -> str:
    """The schema of docs as DDL."""
    return ", ".join("`" + f.name.replace("`", "``") + f"` {f.dataType.simpleString()}" for f in docs.schema.fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(filesystem, path) of a URI, usable on the driver and on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, the same on every worker."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def sliced(batches, rows: int = 2000, size: int = 16 << 20, text: str = "text"):
    """Arrow batches cut to few rows and bytes; a longer text is a batch of its own."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        import pyarrow.compute as pc

        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        while at < n:
            to = int(np.searchsorted(total, total[at] + size, "right")) - 1
            to = min(max(to, at + 1), at + rows, n)
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches, keys: list[str]):
    """Record batches of sorted input, cut so that no group of equal keys is in two.

    Yields (batch, bounds): row numbers where groups begin, and the end.
    """
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        bounds = _bounds(batch, keys)
        last = int(bounds[-2])
        rest = batch.slice(last)
        if last:
            yield batch.slice(0, last), bounds[:-1]
    if rest is not None:
        yield rest, _bounds(rest, keys)


def _bounds(batch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        x = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)
