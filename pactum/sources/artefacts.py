"""Objects of a store: listings, JSON artefacts by key, deletion by prefix."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length bigint, content binary"


#: Spark lists folders by a task for each of up to 10,000, level by level, and its driver keeps a record of every task.
LISTERS = 64
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def few(spark: SparkSession) -> str:
    """How many tasks list folders: a session's own number, LISTERS at most."""
    return str(min(LISTERS, int(spark.conf.get(LISTING))))


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Within it, folders are listed by so many tasks at most, of many folders each; all are listed."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, few(spark))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def objects(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Every file below a folder: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    with few_listers(spark):
        return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def listing(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """The same without contents, which are then not read."""
    return objects(spark, folder, pattern).select("path", "modificationTime", "length")


def below(path: Column, folder: str) -> Column:
    """A file's key: its path below the folder."""
    name = folder.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/").rsplit("/", 1)[-1]
    return F.substring_index(path, f"/{name}/", -1)


def exists(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """keys (key) with whether an object of a listing (key) has it."""
    return keys.join(listed.select("key").distinct().withColumn("_there", F.lit(True)), "key", "left").withColumn("there", F.coalesce("_there", F.lit(False))).drop("_there")


def write_json(rows: DataFrame, folder: str, kind: str) -> None:
    """Records (tenant_id, doc_id and others) as JSON lines, a partition for each tenant; what was there of a tenant is replaced."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("tenant_id").json(f"{folder}/{kind}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_json(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Records of a declared schema; nothing is inferred, and a line that is no JSON has its text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/{kind}")


def delete_prefix(spark: SparkSession, prefix: str) -> int:
    """Delete what lies at or below a path, by the store that it names; how many files went."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(prefix)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    n = fs.getContentSummary(path).getFileCount()
    fs.delete(path, True)
    return n


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Files of rows (key, content) below a folder; gives the keys. A repeated attempt replaces its own file."""

    def run(batches):
        import pyarrow as pa

        store, base = _store(folder)
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store.create_dir(f"{base}/{key}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{key}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"key": batch.column("key")})

    return rows.select("key", "content").mapInArrow(run, "key string")


def read_files(keys: DataFrame, folder: str) -> DataFrame:
    """path and content of the files below a folder that rows (key) name; null contents where there is none.

    The files are opened where the keys are, so the driver neither lists nor keeps them.
    """

    def run(batches):
        import pyarrow as pa

        store, base = _store(folder)

        def read(key):
            try:
                with store.open_input_stream(f"{base}/{key}") as said:
                    return said.read()
            except FileNotFoundError:
                return None

        for batch in batches:
            # A few at a time, as files may be large.
            for at in range(0, batch.num_rows, 16):
                own = batch.column("key").slice(at, 16).to_pylist()
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{key}" for key in own], "content": pa.array(map(read, own), pa.binary())})

    return keys.select("key").mapInArrow(run, "path string, content binary")


def _store(folder: str):
    """The store that a folder's URI names, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)
