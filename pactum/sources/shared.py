"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the one that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset in a session of one machine (as in tests) a temporary
    folder takes its place; on a cluster executors would not find it, so a
    RuntimeError says what is missing.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pactum-shared-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/pactum-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: a plan of its own that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
