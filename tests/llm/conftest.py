from __future__ import annotations

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with what operators make."""

    def make(pairs, extra=""):
        rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, FIELDS)
        from pyspark.sql import functions as F

        for name in extra.split():
            df = df.withColumn(name, F.lit("own"))
        return df

    return make


@pytest.fixture(scope="session")
def case_dir(spark, tmp_path_factory):
    """A folder with tables like the driver's, for queries."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make


ODD = [(1, None), (2, ""), (3, "one"), (None, "null id text here"), (None, None), (7, "same same"), (7, "same same"), (8, "é" * 3000), (9, "!!! ... ???")]


@pytest.fixture(scope="session")
def odd():
    return ODD
