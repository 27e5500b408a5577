"""Versioned tables: upserts, inserts if absent, deletes with roll-back, the embedding cache, status, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key by the given order: a full replace."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with new rows in place of those of equal key; of several new ones the last by order."""
    fresh = latest(new, keys, order).drop(order)
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those new rows whose key it lacks; a conflict changes nothing. Equal new keys: one row stays."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys))


def patch(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with the fields that a change sets; ``set_<field>`` says whether, so that a null can be set too."""
    p = changes.select(key, *(F.col(f).alias(f"_{f}") for f in fields), *(F.col(f"set_{f}") for f in fields))
    rows = base.join(p, key, "left")
    return rows.withColumns({f: F.when(F.coalesce(f"set_{f}", F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(*base.columns)


def next_versions(uploads: DataFrame, order: list[str]) -> DataFrame:
    """Uploads numbered from 1 within each document."""
    return uploads.withColumn("version_number", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("doc_id").agg(F.max("version_number").alias("latest_version"), F.count("*").alias("n_versions"))


def delete_versions(versions: DataFrame, gone: DataFrame, documents: DataFrame) -> DataFrame:
    """documents with the latest version that is left after deleting some; null where none is left."""
    left = versions.join(gone, ["doc_id", "version_number"], "left_anti")
    return documents.join(latest_versions(left), "doc_id", "left")


def delete_cascade(tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that name a deleted document in any of its id columns, edges of either direction too."""
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone.select(F.col("doc_id").alias(c)), c, "left_anti")
        out[name] = df
    return out


def cache_lookup(clauses: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """clauses (content_hash) with the cached vector of that model, if there is one."""
    own = cache.filter(F.col("model") == model).select("content_hash", F.col("vector")).dropDuplicates(["content_hash"])
    return clauses.join(own, "content_hash", "left")


def cache_misses(clauses: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each distinct text that has no cached vector, once."""
    missing = clauses.select("content_hash", "text").join(cache.filter(F.col("model") == model).select("content_hash"), "content_hash", "left_anti")
    return missing.groupBy("content_hash").agg(F.min("text").alias("text"))


def embed_missing(clauses: DataFrame, cache: DataFrame, embedder, model: str, batch: int = 100) -> DataFrame:
    """Cache rows for the misses; embedder: from a list of at most ``batch`` texts to their vectors."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"content_hash": part["content_hash"], "model": model, "vector": embedder(part["text"].tolist())})

    return cache_misses(clauses, cache, model).mapInPandas(run, "content_hash string, model string, vector array<float>")


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each document, by time, then event."""
    last = F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("doc_id").agg(last.alias("s"), F.count("*").alias("n_events")).select("doc_id", "s.status", "s.error", F.col("s.ts").alias("ts"), "n_events")


def listing(documents: DataFrame, limit: int = 200) -> DataFrame:
    """The first documents of each tenant by id."""
    return documents.withColumn("rank", F.row_number().over(W.partitionBy("tenant_id").orderBy("doc_id"))).filter(F.col("rank") <= limit)


def page(documents: DataFrame, tenant: str, before: int | None = None, limit: int = 20) -> DataFrame:
    """One page of a tenant's documents, descending, below the last id of the page before."""
    rows = documents.filter(F.col("tenant_id") == tenant)
    return (rows if before is None else rows.filter(F.col("doc_id") < before)).orderBy(F.desc("doc_id")).limit(limit)


def changes_between(changes: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Changes of versions within optional bounds, both included."""
    v = F.col("version_number")
    rows = changes if low is None else changes.filter(low.isNull() | (v >= low))
    return rows if high is None else rows.filter(high.isNull() | (v <= high))


def replace_by_document(index: DataFrame, new: DataFrame) -> DataFrame:
    """A clause index in which the documents of new have just new's clauses: stale ones go, of equal ids the last by pos stays."""
    fresh = latest(new, ["clause_id"], "pos")
    return index.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def bulk(rows: DataFrame, dimensions: int) -> DataFrame:
    """rows (clause_id, vector) with the reason why one can't be indexed, null for those that can."""
    reason = F.when(F.col("clause_id").isNull(), "no id").when(F.col("vector").isNull(), "no vector").when(F.size("vector") != dimensions, F.concat(F.lit("vector of "), F.size("vector").cast("string")))
    return rows.withColumn("error", reason)


def bulk_counts(rows: DataFrame) -> DataFrame:
    """(ok, errors) of rows that ``bulk`` marked."""
    return rows.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def deleted_counts(tables: dict[str, tuple[DataFrame, list[str]]], gone: DataFrame) -> DataFrame:
    """entity, n: how many rows of each table go with the deleted documents."""
    out = None
    for name, (df, columns) in tables.items():
        left = delete_cascade({name: (df, columns)}, gone)[name]
        n = df.agg(F.count("*").alias("a")).crossJoin(left.agg(F.count("*").alias("b")))  # one row each
        row = n.select(F.lit(name).alias("entity"), (F.col("a") - F.col("b")).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def usage(calls: DataFrame) -> DataFrame:
    """Calls, prompt and answer tokens by model, a token for each four characters begun."""
    tokens = lambda c: F.sum(F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)).alias(f"{c}_tokens")
    return calls.groupBy("model").agg(F.count("*").alias("calls"), tokens("prompt"), tokens("answer"))


def observed(calls: DataFrame, name: str = "usage"):
    """(calls as they are, an observation that holds their number and characters once an action has run)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return calls.observe(seen, F.count(F.lit(1)).alias("calls"), F.sum(F.length("prompt")).alias("prompt_chars"), F.sum(F.length("answer")).alias("answer_chars")), seen


def create(spark, name: str, schema: str, partition_by: str | None = None, location: str | None = None) -> None:
    """A Parquet table of a declared schema, unless it exists."""
    tail = f" PARTITIONED BY ({partition_by})" if partition_by else ""
    tail += f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{tail}")
