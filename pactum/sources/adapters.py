"""Contract-shaped views of the driver's tables, and the same views as DuckDB SQL.

Documents stand for contracts: lines are clauses, the source is the tenant, and
type, lifecycle and date follow from doc_id by rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.vocabulary import CLAUSE_CATEGORIES, LIFECYCLES, RISK_LEVELS

_TYPES = ["MSA", "MSA", "SOW", "SOW", "SOW", "SOW", "AMENDMENT", "AMENDMENT", "AMENDMENT", "AMENDMENT"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def first_words(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(text, " ", n + 1), 1, n), " ")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause for each line of each document."""
    return clauses_of(table(spark, sf_dir, "documents"))


def clauses_of(texts: DataFrame, *own: str) -> DataFrame:
    """A clause for each line of each text (doc_id, text), with the document's columns own."""
    lines = texts.select("doc_id", *own, F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    at = F.length("body") + F.col("pos")
    return lines.select(
        "doc_id", *own, "pos", (F.col("pos") + 1).cast("string").alias("number"), first_words(F.col("body")).alias("title"), "body",
        _pick(CLAUSE_CATEGORIES, at).alias("category"), _pick(RISK_LEVELS, F.length("body")).alias("risk_level"),
    )


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Contract records; a title is the first words of a text's first line. more: columns of the table to keep."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("tenant_id"), first_words(F.element_at(F.split("text", "\n"), 1)).alias("title"),
        _pick(_TYPES, d).alias("doc_type"), _pick(LIFECYCLES, d).alias("lifecycle"),
        F.when(d % 17 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int")), "yyyy-MM-dd")).alias("effective_date"),
        F.col("n_chars").alias("n_chars"), *more,
    )


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a test hierarchy: every document from 20 on amends the one of a third of its number."""
    return table(spark, sf_dir, "documents").filter("doc_id >= 20").select(F.expr("doc_id div 3").alias("parent_id"), F.col("doc_id").alias("child_id"))


def parents_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child_id, parent_id): for each document the earlier one that owns most of its long lines.

    A line of over 20 characters is owned by the least doc_id that has it, so
    the work grows with the number of lines, not of pairs of documents that
    share one. A parent owns at least a fifth of the child's long lines.
    """
    lines = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
        .filter(F.length("line") > 20)
        .select("doc_id", F.sha2("line", 256).alias("line"))
    )
    owner = lines.groupBy("line").agg(F.min("doc_id").alias("owner"))
    owned = lines.join(owner, "line").groupBy("doc_id", "owner").agg(F.count("*").alias("n"))
    best = owned.groupBy("doc_id").agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("owner") != F.col("doc_id"), F.struct("n", (-F.col("owner")).alias("o")))).alias("best")
    )
    return best.filter("best.n >= 0.2 * total").select(F.col("doc_id").alias("child_id"), (-F.col("best.o")).alias("parent_id"))


def contract_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log from events: contract, order, clause key, field, new value, whether its amendment is active."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("root_id"), F.col("ts"), F.col("event_id"), (F.col("event_id") % 7).cast("string").alias("number"),
        F.when(kind == "click", "title").when(kind == "purchase", "category").otherwise("body").alias("field"),
        F.when(kind == "error", "").otherwise(F.concat(kind, F.lit(":"), F.col("event_id").cast("string"))).alias("after"),
        (F.col("value") >= 50).alias("active"),
    )


# The same views for the oracle.


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_WORDS = "array_to_string(list_slice(string_split({0}, ' '), 1, 6), ' ')"
SQL_CLAUSE = f"""line AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
clause AS (SELECT doc_id, pos, CAST(pos + 1 AS VARCHAR) AS number, {SQL_WORDS.format('body')} AS title, body,
    {_list(CLAUSE_CATEGORIES)}[CAST((length(body) + pos) % 24 + 1 AS INTEGER)] AS category, {_list(RISK_LEVELS)}[CAST(length(body) % 4 + 1 AS INTEGER)] AS risk_level FROM line)"""
SQL_DOCUMENT = f"""document AS (SELECT doc_id, source AS tenant_id, {SQL_WORDS.format("string_split(text, chr(10))[1]")} AS title,
    {_list(_TYPES)}[CAST(doc_id % 10 + 1 AS INTEGER)] AS doc_type, {_list(LIFECYCLES)}[CAST(doc_id % 8 + 1 AS INTEGER)] AS lifecycle,
    CASE WHEN doc_id % 17 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS effective_date, n_chars FROM documents)"""
SQL_LINEAGE = "edge AS (SELECT doc_id // 3 AS parent_id, doc_id AS child_id FROM documents WHERE doc_id >= 20)"
SQL_PARENTS = """longline AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
kept AS (SELECT * FROM longline WHERE length(line) > 20),
owner AS (SELECT line, min(doc_id) AS owner FROM kept GROUP BY line),
owned AS (SELECT doc_id, owner, count(*) AS n FROM kept JOIN owner USING (line) GROUP BY ALL),
parents AS (SELECT doc_id AS child_id, owner AS parent_id FROM (
    SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY owner = doc_id, n DESC, owner) AS r FROM owned)
    WHERE r = 1 AND owner <> doc_id AND n >= 0.2 * total)"""
SQL_CHANGES = """change AS (SELECT user_id AS root_id, ts, event_id, CAST(event_id % 7 AS VARCHAR) AS number,
    CASE event_type WHEN 'click' THEN 'title' WHEN 'purchase' THEN 'category' ELSE 'body' END AS field,
    CASE event_type WHEN 'error' THEN '' ELSE event_type || ':' || CAST(event_id AS VARCHAR) END AS after, value >= 50 AS active FROM events)"""
