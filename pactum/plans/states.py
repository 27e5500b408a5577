"""Queries on lineage, replayed states, versions, tables, listings, roll-ups and status."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactum.functions.vocabulary import STATUSES
from pactum.operators import lineage, rollup, store, timeline
from pactum.sources import adapters as a


def root_walk(spark, sf_dir):
    """The same where the edges may have cycles; ``root_cycles`` has some."""
    return lineage.roots(a.lineage(spark, sf_dir), a.documents(spark, sf_dir), "entry").select("doc_id", "root_id", F.col("hops").cast("int").alias("hops"))


def root_pointers(spark, sf_dir):
    return lineage.roots(a.lineage(spark, sf_dir), a.documents(spark, sf_dir)).select("doc_id", "root_id", F.col("hops").cast("int").alias("hops"))


def chain_order(spark, sf_dir):
    return lineage.chain(a.lineage(spark, sf_dir), a.documents(spark, sf_dir)).select("root_id", "seq", "doc_id", "doc_type", "lifecycle", "effective_date")


def _log(spark, sf_dir):
    """(initial clauses, ordered changes) of the contracts in the event log; a contract starts with clauses 0 to 3."""
    log = a.contract_changes(spark, sf_dir)
    changes = log.withColumn("seq", F.row_number().over(W.partitionBy("root_id").orderBy("ts", "event_id")))
    start = log.select("root_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(3))))
    n = F.col("pos").cast("string")
    start = start.select("root_id", "pos", n.alias("number"), F.concat(F.lit("t"), n).alias("title"), F.concat(F.lit("b"), n).alias("body"), F.lit("Fees").alias("category"))
    return timeline.initial(start), changes


def fold_current(spark, sf_dir):
    start, changes = _log(spark, sf_dir)
    return timeline.fold(start, changes.filter("active"))


def fold_future(spark, sf_dir):
    start, changes = _log(spark, sf_dir)
    return timeline.states(start, changes).filter("state = 'future'").drop("state")


def _versions(spark, sf_dir):
    uploads = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderdate", "o_orderstatus")
    return store.next_versions(uploads, ["o_orderdate", "o_orderkey"])


def version_latest(spark, sf_dir):
    return store.latest(_versions(spark, sf_dir), ["doc_id"], "version_number").select("doc_id", "version_number", "o_orderkey")


def version_insert_if_absent(spark, sf_dir):
    v = _versions(spark, sf_dir).select("doc_id", "version_number", "o_orderkey")
    new = v.select("doc_id", (F.col("version_number") + 3).alias("version_number"), (-F.col("o_orderkey")).alias("o_orderkey"))
    return store.insert_if_absent(v, new, ["doc_id", "version_number"])


def version_delete_rollback(spark, sf_dir):
    v = _versions(spark, sf_dir)
    gone = v.filter("o_orderstatus = 'F' or version_number % 3 = 0").select("doc_id", "version_number")
    return store.delete_versions(v, gone, v.select("doc_id").distinct())


def upsert_latest_wins(spark, sf_dir):
    base = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.lit("draft").alias("lifecycle"))
    new = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.lower("o_orderstatus").alias("lifecycle"), F.col("o_orderkey").alias("seq"))
    return store.upsert(base, new, ["doc_id"], "seq")


def partial_update(spark, sf_dir):
    base = a.documents(spark, sf_dir).select("doc_id", "title", "lifecycle", "effective_date")
    d = F.col("doc_id")
    changes = a.table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(
        "doc_id", F.concat(F.lit("title "), d.cast("string")).alias("title"), F.lit("active").alias("lifecycle"), F.lit(None).cast("string").alias("effective_date"),
        (d % 2 == 0).alias("set_title"), (d % 5 == 0).alias("set_lifecycle"), (d % 7 == 0).alias("set_effective_date"),
    )
    return store.patch(base, changes, "doc_id", ["title", "lifecycle", "effective_date"])


def delete_cascade(spark, sf_dir):
    edges, clauses = a.lineage(spark, sf_dir), a.clauses(spark, sf_dir)
    gone = a.documents(spark, sf_dir).filter("doc_id % 10 = 3").select("doc_id")
    left = store.delete_cascade({"edge": (edges, ["parent_id", "child_id"]), "clause": (clauses, ["doc_id"]), "document": (a.documents(spark, sf_dir), ["doc_id"])}, gone)
    return left["edge"].agg(F.lit("edge").alias("entity"), F.count("*").alias("n")).unionByName(left["clause"].agg(F.lit("clause").alias("entity"), F.count("*").alias("n"))).unionByName(left["document"].agg(F.lit("document").alias("entity"), F.count("*").alias("n")))


def _cached(spark, sf_dir):
    from pactum.functions.text import content_hash, embedding_input

    rows = a.clauses(spark, sf_dir).select("doc_id", "pos", content_hash(F.col("body")).alias("content_hash"), embedding_input(F.col("body")).alias("text"))
    cache = rows.filter("doc_id % 4 = 0").select("content_hash", F.lit("hashed-16").alias("model"), F.array(F.lit(0.0)).cast("array<float>").alias("vector"))
    return rows, cache


def cache_hit_miss(spark, sf_dir):
    rows, cache = _cached(spark, sf_dir)
    hit = F.col("vector").isNotNull()
    return store.cache_lookup(rows, cache, "hashed-16").groupBy("doc_id").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def cache_dedupe_misses(spark, sf_dir):
    rows, cache = _cached(spark, sf_dir)
    return store.cache_misses(rows, cache, "hashed-16").select("content_hash", F.length("text").alias("n_chars"))


def _meta(spark, sf_dir):
    docs, clauses = a.documents(spark, sf_dir), a.clauses(spark, sf_dir)
    d = F.col("doc_id")
    classified = docs.select("doc_id", "tenant_id", F.when(d % 6 != 0, F.col("title")).otherwise("").alias("title"), "doc_type", F.when(d % 9 != 0, F.col("lifecycle")).alias("lifecycle"), "effective_date", F.sha2("title", 256).alias("structural_hash"))
    existing = docs.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("old "), d.cast("string")).alias("title"), "doc_type", F.lit("review").alias("lifecycle"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    links = a.lineage(spark, sf_dir).select(F.col("child_id").alias("doc_id"), F.col("parent_id").alias("parent_doc_id"))
    versions = _versions(spark, sf_dir).select("doc_id", "version_number")
    return rollup.meta(classified, rollup.risk(clauses), existing, links, versions, F.lit("2025-01-01 00:00:00").cast("timestamp"))


def meta_assembly(spark, sf_dir):
    rows = _meta(spark, sf_dir)
    return rows.select("doc_id", "tenant_id", "title", "doc_type", "lifecycle", "status", "effective_date", "parent_doc_id", "processed_prefix", "latest_version", "created_at", "clause_count", "high_risk_count", "overall_risk", F.col("risk_counts.critical").alias("critical"))


def portfolio_by_tenant(spark, sf_dir):
    return rollup.portfolio(_meta(spark, sf_dir))


def reconcile_totals(spark, sf_dir):
    orders = a.table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.0).alias("base"), F.col("o_totalprice").alias("stated"))
    parts = a.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("amount"))
    return rollup.reconcile(orders, parts, "o_orderkey").select("o_orderkey", "stated", F.round("expected", 6).alias("expected"), "reconciled")


def tenant_listing(spark, sf_dir):
    return store.listing(a.documents(spark, sf_dir)).select("tenant_id", "rank", "doc_id", "title")


def keyset_page(spark, sf_dir):
    return store.page(a.documents(spark, sf_dir), "src3", 400, 20).select("doc_id", "tenant_id", "title", "doc_type")


def changes_version_range(spark, sf_dir):
    v = _versions(spark, sf_dir).withColumns({"low": F.when(F.col("doc_id") % 3 != 0, 2), "high": F.when(F.col("doc_id") % 4 != 0, 5)})
    return store.changes_between(v, F.col("low"), F.col("high")).select("doc_id", "version_number", "o_orderkey")


def status_events(spark, sf_dir):
    """Status events from the event table: the n-th event of a document moves it to the n-th status, an error to FAILED."""
    e = a.table(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("event_type") == "error", "FAILED").otherwise(F.element_at(F.array(*map(F.lit, STATUSES[:9])), F.least(n, F.lit(9))))
    return e.select(F.col("user_id").alias("doc_id"), "event_id", "ts", status.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), F.col("props"))).alias("error"))


def status_latest(spark, sf_dir):
    return store.latest_status(status_events(spark, sf_dir))


QUERIES = {f.__name__: f for f in (root_walk, root_pointers, chain_order, fold_current, fold_future, version_latest, version_insert_if_absent, version_delete_rollback, upsert_latest_wins, partial_update, delete_cascade, cache_hit_miss, cache_dedupe_misses, meta_assembly, portfolio_by_tenant, reconcile_totals, tenant_listing, keyset_page, changes_version_range, status_latest)}

_ROOT = f"""WITH RECURSIVE {a.SQL_LINEAGE}, walk AS (SELECT doc_id, doc_id AS at_id, 0 AS hops FROM documents UNION ALL SELECT w.doc_id, e.parent_id, w.hops + 1 FROM walk w JOIN edge e ON e.child_id = w.at_id)
SELECT doc_id, max_by(at_id, hops) AS root_id, max(hops) AS hops FROM walk GROUP BY doc_id"""


def _fold(where: str) -> str:
    return f"""WITH {a.SQL_CHANGES}, seqd AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY ts, event_id) AS seq FROM change),
roots AS (SELECT DISTINCT root_id FROM change), start AS (SELECT root_id, CAST(unnest(range(4)) AS VARCHAR) AS k FROM roots),
ev AS (SELECT root_id, k, 0 AS seq, k AS number, unnest(['title', 'body', 'category']) AS field, unnest(['t' || k, 'b' || k, 'Fees']) AS after, FALSE AS gone FROM start
    UNION ALL SELECT root_id, number, seq, number, field, after, field = 'body' AND after = '' FROM seqd WHERE {where}),
kept AS (SELECT * FROM (SELECT *, max(CASE WHEN gone THEN seq ELSE -1 END) OVER (PARTITION BY root_id, k) AS ld FROM ev) WHERE NOT gone AND seq > ld)
SELECT root_id, k AS clause_key, min_by(number, seq) AS number, coalesce(max_by(after, seq) FILTER (field = 'title'), '') AS title, coalesce(max_by(after, seq) FILTER (field = 'body'), '') AS body,
    coalesce(max_by(after, seq) FILTER (field = 'category'), 'Other') AS category FROM kept GROUP BY root_id, k"""


_V = "v AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version_number FROM orders)"
_CACHED = f"{a.SQL_CLAUSE}, r AS (SELECT doc_id, pos, sha256(trim(body)) AS content_hash, coalesce(nullif(trim(body), ''), ' ') AS text FROM clause), c AS (SELECT DISTINCT content_hash FROM r WHERE doc_id % 4 = 0)"
_META = f"""WITH {a.SQL_CLAUSE}, {a.SQL_DOCUMENT}, {a.SQL_LINEAGE}, {_V}, risk AS (SELECT doc_id, count(*) AS n, count(*) FILTER (risk_level = 'low') AS low, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'high') AS high,
    count(*) FILTER (risk_level = 'critical') AS critical FROM clause GROUP BY doc_id), mv AS (SELECT doc_id, max(version_number) AS m FROM v GROUP BY doc_id),
meta AS (SELECT d.doc_id, tenant_id, coalesce(nullif(CASE WHEN d.doc_id % 6 <> 0 THEN title ELSE '' END, ''), CASE WHEN d.doc_id % 4 = 0 THEN 'old ' || d.doc_id END, 'Untitled') AS title, doc_type,
    coalesce(CASE WHEN d.doc_id % 9 <> 0 THEN lifecycle END, CASE WHEN d.doc_id % 4 = 0 THEN 'review' END, 'draft') AS lifecycle, 'READY' AS status, effective_date, parent_id AS parent_doc_id,
    tenant_id || '/' || d.doc_id || '/' AS processed_prefix, CAST(coalesce(m, 0) + 1 AS INTEGER) AS latest_version, CASE WHEN d.doc_id % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS created_at,
    coalesce(n, 0) AS clause_count, coalesce(high + critical, 0) AS high_risk_count, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END AS overall_risk, coalesce(critical, 0) AS critical
    FROM document d LEFT JOIN risk r USING (doc_id) LEFT JOIN edge e ON e.child_id = d.doc_id LEFT JOIN mv USING (doc_id))
"""
_STATUS = "[" + ", ".join(f"'{x}'" for x in STATUSES[:9]) + "]"
SQL = {
    "root_walk": _ROOT,
    "root_pointers": _ROOT,
    "chain_order": f"WITH {a.SQL_DOCUMENT}, {a.SQL_LINEAGE} SELECT parent_id AS root_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(effective_date, ''), doc_id) AS INTEGER) AS seq, doc_id, doc_type, lifecycle, effective_date FROM edge JOIN document ON child_id = doc_id",
    "fold_current": _fold("active"),
    "fold_future": _fold("root_id IN (SELECT root_id FROM change WHERE NOT active)"),
    "version_latest": f"WITH {_V} SELECT doc_id, max(version_number) AS version_number, max_by(o_orderkey, version_number) AS o_orderkey FROM v GROUP BY doc_id",
    "version_insert_if_absent": f"WITH {_V}, old AS (SELECT doc_id, version_number, o_orderkey FROM v) SELECT * FROM old UNION ALL SELECT doc_id, version_number, o_orderkey FROM (SELECT doc_id, version_number + 3 AS version_number, -o_orderkey AS o_orderkey FROM v) n ANTI JOIN old USING (doc_id, version_number)",
    "version_delete_rollback": f"WITH {_V} SELECT doc_id, max(version_number) FILTER (kept) AS latest_version, nullif(count(*) FILTER (kept), 0) AS n_versions FROM (SELECT *, NOT (o_orderstatus = 'F' OR version_number % 3 = 0) AS kept FROM v) GROUP BY doc_id",
    "upsert_latest_wins": "WITH n AS (SELECT o_custkey AS doc_id, 'order ' || max(o_orderkey) AS title, lower(max_by(o_orderstatus, o_orderkey)) AS lifecycle FROM orders GROUP BY o_custkey) SELECT * FROM n UNION ALL SELECT c_custkey, c_name, 'draft' FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM n)",
    "partial_update": f"WITH {a.SQL_DOCUMENT} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'title ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 15 = 0 THEN 'active' ELSE lifecycle END AS lifecycle, CASE WHEN doc_id % 21 = 0 THEN NULL ELSE effective_date END AS effective_date FROM document",
    "delete_cascade": f"WITH {a.SQL_CLAUSE}, {a.SQL_LINEAGE} SELECT 'edge' AS entity, count(*) AS n FROM edge WHERE parent_id % 10 <> 3 AND child_id % 10 <> 3 UNION ALL SELECT 'clause', count(*) FROM clause WHERE doc_id % 10 <> 3 UNION ALL SELECT 'document', count(*) FROM documents WHERE doc_id % 10 <> 3",
    "cache_hit_miss": f"WITH {_CACHED} SELECT doc_id, count(c.content_hash) AS hits, count(*) - count(c.content_hash) AS misses FROM r LEFT JOIN c USING (content_hash) GROUP BY doc_id",
    "cache_dedupe_misses": f"WITH {_CACHED} SELECT content_hash, CAST(length(min(text)) AS INTEGER) AS n_chars FROM r ANTI JOIN c USING (content_hash) GROUP BY content_hash",
    "meta_assembly": _META + "SELECT * FROM meta",
    "portfolio_by_tenant": _META + "SELECT tenant_id, doc_type, count(*) AS n_docs, CAST(sum(clause_count) AS BIGINT) AS n_clauses, CAST(sum(high_risk_count) AS BIGINT) AS n_high_risk, count(*) FILTER (overall_risk = 'critical') AS n_critical FROM meta GROUP BY ROLLUP (tenant_id, doc_type)",
    "reconcile_totals": "SELECT o_orderkey, o_totalprice AS stated, round(coalesce(s, 0), 6) AS expected, abs(coalesce(s, 0) - o_totalprice) <= 1 AS reconciled FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "tenant_listing": f"WITH {a.SQL_DOCUMENT} SELECT * FROM (SELECT tenant_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id) AS INTEGER) AS rank, doc_id, title FROM document) WHERE rank <= 200",
    "keyset_page": f"WITH {a.SQL_DOCUMENT} SELECT doc_id, tenant_id, title, doc_type FROM document WHERE tenant_id = 'src3' AND doc_id < 400 ORDER BY doc_id DESC LIMIT 20",
    "changes_version_range": f"WITH {_V} SELECT doc_id, version_number, o_orderkey FROM v WHERE (doc_id % 3 = 0 OR version_number >= 2) AND (doc_id % 4 = 0 OR version_number <= 5)",
    "status_latest": f"""WITH e AS (SELECT user_id AS doc_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE ({_STATUS})[least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 9)] END AS status, CASE WHEN event_type = 'error' THEN 'Error: ' || props END AS error FROM events)
        SELECT doc_id, status, error, ts, n_events FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_events, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1""",
}
