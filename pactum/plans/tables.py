"""Queries on edges, loaders, indexes, caches, metering and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.functions import text as t
from pactum.functions.vocabulary import EXTRACTION_METHODS, LIFECYCLES, one_of
from pactum.operators import api, diff, lineage, rollup, search, store, timeline
from pactum.plans import diffs, states
from pactum.sources import adapters as a
from pactum.sources.shared import materialize, shared_dir

_DAY = "2024-01-01 00:00:00"


def _time(text=_DAY):
    return F.lit(text).cast("timestamp")


def edge_append(spark, sf_dir):
    """Matches of near-copy documents appended to the edges of every third child; those that come again keep their date."""
    matches = a.parents_by_lines(spark, sf_dir).select(F.col("child_id").alias("doc_id"), F.col("parent_id").alias("parent_doc_id"))
    old = lineage.edges_of(matches.filter("doc_id % 3 = 0"), _time("2023-06-01 00:00:00"))
    return lineage.append_edges(old, lineage.edges_of(matches, _time()))


def root_cycles(spark, sf_dir):
    """Roots where of every eight documents five form a cycle, two lead into it and one stands alone."""
    docs = a.table(spark, sf_dir, "documents").select("doc_id")
    k, base = F.col("doc_id") % 8, F.col("doc_id") - F.col("doc_id") % 8
    parent = F.when(k < 5, base + (k + 1) % 5).when(k == 5, base + 2).when(k == 6, base + 5)
    edges = docs.select(parent.alias("parent_id"), F.col("doc_id").alias("child_id")).filter("parent_id is not null")
    edges = edges.join(docs.withColumnRenamed("doc_id", "parent_id"), "parent_id", "left_semi")
    return lineage.roots(edges, docs, "entry").select("doc_id", "root_id")


def change_upsert(spark, sf_dir):
    """Change rows of every fourth document replaced by a second run of equal ids with one point less."""
    changes = diff.change_ids(diffs._scored(spark, sf_dir), F.lit(1)).select("doc_id", "change_id", "seq", "impact_score")
    again = changes.filter("doc_id % 4 = 0").withColumn("impact_score", F.col("impact_score") - 1).withColumn("_run", F.lit(2))
    return store.upsert(changes, again, ["doc_id", "change_id"], "_run")


def index_replace(spark, sf_dir):
    """Index rows of every fifth document replaced by those of its even lines; no stale row stays."""
    rows = a.clauses(spark, sf_dir).select(t.safe_id(F.col("doc_id"), F.col("number")).alias("clause_id"), "doc_id", "pos", F.length("body").alias("n_chars"))
    new = rows.filter("doc_id % 5 = 0 and pos % 2 = 0").withColumn("n_chars", -F.col("n_chars"))
    return store.replace_by_document(rows, new.unionByName(new))


def bulk_index(spark, sf_dir):
    """Rows that an index takes, and why it refuses others."""
    v = a.table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    rows = v.select(F.when(i % 11 != 0, i).alias("clause_id"), F.when(i % 7 == 0, F.slice("embedding", 1, 10)).when(i % 5 != 0, F.col("embedding")).alias("vector"))
    marked = store.bulk(rows, 64)
    return marked.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def bulk_result(spark, sf_dir):
    v = a.table(spark, sf_dir, "embeddings")
    return store.bulk_counts(store.bulk(v.select(F.col("vec_id").alias("clause_id"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("vector")), 64))


def cache_upsert(spark, sf_dir):
    """Cached vectors of two models; a text that comes again for a model has its last vector."""
    rows = a.clauses(spark, sf_dir).select(t.content_hash(F.col("body")).alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("model"), F.col("doc_id").alias("seq"))
    base = rows.filter("seq % 3 = 0").groupBy("content_hash", "model").agg(F.lit(-1).cast("long").alias("made_by"))
    return store.upsert(base, rows.filter("seq % 3 = 1").withColumn("made_by", F.col("seq")), ["content_hash", "model"], "seq")


def embed_batches(spark, sf_dir):
    """Vectors for texts that the cache lacks, by an embedder that takes lists of at most a hundred."""
    rows, cache = states._cached(spark, sf_dir)
    made = store.embed_missing(rows, cache, lambda texts: [[float(len(x)), float(len(texts) <= 100)] for x in texts], "hashed-16")
    return made.select("content_hash", "model", F.col("vector")[0].cast("double").alias("size"), F.col("vector")[1].cast("double").alias("small"))


def embed_gate(spark, sf_dir):
    """Documents that the embedding stage has work for: those with a clause that has a body."""
    rows = a.clauses(spark, sf_dir).filter(F.trim("body") != "").groupBy("doc_id").agg(F.count("*").alias("n_clauses"))
    return a.documents(spark, sf_dir).select("doc_id").join(rows, "doc_id")


def latest_parent_clauses(spark, sf_dir):
    """Number of clauses that a diff compares with: by the latest artefact, the conventional one, or none."""
    docs = a.documents(spark, sf_dir).select("doc_id", "tenant_id")
    key = lambda n: F.concat(F.lit("v"), n.cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    versions = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version_number")).filter("doc_id % 4 <> 1")
    versions = versions.withColumn("classification_key", F.when((F.col("version_number") < 3) | (F.col("doc_id") % 2 == 0), key(F.col("version_number"))))
    conventional = t.processed_key(F.col("tenant_id"), F.col("doc_id"), "classification.json")
    artefacts = docs.filter("doc_id % 4 <> 2").select(key(F.lit(2)).alias("artefact_key"), F.lit(2).alias("n")).unionByName(docs.filter("doc_id % 3 <> 0").select(conventional.alias("artefact_key"), F.lit(9).alias("n")))
    parents = a.lineage(spark, sf_dir).select(F.col("child_id").alias("doc_id"), "parent_id")
    return lineage.parent_clauses(parents, versions, docs, artefacts).select("doc_id", "parent_id", "n")


def chain_with_current(spark, sf_dir):
    """Chains with amendments on their way: every sixth document under the root of its number div 30, with a date of its own."""
    d = F.col("doc_id")
    docs = a.documents(spark, sf_dir)
    current = docs.filter("doc_id >= 30 and doc_id % 6 = 0").select(
        F.expr("doc_id div 30").alias("root_id"), "doc_id", F.when(d % 12 == 0, "AMENDMENT").otherwise("SOW").alias("doc_type"), F.lit("active").alias("lifecycle"), F.lit("2023-01-01").alias("effective_date"), F.lit("on its way").alias("title"),
    )
    return lineage.chain(a.lineage(spark, sf_dir), docs, current).select("root_id", "seq", "doc_id", "doc_type", "lifecycle", "effective_date")


def current_over_stored(spark, sf_dir):
    """Change rows: of documents on their way the new ones, of others those that are stored."""
    log = a.contract_changes(spark, sf_dir).select(F.col("root_id").alias("doc_id"), "event_id", "field")
    return lineage.prefer(log.filter("doc_id % 3 = 0 and event_id % 2 = 0").withColumn("source", F.lit("current")), log.withColumn("source", F.lit("stored")), ["doc_id"])


def active_members(spark, sf_dir):
    """Members whose changes count now, whatever the case of their lifecycle, and whether it is one of the known ones."""
    cased = F.when(F.col("doc_id") % 2 == 0, F.upper("lifecycle")).when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lifecycle"))
    return a.documents(spark, sf_dir).select("doc_id", timeline.is_active(cased).alias("active"), one_of(cased, LIFECYCLES).alias("known"))


def version_list(spark, sf_dir):
    """Versions as responses show them: every fifth lacks its method, every seventh its keys."""
    v = states._versions(spark, sf_dir)
    k = F.col("o_orderkey")
    method = F.when(k % 5 != 0, F.element_at(F.array(*map(F.lit, EXTRACTION_METHODS)), (k % 3 + 1).cast("int")))
    rows = v.select("doc_id", F.col("version_number").cast("long").alias("version_number"), method.alias("extraction_method"), F.when(k % 7 != 0, F.concat(F.lit("p/"), k.cast("string"))).alias("parsed_key"), F.when(k % 2 == 0, F.concat(F.lit("d/"), k.cast("string"))).alias("diff_key"))
    return api.version_list(rows)


def graph_documents(spark, sf_dir):
    d = F.col("doc_id")
    docs = a.documents(spark, sf_dir).select("doc_id", "tenant_id", "doc_type", "title", F.when(d % 9 == 0, "FAILED").otherwise("READY").alias("status"), F.when(d % 2 == 0, F.lit(3)).alias("latest_version"), F.lit(_DAY).alias("created_at"), F.lit(None).cast("long").alias("parent_doc_id"), F.concat(F.lit("raw/"), d.cast("string")).alias("raw_key"), F.when(d % 3 == 0, F.concat(F.lit("p/"), d.cast("string"))).otherwise("").alias("processed_prefix"), F.lit(_DAY).alias("updated_at"))
    errors = docs.filter("status = 'FAILED'").select("doc_id", F.concat(F.lit("Error: "), d.cast("string")).alias("error"))
    return api.graph_documents(docs, errors).select("id", "tenantId", "type", "title", "status", "currentVersion", "rawS3Uri", "processedS3Uri", "errorMessage")


def _change_rows(spark, sf_dir):
    return diff.change_ids(diffs._scored(spark, sf_dir), F.lit(2)).withColumn("version_number", F.lit(2))


def graph_changes(spark, sf_dir):
    return api.graph_changes(_change_rows(spark, sf_dir)).select("id", "documentId", "fromVersion", "toVersion", "clauseNumber", "field", "impactScore", "aiRationale")


def graph_versions(spark, sf_dir):
    versions = a.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version_number"), F.lit(_DAY).alias("created_at"))
    return api.graph_versions(versions, _change_rows(spark, sf_dir)).select("documentId", "version", "changes", "summary")


def refined_scores(spark, sf_dir):
    """Scores of each document's most changed clauses by a refiner that fails for fees."""

    def refiner(category, field, before, after):
        if category == "Fees":
            raise RuntimeError("no answer")
        return min(99, len(before) % 50 + len(after) % 50), f"{field}: {len(before)} to {len(after)}"

    found = diff.refine(diffs._scored(spark, sf_dir), refiner)
    return found.select("doc_id", "seq", "impact_score", "impact_rationale")


def usage_metering(spark, sf_dir):
    calls = a.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, "large").otherwise("small").alias("model"), F.col("text").alias("prompt"), F.when(F.col("doc_id") % 3 != 0, F.left("text", F.lit(50))).alias("answer"))
    return store.usage(calls)


def deleted_counts(spark, sf_dir):
    gone = a.documents(spark, sf_dir).filter("doc_id % 10 = 3").select("doc_id")
    return store.deleted_counts({"edge": (a.lineage(spark, sf_dir), ["parent_id", "child_id"]), "clause": (a.clauses(spark, sf_dir), ["doc_id"]), "document": (a.documents(spark, sf_dir), ["doc_id"])}, gone)


def meta_fields(spark, sf_dir):
    """Every field of the document record that the classification, the parsed file and the checks give."""
    d = F.col("doc_id")
    docs = a.documents(spark, sf_dir)
    findings = F.transform(F.sequence(F.lit(1), (d % 4).cast("int") + 1), lambda i: F.struct(F.lit("x").alias("label"), F.lit("y").alias("detail"), F.lit("info").alias("severity")))
    classified = docs.select(
        "doc_id", "tenant_id", "title", "doc_type", "lifecycle", "effective_date", F.sha2("title", 256).alias("structural_hash"), F.when(d % 2 == 0, F.array(F.lit("A"), F.lit("B"))).alias("parties"), F.concat(F.lit("raw/"), d.cast("string")).alias("raw_key"),
        F.when(d % 3 == 0, F.sha2("title", 256)).alias("checksum"), F.when(d % 5 == 0, F.col("title")).alias("summary"), F.when(d % 7 != 0, findings).alias("key_findings"), F.lit("fixed").alias("pricing_model"), F.when(d % 2 == 1, F.lit("the agreement")).alias("parent_reference"),
        F.lit(1.5).alias("contract_value"), F.lit(None).cast("double").alias("base_value"), F.lit(None).cast("double").alias("value_delta"), F.lit("USD").alias("currency"), F.lit("Net 30").alias("payment_terms"), (d % 2 == 0).alias("reconciled"),
    )
    nothing = spark.createDataFrame([], "doc_id long, title string, doc_type string, lifecycle string, created_at timestamp")
    rows = rollup.meta(classified, rollup.risk(a.clauses(spark, sf_dir)), nothing, spark.createDataFrame([], "doc_id long, parent_doc_id long"), spark.createDataFrame([], "doc_id long, version_number int"), _time())
    return rows.select("doc_id", "title", F.size("parties").alias("n_parties"), "raw_key", "checksum", "summary", "findings_count", "pricing_model", "parent_reference", "contract_value", "currency", "payment_terms", "reconciled", "latest_version")


def top_k_clamp(spark, sf_dir):
    asked = F.when(F.col("p_size") % 4 != 0, F.col("p_size") - 10)
    return a.table(spark, sf_dir, "part").select("p_partkey", search.top_k(asked).cast("int").alias("k"))


def timestamps(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", t.utc_seconds(F.col("ts")).alias("at"))


def table_created_once(spark, sf_dir):
    """An index table made twice under one name: the second time changes nothing."""
    from pactum.functions import schemas

    name, folder = f"pactum_edges_{shared_dir(spark, 'x').rsplit('-', 1)[-1]}", shared_dir(spark, "table")
    for _ in range(2):
        store.create(spark, name, schemas.LINEAGE, location=folder)
        a.lineage(spark, sf_dir).select(F.col("parent_id").cast("string").alias("parent_id"), F.col("child_id").cast("string").alias("child_id"), _time().alias("created_at")).filter("parent_id % 2 = 0").write.mode("append").insertInto(name)
    rows = materialize(spark.table(name).groupBy("parent_id").agg(F.count("*").alias("n")), "created")
    spark.sql(f"DROP TABLE {name}")
    return rows


QUERIES = {
    f.__name__: f
    for f in (
        edge_append, root_cycles, change_upsert, index_replace, bulk_index, bulk_result, cache_upsert, embed_batches, embed_gate, latest_parent_clauses, chain_with_current, current_over_stored, active_members, version_list,
        graph_documents, graph_changes, graph_versions, refined_scores, usage_metering, deleted_counts, meta_fields, top_k_clamp, timestamps, table_created_once,
    )
}

_ID = "sha256(concat_ws('|', doc_id, {0}, seq))"
SQL = {
    "edge_append": f"WITH {a.SQL_PARENTS} SELECT parent_id, child_id, CASE WHEN child_id % 3 = 0 THEN TIMESTAMP '2023-06-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at FROM parents",
    "root_cycles": """WITH RECURSIVE d AS (SELECT doc_id, doc_id % 8 AS k, doc_id - doc_id % 8 AS b FROM documents), e AS (SELECT doc_id AS child_id, CASE WHEN k < 5 THEN b + (k + 1) % 5 WHEN k = 5 THEN b + 2 WHEN k = 6 THEN b + 5 END AS parent_id FROM d),
        edge AS (SELECT * FROM e WHERE parent_id IN (SELECT doc_id FROM documents)), walk AS (SELECT doc_id, doc_id AS place, 0 AS n FROM documents UNION ALL SELECT w.doc_id, e.parent_id, n + 1 FROM walk w JOIN edge e ON e.child_id = w.place WHERE n < 8),
        looped AS (SELECT DISTINCT doc_id FROM walk WHERE n > 0 AND place = doc_id), ends AS (SELECT w.doc_id, w.place, w.n FROM walk w WHERE w.place IN (SELECT doc_id FROM looped) OR w.place NOT IN (SELECT child_id FROM edge))
        SELECT doc_id, min_by(place, n) AS root_id FROM ends GROUP BY doc_id""",
    "change_upsert": diffs.SQL_SCORED + f"SELECT doc_id, {_ID.format(1)} AS change_id, seq, CAST(impact_score - CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS impact_score FROM impact",
    "index_replace": f"WITH {a.SQL_CLAUSE} SELECT doc_id || '::' || number AS clause_id, doc_id, pos, CAST(CASE WHEN doc_id % 5 = 0 THEN -length(body) ELSE length(body) END AS INTEGER) AS n_chars FROM clause WHERE doc_id % 5 <> 0 OR pos % 2 = 0",
    "bulk_index": "SELECT CASE WHEN vec_id % 11 = 0 THEN 'no id' WHEN vec_id % 7 = 0 THEN 'vector of 10' WHEN vec_id % 5 = 0 THEN 'no vector' ELSE 'ok' END AS outcome, count(*) AS n FROM embeddings GROUP BY 1",
    "bulk_result": "SELECT count(*) FILTER (vec_id % 3 <> 0) AS ok, count(*) FILTER (vec_id % 3 = 0) AS errors FROM embeddings",
    "cache_upsert": f"""WITH {a.SQL_CLAUSE}, r AS (SELECT sha256(trim(body)) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, doc_id AS seq FROM clause), n AS (SELECT content_hash, model, max(seq) AS made_by FROM r WHERE seq % 3 = 1 GROUP BY ALL)
        SELECT * FROM n UNION ALL SELECT DISTINCT content_hash, model, CAST(-1 AS BIGINT) FROM r ANTI JOIN n USING (content_hash, model) WHERE seq % 3 = 0""",
    "embed_batches": f"WITH {states._CACHED} SELECT content_hash, 'hashed-16' AS model, CAST(length(min(text)) AS DOUBLE) AS size, CAST(1 AS DOUBLE) AS small FROM r ANTI JOIN c USING (content_hash) GROUP BY content_hash",
    "embed_gate": f"WITH {a.SQL_CLAUSE} SELECT doc_id, count(*) AS n_clauses FROM clause WHERE trim(body) <> '' GROUP BY doc_id",
    "latest_parent_clauses": f"""WITH {a.SQL_LINEAGE}, p AS (SELECT child_id AS doc_id, parent_id, CASE WHEN parent_id % 4 = 1 THEN NULL WHEN parent_id % 2 = 0 THEN 3 ELSE 2 END AS v FROM edge)
        SELECT doc_id, parent_id, CAST(CASE WHEN v = 2 AND parent_id % 4 <> 2 THEN 2 ELSE 9 END AS INTEGER) AS n FROM p WHERE parent_id IN (SELECT doc_id FROM documents) AND ((v = 2 AND parent_id % 4 <> 2) OR parent_id % 3 <> 0)""",
    "chain_with_current": f"""WITH {a.SQL_DOCUMENT}, {a.SQL_LINEAGE}, cur AS (SELECT doc_id // 30 AS root_id, doc_id, CASE WHEN doc_id % 12 = 0 THEN 'AMENDMENT' ELSE 'SOW' END AS doc_type FROM documents WHERE doc_id >= 30 AND doc_id % 6 = 0),
        l AS (SELECT parent_id AS root_id, child_id AS doc_id FROM edge UNION SELECT root_id, doc_id FROM cur WHERE doc_type = 'AMENDMENT'),
        m AS (SELECT l.root_id, l.doc_id, coalesce(c.doc_type, d.doc_type) AS doc_type, CASE WHEN c.doc_id IS NULL THEN d.lifecycle ELSE 'active' END AS lifecycle, CASE WHEN c.doc_id IS NULL THEN d.effective_date ELSE '2023-01-01' END AS effective_date FROM l JOIN document d USING (doc_id) LEFT JOIN cur c ON c.doc_id = l.doc_id)
        SELECT root_id, CAST(row_number() OVER (PARTITION BY root_id ORDER BY coalesce(effective_date, ''), doc_id) AS INTEGER) AS seq, doc_id, doc_type, lifecycle, effective_date FROM m""",
    "current_over_stored": f"""WITH {a.SQL_CHANGES}, c AS (SELECT root_id AS doc_id, event_id, field FROM change WHERE root_id % 3 = 0 AND event_id % 2 = 0)
        SELECT *, 'current' AS source FROM c UNION ALL SELECT root_id, event_id, field, 'stored' FROM change WHERE root_id NOT IN (SELECT doc_id FROM c)""",
    "active_members": f"WITH {a.SQL_DOCUMENT} SELECT doc_id, (doc_id % 2 = 0 OR doc_id % 5 <> 0) AND lifecycle = 'active' AS active, doc_id % 2 <> 0 AND doc_id % 5 <> 0 AS known FROM document",
    "version_list": f"""WITH {states._V} SELECT doc_id, version_number, CASE WHEN o_orderkey % 5 <> 0 THEN (['pdfplumber', 'textract', 'docx'])[CAST(o_orderkey % 3 + 1 AS INTEGER)] ELSE '' END AS extraction_method, '' AS created_at,
        CASE WHEN o_orderkey % 7 <> 0 THEN 'p/' || o_orderkey ELSE '' END AS parsed_key, '' AS classification_key, CAST(NULL AS VARCHAR) AS timeline_key, CASE WHEN o_orderkey % 2 = 0 THEN 'd/' || o_orderkey END AS diff_key FROM v""",
    "graph_documents": f"""WITH {a.SQL_DOCUMENT} SELECT doc_id AS id, tenant_id AS "tenantId", doc_type AS type, title, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'READY' END AS status, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS "currentVersion",
        'raw/' || doc_id AS "rawS3Uri", CASE WHEN doc_id % 3 = 0 THEN 'p/' || doc_id END AS "processedS3Uri", CASE WHEN doc_id % 9 = 0 THEN 'Error: ' || doc_id END AS "errorMessage" FROM document""",
    "graph_changes": diffs.SQL_SCORED + f"""SELECT {_ID.format(2)} AS id, doc_id AS "documentId", 1 AS "fromVersion", 2 AS "toVersion", clause_number AS "clauseNumber", field, impact_score AS "impactScore",
        'Heuristic: ' || category || ', field=' || field || ', Δ=' || CAST(CAST(round_even(delta_pct, 0) AS INTEGER) AS VARCHAR) || '%' AS "aiRationale" FROM impact""",
    "graph_versions": diffs.SQL_SCORED + """SELECT d.doc_id AS "documentId", v AS version, CAST(CASE WHEN v = 2 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS changes, CASE WHEN v = 2 AND n > 0 THEN n || ' change(s)' END AS summary
        FROM documents d CROSS JOIN (SELECT unnest([1, 2]) AS v) LEFT JOIN (SELECT doc_id, count(*) AS n FROM impact GROUP BY doc_id) USING (doc_id)""",
    "refined_scores": diffs.SQL_SCORED + """SELECT doc_id, seq, CASE WHEN r <= 10 AND category <> 'Fees' THEN CAST(least(99, length(b) % 50 + length(e) % 50) AS INTEGER) ELSE impact_score END AS impact_score,
        CASE WHEN r <= 10 AND category <> 'Fees' THEN field || ': ' || length(b) || ' to ' || length(e) ELSE 'Heuristic: ' || category || ', field=' || field || ', Δ=' || CAST(CAST(round_even(delta_pct, 0) AS INTEGER) AS VARCHAR) || '%' END AS impact_rationale
        FROM (SELECT *, left(before, 3000) AS b, left(after, 3000) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY delta_pct DESC, seq) AS r FROM impact)""",
    "usage_metering": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'large' ELSE 'small' END AS model, count(*) AS calls, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN doc_id % 3 <> 0 THEN ceil(length(left(text, 50)) / 4) ELSE 0 END) AS BIGINT) AS answer_tokens FROM documents GROUP BY 1",
    "deleted_counts": f"WITH {a.SQL_CLAUSE}, {a.SQL_LINEAGE} SELECT 'edge' AS entity, count(*) AS n FROM edge WHERE parent_id % 10 = 3 OR child_id % 10 = 3 UNION ALL SELECT 'clause', count(*) FROM clause WHERE doc_id % 10 = 3 UNION ALL SELECT 'document', count(*) FROM documents WHERE doc_id % 10 = 3",
    "meta_fields": f"""WITH {a.SQL_DOCUMENT} SELECT doc_id, coalesce(nullif(title, ''), 'Untitled') AS title, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_parties, 'raw/' || doc_id AS raw_key, CASE WHEN doc_id % 3 = 0 THEN sha256(title) ELSE '' END AS checksum, CASE WHEN doc_id % 5 = 0 THEN title ELSE '' END AS summary,
        CAST(CASE WHEN doc_id % 7 <> 0 THEN doc_id % 4 + 1 ELSE 0 END AS INTEGER) AS findings_count, 'fixed' AS pricing_model, CASE WHEN doc_id % 2 = 1 THEN 'the agreement' END AS parent_reference, CAST(1.5 AS DOUBLE) AS contract_value, 'USD' AS currency, 'Net 30' AS payment_terms, doc_id % 2 = 0 AS reconciled, 1 AS latest_version FROM document""",
    "top_k_clamp": "SELECT p_partkey, CAST(greatest(1, least(20, CASE WHEN p_size % 4 <> 0 THEN p_size - 10 ELSE 8 END)) AS INTEGER) AS k FROM part",
    "timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "table_created_once": f"WITH {a.SQL_LINEAGE} SELECT CAST(parent_id AS VARCHAR) AS parent_id, 2 * count(*) AS n FROM edge WHERE parent_id % 2 = 0 GROUP BY 1",
}
