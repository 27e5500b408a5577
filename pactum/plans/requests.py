"""Queries of the document API."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.functions.vocabulary import DOC_TYPES
from pactum.operators import api, search
from pactum.plans import searches, states
from pactum.sources import adapters as a
from pactum.sources.shared import materialize
from pactum.streaming.status import token_groups


def _requests(spark, sf_dir):
    """A request for every customer's versions; every fifth one comes from another tenant."""
    d = F.col("c_custkey")
    rows = a.table(spark, sf_dir, "customer").select(d.alias("request_id"), d.alias("doc_id"), F.when(d % 5 == 0, "t9").otherwise(F.concat(F.lit("t"), (d % 3).cast("string"))).alias("tenant_id"))
    docs = a.table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(d.alias("doc_id"), F.concat(F.lit("t"), (d % 3).cast("string")).alias("tenant_id"), F.col("c_name").alias("title"))
    return rows, docs


def document_detail(spark, sf_dir):
    rows, docs = _requests(spark, sf_dir)
    found = api.detail(rows, docs, states._versions(spark, sf_dir))
    return found.select("request_id", "found", "title", F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"))


def latest_artefact(spark, sf_dir):
    rows, docs = _requests(spark, sf_dir)
    versions = states._versions(spark, sf_dir).withColumn("diff_key", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("diff/"), F.col("o_orderkey").cast("string"))))
    return api.latest_artefact(rows, docs, versions, "diff_key")


def delete_version(spark, sf_dir):
    versions = states._versions(spark, sf_dir)
    kept = versions.filter("doc_id % 4 <> 0 or version_number = 1")
    return api.delete_version(kept.groupBy("doc_id").agg(F.max("version_number").alias("version_number")), kept)


def ask_answers(spark, sf_dir):
    clauses, questions = searches._clauses(spark, sf_dir), searches._questions(spark, sf_dir)
    found = api.ask(questions, searches._index(clauses, questions), clauses)
    return found.select("query_id", F.sha2("answer", 256).alias("answer_sha"), F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"))


def tenant_resolution(spark, sf_dir):
    d = F.col("c_custkey")
    claim = lambda m, name: F.when(d % m == 0, "").when(d % m == 1, F.concat(F.lit(name), (d % 4).cast("string")))
    return a.table(spark, sf_dir, "customer").select("c_custkey", api.tenant(claim(2, "j"), claim(3, "r"), claim(5, "h")).alias("tenant_id"))


def list_documents(spark, sf_dir):
    found = api.list_documents(a.documents(spark, sf_dir), 100)
    return found.select("tenant_id", "count", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


def _names(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.when(p % 5 == 0, "").when(p % 5 == 1, F.concat(F.lit("in\\"), F.col("p_name"), F.lit(".pdf"))).when(p % 5 == 2, F.concat("p_name", F.lit(".exe"))).otherwise(F.concat("p_name", F.lit(".docx")))
    return a.table(spark, sf_dir, "part").select(p.alias("request_id"), F.concat(F.lit("t"), (p % 3).cast("string")).alias("tenant_id"), name.alias("filename"), F.when(p % 2 == 0, "sow").alias("doc_type"))


def pending_upload(spark, sf_dir):
    """PENDING records of the valid upload requests."""
    pending = api.upload(_names(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp"))[1]
    return pending.select("doc_id", "tenant_id", "title", "doc_type", "lifecycle", "status", "raw_key", "latest_version")


def upload_answers(spark, sf_dir):
    return api.upload(_names(spark, sf_dir), F.current_timestamp())[0].select("request_id", "status", "error", F.col("key").isNotNull().alias("accepted"))


def _updates(spark, sf_dir):
    d = F.col("doc_id")
    body = F.when(d % 4 == 0, '{"title": " New title ", "lifecycle": "signed"}').when(d % 4 == 1, '{"docType": "NDA"}').when(d % 4 == 2, '{"docType": "X"}').otherwise('{"owner": 1}')
    docs = a.documents(spark, sf_dir)
    asked = docs.filter("doc_id % 5 <> 0").select(d.alias("request_id"), F.when(d % 7 == 0, "other").otherwise(F.col("tenant_id")).alias("tenant_id"), "doc_id", body.alias("body"))
    return api.update(asked, docs.select("doc_id", "tenant_id", "title", "lifecycle", "doc_type"))


def update_answers(spark, sf_dir):
    return _updates(spark, sf_dir)[0].select("request_id", "status", "error")


def update_documents(spark, sf_dir):
    return _updates(spark, sf_dir)[1].select("doc_id", "title", "lifecycle", "doc_type")


def _kept_files(spark, sf_dir):
    d = F.col("doc_id")
    docs = a.documents(spark, sf_dir).filter("doc_id % 11 <> 0").select("doc_id", "tenant_id", F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("tenants/x/"), d.cast("string"), F.when(d % 2 == 0, "/a.pdf").otherwise("/b.txt"))).alias("raw_key"))
    return a.documents(spark, sf_dir).select(d.alias("request_id"), "doc_id", "tenant_id"), docs


def file_links(spark, sf_dir):
    return api.file_link(*_kept_files(spark, sf_dir))


def reprocess_requests(spark, sf_dir):
    return api.reprocess(*_kept_files(spark, sf_dir)).select("request_id", "path", "status", "error")


def search_results(spark, sf_dir):
    """Clause search as the query language answers it: the three best clauses by both channels."""
    clauses, questions = searches._clauses(spark, sf_dir), searches._questions(spark, sf_dir)
    hits = search.hybrid(searches._embedded(questions), searches._index(clauses, questions), clauses, 3, dimensions=16)
    found = api.search_clauses(hits, clauses)
    return found.select("query_id", "rank", "documentId", "clauseNumber", F.sha2("text", 256).alias("text_sha"), "score", F.sha2(F.element_at("highlights", 1), 256).alias("highlight_sha"))


def ask_stream(spark, sf_dir):
    """Answers over the context by document, as the groups of tokens that are sent."""
    hits, clauses = searches._retrieved(spark, sf_dir)
    said = search.answer(searches._questions(spark, sf_dir), search.context(hits, clauses, 1200, True))
    words = said.select(F.col("query_id").alias("session_id"), F.posexplode(F.split("answer", " ")).alias("pos", "token"))
    return token_groups(materialize(words, "tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        document_detail, latest_artefact, delete_version, ask_answers, tenant_resolution, list_documents, pending_upload, upload_answers, update_answers, update_documents, file_links, reprocess_requests, search_results, ask_stream,
    )
}

_NOTHING = search.NOTHING_FOUND.replace("'", "''")
_R = """r AS (SELECT c_custkey AS request_id, c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 't9' ELSE 't' || (c_custkey % 3) END AS tenant_id FROM customer),
d AS (SELECT c_custkey AS doc_id, 't' || (c_custkey % 3) AS tenant_id, c_name AS title FROM customer WHERE c_custkey % 7 <> 0)"""
_FILE = "CASE WHEN d.doc_id % 3 <> 0 THEN 'tenants/x/' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN '/a.pdf' ELSE '/b.txt' END END"
_NAMED = """q AS (SELECT p_partkey AS request_id, 't' || (p_partkey % 3) AS tenant_id, p_name || CASE WHEN p_partkey % 5 = 1 THEN '.pdf' ELSE '.docx' END AS name, p_partkey % 5 NOT IN (0, 2) AND regexp_full_match(p_name || '.docx', '[A-Za-z0-9._ -]{1,200}') AS good, p_partkey % 2 = 0 AS sow, p_name FROM part),
u AS (SELECT *, sha256(concat_ws('|', tenant_id, request_id, name)) AS doc_id FROM q)"""
_UPD = "u AS (SELECT *, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 4 < 2 AS good FROM document)"
SQL = {
    "tenant_resolution": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 1 THEN 'j' || (c_custkey % 4) END, CASE WHEN c_custkey % 3 = 1 THEN 'r' || (c_custkey % 4) END, CASE WHEN c_custkey % 5 = 1 THEN 'h' || (c_custkey % 4) END, 'default') AS tenant_id FROM customer",
    "list_documents": f"WITH {a.SQL_DOCUMENT}, r AS (SELECT tenant_id, doc_id, row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id) AS n FROM document) SELECT tenant_id, count(*) AS count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM r WHERE n <= 100 GROUP BY tenant_id",
    "pending_upload": f"WITH {_NAMED} SELECT doc_id, tenant_id, p_name AS title, CASE WHEN sow THEN 'SOW' ELSE 'OTHER' END AS doc_type, 'draft' AS lifecycle, 'PENDING' AS status, 'tenants/' || tenant_id || '/uploads/' || doc_id || '/' || name AS raw_key, 0 AS latest_version FROM u WHERE good",
    "upload_answers": f"""WITH {_NAMED} SELECT request_id, CAST(CASE WHEN good THEN 200 ELSE 400 END AS INTEGER) AS status, CASE WHEN good THEN NULL WHEN request_id % 5 = 0 THEN 'Missing required query parameter: filename' WHEN request_id % 5 = 2 AND regexp_full_match(p_name || '.exe', '[A-Za-z0-9._ -]{{1,200}}') THEN 'Unsupported file type. Allowed: pdf, docx, doc, txt'
        ELSE 'Invalid filename' END AS error, good AS accepted FROM u""",
    "update_answers": f"""WITH {a.SQL_DOCUMENT} SELECT doc_id AS request_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 404 WHEN doc_id % 4 < 2 THEN 200 ELSE 400 END AS INTEGER) AS status, CASE WHEN doc_id % 7 = 0 THEN '{api.NOT_FOUND}' WHEN doc_id % 4 = 2 THEN 'Invalid docType. Must be one of: {", ".join(sorted(DOC_TYPES))}'
        WHEN doc_id % 4 = 3 THEN 'Unknown field(s): owner' END AS error FROM document WHERE doc_id % 5 <> 0""",
    "update_documents": f"WITH {a.SQL_DOCUMENT}, {_UPD} SELECT doc_id, CASE WHEN good AND doc_id % 4 = 0 THEN 'New title' ELSE title END AS title, CASE WHEN good AND doc_id % 4 = 0 THEN 'signed' ELSE lifecycle END AS lifecycle, CASE WHEN good AND doc_id % 4 = 1 THEN 'NDA' ELSE doc_type END AS doc_type FROM u",
    "file_links": f"""SELECT d.doc_id AS request_id, CAST(CASE WHEN d.doc_id % 11 = 0 OR d.doc_id % 3 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status, CASE WHEN d.doc_id % 11 <> 0 THEN {_FILE} END AS path, CASE WHEN d.doc_id % 11 <> 0 AND d.doc_id % 3 <> 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'a.pdf' ELSE 'b.txt' END END AS filename,
        CASE WHEN d.doc_id % 11 <> 0 AND d.doc_id % 3 <> 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'application/pdf' ELSE 'text/plain' END END AS content_type, CASE WHEN d.doc_id % 11 = 0 THEN '{api.NOT_FOUND}' WHEN d.doc_id % 3 = 0 THEN '{api.NO_FILE}' END AS error FROM documents d""",
    "reprocess_requests": f"""SELECT d.doc_id AS request_id, CASE WHEN d.doc_id % 11 <> 0 THEN {_FILE} END AS path, CASE WHEN d.doc_id % 11 <> 0 AND d.doc_id % 3 <> 0 THEN 'PENDING' END AS status, CASE WHEN d.doc_id % 11 = 0 THEN '{api.NOT_FOUND}' WHEN d.doc_id % 3 = 0 THEN '{api.NO_UPLOAD}' END AS error FROM documents d""",
    "search_results": f"""WITH {searches._INDEXED}, {searches._Q}, {searches._QV}, {searches._CV}, {searches._knn('near', 'qv', 'cv', 6)}, {searches._bm25('kw', 'question', 6)}, {searches._fuse('hy', 'near', 'kw', 3)}
        SELECT query_id, rank, i.doc_id AS "documentId", clause_number AS "clauseNumber", sha256(text) AS text_sha, score, sha256(left(text, 200)) AS highlight_sha FROM hy h JOIN idx i ON i.clause_id = h.clause_id""",
    "ask_stream": searches._RETRIEVED + f""", said AS (SELECT q.query_id AS session_id, coalesce(string_split('[doc=' || i.doc_id || '] §' || clause_number || chr(10) || i.text, chr(10))[1], '{_NOTHING}') AS answer FROM question q LEFT JOIN (SELECT * FROM got WHERE rank = 1) g USING (query_id) LEFT JOIN idx i USING (clause_id)),
        w AS (SELECT session_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT session_id, string_split(answer, ' ') AS t FROM said)), g AS (SELECT session_id, CAST(pos // 4 AS INTEGER) AS flush, string_agg(token, '' ORDER BY pos) AS token, FALSE AS final FROM w GROUP BY ALL)
        SELECT * FROM g UNION ALL SELECT session_id, CAST(max(flush) + 1 AS INTEGER), '', TRUE FROM g GROUP BY session_id""",
    "document_detail": f"WITH {_R}, {states._V}, s AS (SELECT doc_id, string_agg(CAST(version_number AS VARCHAR), ',' ORDER BY version_number) AS l FROM v GROUP BY doc_id) "
    "SELECT request_id, d.doc_id IS NOT NULL AS found, title, CASE WHEN d.doc_id IS NULL THEN '' ELSE coalesce(l, '') END AS versions FROM r LEFT JOIN d ON d.doc_id = r.doc_id AND d.tenant_id = r.tenant_id LEFT JOIN s ON s.doc_id = r.doc_id",
    "latest_artefact": f"WITH {_R}, {states._V}, s AS (SELECT doc_id, max(version_number) AS n, max_by(o_orderkey, version_number) AS k FROM v GROUP BY doc_id), "
    f"j AS (SELECT request_id, n, CASE WHEN k % 2 = 0 THEN 'diff/' || k END AS artefact, CASE WHEN d.doc_id IS NULL THEN '{api.NOT_FOUND}' WHEN n IS NULL THEN '{api.NO_VERSIONS}' WHEN k % 2 <> 0 THEN '{api.MISSING['diff_key']}' END AS error "
    "FROM r LEFT JOIN d ON d.doc_id = r.doc_id AND d.tenant_id = r.tenant_id LEFT JOIN s ON s.doc_id = r.doc_id) "
    "SELECT request_id, CASE WHEN error IS NULL THEN n END AS version_number, CASE WHEN error IS NULL THEN artefact END AS artefact, error FROM j",
    "delete_version": f"WITH {states._V}, k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE max(version_number) END AS m FROM v GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN m = 1 THEN 'document' ELSE 'version' END AS action, CASE WHEN m > 1 THEN CAST(m - 1 AS INTEGER) END AS latest_version FROM k",
    "ask_answers": f"""WITH {searches._INDEXED}, {searches._Q}, {searches._QV}, {searches._CV}, {searches._knn('near', 'qv', 'cv', 8)}, {searches._bm25('kw', 'question', 8)},
        filled AS (SELECT query_id, clause_id, doc_id, 0 AS channel, rank AS r FROM near UNION ALL SELECT query_id, clause_id, doc_id, 1, rank FROM kw ANTI JOIN near USING (query_id, clause_id)),
        got AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY channel, r) AS rank FROM filled) WHERE rank <= 8),
        ctx AS (SELECT query_id, '[§' || max(clause_number) FILTER (rank = 1) || '] ' || left(max(text) FILTER (rank = 1), 1200) AS first, count(*) AS n FROM got JOIN idx USING (clause_id) GROUP BY query_id)
        SELECT q.query_id, sha256(coalesce(string_split(first, chr(10))[1], '{_NOTHING}')) AS answer_sha, CAST(coalesce(n, 0) AS INTEGER) AS n_citations FROM question q LEFT JOIN ctx USING (query_id)""",
}
