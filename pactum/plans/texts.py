"""Queries on scalar text functions, validation, extraction routing and ordered concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.functions import text as t
from pactum.functions.vocabulary import DOC_TYPES, LIFECYCLES
from pactum.operators import rollup, validation
from pactum.plans.diffs import SQL_KEY, SQL_NORM
from pactum.sources import adapters as a
from pactum.sources import extract


def _docs(spark, sf_dir):
    return a.table(spark, sf_dir, "documents")


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.normalize(F.col("text")), 256).alias("norm_sha"), F.length(t.normalize(F.col("text"))).alias("norm_length"))


def clause_key(spark, sf_dir):
    return a.table(spark, sf_dir, "part").select("p_partkey", t.clause_key(F.concat(F.lit("§ "), F.col("p_size").cast("string"), F.lit("."), F.col("p_brand"), F.lit(" (B)"))).alias("clause_key"))


def content_hash(spark, sf_dir):
    return a.clauses(spark, sf_dir).select("doc_id", "pos", t.content_hash(F.col("body")).alias("content_hash"), F.length(t.embedding_input(F.col("body"))).alias("input_length"))


def structural_hash(spark, sf_dir):
    ordered = a.clauses(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "number", "title"))).alias("c"))
    return ordered.select("doc_id", t.structural_hash(F.col("c")).alias("structural_hash"))


def header_detect(spark, sf_dir):
    numbered = _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "Section ").when(i % 3 == 1, "§").otherwise(""), (i + 1).cast("string"), F.lit(". "), x)), "\n").alias("text"))
    return numbered.select("doc_id", F.explode(t.headers(F.col("text"))).alias("h")).select("doc_id", "h.line", "h.number", "h.title")


def chunk_sliding(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("chunk", "content")).select("doc_id", "chunk", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha"))


def truncate_head_tail(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.truncated(F.col("text"), 250), 256).alias("sha"), F.length(t.truncated(F.col("text"), 250)).alias("n_chars"))


def title_jaccard(spark, sf_dir):
    edges, docs = a.lineage(spark, sf_dir), a.documents(spark, sf_dir).select("doc_id", "title")
    child = edges.join(docs.withColumnsRenamed({"doc_id": "child_id", "title": "child_title"}), "child_id")
    both = child.join(docs.withColumnsRenamed({"doc_id": "parent_id", "title": "parent_title"}), "parent_id")
    return both.select("child_id", "parent_id", F.round(t.title_similarity(F.col("child_title"), F.col("parent_title")), 6).alias("similarity"))


def clause_explode(spark, sf_dir):
    return a.clauses(spark, sf_dir).select("doc_id", "pos", "number", "title", F.length("body").alias("body_length"), "category", "risk_level", t.safe_id(F.col("doc_id"), F.col("number")).alias("clause_id"))


def page_concat(spark, sf_dir):
    turns = a.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.expr("cast(turn div 3 as int)").alias("page"), F.col("turn").cast("int").alias("pos"), F.when(F.col("role") == "system", "TABLE").otherwise("LINE").alias("block_type"), F.col("text"))
    pages = extract.pages_from_blocks(turns)
    return pages.select("doc_id", F.size("pages").alias("n_pages"), F.sha2("text", 256).alias("text_sha"), extract.char_count(F.col("pages")).cast("long").alias("char_count"))


def extraction_route(spark, sf_dir):
    pages = a.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 5 == 0, "docx").otherwise("pdf").alias("file_type"), F.when(F.col("page_id") % 7 != 0, F.array(F.struct(F.lit(1).alias("page"), F.col("html").alias("text"), (F.length("html") % 400).alias("char_count")))).alias("pages"))
    return pages.select("doc_id", extract.route(F.col("file_type"), F.col("pages")).alias("extraction_method"))


def _keys(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("inbox/"), d, F.lit(".pdf"))).otherwise(F.concat(F.lit("tenants/"), F.col("source"), F.lit("/uploads/"), d, F.lit("/a.b.pdf")))
    return _docs(spark, sf_dir).select("doc_id", "source", key.alias("key"))


def key_parse(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("key", t.ids_from_key(F.col("key"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("i"))
    return rows.select("key", "i.tenant_id", F.col("i.doc_id").alias("parsed_doc_id"), t.media_type(F.col("key")).alias("media_type"))


def upload_validation(spark, sf_dir):
    p = a.table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, [".pdf", ".DOCX", ".txt", ".exe", "", "/x.doc"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 11 == 0, F.lit("  ")).when(F.col("p_partkey") % 13 == 0, F.concat("p_name", F.lit("?.pdf"))).otherwise(F.concat(F.lit("up\\"), F.col("p_name"), ext))
    kind = F.element_at(F.array(*map(F.lit, ["sow", "MSA", "bogus", "other"])), (F.col("p_size") % 4 + 1).cast("int"))
    rows = p.select("p_partkey", name.alias("filename"), kind.alias("doc_type"))
    return rows.select("p_partkey", validation.upload(F.col("filename"), F.col("doc_type")).alias("v")).select("p_partkey", "v.valid", "v.reason", "v.filename", "v.title")


def patch_validation(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    i = F.col("event_id")
    body = (
        F.when(i % 9 == 0, "{}").when(i % 9 == 1, "[1]").when(i % 9 == 2, "").when(i % 9 == 3, '{"lifecycle": "active"}').when(i % 9 == 4, '{"lifecycle": "gone"}')
        .when(i % 9 == 5, '{"docType": "X"}').when(i % 9 == 6, '{"title": "  "}').when(i % 9 == 7, '{"title": " A title ", "docType": "MSA"}').otherwise('{"owner": "z", "extra": 1}')
    )
    return e.select("event_id", validation.patch(body).alias("v")).select("event_id", "v.status", "v.error", "v.title", "v.lifecycle", "v.doc_type")


def risk_rollup(spark, sf_dir):
    return rollup.risk(a.clauses(spark, sf_dir)).select("doc_id", "clause_count", "low", "medium", "high", "critical", "high_risk_count")


def overall_risk(spark, sf_dir):
    return rollup.risk(a.clauses(spark, sf_dir)).select("doc_id", "overall_risk")


QUERIES = {f.__name__: f for f in (normalize_text, clause_key, content_hash, structural_hash, header_detect, chunk_sliding, truncate_head_tail, title_jaccard, clause_explode, page_concat, extraction_route, key_parse, upload_validation, patch_validation, risk_rollup, overall_risk)}

_N = SQL_NORM.format
_KEYS = "keys AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'inbox/' || doc_id || '.pdf' ELSE 'tenants/' || source || '/uploads/' || doc_id || '/a.b.pdf' END AS key FROM documents)"
_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_TYPES, _CYCLES = ", ".join(sorted(DOC_TYPES)), ", ".join(sorted(LIFECYCLES))
SQL = {
    "normalize_text": f"SELECT doc_id, sha256({_N('text')}) AS norm_sha, CAST(length({_N('text')}) AS INTEGER) AS norm_length FROM documents",
    "clause_key": "SELECT p_partkey, " + SQL_KEY.format("'§ ' || p_size || '.' || p_brand || ' (B)'") + " AS clause_key FROM part",
    "content_hash": f"WITH {a.SQL_CLAUSE} SELECT doc_id, pos, sha256(trim(body)) AS content_hash, CAST(greatest(length(trim(body)), 1) AS INTEGER) AS input_length FROM clause",
    "structural_hash": f"WITH {a.SQL_CLAUSE} SELECT doc_id, sha256(string_agg({_N('number')} || '|' || {_N('title')}, chr(10) ORDER BY pos)) AS structural_hash FROM clause GROUP BY doc_id",
    "header_detect": f"WITH {a.SQL_CLAUSE} SELECT doc_id, pos AS line, number, trim(body) AS title FROM clause WHERE length(ltrim(body)) BETWEEN 2 AND 200 OR (length(ltrim(body)) = 1 AND length(body) > 1)",
    "chunk_sliding": "WITH n AS (SELECT doc_id, text, greatest(ceil((length(text) - 2000) / 1800.0), 0)::INTEGER AS k FROM documents), c AS (SELECT doc_id, text, unnest(range(k + 1))::INTEGER AS chunk FROM n) "
    "SELECT doc_id, chunk, length(substr(text, chunk * 1800 + 1, 2000))::INTEGER AS n_chars, sha256(substr(text, chunk * 1800 + 1, 2000)) AS sha FROM c",
    "truncate_head_tail": "WITH x AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 600) || chr(10) || chr(10) || '[... TRUNCATED ...]' || chr(10) || chr(10) || right(text, 368) END AS s FROM documents) "
    "SELECT doc_id, sha256(s) AS sha, length(s)::INTEGER AS n_chars FROM x",
    "title_jaccard": f"WITH {a.SQL_DOCUMENT}, {a.SQL_LINEAGE}, w AS (SELECT doc_id, list_distinct(string_split({_N('title')}, ' ')) AS w, {_N('title')} = '' AS none FROM document) "
    "SELECT child_id, parent_id, CASE WHEN x.none OR y.none THEN 0.0 ELSE round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) END AS similarity FROM edge JOIN w x ON x.doc_id = child_id JOIN w y ON y.doc_id = parent_id",
    "clause_explode": f"WITH {a.SQL_CLAUSE} SELECT doc_id, pos, number, title, length(body)::INTEGER AS body_length, category, risk_level, doc_id || '::' || number AS clause_id FROM clause",
    "page_concat": "WITH l AS (SELECT conv_id AS doc_id, (turn // 3)::INTEGER AS page, turn, text FROM conversations WHERE role <> 'system'), p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY turn, text) AS t, sum(length(text)) AS n FROM l GROUP BY ALL) "
    "SELECT doc_id, count(*)::INTEGER AS n_pages, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS text_sha, sum(n)::BIGINT AS char_count FROM p GROUP BY doc_id",
    "extraction_route": "SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN 'docx' WHEN page_id % 7 <> 0 AND length(html) % 400 >= 200 THEN 'pdfplumber' ELSE 'textract' END AS extraction_method FROM pages",
    "key_parse": f"WITH {_KEYS} SELECT key, CASE WHEN key LIKE 'tenants/%' THEN split_part(key, '/', 2) ELSE 'default' END AS tenant_id, CASE WHEN key LIKE 'tenants/%' THEN split_part(key, '/', 4) ELSE key END AS parsed_doc_id, 'application/pdf' AS media_type FROM keys",
    "upload_validation": f"""WITH f AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 13 = 0 THEN p_name || '?.pdf' ELSE 'up\\' || p_name || (['.pdf', '.DOCX', '.txt', '.exe', '', '/x.doc'])[CAST(p_partkey % 6 + 1 AS INTEGER)] END) AS raw,
        upper((['sow', 'MSA', 'bogus', 'other'])[CAST(p_size % 4 + 1 AS INTEGER)]) AS kind FROM part), g AS (SELECT *, list_last(string_split(replace(raw, '\\', '/'), '/')) AS name FROM f),
    h AS (SELECT *, CASE WHEN raw = '' THEN 'Missing required query parameter: filename' WHEN name IN ('', '.', '..') OR NOT regexp_full_match(name, '[A-Za-z0-9._ -]{{1,200}}') THEN 'Invalid filename'
        WHEN NOT regexp_matches(lower(name), '\\.(pdf|docx|doc|txt)$') THEN 'Unsupported file type. Allowed: pdf, docx, doc, txt' WHEN kind NOT IN ('SOW', 'MSA', 'AMENDMENT', 'NDA', 'OTHER') THEN 'Invalid docType ''' || kind || '''. Must be one of: {_TYPES}' END AS reason FROM g)
    SELECT p_partkey, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN name END AS filename, CASE WHEN reason IS NULL THEN regexp_replace(name, '\\.[^.]*$', '') END AS title FROM h""",
    "patch_validation": f"""SELECT event_id, (CASE WHEN event_id % 9 IN (3, 7) THEN 200 ELSE 400 END)::INTEGER AS status, CASE event_id % 9 WHEN 0 THEN 'No fields to update' WHEN 1 THEN 'Body must be a JSON object' WHEN 2 THEN 'Request body is required'
        WHEN 4 THEN 'Invalid lifecycle. Must be one of: {_CYCLES}' WHEN 5 THEN 'Invalid docType. Must be one of: {_TYPES}' WHEN 6 THEN 'title cannot be empty' WHEN 8 THEN 'Unknown field(s): extra, owner' END AS error,
        CASE WHEN event_id % 9 = 7 THEN 'A title' END AS title, CASE WHEN event_id % 9 = 3 THEN 'active' END AS lifecycle, CASE WHEN event_id % 9 = 7 THEN 'MSA' END AS doc_type FROM events""",
    "risk_rollup": f"WITH {a.SQL_CLAUSE} SELECT doc_id, count(*) AS clause_count, count(*) FILTER (risk_level = 'low') AS low, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'critical') AS critical, count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk_count FROM clause GROUP BY doc_id",
    "overall_risk": f"WITH {a.SQL_CLAUSE} SELECT doc_id, (['low', 'medium', 'high', 'critical'])[max(list_position(['low', 'medium', 'high', 'critical'], risk_level))] AS overall_risk FROM clause GROUP BY doc_id",
}
