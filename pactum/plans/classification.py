"""Queries on classification: hints, prompts, rules, defaults, figures and the model seams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pactum.functions import text as t
from pactum.functions.vocabulary import CLAUSE_CATEGORIES
from pactum.operators import classify, rollup
from pactum.plans.diffs import SQL_NORM
from pactum.sources import adapters as a

KINDS = ["Statement of Work", "Master Services Agreement", "Amendment No.", "Mutual Non-Disclosure Agreement", "Letter"]
RISKS = ["", " unlimited liability", " at its sole discretion", " may terminate", ""]


def contracts(spark, sf_dir):
    """Contract texts: a heading, a section for each line of a document, a date and three amounts, which add up but for every fourth."""
    d = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    section = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(". "), pick(CLAUSE_CATEGORIES, i), F.lit("\n- "), x, pick(RISKS, d + i)))
    base, delta = d % 1000 * 10 + 100, F.when(d % 3 == 0, d % 7 * 100 + 1).otherwise(0)
    tail = F.concat(
        F.lit("\nEffective 2024-"), F.lpad((d % 12 + 1).cast("string"), 2, "0"), F.lit("-15\nBase fee: $"), base.cast("string"),
        F.when(delta > 0, F.concat(F.lit("\nAmendment 1: $"), delta.cast("string"))).otherwise(""), F.lit("\nTotal Contract Value: $"), (base + delta + F.when(d % 4 == 0, 5).otherwise(0)).cast("string"),
    )
    text = F.concat(pick(KINDS, d), F.lit(" "), d.cast("string"), F.lit("\n"), F.array_join(section, "\n"), tail)
    return a.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant_id"), text.alias("text"))


def header_hints(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", classify.hints(F.col("text")).alias("h")).select("doc_id", F.size("h").alias("n"), F.array_join("h", ";").alias("hints"))


def classify_prompt(spark, sf_dir):
    asked = classify.prompt(t.truncated(F.col("text"), 250), classify.hints(F.col("text")))
    return contracts(spark, sf_dir).select("doc_id", F.sha2(asked, 256).alias("prompt_sha"), F.length(asked).alias("n_chars"))


def validation_prompt(spark, sf_dir):
    figures = F.struct(F.lit("USD").alias("currency"), (F.col("doc_id") * 2).alias("total"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("base"))
    asked = classify.check_prompt(F.left("text", F.lit(100)), figures)
    return contracts(spark, sf_dir).select("doc_id", F.sha2(asked, 256).alias("prompt_sha"))


def classify_clauses(spark, sf_dir):
    found = contracts(spark, sf_dir).select("doc_id", F.posexplode(classify.clauses(F.col("text"))).alias("pos", "c"))
    return found.select("doc_id", "pos", "c.number", "c.title", "c.category", "c.risk_level", F.sha2("c.body", 256).alias("body_sha"))


def classification(spark, sf_dir):
    found = classify.classify(contracts(spark, sf_dir))
    money = [F.col(c).cast("double").alias(c) for c in ("contract_value", "base_value", "value_delta")]
    return found.select("doc_id", "doc_type", "title", "effective_date", "lifecycle", F.size("clauses").alias("n_clauses"), "currency", *money, "reconciled", F.col("validation.confidence").alias("confidence"), "structural_hash", "error")


def money_validation(spark, sf_dir):
    d = F.col("doc_id")
    rows = contracts(spark, sf_dir).select("doc_id", F.when(d % 10 != 9, F.col("text")).alias("text"), F.when(d % 2 == 0, F.lit(7).cast("decimal(18,2)")).alias("contract_value"))
    found = classify.validated(rows)
    return found.select("doc_id", "validated", "reconciled", "currency", F.col("base_value").cast("double").alias("base_value"), F.col("contract_value").cast("double").alias("contract_value"), F.size("line_items").alias("n_items"), F.array_join("issues", ";").alias("issues"), "confidence")


def canonical_figures(spark, sf_dir):
    """Extracted figures under those that a check found for every second document."""
    o = a.table(spark, sf_dir, "orders")
    classified = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("EUR").alias("currency"), F.col("o_totalprice").alias("contract_value"), F.lit(1.0).alias("base_value"), F.lit(None).cast("double").alias("value_delta"), F.lit(None).cast("double").alias("new_total_value"), F.lit("Net 30").alias("payment_terms"))
    k = F.col("o_orderkey")
    found = o.filter("o_orderkey % 2 = 0").select(k.alias("doc_id"), F.when(k % 4 == 0, "USD").otherwise("").alias("currency"), F.when(k % 3 == 0, F.lit(5.0)).alias("contract_value"), F.lit(None).cast("double").alias("base_value"), F.lit(2.0).alias("value_delta"), F.lit(None).cast("double").alias("new_total_value"))
    return rollup.canonical(classified, found).drop("new_total_value")


_PARTIAL = [
    "{}", '{"doc_type": "sow", "lifecycle": "Active", "clauses": [{"number": "1", "title": "a", "category": "Bogus"}, {"category": "Fees", "risk_level": "HIGH"}]}',
    '{"doc_type": "CONTRACT", "commercials": {"pricing_model": "fixed"}, "amendment": {"amendment_type": "addendum", "changes": [{"change_type": "odd", "category": "scope"}]}}',
    '{"confidence": {"overall": "high"}, "key_findings": [{"label": "x", "severity": "grave"}], "parties": ["A", "B"]}', "not json",
]


def classify_defaults(spark, sf_dir):
    """Answers of models that leave blocks out."""
    answers = F.array(*map(F.lit, _PARTIAL))
    rows = a.table(spark, sf_dir, "documents").select("doc_id", F.element_at(answers, (F.col("doc_id") % 5 + 1).cast("int")).alias("answer"))
    r = F.col("r")
    found = rows.select("doc_id", classify.parsed_record(F.col("answer")).alias("r"))
    return found.select(
        "doc_id", r["doc_type"].alias("doc_type"), r["lifecycle"].alias("lifecycle"), r["title"].alias("title"), F.size(r["parties"]).alias("n_parties"), F.array_join(r["clauses"]["category"], ",").alias("categories"),
        F.array_join(r["clauses"]["risk_level"], ",").alias("risks"), r["commercials"]["pricing_model"].alias("pricing_model"), r["amendment"]["amendment_type"].alias("amendment_type"),
        F.array_join(r["amendment"]["changes"]["change_type"], ",").alias("change_types"), r["confidence"]["overall"].alias("overall"), F.array_join(r["key_findings"]["severity"], ",").alias("severities"), F.size(r["scope"]["in_scope"]).alias("n_scope"),
    )


def _counting(system, prompt, schema):
    """Stands for a model: says how long the prompt is, and fails for every tenth document."""
    if prompt.endswith("3"):
        raise ValueError("refused")
    return json.dumps({"n": len(prompt)}) if schema else f"{len(prompt)} characters"


def _prompts(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("prompt"))


def structured_completion(spark, sf_dir):
    return classify.completion(_prompts(spark, sf_dir), _counting, schema="n int", wait=0.0).drop("prompt")


def text_completion(spark, sf_dir):
    return classify.completion(_prompts(spark, sf_dir), _counting, attempts=2, wait=0.0).drop("prompt")


def tokenizer_truncation(spark, sf_dir):
    """Texts cut by a tokenizer of words and spaces."""
    import re

    split = lambda s: re.findall(r"[^ ]+| +", s)
    rows = t.truncated_by(a.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 200, split, "".join)
    return rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (header_hints, classify_prompt, validation_prompt, classify_clauses, classification, money_validation, canonical_figures, classify_defaults, structured_completion, text_completion, tokenizer_truncation)}

_N = SQL_NORM.format
_AMOUNT = r"(?:USD|EUR|GBP|\$|€|£)\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
_CATS, _RISKS, _KINDS = (f"{values}" for values in (CLAUSE_CATEGORIES, RISKS, KINDS))
_CONTRACT = rf"""part AS (SELECT doc_id, source AS tenant_id, string_split(text, chr(10)) AS l, doc_id % 1000 * 10 + 100 AS base, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 * 100 + 1 ELSE 0 END AS delta, doc_id % 4 = 0 AS off FROM documents),
tailed AS (SELECT *, chr(10) || 'Effective 2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' || chr(10) || 'Base fee: $' || base || CASE WHEN delta > 0 THEN chr(10) || 'Amendment 1: $' || delta ELSE '' END
    || chr(10) || 'Total Contract Value: $' || (base + delta + CASE WHEN off THEN 5 ELSE 0 END) AS tail FROM part),
piece AS (SELECT doc_id, tenant_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line, len(l) AS n, tail FROM tailed),
sec AS (SELECT doc_id, tenant_id, pos, {_CATS}[CAST(pos % 24 + 1 AS INTEGER)] AS title, '- ' || line || {_RISKS}[CAST((doc_id + pos) % 5 + 1 AS INTEGER)] || CASE WHEN pos = n - 1 THEN tail ELSE '' END AS body FROM piece),
contract AS (SELECT doc_id, any_value(tenant_id) AS tenant_id, {_KINDS}[CAST(doc_id % 5 + 1 AS INTEGER)] || ' ' || doc_id || chr(10) || string_agg('Section ' || (pos + 1) || '. ' || title || chr(10) || body, chr(10) ORDER BY pos) AS text FROM sec GROUP BY doc_id),
hint AS (SELECT doc_id, string_agg((pos + 1) || ' ' || title, ';' ORDER BY pos) AS h, string_agg('- ' || (pos + 1) || ' ' || title, chr(10) ORDER BY pos) AS listed, CAST(count(*) AS INTEGER) AS n FROM sec WHERE pos < 50 GROUP BY doc_id),
money AS (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS source FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_AMOUNT}')) AS m FROM contract)),
item AS (SELECT doc_id, i, regexp_replace(regexp_extract(source, '(?im)^(.*?){_AMOUNT}.*$', 1), '[\s:]+$', '') AS label, CAST(replace(regexp_extract(source, '(?im)^(.*?){_AMOUNT}.*$', 2), ',', '') AS DOUBLE) AS amount FROM money),
fig AS (SELECT doc_id, max_by(amount, i) FILTER (regexp_matches(label, '(?i)\b(base|original)\b')) AS base, max_by(amount, i) FILTER (regexp_matches(label, '(?i)total|not.to.exceed')) AS total,
    sum(amount) FILTER (regexp_matches(label, '(?i)^(amendment|change order)')) AS delta, max_by(amount, i) FILTER (regexp_matches(label, '(?i)\bnew total')) AS fresh, CAST(count(*) AS INTEGER) AS n_items, list(amount) AS amounts FROM item GROUP BY doc_id),
told AS (SELECT c.doc_id, c.text, f.*, coalesce(base, 0) + coalesce(delta, 0) AS expected, coalesce(fresh, total) AS stated, regexp_extract(c.text, '(USD|EUR|GBP|\$|€|£)\s?[0-9]', 1) AS sign FROM contract c LEFT JOIN fig f USING (doc_id)),
risky AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)\b(unlimited|uncapped)\b') THEN 'critical' WHEN regexp_matches(body, '(?i)\b(sole discretion|indemnif\w+)') THEN 'high' WHEN regexp_matches(body, '(?i)\b(terminat\w+|renew\w*|penalt\w+)') THEN 'medium' ELSE 'low' END AS risk FROM sec)"""
_SIGN = "CASE sign WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE nullif(sign, '') END"
_CUT = "CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 600) || chr(10) || chr(10) || '[... TRUNCATED ...]' || chr(10) || chr(10) || right(text, 368) END"
_ASKED = f"'Extract this contract.' || chr(10) || chr(10) || 'Headers found:' || chr(10) || coalesce(listed, '(none)') || chr(10) || chr(10) || 'Document:' || chr(10) || '<<<' || chr(10) || {_CUT} || chr(10) || '>>>'"


def _kind(text: str) -> str:
    words = [("AMENDMENT", r"(?i)\b(amendment|change order|addendum|side letter)\b"), ("SOW", r"(?i)\b(statement of work|sow)\b"), ("MSA", r"(?i)\bmaster\b.{0,40}\bagreement\b"), ("NDA", r"(?i)\b(non-?disclosure|confidentiality)\b.{0,20}\bagreement\b")]
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{name}'" for name, p in words) + " END"


SQL = {
    "header_hints": f"WITH {_CONTRACT} SELECT doc_id, n, h AS hints FROM hint",
    "classify_prompt": f"WITH {_CONTRACT}, q AS (SELECT doc_id, {_ASKED} AS p FROM contract LEFT JOIN hint USING (doc_id)) SELECT doc_id, sha256(p) AS prompt_sha, CAST(length(p) AS INTEGER) AS n_chars FROM q",
    "validation_prompt": f"""WITH {_CONTRACT} SELECT doc_id, sha256('Figures to check:' || chr(10) || '{{"currency":"USD","total":' || (doc_id * 2) || CASE WHEN doc_id % 2 = 0 THEN ',"base":' || doc_id ELSE '' END || '}}'
        || chr(10) || chr(10) || 'Document:' || chr(10) || '<<<' || chr(10) || left(text, 100) || chr(10) || '>>>') AS prompt_sha FROM contract""",
    "classify_clauses": f"WITH {_CONTRACT} SELECT doc_id, pos, CAST(pos + 1 AS VARCHAR) AS number, title, title AS category, risk AS risk_level, sha256(body) AS body_sha FROM risky",
    "classification": f"""WITH {_CONTRACT}, shaped AS (SELECT doc_id, sha256(string_agg((pos + 1) || '|' || {_N('title')}, chr(10) ORDER BY pos)) AS structural_hash, CAST(count(*) AS INTEGER) AS n_clauses FROM sec GROUP BY doc_id)
        SELECT t.doc_id, coalesce({_kind('string_split(text, chr(10))[1]')}, {_kind('left(text, 2000)')}, 'OTHER') AS doc_type,
        string_split(text, chr(10))[1] AS title, nullif(regexp_extract(text, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), '') AS effective_date, CASE WHEN regexp_matches(text, '(?im)^\\s*(signed|executed)\\b') THEN 'signed' ELSE 'draft' END AS lifecycle,
        n_clauses, {_SIGN} AS currency, total AS contract_value, base AS base_value, delta AS value_delta, abs(expected - stated) <= 1 AS reconciled, CASE WHEN stated IS NULL THEN 'low' WHEN abs(expected - stated) <= 1 THEN 'high' ELSE 'medium' END AS confidence,
        structural_hash, CAST(NULL AS VARCHAR) AS error FROM told t JOIN shaped USING (doc_id)""",
    "money_validation": f"""WITH {_CONTRACT}, k AS (SELECT *, doc_id % 10 <> 9 AS known, doc_id % 2 = 0 AND NOT list_contains(coalesce(amounts, []), 7.0) AS unfounded FROM told)
        SELECT doc_id, known AS validated, CASE WHEN known THEN abs(expected - stated) <= 1 END AS reconciled, CASE WHEN known THEN {_SIGN} END AS currency, CASE WHEN known THEN base END AS base_value, CASE WHEN known THEN total END AS contract_value, CASE WHEN known THEN coalesce(n_items, 0) ELSE 0 END AS n_items,
        concat_ws(';', CASE WHEN known AND unfounded THEN 'the extracted total is not in the text' END, CASE WHEN known AND abs(expected - stated) > 1 THEN 'base and changes do not add up to the total' END, CASE WHEN NOT known THEN 'validation pass unavailable' END) AS issues,
        CASE WHEN NOT known OR stated IS NULL THEN 'low' WHEN abs(expected - stated) <= 1 AND NOT unfounded THEN 'high' ELSE 'medium' END AS confidence FROM k""",
    "canonical_figures": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN o_orderkey % 6 = 0 THEN 5.0 ELSE o_totalprice END AS contract_value, CAST(1.0 AS DOUBLE) AS base_value, CASE WHEN o_orderkey % 2 = 0 THEN CAST(2.0 AS DOUBLE) END AS value_delta, 'Net 30' AS payment_terms FROM orders",
    "classify_defaults": """SELECT doc_id, CASE WHEN m = 1 THEN 'SOW' WHEN m < 4 THEN 'OTHER' END AS doc_type, CASE WHEN m = 1 THEN 'active' WHEN m < 4 THEN 'draft' END AS lifecycle, CASE WHEN m < 4 THEN '' END AS title, CAST(CASE WHEN m = 3 THEN 2 WHEN m < 4 THEN 0 END AS INTEGER) AS n_parties,
        CASE WHEN m = 1 THEN 'Other,Fees' WHEN m < 4 THEN '' END AS categories, CASE WHEN m = 1 THEN 'low,high' WHEN m < 4 THEN '' END AS risks, CASE WHEN m = 2 THEN 'fixed' WHEN m < 4 THEN 'unknown' END AS pricing_model, CASE WHEN m = 2 THEN 'addendum' WHEN m < 4 THEN 'none' END AS amendment_type,
        CASE WHEN m = 2 THEN 'modification' WHEN m < 4 THEN '' END AS change_types, CASE WHEN m = 3 THEN 'high' WHEN m < 4 THEN 'low' END AS overall, CASE WHEN m = 3 THEN 'info' WHEN m < 4 THEN '' END AS severities, CAST(CASE WHEN m < 4 THEN 0 END AS INTEGER) AS n_scope
        FROM (SELECT doc_id, doc_id % 5 AS m FROM documents)""",
    "structured_completion": """SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN '{"n": ' || length('Document ' || doc_id) || '}' END AS answer, CASE WHEN doc_id % 10 = 3 THEN 'ValueError: refused' END AS error, CAST(CASE WHEN doc_id % 10 = 3 THEN 4 ELSE 1 END AS INTEGER) AS n_attempts FROM documents""",
    "text_completion": """SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN length('Document ' || doc_id) || ' characters' END AS answer, CASE WHEN doc_id % 10 = 3 THEN 'ValueError: refused' END AS error, CAST(CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS INTEGER) AS n_attempts FROM documents""",
    "tokenizer_truncation": """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ ]+| +') AS t FROM documents), x AS (SELECT doc_id, CASE WHEN len(t) <= 200 THEN text ELSE array_to_string(t[1:120], '') || chr(10) || chr(10) || '[... TRUNCATED ...]' || chr(10) || chr(10) || array_to_string(t[len(t) - 63:], '') END AS s FROM w)
        SELECT doc_id, sha256(s) AS sha, CAST(length(s) AS INTEGER) AS n_chars FROM x""",
}
