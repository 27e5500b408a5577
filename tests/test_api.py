"""The document API's requests."""

import pytest
from pyspark.sql import functions as F

from pactum.operators import api, search

DOC = "doc_id int, tenant_id string, title string, lifecycle string, doc_type string, raw_key string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, "t", "one", "draft", "SOW", "k/1.pdf"), (2, "t", "two", "draft", "MSA", ""), (3, "u", "three", "draft", "NDA", None)], DOC)


def test_update(spark, documents):
    asked = spark.createDataFrame([(10, "t", 1, '{"title": " new "}'), (11, "t", 3, '{"title": "x"}'), (12, "t", 2, '{"lifecycle": "nope"}')], "request_id int, tenant_id string, doc_id int, body string")
    answers, after = api.update(asked, documents)
    assert {r.request_id: (r.status, (r.error or "")[:9]) for r in answers.collect()} == {10: (200, ""), 11: (404, "Document "), 12: (400, "Invalid l")}
    assert {r.doc_id: (r.title, r.lifecycle) for r in after.collect()} == {1: ("new", "draft"), 2: ("two", "draft"), 3: ("three", "draft")}


def test_reprocess_and_listing(spark, documents):
    asked = spark.createDataFrame([(10, "t", 1), (11, "t", 2), (12, "t", 3)], "request_id int, tenant_id string, doc_id int")
    rows = {r.request_id: (r.path, r.status, r.error) for r in api.reprocess(asked, documents).collect()}
    assert rows[10] == ("k/1.pdf", "PENDING", None) and rows[11][2].startswith("Original upload") and rows[12][2] == api.NOT_FOUND
    assert {r.tenant_id: (r["count"], r.doc_ids) for r in api.list_documents(documents).collect()} == {"t": (2, [1, 2]), "u": (1, [3])}


@pytest.mark.parametrize("given,want", [((None, "", None), "default"), ((None, "r", "h"), "r"), (("j", "r", "h"), "j"), ((None, None, "h"), "h")])
def test_tenant(spark, given, want):
    assert spark.range(1).select(api.tenant(*(F.lit(x).cast("string") for x in given)).alias("t")).first().t == want


def test_ask_without_hits_or_question(spark):
    clauses = spark.createDataFrame([(1, 7, "t", "1", "Fees", "fees", "the fee is ten\nor more")], "clause_id int, doc_id int, tenant_id string, clause_number string, category string, title string, text string")
    q = spark.createDataFrame([(1, "t", "what fee"), (2, "none", "what fee"), (3, "t", "  ")], "query_id int, tenant_id string, text string")
    found = {r.query_id: r for r in api.ask(q, search.postings(clauses), clauses).collect()}
    assert set(found) == {1, 2} and found[1].answer == "[§1] the fee is ten" and found[1].citations[0].doc_id == 7
    assert found[2].answer == search.NOTHING_FOUND
