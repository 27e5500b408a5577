"""Classification, its seams and the stages, on small fixtures."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactum.functions import text as t
from pactum.operators import classify, lineage, search, store
from pactum.sources import artefacts, extract
from pactum.streaming import ingest, stages

CONTRACT = """Master Services Agreement
between A and B, effective 2024-02-03, governed by the laws of Utopia
1. Definitions
Words mean what they say.
2. Limitation of Liability
Liability is unlimited.
3. Fees
Net 30 from invoice.
Base fee: $7,500
Amendment #1 (ATS): $3,000
Amendment #2: $1,800.00
New Total Project Cost: $12,300
Signed by both."""


def parsed(spark, *rows):
    return spark.createDataFrame(rows, "doc_id string, tenant_id string, text string")


def test_rules(spark):
    r = classify.classify(parsed(spark, ("d", "t", CONTRACT), ("e", "t", ""), ("f", "t", None))).orderBy("doc_id").collect()
    d = r[0]
    assert (d.doc_type, d.title, d.effective_date, d.lifecycle, d.payment_terms, d.currency) == ("MSA", "Master Services Agreement", "2024-02-03", "signed", "Net 30", "USD")
    assert [(c.number, c.category, c.risk_level) for c in d.clauses] == [("1", "Definitions", "low"), ("2", "Liability", "critical"), ("3", "Fees", "low")]
    assert (d.base_value, d.value_delta, d.new_total_value, d.reconciled, d.validation.confidence) == (Decimal(7500), Decimal(4800), Decimal(12300), True, "high")
    assert d.error is None and [x.error for x in r[1:]] == [classify.NO_TEXT] * 2 and r[1].clauses is None


def test_figures_that_do_not_add_up(spark):
    rows = classify.validated(spark.createDataFrame([("a", CONTRACT.replace("12,300", "12,302"), Decimal(5)), ("b", None, None), ("c", "no money", None)], "doc_id string, text string, contract_value decimal(18,2)"))
    r = {x.doc_id: x for x in rows.collect()}
    assert (r["a"].reconciled, len(r["a"].issues), r["a"].confidence) == (False, 2, "medium")
    assert (r["b"].validated, r["b"].issues, r["b"].confidence) == (False, [classify.UNCHECKED], "low")
    assert (r["c"].reconciled, r["c"].line_items, r["c"].confidence) == (None, [], "low")


def test_a_model(spark):
    """A model that needs a second try, one that never answers, and one that talks instead."""
    calls = spark.sparkContext.accumulator(0)

    def model(system, prompt, schema):
        calls.add(1)
        if "never" in prompt:
            raise TimeoutError("busy")
        if "talks" in prompt:
            return '"just talk"'
        assert "- 1 Definitions" in prompt and schema
        return json.dumps({"doc_type": "msa", "title": "T", "clauses": [{"number": "1", "title": "Definitions", "body": "b", "category": "Definitions"}], "commercials": {"total_contract_value": 5, "currency": "EUR"}})

    rows = classify.classify(parsed(spark, ("d", "t", CONTRACT), ("n", "t", "never"), ("s", "t", "talks"), ("z", "t", " ")), model, attempts=3, wait=0.0)
    r = {x.doc_id: x for x in rows.collect()}
    assert (r["d"].doc_type, r["d"].lifecycle, r["d"].pricing_model, len(r["d"].clauses)) == ("MSA", "draft", "unknown", 1)
    assert (r["d"].contract_value, r["d"].currency) == (Decimal(12300), "USD")  # what the text says stands over the model's figures
    assert r["n"].error == "TimeoutError: busy" and r["s"].error == "The answer is no record" and r["z"].error == classify.NO_TEXT
    assert r["n"].doc_type is None


def test_completion_waits_and_stops(spark, monkeypatch):
    said = classify.completion(spark.createDataFrame([("x", 1)], "prompt string, other int"), lambda s, p, k: "no json", schema="n int", attempts=2, wait=0.0).first()
    assert said.answer is None and said.error.startswith("JSONDecodeError") and said.n_attempts == 2 and said.other == 1
    with pytest.raises(ValueError, match="in the way"):
        classify.completion(spark.createDataFrame([("x", 1)], "prompt string, ERROR int"), None)


def test_english_terms(spark):
    text = "The cat's parties were running, planned and hoped; classes of boxes, agreed to (and) tied. Its bus is focus"
    got = spark.createDataFrame([(text,), (None,)], "x string").select(t.analyzed(F.col("x")).alias("w")).collect()
    assert got[0].w == ["cat", "party", "were", "run", "plan", "hop", "class", "box", "agre", "tied", "it", "bus", "focus"]
    assert got[1].w == []


def test_searches_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    rows = [(i, i // 3, f"t{i % 2}", "SOW", f"title {i % 5}", f"alpha {'beta ' * (i % 4)} gamma{i % 7}", [float(i % 3), float(i % 5), 1.0]) for i in range(60)]
    clauses = spark.createDataFrame(rows, "clause_id int, doc_id int, tenant_id string, doc_type string, title string, text string, vector array<double>")
    queries = spark.createDataFrame([(q, f"t{q % 2}", f"beta gamma{q}", [1.0, float(q), 0.5]) for q in range(6)] + [(9, "t0", "beta", None)], "query_id int, tenant_id string, text string, vector array<double>")

    def found():
        index = search.index(clauses, search.asked_terms(queries))
        a = search.knn(queries, clauses, 4, 3).collect()
        assert sorted(a) == sorted(search.knn(queries, clauses, 4).collect())
        return sorted(a), sorted(search.bm25(queries, index, clauses, 4).collect())

    few = found()
    monkeypatch.setattr(search, "FEW", 0)
    assert found() == few and len(few[0]) == 24


def test_cycles(spark):
    nodes = spark.range(9).select(F.col("id").cast("int").alias("doc_id"))
    edges = spark.createDataFrame([(1, 0), (2, 1), (0, 2), (0, 3), (3, 4), (5, 6)], "parent_id int, child_id int")
    got = {r.doc_id: (r.root_id, r.hops) for r in lineage.roots(edges, nodes, "entry").collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (0, 1), 4: (0, 2), 5: (5, 0), 6: (5, 1), 7: (7, 0), 8: (8, 0)}


def test_observed_usage(spark):
    calls, seen = store.observed(spark.createDataFrame([("ab", "c"), ("d", None)], "prompt string, answer string"), "u")
    assert calls.count() == 2 and seen.get == {"calls": 2, "prompt_chars": 3, "answer_chars": 1}


def test_reader_errors_are_rows(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF"), ("b.docx", b"PK\x03\x04"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(content)

    def reader(content):
        raise OSError("torn")

    r = {x.doc_id: x.error for x in extract.parse(artefacts.objects(spark, str(tmp_path)), reader).collect()}
    assert r == {"a.pdf": "OSError: torn", "b.docx": "No extractor could read the file", "c.txt": "Unsupported file type: 'c.txt'. Supported: pdf, docx"}


def put(folder, doc, text):
    from pactum.plans.files import docx

    path = folder / f"tenants/t/uploads/{doc}"
    path.mkdir(parents=True, exist_ok=True)
    (path / "file.docx").write_bytes(docx(text))


def test_stages_link_diff_and_replay(spark, tmp_path):
    """A base contract, its amendment in a later batch, then the amendment's next version; a file that comes again is none."""
    base = "Master Services Agreement Alpha Project\n1. Fees\nThe fee for alpha work is ten.\n2. Liability\nLiability is capped for alpha.\n3. Term\nOne year of alpha."
    amended = base.replace("Master Services Agreement", "Amendment to Master Services Agreement").replace("is ten", "is twelve and a half")
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    put(folder, "m", base)
    put(folder, "bad", "x")
    (folder / "tenants/t/uploads/bad/file.docx").write_bytes(b"PK\x03\x04")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")

    def batch(*docs, number):
        paths = [str(folder / f"tenants/t/uploads/{d}/file.docx") for d in docs]
        stages.process(spark.read.format("binaryFile").load(paths), out, number, now=now)

    batch("m", "bad", number=0)
    put(folder, "a", amended)
    batch("m", "a", number=1)
    batch("m", "a", number=1)  # the same batch once more
    put(folder, "a", amended.replace("One year", "Two years"))
    batch("a", number=2)
    docs = {r.doc_id: r for r in stages.current_documents(spark, out).collect()}
    assert set(docs) == {"m", "a"} and (docs["m"].latest_version, docs["a"].latest_version) == (1, 2)
    assert (docs["a"].doc_type, docs["a"].parent_doc_id, docs["m"].parent_doc_id) == ("AMENDMENT", "m", None)
    assert [tuple(r) for r in stages.stored(spark, out, "edges").select("parent_id", "child_id").distinct().collect()] == [("m", "a")]
    changes = stages.stored(spark, out, "changes")
    assert sorted((r.version_number, r.clause_number, r.field) for r in changes.collect()) == [(1, "1", "body"), (2, "1", "body"), (2, "3", "body")]
    states = {(r.state, r.clause_key): r.body for r in stages.stored(spark, out, "states").filter("batch = 2 and root_id = 'm'").collect()}
    assert states[("initial", "1")] == "The fee for alpha work is ten." and states[("current", "1")] == states[("initial", "1")]
    assert "twelve" in states[("future", "1")] and states[("future", "3")].startswith("Two years")
    status = {r.doc_id: (r.status, r.error) for r in store.latest_status(stages.stored(spark, out, "status")).collect()}
    assert status == {"m": ("READY", None), "a": ("READY", None), "bad": ("FAILED", "Error: No extractor could read the file")}
    assert stages.quarantine(spark, out, now).count() == 1 and stages.quarantine(spark, out, now + F.expr("interval 20 days")).count() == 0
    index = stages.stored(spark, out, "index").filter("batch = 2").collect()
    assert {r.doc_id for r in index} == {"a"} and len(index) == 3


def test_ingest_counts_a_checksum_once(spark, tmp_path):
    for n, (name, text) in enumerate((("a", "one"), ("a", "one"), ("a", "two"))):
        put(tmp_path / f"in{n}", name, text)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in{n}").rename(tmp_path / "in" / str(n))
        ingest.start(ingest.arriving(spark, str(tmp_path / "in")), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    rows = stages.stored(spark, f"file://{tmp_path}/out", "parsed").collect()
    assert sorted((r.batch, r.text) for r in rows) == [(0, "one"), (2, "two")]


def test_artefacts(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    artefacts.write_json(spark.createDataFrame([("a", "d", 1)], "tenant_id string, doc_id string, n int"), folder, "k")
    (tmp_path / "x/k/tenant_id=a/broken.json").write_text("not json\n")
    r = artefacts.read_json(spark, folder, "k", "doc_id string, n int").orderBy("doc_id").collect()
    assert [(x.doc_id, x.n, x._corrupt_record) for x in r] == [(None, None, "not json"), ("d", 1, None)]
    assert artefacts.delete_prefix(spark, f"{folder}/nothing") == 0 and artefacts.delete_prefix(spark, f"{folder}/k/tenant_id=a") >= 2


def test_documents_of_two_tenants_share_an_id(spark):
    """A join on the id would give four rows, of mixed figures; each figure is read out of a text once, so nothing is joined or dealt out."""
    other = CONTRACT.replace("12,300", "45,600")
    rows = classify.classify(parsed(spark, ("d", "t", CONTRACT), ("d", "u", other)))
    found = {r.tenant_id: r.contract_value for r in rows.collect()}
    assert rows.count() == 2 and found == {"t": Decimal(12300), "u": Decimal(45600)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
