"""Worked examples and properties of the contract operators."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pactum.operators import diff, lineage, rollup, search, store, timeline, validation
from pactum.sources import extract
from pactum.streaming import ingest, status

CLAUSE = "doc_id int, pos int, number string, title string, body string, category string"


def clauses(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, *r) for i, r in enumerate(rows)], CLAUSE)


@pytest.fixture(scope="module")
def scored(spark):
    parent = clauses(spark, [("1", "T", "hello", "Fees"), ("2", "T", "ten chars.", "Liability"), ("3", "A", "b", "Fees"), ("5", "T", "gone", "Liability")])
    current = clauses(spark, [("1", "T", "HELLO ", "Fees"), ("2", "T", "ten chars, and ten more", "Liability"), ("3", "A", "b", "Term"), ("4", "T", "new", "IP")])
    return diff.score(diff.diff(current, parent), current)


def test_diff_and_scores(scored):
    rows = [(r.seq, r.clause_number, r.field, r.before, r.after, r.impact_score) for r in scored.orderBy("seq").collect()]
    assert rows == [
        (1, "2", "body", "ten chars.", "ten chars, and ten more", 80), (2, "3", "category", "Fees", "Term", 40),
        (3, "4", "body", "", "new", 80), (4, "5", "body", "gone", "", 50),
    ]
    assert scored.filter("seq = 1").first().impact_rationale == "Heuristic: Liability, field=body, Δ=57%"


def test_summary(spark, scored):
    docs = spark.createDataFrame([(1, True, True), (2, False, False), (3, True, False), (4, True, True)], "doc_id int, has_parent boolean, parent_known boolean")
    said = {r.doc_id: r.impact_summary for r in diff.summarise(scored, docs).collect()}
    assert said == {1: "4 change(s): 2 high, 2 medium, 0 low impact.", 2: diff.FIRST_VERSION, 3: diff.NO_PARENT, 4: diff.NO_CHANGES}


def test_diff_of_equal_clauses_is_empty_and_duplicates(spark):
    a = clauses(spark, [("1", "x", "y", "Fees"), ("", "n", "m", "Other"), ("2", None, None, None)])
    assert diff.diff(a, a).isEmpty()
    twice = clauses(spark, [("1", "old", "y", "Fees"), ("1.", "new", "y", "Fees")])
    assert diff.diff(a.filter("pos = 0"), twice).count() == 2  # keys 1 and 1. differ: one is added, both of the parent's are compared or gone


def test_refiner_overrides_and_failures_keep_the_heuristic(spark, scored):
    def refiner(category, field, before, after):
        if field == "category":
            raise RuntimeError("no model")
        return 7, "said"

    out = {r.seq: (r.impact_score, r.impact_rationale) for r in diff.refine(scored, refiner).collect()}
    assert out[1] == (7, "said") and out[2][0] == 40
    assert diff.refine(scored) is scored


def sequential(start, changes):
    state = {k: dict(v) for k, v in start.items()}
    for number, field, after in changes:
        key = "".join(c for c in number.lower() if c.isalnum() or c == ".")
        if not key:
            continue
        if field == "body" and after == "":
            state.pop(key, None)
            continue
        state.setdefault(key, {"number": number, "title": "", "body": "", "category": "Other"})[field] = after
    return state


def test_fold_equals_sequential_replay(spark):
    rng = random.Random(5)
    starts, changes, want = [], [], {}
    for root in range(120):
        start = {str(k): {"number": str(k), "title": f"t{k}", "body": f"b{k}", "category": "Fees"} for k in range(rng.randint(0, 3))}
        log = [(rng.choice(["0", "1", "2", "3", " 1", "", "§"]), rng.choice(["title", "body", "body", "category"]), rng.choice(["", "x", "y", "z"])) for _ in range(rng.randint(0, 9))]
        starts += [(root, k, *v.values()) for k, v in start.items()]
        changes += [(root, i, *c) for i, c in enumerate(log, 1)]
        want |= {(root, k): v for k, v in sequential(start, log).items()}
    s = spark.createDataFrame(starts, "root_id int, clause_key string, number string, title string, body string, category string")
    c = spark.createDataFrame(changes, "root_id int, seq int, number string, field string, after string")
    got = {(r.root_id, r.clause_key): {"number": r.number, "title": r.title, "body": r.body, "category": r.category} for r in timeline.fold(s, c).collect()}
    assert got == want


def test_states_of_signed_and_active_members(spark):
    start = timeline.initial(spark.createDataFrame([(1, 0, "1", "A", "x", None), (1, 1, "2", "B", "y", None)], "root_id int, pos int, number string, title string, body string, category string"))
    changes = spark.createDataFrame([(1, 1, "1", "body", "x2", True), (1, 2, "2", "body", "", False), (1, 3, "3", "body", "z", False)], "root_id int, seq int, number string, field string, after string, active boolean")
    rows = {(r.state, r.clause_key): (r.title, r.body, r.category) for r in timeline.states(start, changes).collect()}
    assert rows[("current", "1")] == ("A", "x2", "Other") and rows[("current", "2")] == ("B", "y", "Other")
    assert {k for s, k in rows if s == "future"} == {"1", "3"} and rows[("future", "3")] == ("", "z", "Other")
    assert timeline.states(start, changes.filter("active")).filter("state = 'future'").isEmpty()


def hits(spark, rows):
    return spark.createDataFrame([(1, f"c{d}", d, float(s), i) for i, (d, s) in enumerate(rows, 1)], "query_id int, clause_id string, doc_id int, score double, rank int")


def test_hybrid_normalisation(spark):
    out = search.fuse(hits(spark, [(1, 0.9), (2, 0.7), (3, 0.5)]), hits(spark, [(2, 8), (4, 4)])).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in out] == [(2, 0.7), (1, 0.6), (3, 0.0), (4, 0.0)]
    lone = search.fuse(hits(spark, [(1, 0.9)]), hits(spark, [])).first()
    assert lone.score == 0


def test_retrieval_fills_from_keywords(spark):
    out = search.retrieve(hits(spark, [(1, 0.9), (2, 0.8)]), hits(spark, [(2, 9), (3, 8), (4, 7)]), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.channel) for r in out] == [(1, 0), (2, 0), (3, 1)]
    texts = spark.createDataFrame([(f"c{i}", str(i), "t" * 9, "Fees") for i in range(1, 5)], "clause_id string, clause_number string, text string, category string")
    c = search.context(search.retrieve(hits(spark, [(1, 0.9)]), hits(spark, [(2, 9)]), 3), texts, 3).first()
    assert c.context == "[§1] ttt\n[§2] ttt" and [x.doc_id for x in c.citations] == [1, 2]
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    said = {r.query_id: r.answer for r in search.answer(asked, search.context(hits(spark, [(1, 0.9)]), texts, 3)).collect()}
    assert said == {1: "[§1] ttt", 2: search.NOTHING_FOUND}


def test_search_conditions(spark):
    clause = spark.createDataFrame([(i, i // 2, "t", "SOW" if i < 4 else "NDA", "title", f"alpha {'beta ' * i}", f"{i}abc") for i in range(6)], "clause_id int, doc_id int, tenant_id string, doc_type string, title string, text string, structural_hash string")
    q = spark.createDataFrame([(1, "t", "beta", 1, ["SOW"], None, None), (2, "t", "alpha", None, None, 2, None), (3, "t", "alpha", None, None, None, "3a"), (4, "u", "alpha", None, None, None, None)], "query_id int, tenant_id string, text string, exclude_doc_id int, doc_types array<string>, doc_id int, hash_prefix string")
    found = {}
    for r in search.bm25(q, search.postings(clause), clause).collect():
        found.setdefault(r.query_id, set()).add(r.clause_id)
    assert found == {1: {1}, 2: {4, 5}, 3: {3}}


def test_parent_match_thresholds(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id int, title string")
    hybrid = spark.createDataFrame([(10, 1, 1.0), (11, 1, 0.9)], "child_id int, doc_id int, score double")
    structural = spark.createDataFrame([(11, 1)], "child_id int, doc_id int")
    out = {r.doc_id: r for r in lineage.combine(hybrid, structural, docs([(10, "q"), (11, "a b c"), (12, "z")]), docs([(1, "b c d")])).collect()}
    assert (out[10].parent_doc_id, out[10].match_confidence, out[10].match_reason) == (None, 0.6, "best candidate 1 below threshold (0.60)")
    assert (out[11].parent_doc_id, out[11].match_confidence, out[11].match_reason) == (1, 0.865, "hybrid=0.90 + structural-hash + title-sim=0.50")
    assert (out[12].match_confidence, out[12].match_reason) == (0.0, "no candidates found")


def test_representative(spark):
    rows = [(1, 0, "a", "Other", "long long"), (1, 1, "b", "Term", "x"), (2, 0, "c", "Other", "short"), (2, 1, "d", "Other", "longer body"), (3, 0, "e", "Fees", "")]
    df = spark.createDataFrame(rows, "doc_id int, pos int, number string, category string, body string")
    assert {r.doc_id: r.number for r in lineage.representative(df).collect()} == {1: "b", 2: "d", 3: "e"}


def test_roots_and_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "doc_id int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (6, 6)], "parent_id int, child_id int")
    want = {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 1), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    for out in (lineage.roots(edges, nodes), lineage.roots_sql(spark, edges, nodes)):
        assert {r.doc_id: (r.root_id, r.hops) for r in out.collect()} == want
    loop = spark.createDataFrame([(5, 6), (6, 5)], "parent_id int, child_id int")
    assert {r.doc_id: r.root_id for r in lineage.roots_sql(spark, loop, nodes.filter("doc_id = 5")).collect()} == {5: 5}


def test_roots_of_deep_chains(spark):
    nodes = spark.range(301).select(F.col("id").cast("int").alias("doc_id"))
    edges = nodes.filter("doc_id > 0").select((F.col("doc_id") - 1).alias("parent_id"), F.col("doc_id").alias("child_id"))
    assert {r.doc_id: (r.root_id, r.hops) for r in lineage.roots(edges, nodes).collect()} == {i: (0, i) for i in range(301)}
    below = edges.filter("child_id > 1").unionByName(spark.createDataFrame([(7, 1)], "parent_id int, child_id int"))
    with pytest.raises(ValueError, match="cycle"):
        lineage.roots(below, nodes)


def test_chain_order_and_ghosts(spark):
    edges = spark.createDataFrame([(1, 4), (1, 3), (1, 2), (1, 9)], "parent_id int, child_id int")
    docs = spark.createDataFrame([(2, "AMENDMENT", "active", "2024-02-01", "b"), (3, "AMENDMENT", "signed", "2024-01-01", "c"), (4, "AMENDMENT", "active", None, "d")], "doc_id int, doc_type string, lifecycle string, effective_date string, title string")
    rows = lineage.chain(edges, docs).orderBy("seq").collect()
    assert [r.doc_id for r in rows] == [4, 9, 3, 2] and (rows[1].doc_type, rows[1].lifecycle) == ("AMENDMENT", "draft")


def test_risk(spark):
    df = spark.createDataFrame([(1, x) for x in ["low", "HIGH", None, "weird", "critical"]], "doc_id int, risk_level string")
    r = rollup.risk(df).first()
    assert (r.low, r.medium, r.high, r.critical, r.high_risk_count, r.overall_risk, r.clause_count) == (2, 0, 1, 1, 2, "critical", 5)


@pytest.mark.parametrize("stated,want", [(12300.0, True), (12302.0, False), (None, None)])
def test_reconciliation(spark, stated, want):
    totals = spark.createDataFrame([(1, 7500.0, stated)], "k int, base double, stated double")
    parts = spark.createDataFrame([(1, 3000.0), (1, 1800.0)], "k int, amount double")
    assert rollup.reconcile(totals, parts, "k").first().reconciled is want


def test_canonical_figures(spark):
    f = "doc_id int, currency string, contract_value double, base_value double, value_delta double, new_total_value double, payment_terms string"
    c = spark.createDataFrame([(1, "USD", 1.0, 2.0, 3.0, 4.0, "net 30")], f)
    v = spark.createDataFrame([(1, "", None, 9.0, None, 5.0, "net 60")], f)
    assert tuple(rollup.canonical(c, v).first()) == (1, "USD", 1.0, 9.0, 3.0, 5.0, "net 30")


def test_versions(spark):
    v = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "doc_id int, version_number int")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    left = lambda gone: store.delete_versions(v, spark.createDataFrame(gone, "doc_id int, version_number int"), docs).filter("doc_id = 1").first().latest_version
    assert left([(1, 3)]) == 2 and left([(1, 2)]) == 3 and left([(1, 1), (1, 2), (1, 3)]) is None


def test_patch_and_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    p = spark.createDataFrame([(1, None, True), (2, "z", False)], "k int, v string, set_v boolean")
    assert sorted(map(tuple, store.patch(base, p, "k", ["v"]).collect())) == [(1, None), (2, "b")]
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "n", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, store.upsert(base, new, ["k"], "seq").collect())) == [(1, "a"), (2, "y"), (3, "n")]
    assert sorted(map(tuple, store.insert_if_absent(base, new.filter("k = 3 or seq = 2").drop("seq"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "n")]


def test_embedding_cache(spark):
    rows = spark.createDataFrame([(1, "h1", "a"), (2, "h2", "b"), (3, "h2", "b")], "id int, content_hash string, text string")
    cache = spark.createDataFrame([("h1", "m", [1.0]), ("h2", "other", [2.0])], "content_hash string, model string, vector array<float>")
    made = store.embed_missing(rows, cache, lambda texts: [[float(len(t))] for t in texts], "m").collect()
    assert [(r.content_hash, r.vector) for r in made] == [("h2", [1.0])]


def test_validation_edges(spark):
    def check(column):
        return spark.range(1).select(column.alias("v")).first().v

    long = "x" * 501
    assert check(validation.patch(F.lit('{"title": "%s"}' % long))).error.startswith("title is too long")
    assert check(validation.patch(F.lit("{bad"))).error == "Invalid JSON body"
    assert check(validation.upload(F.lit("a/b\\c.txt"), F.lit(None).cast("string"))).filename == "c.txt"
    assert check(validation.upload(F.lit(None).cast("string"), F.lit("MSA"))).reason.startswith("Missing")


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p(paragraphs[0])}{table}{''.join(map(p, paragraphs[1:]))}</w:body></w:document>")
    return out.getvalue()


def test_extraction(spark):
    files = [("s3/tenants/t/uploads/d1/a.docx", docx([" one ", "two", "  "], [["x", ""], ["y", "z"]])), ("tenants/t/uploads/d2/b.pdf", b"%PDF big"), ("tenants/t/uploads/d3/c.pdf", b"%PDF scan"), ("d.txt", b"plain"), ("e.docx", b"broken")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    reader = lambda c: ["x" * 150, "y" * 50] if b"big" in c else ["x"]
    out = {r.doc_id: r for r in extract.parse(df, reader, lambda c: ["seen"]).collect()}
    assert out["d1"].text == "one\ntwo\nx\ny | z" and out["d1"].extraction_method == "docx" and out["d1"].tenant_id == "t"
    assert out["d2"].extraction_method == "pdfplumber" and len(out["d2"].pages) == 2
    assert out["d3"].extraction_method == "textract" and out["d3"].text == "seen"
    assert out["d.txt"].error.startswith("Unsupported file type") and out["e.docx"].error


def test_ingest_of_arriving_files(spark, tmp_path):
    source = tmp_path / "in/tenants/t/uploads/d1"
    source.mkdir(parents=True)
    (source / "a.docx").write_bytes(docx(["hello"], []))
    (source.parent / "d2").mkdir()
    (source.parent / "d2/bad.txt").write_bytes(b"x")
    for _ in range(2):  # the second run finds nothing new
        ingest.start(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n)).collect()
    assert [(r.doc_id, r.text) for r in read("parsed")] == [("d1", "hello")]
    assert sorted((r.doc_id, r.status) for r in read("status")) == [("d1", "READY"), ("d2", "FAILED")]


def test_status_stream_drops_repeats(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "PENDING", None), (1, 2, "2024-01-01 00:01:00", "READY", None), (1, 2, "2024-01-01 00:01:00", "READY", None)]
    df = spark.createDataFrame(rows, "doc_id long, event_id long, ts string, status string, error string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    out = status.run_available(status.latest_status_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "s", "complete", f"file://{tmp_path}/check")
    assert [(r.doc_id, r.status, r.n_events) for r in out.collect()] == [(1, "READY", 2)]


def test_empty_tables(spark):
    none = clauses(spark, [])
    assert diff.score(diff.diff(none, none), none).isEmpty()
    assert rollup.risk(none.withColumn("risk_level", F.lit("low"))).isEmpty()
