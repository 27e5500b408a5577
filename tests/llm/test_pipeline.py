"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from pactum.llm import decontamination, minhash_forest, packing, quality, toxicity
from pactum.llm.common import materialize, table


def test_every_stage_does_its_operators_work(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    docs = table(spark, sf_dir, "documents")
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, materialize(stage(spark, docs, sf_dir), name)
        if name == "packing":
            assert ids(out) == ids(before)
            break
        assert out.columns == before.columns and ids(out) <= ids(before)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.verdicts(before, toxicity.scorer(toxicity.train(before, labels)), 0.5).filter("predicted = 1").collect()}
        elif name == "quality":
            bad = {r.doc_id for r in quality.verdicts(before, quality.scorer(quality.train(before, labels)), 0.3).filter("predicted = 0").collect()}
        elif name == "near_duplicates":
            bad = {r.doc_id for r in minhash_forest.join(before).filter("doc_id <> class_id").collect()}
        else:
            bad = {r.doc_id for r in decontamination.contaminated(before, items).filter("n_hit > 0").collect()}
        assert ids(out) == ids(before) - bad
        docs = out
    assert {"sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def test_registered_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)}


def test_stages_of_an_empty_table(spark, case_dir, documents):
    folder = case_dir(documents=documents([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert packing.CAPACITY == 2048
