"""Held-out accuracy, determinism and odd cases of the classifiers."""

import zlib

import numpy as np
import pytest

from pactum.llm import labelled, quality, toxicity

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = np.random.default_rng(3)
    parts = ["the", "er", "on", "an", "in", "ed", "ing", "tion", "ble", "st"]
    bad = ["grumblefink", "zozzleprat", "wuffnork", "quibhexer"]

    def text(toxic):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(60, 220))]
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.integers(len(words))] = str(rng.choice(bad))
        return " ".join(words).encode()

    y = np.array([int(i % 4 == 0) for i in range(640)])
    return [text(v) for v in y], y


def test_toxic_words_are_found(toxic_corpus):
    texts, y = toxic_corpus
    score = toxicity.scorer(toxicity.fit(texts[:480], y[:480]))()
    found = np.array([score(t) >= toxicity.CUT for t in texts[480:]])
    assert (found == y[480:]).mean() > 0.95
    assert score(texts[500]) == score(texts[500]) and 0 <= score(b"") <= 1


def test_the_shared_dictionary_is_trained_on_all_ordinary_texts(monkeypatch):
    y = np.array([int(i % 100 == 0) for i in range(3200)])
    texts = [f"ordinary text of number {i}".encode() for i in range(len(y))]
    given = []
    real = toxicity._dictionary
    monkeypatch.setattr(toxicity, "_dictionary", lambda size, samples, **o: given.append((size, samples)) or real(size, samples, **o))
    toxicity.fit(texts, y)
    later = labelled.every_fourth(y)
    assert [sorted(s) for n, s in given if n == toxicity._BASE] == [sorted(t for t, v, c in zip(texts, y, later, strict=True) if not v and not c)]


def test_held_out_accuracy_on_the_tables(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    for query, name, cut, least in ((toxicity.op4_toxicity, "toxic", 0.5, 0.9), (quality.op9_quality, "quality", 0.3, 0.98)):
        rows = [r for r in query(spark, BIG).collect() if r.held_out and r.doc_id in labels]
        assert all(r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
        right = np.mean([r.predicted == labels[r.doc_id][name] for r in rows])
        assert len(rows) > 500 and right > least, (name, right)


def test_held_out_rows(documents):
    rows = documents([(i, "t") for i in range(50)] + [(None, "t")]).select("doc_id", labelled.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in rows)


def test_sample_is_bounded_and_blind_to_held_out_rows(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (4, None), (4, 0)], "doc_id long, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic", 20, 30)
    assert (y == 1).sum() == 20 and (y == 0).sum() == 30
    assert not [t for t in texts if zlib.crc32(t.split()[1]) % 5 == 0]
    again = labelled.sample(docs.repartition(7), labels.repartition(5), "toxic", 20, 30)
    assert again[0] == texts and (again[1] == y).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_and_odd_rows(documents, odd, module):
    model = module.fit([], np.zeros(0, np.int64))
    df = documents(odd, "score _toxicity _quality")
    assert len(labelled.verdicts(df, module.scorer(model), 0.5).collect()) == len(odd)
    kept = module.keep(df, model)
    assert kept.columns == df.columns and kept.count() == len(odd)
    assert module.keep(documents([]), model).count() == 0


def test_both_models_score_odd_rows(documents, odd, toxic_corpus):
    texts, y = toxic_corpus
    for module in (toxicity, quality):
        model = module.fit(texts[:200], y[:200])
        rows = labelled.verdicts(documents(odd), module.scorer(model), 0.5).collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


def test_indicators_cover_whole_texts_whatever_the_piece(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5000).astype(np.uint8))
    whole = quality.indicators(text)
    monkeypatch.setattr(quality, "_PIECE", 64)
    assert (quality.indicators(text) == whole).all()


def test_shapes_tell_repetition():
    s = quality.shapes(b"Aa aa aa bb1 $$$ cc\nAa aa aa bb1 $$$ cc\nzz")
    again, line = (s // 16) % 4, s // 64
    assert again[2] == 1 and again[1] == 0
    assert line.tolist() == [0] * 6 + [1] * 6 + [0]


def test_descent_separates_and_stays_in_the_box():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 50, 10)) if v else np.unique(rng.integers(40, 90, 10)) for v in (1, 0) * 60]
    y = np.array([1, 0] * 60)
    w, b = quality.descent(rows, y, np.ones(100), 1.0)
    assert np.mean([(w[r].sum() + b > 0) == v for r, v in zip(rows, y, strict=True)]) > 0.97


def test_logistic_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < labelled.chance(2 * x[:, 0] - 1)).astype(int)
    w = labelled.logistic(x, y, 1e-6)
    assert abs(w[0] - 2) < 0.25 and abs(w[1] + 1) < 0.2
