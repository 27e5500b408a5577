"""Token attribution against the library's offsets; licence paragraphs."""

import random

import numpy as np
import pytest

from pactum.llm import bpe, licenses, token_counts


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.vocabulary_path())


def test_spans_are_the_librarys_offsets(coder):
    rng = random.Random(1)
    sizes = token_counts.byte_lengths(coder)
    texts = ["".join(rng.choice("ab é中\n😀'st. ") for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", "<|endoftext|>é", "\n\n\n"]
    for t in texts:
        e = coder.library.encode(t, add_special_tokens=False)
        a, b = token_counts.token_spans(t, sizes[np.array(e.ids, int)])
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == e.offsets, t


def brute(offsets, spans, rule):
    out = []
    for a, b in offsets:
        touched = [i for i, (x, y) in enumerate(spans) if x < b and a < y]
        if rule == "first":
            out.append(next((i for i in touched if spans[i][0] <= a < spans[i][1]), -1))
        else:
            out.append(max(touched, key=lambda i: (min(b, spans[i][1]) - max(a, spans[i][0]), -i), default=-1))
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_brute_force(rule):
    rng = random.Random(2)
    for _ in range(400):
        cuts = np.cumsum([rng.randint(1, 5) for _ in range(12)]).tolist()
        tokens = list(zip([0, *cuts[:-1]], cuts, strict=True))
        marks = sorted(rng.randint(0, cuts[-1] + 3) for _ in range(8))
        spans = list(zip(marks[::2], marks[1::2], strict=True))
        a, b = np.array(tokens).T
        assert token_counts.attributed(a, b, spans, rule).tolist() == brute(tokens, spans, rule), (tokens, spans)
    with pytest.raises(ValueError):
        token_counts.attributed(np.array([0]), np.array([1]), [(0, 5), (3, 6)], rule)


def check_lines(rows, pairs, coder):
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.doc_tokens))
    for i, t in pairs:
        if i is None:
            continue
        e = coder.library.encode(t or "", add_special_tokens=False)
        n = brute(e.offsets, token_counts.lines(t or ""), "first")
        assert sorted(got[i])[:: len(got[i]) // len(set(got[i]))] == [(s, n.count(s), len(e.ids)) for s in range(len(token_counts.lines(t or "")))]


def test_counts_of_lines(documents, odd, coder):
    pairs = [*odd, (50, "a line\n\n\nwith é\nand  more"), (51, "\n"), (52, "中文\n字")]
    check_lines(token_counts.counts(documents(pairs, "section start stop")).collect(), pairs, coder)
    assert token_counts.counts(documents([])).count() == 0
    with pytest.raises(ValueError):
        token_counts.counts(documents([]), rule="last")


def test_counts_of_given_sections(spark, documents, coder):
    text = "heading: body text here and a tail"
    sections = spark.createDataFrame([(1, 9, 18), (1, 0, 7), (9, 0, 5), (1, 100, 120)], "doc_id long, start long, stop long")
    rows = {r.section: r for r in token_counts.counts(documents([(1, text), (2, "none")]), sections).filter("doc_id = 1").collect()}
    offsets = coder.library.encode(text, add_special_tokens=False).offsets
    n = brute(offsets, [(0, 7), (9, 18), (100, 120)], "first")
    assert {s: rows[s].n_tokens for s in rows} == {s: n.count(s) for s in (-1, 0, 1, 2)}
    assert sum(r.n_tokens for r in rows.values()) == len(offsets) == rows[0].doc_tokens


def test_count_query(spark, sf_dir, coder):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_lines(token_counts.op2_token_counts(spark, sf_dir).collect(), pairs, coder)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice(["th", "er", "on", "an", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 40))) for _ in range(500)]
    return licenses.fit(lines + ["a licence to fish under the rule", "the general public is licensed", "version 2.0 of the plan", ""])


def test_notices_are_found_and_confirmed(documents, model):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Released under the MIT License.": "MIT", "We publish it under the GNU Lesser General Public License, version 2.": "LGPL", "MIT License": "MIT", "Code: BSD 3-Clause License": "BSD",
    }
    text = "\n".join(["onan er thin", *lines, "er th on onan inth", ""])
    rows = licenses.scan(documents([(1, text), (2, "th er on\nan in")], "family"), model).collect()
    assert {r.paragraph: r.family for r in rows} == dict(enumerate(lines.values(), 1))
    assert all(r.confirmed and r.doc_id == 1 and r.probability >= licenses.CUT for r in rows)


def test_wrapped_names_and_licence_texts_are_confirmed(documents, model):
    rng = random.Random(4)
    said = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "an", "in"]) for _ in range(3)) for _ in range(n))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    bsd = "Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    pairs = [
        (1, f"{said(9)}\nThis work is licensed under the GNU General\nPublic License, version 3.\n{said(9)}"), (2, "Released under the GNU\nGeneral\nPublic License"),
        (3, f"{said(8)}\n\n{mit}\n\n{said(8)}"), (4, f"{said(8)}\n\n{bsd}\n"), (5, f"{isc}\n\n{said(7)}"), (6, f"{said(150)}\n{mit}\n{said(200)}"), (7, said(400)), (8, "\n".join(said(9) for _ in range(60))),
    ]
    rows = licenses.scan(documents(pairs), model).collect()
    confirmed = [(r.doc_id, r.family) for r in rows if r.confirmed]
    assert sorted(confirmed) == [(1, "GPL"), (2, "GPL"), (3, "MIT"), (4, "BSD"), (5, "ISC"), (6, "MIT")]
    assert {r.doc_id: r.paragraph for r in rows if r.confirmed and r.doc_id < 6} == {1: 1, 2: 0, 3: 2, 4: 2, 5: 0}


def test_odd_rows_have_no_licence(documents, odd, model):
    assert licenses.scan(documents(odd), model).count() == 0
    assert licenses.scan(documents([]), licenses.fit([])).count() == 0


def test_licence_query_finds_every_notice_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    phrases = {"GNU General Public License": "GPL", "Apache License": "Apache", "CC BY-NC": "CC-BY-NC", "MIT License": "MIT"}
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for i, line in enumerate(r.text.split("\n")):
            for p, f in phrases.items():
                if p in line:
                    want[(r.doc_id, i)] = f
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.op7_licenses(spark, folder).filter("confirmed").collect()}
    assert want and {k: got.get(k) for k in want} == want
    assert {f for k, f in got.items() if k not in want} <= {"Proprietary"}


def test_sample_is_bounded(documents):
    docs = documents([(i, "one\ntwo\n\nthree") for i in range(50)])
    assert len(licenses.unknown_sample(docs, 10, 12)) == 12
    assert len(licenses.unknown_sample(docs, 3, 100)) == 9
