"""Texts of five megabytes go through every operator whole: what stands at their end counts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pactum.llm import bpe, queries


@pytest.fixture(scope="module")
def long_dir(spark, case_dir, documents):
    rng = random.Random(6)
    words = [f"{rng.choice(['al', 'be', 'ga', 'om'])}{rng.choice(['pha', 'ta', 'mma', 'ega'])}{i}" for i in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(48_000)]
    text = "\n".join([*lines, "one two three four five six seven eight nine ten eleven", "Licensed under the Apache License, Version 2.0."])
    assert len(text) > 5_000_000
    docs = [(1, text), (2, text), (3, "a short text of a few words"), (4, text + " and a little more")] + [(10 + i, f"filler text number {i} of the corpus") for i in range(60)]
    labels = spark.createDataFrame([(10 + i, i % 2, (i + 1) % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(5, "TWO three four five six seven eight nine ten eleven")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", text), (2, 0, "user", "hello"), (2, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return case_dir(documents=documents(docs), labels=labels, benchmark=items, conversations=turns), dict(docs)


def rows(spark, name, folder):
    found = {}
    for r in queries.QUERIES[name](spark, folder).collect():
        found.setdefault(r[0], []).append(r)
    return found


def test_media(spark, long_dir):
    got = rows(spark, "op1_media", long_dir[0])
    for i in (1, 3):
        data = long_dir[1][i].encode()
        whole = data + b"\0" * (-len(data) % 64)
        assert got[i][0].payload_sha256 == hashlib.sha256(whole).hexdigest() and got[i][0].tail_crc32 == zlib.crc32(whole[-64:])
    assert got[1][0].media_sha256 == got[2][0].media_sha256


def test_near_duplicates(spark, long_dir):
    got = rows(spark, "op3_minhash_join", long_dir[0])
    assert [(got[i][0].class_id, got[i][0].n_links) for i in (1, 2, 3, 4)] == [(1, 2), (1, 2), (3, 0), (1, 2)]


@pytest.mark.parametrize("name", ["op4_toxicity", "op9_quality"])
def test_scores(spark, long_dir, name):
    got = rows(spark, name, long_dir[0])
    assert got[1][0].score == got[2][0].score and all(0 <= r[0].score <= 1 for r in got.values()) and len(got) == 64


def test_leak_at_the_end(spark, long_dir):
    got = rows(spark, "op5_decontamination", long_dir[0])
    assert [(got[i][0].n_hit, got[i][0].n_items) for i in (1, 2, 3, 4)] == [(10, 1), (10, 1), (0, 0), (10, 1)]


def test_tokens(spark, long_dir):
    library = bpe.encoder(bpe.vocabulary_path()).library
    ids = library.encode(long_dir[1][1], add_special_tokens=False).ids
    files = rows(spark, "op6_token_files", long_dir[0])
    assert (files[1][0].start, files[1][0].n_tokens, files[1][0].ids_crc32) == (0, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
    assert files[2][0].start == len(ids) + 1
    packed, at = sorted(rows(spark, "op8_packing", long_dir[0])[1], key=lambda r: r.start), 0
    for r in packed:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array([*ids, 1][at : at + r.length], "<u4").tobytes())
        at += r.length
    assert at == len(ids) + 1
    counts = rows(spark, "op2_token_counts", long_dir[0])[1]
    assert sum(r.n_tokens for r in counts) == len(ids) == counts[0].doc_tokens and len(counts) == 48_002


def test_licence_at_the_end(spark, long_dir):
    got = rows(spark, "op7_licenses", long_dir[0])
    assert [(r.paragraph, r.family) for r in got[1] if r.confirmed] == [(48_001, "Apache")] and 3 not in got


def test_chat(spark, long_dir):
    got = rows(spark, "op10_chat_tree", long_dir[0])
    text = long_dir[1][1]
    for i in (1, 2):
        assert got[i][0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i][0].turns_sha256 == hashlib.sha256(f"user\nhello\nassistant\n{text}\n".encode()).hexdigest()
