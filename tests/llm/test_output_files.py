"""Token files and packing: exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from pactum.llm import bpe, packing, token_files

FIXED = [(5, "b text"), (3, "a text with more words in it"), (4, None), (3, "another of id 3"), (None, "no id"), (10, "x " * 3000)]


@pytest.fixture(scope="module")
def library():
    return bpe.Encoder(bpe.vocabulary_path()).library


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def check_files(rows, pairs, library):
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in pairs), key=lambda i: (i is not None, i or 0))
    at, left = 0, defaultdict(list)
    for i, t in pairs:
        y = ids_of(library, t, 2)
        left[i].append((len(y), crc(y)))
    for r in rows:
        assert r.start == at
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(left.values())


def test_files_round_trip(documents, library):
    check_files(token_files.read(token_files.write(documents(FIXED, "start n_tokens"))).collect(), FIXED, library)


def test_files_of_odd_rows_and_of_none(documents, odd, library):
    check_files(token_files.read(token_files.write(documents(odd))).collect(), odd, library)
    assert token_files.read(token_files.write(documents([]))).count() == 0


def test_file_layout(documents, library, tmp_path):
    shards = token_files.write(documents([(1, "ab cd"), (2, "")]), folder=f"file://{tmp_path}/f").collect()
    name = f"shard-{shards[0].shard:06d}"
    assert shards[0].width == 2
    assert token_files.mapped(f"file://{tmp_path}/f", f"{name}.ids", "<u2").tolist() == [*ids_of(library, "ab cd", 2), 2]
    assert token_files.mapped(f"file://{tmp_path}/f", f"{name}.idx", "<i8").tolist() == [0, 3, 4]
    part = token_files.Mapped(f"file://{tmp_path}/f", f"{name}.idx", "<i8")
    assert len(part) == 3 and part[1:].tolist() == [3, 4] and part[3:9].tolist() == []
    assert not [x for x in (tmp_path / "f").iterdir() if x.name.startswith(".shard")]


def test_query_over_the_table(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_files(token_files.op6_token_files(spark, sf_dir).collect(), docs, library)
    check_packing(packing.op8_packing(spark, sf_dir).collect(), docs, library)


def check_packing(rows, pairs, library, capacity=2048):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for i, t in pairs:
        want[i].append(ids_of(library, t, 1))
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) > 1:  # pieces of rows with one id can't be told apart by id alone
            assert sum(r.length for r in pieces) == sum(map(len, want[i]))
            continue
        at, ids = 0, want[i][0]
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_packing_of_odd_rows_and_of_none(documents, odd, library):
    check_packing(packing.pack(documents(odd, "length task rank")).collect(), odd, library)
    check_packing(packing.pack(documents(FIXED)).collect(), FIXED, library)
    assert packing.pack(documents([])).count() == 0


def test_padding_is_little(documents, library):
    pairs = [(i, "word " * (i * 37 % 900)) for i in range(400)]
    rows = packing.pack(documents(pairs)).collect()
    assert check_packing(rows, pairs, library) <= 2048 + 0.01 * sum(r.length for r in rows)


def test_pieces_carry_their_ids(documents, library):
    rows = packing.pack(documents(FIXED[:2]), with_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_cuts_are_class_lengths():
    for n in range(1, 5000):
        parts = packing.cut(n, 2048)
        assert sum(parts) == n and all(2048 // (2048 // p) >= p for p in parts) and len(parts) <= 9 + n // 2048
