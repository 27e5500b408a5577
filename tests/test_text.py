"""Worked examples of the scalar functions."""

import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.functions import text as t
from pactum.sources import extract


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given_,want", [("  Straße\t Élève ", "strasse eleve"), (None, ""), ("", ""), ("Œuvre Łódź Ærø", "oeuvre lodz aero"), ("Ελλάδα Ψυχή", "ellada psukhe"), ("Щука Москва", "shchuka moskva"), ("Việt “a” – …", 'viet "a" - ...'), ("漢字 x", "漢字 x")])
def test_normalize(spark, given_, want):
    assert one(spark, t.normalize(F.lit(given_).cast("string"))) == want


@pytest.mark.parametrize("given_,want", [("§7.4 (A)", "7.4a"), ("Section 2.1", "section2.1"), (None, ""), ("É-1", "é1")])
def test_clause_key(spark, given_, want):
    assert one(spark, t.clause_key(F.lit(given_).cast("string"))) == want


def test_structural_hash(spark):
    rows = spark.createDataFrame([([],), ([("A", "B")],)], "c array<struct<number:string,title:string>>")
    empty, ab = [r.x for r in rows.select(t.structural_hash(F.col("c")).alias("x")).collect()]
    assert empty == hashlib.sha256(b"").hexdigest()
    assert ab == hashlib.sha256(b"a|b").hexdigest()


def test_headers(spark):
    found = one(spark, t.headers(F.lit("intro\n  Section 2.1. Fees and Payment\n1 X\r\n§3 Term of it\nARTICLE 4 é Title")))
    assert [tuple(h) for h in found] == [(1, "2.1", "Fees and Payment"), (3, "3", "Term of it"), (4, "4", "é Title")]


@pytest.mark.parametrize("a,b,want", [("a b c", "b c d", 0.5), ("", "a", 0.0), ("x", "X ", 1.0)])
def test_title_similarity(spark, a, b, want):
    assert one(spark, t.title_similarity(F.lit(a), F.lit(b))) == want
    assert one(spark, t.title_similarity(F.lit(b), F.lit(a))) == want


def test_chunks(spark):
    assert one(spark, t.chunks(F.lit("abcdefghijklmnopqrstuvwxyz"), 10, 2)) == ["abcdefghij", "ijklmnopqr", "qrstuvwxyz"]
    assert one(spark, t.chunks(F.lit("short"), 10, 2)) == ["short"]
    with pytest.raises(ValueError):
        t.chunks(F.lit("x"), 5, 5)


@given(st.integers(0, 60), st.integers(2, 12), st.data())
@settings(max_examples=15, deadline=None)
def test_chunks_cover_the_text(spark, n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    text = "".join(chr(97 + i % 26) for i in range(n))
    parts = one(spark, t.chunks(F.lit(text), size, overlap))
    assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == text
    assert all(len(p) <= size for p in parts)


def test_truncated(spark):
    text = "x" * 100 + "y" * 100
    out = one(spark, t.truncated(F.lit(text), 25))
    assert out == text[:60] + t.TRUNCATED + text[-8:]
    assert one(spark, t.truncated(F.lit("x" * 100), 25)) == "x" * 100
    assert one(spark, t.truncated(F.lit("z" * 50), 1)) == "zz" + t.TRUNCATED


def test_ids_media_and_safe_id(spark):
    none = F.lit(None).cast("string")
    assert tuple(one(spark, t.ids_from_key(F.lit("tenants/t1/uploads/d9/a.pdf"), none, none))) == ("t1", "d9")
    assert tuple(one(spark, t.ids_from_key(F.lit("x/y.pdf"), none, none))) == ("default", "x/y.pdf")
    assert one(spark, t.safe_id(F.lit("d"), F.lit("1 / A"))) == "d::1___A"
    assert one(spark, t.media_type(F.lit("A.PDF"))) == "application/pdf"
    assert one(spark, t.media_type(F.lit("a.bin"))) == "application/octet-stream"


@pytest.mark.parametrize("path,content,want", [("a.PDF", b"", "pdf"), ("a.bin", b"xx%PDF-1.4", "pdf"), ("a.docx", b"", "docx"), ("a", b"PK\x03\x04z", "docx"), ("a.txt", b"hi", None)])
def test_file_type(spark, path, content, want):
    assert one(spark, t.file_type(F.lit(path), F.lit(bytearray(content)))) == want


@pytest.mark.parametrize("counts,want", [([120, 80], "pdfplumber"), ([120, 79], "textract"), (None, "textract")])
def test_route(spark, counts, want):
    pages = None if counts is None else [(i, "", n) for i, n in enumerate(counts, 1)]
    row = spark.createDataFrame([("pdf", pages)], f"kind string, pages {extract.PAGES}")
    assert row.select(extract.route(F.col("kind"), F.col("pages")).alias("x")).first().x == want


def test_folding_follows_decomposition(spark):
    letters = "".join(c for c in map(chr, range(0xC0, 0x180)) if unicodedata.normalize("NFKD", c)[0].isascii())
    want = "".join(unicodedata.normalize("NFKD", c)[0] for c in letters)
    assert one(spark, t.ascii_folded(F.lit(letters))) == want


def test_cosine(spark):
    assert one(spark, t.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))) == pytest.approx(1)
    assert one(spark, t.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
