"""Word hashing and BPE against plain Python."""

import random
import re

import numpy as np
import pytest

from pactum.llm import bpe
from pactum.llm.common import sliced, utf8, whole_groups
from pactum.llm.words import WORD_PATTERN, grams, hash_words, shingle_sets


def words_of(text):
    return re.findall(WORD_PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def random_text(rng, n=60):
    return "".join(rng.choice("abAB19 .,\n'é中ß-_`{") for _ in range(rng.randint(0, n)))


def column(texts):
    import pyarrow as pa

    return utf8(pa.array(texts, pa.string()))


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(3000)] + ["", None, "a" * 9000, "x", "É"]
    hashes, bounds = hash_words(*column(texts))
    names, back = {}, {}
    at = 0
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        own = words_of(t)
        assert b - a == len(own) and a == at
        at = b
        for w, h in zip(own, hashes[a:b].tolist(), strict=True):
            assert names.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_words_across_steps_of_the_scan(monkeypatch):
    from pactum.llm import words

    text = " ".join(f"w{i}" for i in range(5000))
    whole = hash_words(*column([text, "tail"]))
    monkeypatch.setattr(words, "_STEP", 64)
    parts = hash_words(*column([text, "tail"]))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_grams_and_shingles():
    h, _ = hash_words(*column(["a b c d e f a b c d e"]))
    g = grams(h, 5)
    assert g[0] == g[6] and len(set(g.tolist())) == 6
    sets = list(shingle_sets(*column(["a b c d e f a b c d e", "a b", "", None, "a  B"])))
    assert [len(s) for s in sets] == [6, 1, 0, 0, 1] and sets[1] == sets[4]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary_path())


def test_ids_are_the_librarys(encoder):
    rng = random.Random(2)
    alphabet = "ab sT'redlvm.  \n\t1é9-'' x 中½ ß\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += ["", " ", "\n\n", "don't we'll 'tis", "<|endoftext|>a", "  lead", "trail  ", "a\r\nb", "x" * 5000, "I've  'd"]
    for _ in range(2):  # with an empty and a full cache
        ids, offsets = encoder.encode(texts)
        want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def test_long_texts_are_cut_without_a_trace(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "_PASS", 200)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdé,.'1\n") for _ in range(rng.randint(1, 9))) for _ in range(900))
    ids, offsets = encoder.encode([text, "", "b"], end=2)
    assert ids.tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2, 2, *encoder.library.encode("b").ids, 2]
    assert len(offsets) == 4


def test_a_full_cache_is_dropped(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 5)
    for t in ("one two three four five six seven", "eight nine", "one nine"):
        ids, _ = encoder.encode([t])
        assert ids.tolist() == encoder.library.encode(t).ids


def test_batches_are_cut_and_groups_kept_whole():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 2, 2, 3], "text": ["a" * 50, None, "b", "c", "d" * 90, "e"]})
    parts = list(sliced([batch], rows=2, size=60))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    groups = [g.column("k").to_pylist()[i:j] for g, bounds in whole_groups([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3)], ["k"]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert groups == [[1, 1], [2, 2, 2], [3]]
    assert np.array_equal(utf8(batch.column("text"))[1][:3], [0, 50, 50])
