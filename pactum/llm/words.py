"""Words of UTF-8 texts as 64-bit hashes, found without a Python object per word.

A word is a maximal run of ``0-9``, ``a-z``, ``A-Z`` (lowered) and bytes from
0x80 up, which is the code-point class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z, as no UTF-8 byte of a non-ASCII character is below 0x80.
"""

from __future__ import annotations

import numpy as np

from pactum.llm.common import mix64, random64

#: The same class and rule as SQL text, for DuckDB and Spark.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LOWER[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LOWER[_b] = _b + 32
_VALUE = random64(256, 11)
_PLACE = random64(1 << 12, 23) | np.uint64(1)
_STEP = 1 << 18


def _coefficients(place: np.ndarray) -> np.ndarray:
    """A fixed odd number for each place in a word: from a table where words are short, else by the table's rule."""
    if not len(place) or place.max() < len(_PLACE):
        return _PLACE[place]
    return mix64((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(23)) | np.uint64(1)


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end).

    raw: the bytes of all texts; offsets: where each begins, and the end.
    """
    hashes, starts = [], []
    begins = offsets[:-1][np.diff(offsets) > 0]
    at, end = 0, len(raw)
    while at < end:
        to = min(at + _STEP, end)
        while to < end:  # not within a word
            gaps = np.flatnonzero(_LOWER[raw[at:to]] == 0)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(to + _STEP, end)
        low = _LOWER[raw[at:to]]
        isword = low != 0
        first = isword.copy()
        first[1:] &= ~isword[:-1]
        cut = begins[np.searchsorted(begins, at) : np.searchsorted(begins, to)] - at
        first[cut] |= isword[cut]
        kept = np.flatnonzero(isword)
        if len(kept):
            heads = np.flatnonzero(first[kept])
            lengths = np.diff(np.append(heads, len(kept)))
            place = np.arange(len(kept)) - np.repeat(heads, lengths)
            sums = np.add.reduceat(_VALUE[low[kept]] * _coefficients(place), heads)
            hashes.append(mix64(sums + lengths.astype(np.uint64)))
            starts.append(kept[heads] + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words, text ends disregarded: len(words) - n + 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    coefficients = random64(n, 101 + n + seed) | np.uint64(1)
    total = words[: len(words) - n + 1] * coefficients[0]
    for i in range(1, n):
        total = total + words[i : len(words) - n + 1 + i] * coefficients[i]
    return mix64(total)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5):
    """For each text its sorted distinct shingle hashes.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    words, bounds = hash_words(raw, offsets)
    every = grams(words, n)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield grams(words[a:b], int(b - a))
        else:
            yield words[:0]


def member(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array ``of``."""
    if not len(of) or not len(hashes):
        return np.zeros(len(hashes), bool)
    bits = np.zeros(1 << 16, bool)
    bits[(of >> np.uint64(48)).astype(np.int64)] = True
    out = bits[(hashes >> np.uint64(48)).astype(np.int64)]
    some = np.flatnonzero(out)
    slot = np.minimum(np.searchsorted(of, hashes[some]), len(of) - 1)
    out[some] = of[slot] == hashes[some]
    return out
