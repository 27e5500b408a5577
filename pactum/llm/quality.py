"""Quality by naive Bayes support vectors.

A text's features are indicators of hashed n-grams in two views of it: runs of
2 to 4 bytes, and runs of 1 to 3 word shapes (case, digits, marks, whether the
word repeats one of the few before it, whether its line occurred before). Each
indicator is scaled by the log ratio of its smoothed frequencies in the two
classes, and dual coordinate descent fits a linear hinge-loss model on the
scaled indicators. A logistic function of the margin, fitted on labelled texts
that the model has not seen, is the score.

Labels come from training rows alone (see ``labelled``), at most ONES and ZEROS
of them; scoring reads every byte of every text.

Cases: null and empty texts have no feature and get the intercept's score; equal
texts have equal scores whatever their other columns; without rows of both
labels the score is the share of good training rows (1 without any); an empty
table gives no rows; columns of any name stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import free_name, own_columns, random64, table
from pactum.llm.labelled import chance, every_fourth, logistic, sample, scored, verdicts

ONES, ZEROS = 3000, 3000
CUT = 0.3
BITS = 19
_PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, np.uint8) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = _LOWER[128:] = 1
_DIGIT[48:58] = 1
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = 1
_KIND = (_UPPER * 1 + _LOWER * 2 + _DIGIT * 4 + _MARK * 8).astype(np.uint8)
_VALUE = random64(256, 53)
_PLACE = random64(256, 59) | np.uint64(1)


def _hash(x: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashed n-grams of a sequence of small numbers."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(x) - n + 1, salt, np.uint64)
    for i in range(n):
        h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


def shapes(text: bytes) -> np.ndarray:
    """A small number for each word: kinds of characters, repetition nearby, whether its line is a repeated one."""
    a = np.frombuffer(text, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    kept = np.flatnonzero(word)
    heads = np.concatenate([[0], np.cumsum(stops - starts)[:-1]])
    kind = np.bitwise_or.reduceat(_KIND[a[kept]], heads).astype(np.uint64)
    place = (np.arange(len(kept)) - np.repeat(heads, stops - starts)) & 255
    name = np.add.reduceat(_VALUE[a[kept]] * _PLACE[place], heads)
    again = np.zeros(len(name), np.uint64)
    again[1:] += name[1:] == name[:-1]
    near = np.zeros(len(name), bool)
    for i in range(2, 9):
        near[i:] |= name[i:] == name[:-i]
    again[(again == 0) & near] = 2
    # A line is known by the sum of its words' hashes by place.
    line = np.cumsum(np.diff(np.searchsorted(np.flatnonzero(a == 10), starts), prepend=-1) > 0) - 1
    line = np.maximum(line, 0)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    order = (np.arange(len(name)) - first[line]) & 255
    whole = np.add.reduceat(name * _PLACE[order], first)
    _, at = np.unique(whole, return_index=True)
    repeated = np.ones(len(whole), np.uint64)
    repeated[at] = 0
    return kind + np.uint64(16) * again + np.uint64(64) * repeated[line]


def indicators(text: bytes) -> np.ndarray:
    """The distinct feature numbers of a text."""
    seen = np.zeros(1 << BITS, bool)
    a = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(a) - 1), _PIECE):  # overlapping by the longest run less one
        piece = a[at : at + _PIECE + 3].astype(np.uint64)
        for n in (2, 3, 4):
            seen[_hash(piece, n, n)] = True
    s = shapes(text)
    for n in (1, 2, 3):
        seen[_hash(s, n, 100 + n)] = True
    return np.flatnonzero(seen)


def margin(text: bytes, weights: np.ndarray) -> float:
    return float(weights[indicators(text)].sum())


def descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over scaled indicators by dual coordinate descent; the intercept is a constant feature."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(scale)), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    square = np.array([1 + (scale[r] ** 2).sum() for r in rows])
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            slope = sign[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * x
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-6 * c:
            break
    return w, bias


def fit(texts: list[bytes], y: np.ndarray, c: float = 0.01) -> dict:
    """Model from three quarters of the texts, calibration from the others."""
    later = every_fourth(y)
    if min(int(y.sum()), int((1 - y).sum()), int(y[later].sum()), int((1 - y[later]).sum())) < 5:
        return {"share": float(y.mean()) if len(y) else 1.0}
    rows = [indicators(t).astype(np.int32) for t in texts]
    own, good = [r for r, l in zip(rows, later, strict=True) if not l], y[~later]
    counts = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for r, v in zip(own, good, strict=True):
        counts[int(v)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = descent(own, good, ratio, c)
    weights = (w * ratio).astype(np.float32)
    z = np.array([weights[r].sum() + bias for r, l in zip(rows, later, strict=True) if l])
    spread = float(np.abs(z).mean()) or 1.0
    return {"weights": weights, "bias": bias, "spread": spread, "line": logistic(z[:, None] / spread, y[later])}


def scorer(model: dict):
    def make():
        if "weights" not in model:
            return lambda text: model["share"]
        weights, bias, spread, (a, b) = model["weights"], model["bias"], model["spread"], model["line"]
        return lambda text: chance(a * (margin(text, weights) + bias) / spread + b)

    return make


def train(docs: DataFrame, labels: DataFrame, ones: int = ONES, zeros: int = ZEROS) -> dict:
    return fit(*sample(docs, labels, "quality", ones, zeros))


def keep(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score reaches the cut."""
    score = free_name(docs.columns, "quality")
    return scored(docs, scorer(model), score).filter(F.col(score) >= cut).select(*own_columns(docs))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return verdicts(docs, scorer(train(docs, labels)), CUT)
