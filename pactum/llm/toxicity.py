"""Toxicity by compression distance.

Two zstandard dictionaries are trained. Both hold a dictionary of ordinary text;
before it, one holds a dictionary trained on the recurring vocabulary that toxic
texts have and ordinary ones lack, the other one trained on the converse. Every
window of a text is compressed with either, and the difference of lengths says
which explains it better. A text's score is a logistic function, fitted on
labelled texts that no dictionary has seen, of the share of windows beyond a
few thresholds, their mean and extreme difference and their number.

The dictionaries are raw content, so lengths depend on matches only and not on
entropy tables that would shift all windows of a language. Labels come from
training rows alone (see ``labelled``), at most ONES and ZEROS of them; scoring
reads every byte of every text.

Cases: null and empty texts have one empty window, whose lengths are equal;
equal texts have equal scores whatever their other columns; without rows of both
labels the score is the share of toxic training rows (0 without any); an empty
table gives no rows; columns of any name stay as they are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import free_name, own_columns, table
from pactum.llm.labelled import chance, every_fourth, logistic, sample, scored, verdicts

ONES, ZEROS = 2500, 7500
WINDOW, STEP = 64, 32
CUT = 0.5
GRAM = 5
_BITS = 22
_OWN, _BASE = 1024, 16384


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - GRAM + 1 + i] + np.uint64(1)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _vocabulary(texts: list[bytes], others: list[bytes], least: int = 3) -> list[bytes]:
    """For each text its words that recur in ``texts`` and hold a run of bytes that ``others`` lack."""
    seen, spread = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, np.int32)
    for t in others:
        seen[_grams(t)] = True
    for t in texts:
        spread[np.unique(_grams(t))] += 1
    found, count, elsewhere = [], Counter(), Counter()
    for t in texts:
        h, own, last = _grams(t), [], -1
        for at in np.flatnonzero(~seen[h] & (spread[h] >= least)).tolist():
            middle = at + GRAM // 2
            if t[middle : middle + 1].isspace():
                continue
            start, stop = t.rfind(b" ", 0, middle) + 1, t.find(b" ", middle)
            if start != last:
                own.append(t[start : len(t) if stop < 0 else stop].strip(b".,\n"))
                last = start
        found.append(own)
        count.update(set(own))
    for t in others:
        elsewhere.update({w.strip(b".,") for w in t.split()} & count.keys())
    kept = {w for w, n in count.items() if n >= 2 and n * len(others) > 10 * elsewhere[w] * len(texts)}
    joined = (b" ".join([b"", *(w for w in own if w in kept)]) for own in found)
    return [x for x in joined if len(x) >= 8]


def _dictionary(size: int, samples: list[bytes], **options) -> bytes:
    """A trained dictionary's bytes; of few samples, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(dictionary: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=4, target_length=16,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


def distances(text: bytes, toxic, ordinary) -> np.ndarray:
    """For each window, the bytes that the toxic dictionary saves against the ordinary one."""
    short, long = toxic.compress, ordinary.compress
    stops = range(0, max(1, len(text) - WINDOW + STEP), STEP)
    return np.array([len(long(text[i : i + WINDOW])) - len(short(text[i : i + WINDOW])) for i in stops], np.float64)


def features(d: np.ndarray) -> list[float]:
    return [d.mean(), (d >= 1).mean(), (d >= 3).mean(), (d >= 5).mean(), (d <= -1).mean(), (d <= -3).mean(), np.log(len(d)), d.max(), np.log1p((d >= 3).sum()), np.log1p((d >= 4).sum())]


def fit(texts: list[bytes], y: np.ndarray) -> dict:
    """Dictionaries from three quarters of the texts, calibration from the others."""
    share = float(y.mean()) if len(y) else 0.0
    later = every_fourth(y)
    toxic, ordinary = ([t for t, v, c in zip(texts, y, later, strict=True) if v == k and not c] for k in (1, 0))
    if min(len(toxic), len(ordinary), int(y[later].sum()), int((1 - y[later]).sum())) < 5:
        return {"share": share}
    base = _dictionary(_BASE, [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)], k=64, d=8)
    own = [_dictionary(_OWN, _vocabulary(a, b), k=32, d=6) for a, b in ((toxic, ordinary), (ordinary, toxic))]
    size = max(map(len, own))  # of equal length, so that matches in the common part cost the same
    model = {"toxic": own[0].rjust(size, b"\n") + base, "ordinary": own[1].rjust(size, b"\n") + base}
    pair = compressor(model["toxic"]), compressor(model["ordinary"])
    x = np.array([features(distances(t, *pair)) for t, c in zip(texts, later, strict=True) if c])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    return model | {"mean": mean, "spread": spread, "weights": logistic((x - mean) / spread, y[later])}


def scorer(model: dict):
    def make():
        if "weights" not in model:
            return lambda text: model["share"]
        pair = compressor(model["toxic"]), compressor(model["ordinary"])
        mean, spread, weights = model["mean"], model["spread"], model["weights"]
        return lambda text: chance(((np.array(features(distances(text, *pair))) - mean) / spread) @ weights[:-1] + weights[-1])

    return make


def train(docs: DataFrame, labels: DataFrame, ones: int = ONES, zeros: int = ZEROS) -> dict:
    return fit(*sample(docs, labels, "toxic", ones, zeros))


def keep(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is below the cut."""
    score = free_name(docs.columns, "toxicity")
    return scored(docs, scorer(model), score).filter(F.col(score) < cut).select(*own_columns(docs))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return verdicts(docs, scorer(train(docs, labels)), CUT)
