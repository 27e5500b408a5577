"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line, a group of lines that a family's name is wrapped over, or
a run of lines between lines without words, in sliding windows where it is long.
A multinomial logistic regression over sparse hashed word 1- to 3-grams tells
licence families from an ``unknown`` class. It is trained on notices made from the
families' names and usual phrases, on the licences' own paragraphs and headers and
excerpts of them, and on a bounded sample of the corpus's own paragraphs as
unknown ones. A temperature, fitted on notices
and paragraphs that training has not seen, calibrates its chances; below the cut
a paragraph is unknown. A family found is confirmed where the paragraph holds
most word pairs of one of the family's templates: its names and paragraphs. Of
overlapping paragraphs of one family, one row stays: a confirmed one, else the
narrowest; ``paragraph`` is the number of its first line.

A paragraph without any n-gram of a notice gets only weights of unknown
paragraphs, so it is unknown; that is decided for all by array operations, and
chances are computed for the others alone.

Cases: null and empty texts have no licence paragraph; repeated rows count each;
an empty table gives no rows (and a model that knows notices alone); other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import ranges, sliced, table, utf8
from pactum.llm.licence_texts import TEXTS
from pactum.llm.words import grams, hash_words, member

CUT = 0.5
CONFIRM = 0.75
SAMPLE_DOCS = 600
SAMPLE_LINES = 2000
LONGEST_SAMPLE_TEXT = 64 << 10
#: Words of a window, and between the starts of two. Templates are compared with a step more on either side.
WINDOW, STEP = 128, 64
EXCERPT = 24

#: Names of licence families, as notices write them. Fixed values.
FAMILIES = {
    "Apache": ["Apache License", "Apache Software License"],
    "MIT": ["MIT License", "Expat License"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "MPL": ["Mozilla Public License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "EPL": ["Eclipse Public License"],
    "CC-BY": ["CC BY", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC", "Creative Commons Attribution-NonCommercial License"],
    "CC0": ["CC0 Public Domain Dedication"],
    "Unlicense": ["The Unlicense"],
    "Proprietary": ["proprietary license. All rights reserved", "commercial license agreement. All rights reserved", "All rights reserved"],
}
_FRAMES = [
    "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "Published under {}", "Provided under {}",
    "This work is licensed under the {}", "This work is licensed under {}", "This file is part of a work under the {}", "This software is released under the terms of the {}",
    "Redistribution is permitted under the {}", "Use of this source is governed by the {}", "Permission is granted under the {}", "See the {} for details", "Subject to the {}", "License: {}",
]
_VERSIONS = ["", " 1.0", " 2.0", " 3.0", " 4.0", ", Version 2.0", ", version 2", ", version 3", " or later", " International"]
UNKNOWN = "unknown"


def notices() -> tuple[list[str], list[int]]:
    """Made notices and their families' numbers from 1; 0 is unknown."""
    texts, numbers = [], []
    for number, names in enumerate(FAMILIES.values(), 1):
        for name in names:
            for frame in _FRAMES:
                for version in _VERSIONS:
                    texts.append(frame.format(name + version) + ".")
                    numbers.append(number)
    for number, family in enumerate(FAMILIES, 1):
        for text in TEXTS.get(family, []):
            words = text.split()
            parts = [text] + [" ".join(words[i : i + EXCERPT]) for i in range(0, len(words) - EXCERPT // 2, 4) if len(words) > EXCERPT]
            texts += parts
            numbers += [number] * len(parts)
    return texts, numbers


def _encoded(texts: list[str]):
    import pyarrow as pa

    return hash_words(*utf8(pa.array(texts, pa.large_string())))


def features(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit n-gram hashes of all paragraphs, each one's paragraph), not sorted."""
    numbers, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for n in (1, 2, 3):
        g = grams(words, n, 7)
        if len(g):
            whole = owner[: len(g)] == owner[n - 1 :]
            numbers.append(g[whole])
            owners.append(owner[: len(g)][whole])
    return np.concatenate(numbers), np.concatenate(owners)


def _logits(model: dict, numbers: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
    """Scores of each row: its n-grams' weights over the root of their number, and the intercept; new n-grams weigh 0."""
    count = np.bincount(owners, minlength=rows)
    seen = member(numbers, model["used"])
    numbers, owners = numbers[seen], owners[seen]
    order = np.argsort(owners, kind="stable")
    values = model["weights"][np.searchsorted(model["used"], numbers[order])]
    return _summed(values, np.bincount(owners, minlength=rows)) / np.sqrt(np.maximum(count, 1))[:, None] + model["weights"][-1]


def _summed(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, count of them each."""
    out = np.zeros((len(count), values.shape[1]), values.dtype)
    full = np.flatnonzero(count)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(count) - count)[full], axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(unknown: list[str], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-6) -> dict:
    """Model from made notices and unknown paragraphs; a quarter of both calibrates."""
    texts, y = notices()
    templates = _templates()
    every = [t for own in templates.values() for t in own]
    unknown = unknown + [" ".join(unknown[i : i + 4]) for i in range(0, len(unknown), 4)]  # lines, and runs of lines
    unknown = [t for t in unknown if t.strip() and _similarity(t, every) < CONFIRM]
    texts, y = texts + unknown, np.array(y + [0] * len(unknown))
    order = np.random.default_rng(3).permutation(len(texts))
    later = np.zeros(len(texts), bool)
    later[order[: len(texts) // 4]] = True
    numbers, owners = features(*_encoded(texts))
    known = np.unique(numbers[y[owners] > 0])
    # A dense space of the n-grams that occur; the last row is the intercept.
    used, small = np.unique(numbers, return_inverse=True)
    k = len(FAMILIES) + 1
    w = np.zeros((len(used) + 1, k), np.float32)
    own = ~later
    rows = np.flatnonzero(own)
    place = np.full(len(texts), -1)
    place[rows] = np.arange(len(rows))
    kept = own[owners]
    f, o = small[kept], place[owners[kept]]
    order = np.argsort(o, kind="stable")
    f, o = f[order], o[order]
    count = np.bincount(o, minlength=len(rows))
    scale = (1 / np.sqrt(np.maximum(count, 1))).astype(np.float32)[:, None]
    target = np.eye(k)[y[rows]]
    balance = (1 / np.maximum(np.bincount(y[rows], minlength=k), 1))[y[rows]]
    balance = np.where(y[rows] == 0, (k - 1) * balance, balance)  # unknown paragraphs weigh as much as all families
    balance = balance / balance.sum()
    order = np.argsort(f, kind="stable")
    f_sorted, o_sorted = f[order], o[order]
    heads = np.flatnonzero(np.diff(f_sorted, prepend=-1))
    square = np.full(w.shape, 1e-8, np.float32)
    for _ in range(rounds):
        p = _softmax(_summed(w[f], count) * scale + w[-1])
        error = ((p - target) * balance[:, None]).astype(np.float32)
        gradient = ridge * w
        gradient[f_sorted[heads]] += np.add.reduceat((error * scale)[o_sorted], heads, axis=0)
        gradient[-1] += error.sum(axis=0)
        square += gradient**2
        w -= rate * gradient / np.sqrt(square)
    model = {"used": used, "known": known, "weights": w, "temperature": 1.0}
    tested = np.flatnonzero(later)
    place[:] = -1
    place[tested] = np.arange(len(tested))
    kept = later[owners]
    z = _logits(model, numbers[kept], place[owners[kept]], len(tested))
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(tested)), y[tested]] + 1e-12).mean()
    return model | {"temperature": float(min(np.geomspace(0.5, 5, 40), key=loss))}


def _pairs(text: str) -> set:
    return _word_pairs(_encoded([text])[0])


def _word_pairs(words: np.ndarray) -> set:
    return set(grams(words, 2, 13).tolist()) if len(words) > 1 else set(words.tolist())


def _templates() -> dict[str, list[set]]:
    return {f: [_pairs(n) for n in [*names, *TEXTS.get(f, [])]] for f, names in FAMILIES.items()}


def _similarity(text: str, templates: list[set]) -> float:
    """The greatest share of a template's word pairs that the text holds."""
    return _nearest(_pairs(text), templates)


def _nearest(own: set, templates: list[set]) -> float:
    return max(len(own & t) / len(t) for t in templates)


def unknown_sample(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_lines: int = SAMPLE_LINES) -> list[str]:
    """At most n_lines lines of the n_docs documents of least id hash, of repeated ids the least text: the bound holds whatever the corpus."""
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(n_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= LONGEST_SAMPLE_TEXT)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "doc_id"])
    return [line for t in rows["text"] for line in t.split("\n") if line.strip()][:n_lines]


def _wrapped(words: np.ndarray, bounds: np.ndarray, doc: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of neighbouring lines over whose ends a name's word pair goes, at most a step before and after those ends."""
    ends = bounds[1:-1]
    cross = np.flatnonzero((np.diff(bounds)[:-1] > 0) & (np.diff(bounds)[1:] > 0) & (doc[:-1] == doc[1:]))
    pairs = grams(words, 2, 13)
    cross = cross[member(pairs[ends[cross] - 1], names)] if len(cross) else cross
    if not len(cross):
        return cross, cross
    heads = np.flatnonzero(np.diff(cross, prepend=-2) > 1)
    first, last = cross[heads], cross[np.append(heads[1:], len(cross)) - 1]
    return np.maximum(bounds[first], ends[first] - STEP), np.minimum(bounds[last + 2], ends[last] + STEP)


def _windows(bounds: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of the windows of all runs of lines with words, and of their runs; runs of one short line are none."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    new = np.ones(len(full), bool)
    new[1:] = (np.diff(full) > 1) | (doc[full[1:]] != doc[full[:-1]])
    heads = np.flatnonzero(new)
    stops = np.append(heads[1:], len(full))
    low, high = bounds[full[heads]], bounds[full[stops - 1] + 1]
    kept = (stops - heads > 1) | (high - low > WINDOW)
    low, high = low[kept], high[kept]
    n = np.maximum(-(-(high - low - WINDOW) // STEP), 0) + 1
    run = np.repeat(np.arange(len(low)), n)
    starts = low[run] + STEP * ranges(np.zeros(len(n), np.int64), n)
    return starts, np.minimum(starts + WINDOW, high[run]), low[run], high[run]


def scan(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """A row for each licence paragraph: doc_id, paragraph (its first line from 0), family, probability, similarity, confirmed."""
    names = [UNKNOWN, *FAMILIES]

    def told(words, bounds):
        """(paragraph, family, chance) of those that are no unknown ones."""
        numbers, owners = features(words, bounds)
        some = np.unique(owners[member(numbers, model["known"])])
        if not len(some):
            return []
        kept = np.isin(owners, some)
        p = _softmax(_logits(model, numbers[kept], np.searchsorted(some, owners[kept]), len(some)) / model["temperature"])
        best = p[:, 1:].argmax(axis=1) + 1
        return [(int(some[i]), names[best[i]], float(p[i, best[i]])) for i in np.flatnonzero(p[np.arange(len(some)), best] >= cut).tolist()]

    def run(batches):
        import pyarrow as pa

        templates = _templates()
        pairs = np.unique(np.array([h for own in FAMILIES.values() for n in own for h in _pairs(n)], np.uint64))
        for batch in sliced(batches, size=2 << 20):
            texts = batch.column("text").fill_null("").to_pylist()
            every = [t.split("\n") for t in texts]
            words, bounds = _encoded([line for lines in every for line in lines])
            if not len(words):
                continue
            starts = np.cumsum([0] + [len(x) for x in every])
            doc = np.repeat(np.arange(len(every)), np.diff(starts))
            # Word ranges from narrow to wide: lines, wrapped names, windows; and those to compare with templates.
            a, b = _wrapped(words, bounds, doc, pairs)
            c, d, low, high = _windows(bounds, doc)
            levels = [(bounds[:-1], bounds[1:], bounds[:-1], bounds[1:]), (a, b, a, b), (c, d, np.maximum(c - STEP, low), np.minimum(d + STEP, high))]
            rows: dict = {}
            for level, (first, stop, left, right) in enumerate(levels):
                sizes = stop - first
                chosen = words if not level else words[ranges(first, sizes)]
                for i, family, chance in told(chosen, bounds if not level else np.append(0, np.cumsum(sizes))):
                    x, y = int(first[i]), int(stop[i])
                    line = int(np.searchsorted(bounds, x, "right")) - 1
                    close = _nearest(_word_pairs(words[left[i] : right[i]]), templates[family])
                    own = rows.setdefault((int(doc[line]), family), [])
                    inner = [r for r in own if r[0] < y and x < r[1]] if level else []
                    if any(r[4] >= CONFIRM for r in inner) or inner and close < CONFIRM:
                        continue
                    own[:] = [r for r in own if r not in inner] + [(x, y, line, chance, close)]
            found = sorted((line, d, family, chance, close) for (d, family), own in rows.items() for _, _, line, chance, close in own)
            if found:
                lines, owner, family, chance, close = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(owner)), "paragraph": pa.array([i - int(starts[d]) for i, d in zip(lines, owner, strict=True)], pa.int32()),
                    "family": list(family), "probability": list(chance), "similarity": list(close), "confirmed": [s >= CONFIRM for s in close],
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(unknown_sample(docs)))
