"""Token counts of sections by offset-mapped attribution.

Every whole document is encoded once. A token's bytes are known from its
vocabulary entry, so a running sum maps tokens to byte spans of the text, and
those to character spans. Sections are character spans of the text; both lists
are sorted, so a merge joins tokens with the sections that they touch, and a
token that touches several goes to one of them by a stated rule:

* ``first``   - the section that holds the token's first character;
* ``largest`` - the section that holds most of its characters, at ties the first.

Tokens that touch no section count under section -1, so a document's counts add
up to its tokens.

Cases: a null text is an empty one with one empty section; sections that lie
outside the text or are empty have no tokens, those with a null bound don't
count; where sections overlap, the later one begins where those before it end;
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm import bpe
from pactum.llm.common import sliced, table

RULES = ("first", "largest")
_COUNT = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long, doc_tokens long"


def byte_lengths(coder: bpe.Encoder) -> np.ndarray:
    """Bytes of each token id; byte-level entries have a character for each byte."""
    out = np.zeros(coder.size, np.int64)
    special = set(coder.special)
    for token, i in coder.library.get_vocab().items():
        out[i] = len(token.encode()) if token in special else len(token)
    return out


def lines(text: str) -> list[tuple[int, int]]:
    """Spans of a text's lines, each with the newline that ends it."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without their overlaps: each begins where those before it end, at the earliest."""
    out, end = [], 0
    for a, b in spans:
        a = max(a, end)
        end = max(a, b)
        out.append((a, end))
    return out


def token_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of these byte sizes; one that holds part of a character spans all of it."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():
        return starts, ends
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    number = np.cumsum(lead) - 1  # each byte's character
    return number[starts], number[ends - 1] + 1


def attributed(starts: np.ndarray, stops: np.ndarray, sections: list[tuple[int, int]], rule: str) -> np.ndarray:
    """Each token's section by the rule, -1 for none; sections sorted and apart."""
    n = len(sections)
    if not n:
        return np.full(len(starts), -1)
    a, b = np.array(sections, np.int64).T
    if (a[1:] < b[:-1]).any() or (b < a).any():
        raise ValueError("sections must be sorted and not overlap")
    low = np.searchsorted(b, starts, "right")  # the first section that ends after the token begins
    high = np.searchsorted(a, stops, "left") - 1  # the last one that begins before it ends
    if rule == "first":
        holder = np.searchsorted(a, starts, "right") - 1
        # Of sections that begin together only the last isn't empty.
        return np.where((holder >= 0) & (starts < b[np.maximum(holder, 0)]), holder, -1)
    out = np.where(low <= high, low, -1)
    for t in np.flatnonzero(high > low).tolist():
        own = range(int(low[t]), int(high[t]) + 1)
        out[t] = max(own, key=lambda s: (min(stops[t], b[s]) - max(starts[t], a[s]), -s))
    return out


def counts(docs: DataFrame, sections: DataFrame | None = None, rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """Tokens by section: doc_id, section (number in order, or -1), start, stop, n_tokens, n_crossing, doc_tokens.

    sections: (doc_id, start, stop) in characters; without it each line is one.
    n_crossing: those of its tokens that reach beyond it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or bpe.vocabulary_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with_spans = sections is not None
    if with_spans:
        spans = sections.filter("start is not null and stop is not null").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        texts = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_d"]), "left").select("doc_id", "text", "spans")

    def run(batches):
        import pyarrow as pa

        coder = bpe.encoder(path)
        sizes = byte_lengths(coder)
        for batch in sliced(batches):
            own = batch.column("text").fill_null("").to_pylist()
            given = batch.column("spans").to_pylist() if with_spans else None
            ids, offsets = coder.encode(own)
            columns: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(own):
                spans = lines(text) if given is None else apart([(s["start"], s["stop"]) for s in given[i] or ()])
                x, y = token_spans(text, sizes[ids[offsets[i] : offsets[i + 1]]])
                to = attributed(x, y, spans, rule)
                n = np.bincount(to + 1, minlength=len(spans) + 1)
                a, b = np.array(spans, np.int64).reshape(-1, 2).T
                known = to >= 0
                beyond = (x[known] < a[to[known]]) | (y[known] > b[to[known]])
                crossing = np.bincount(to[known][beyond] + 1, minlength=len(spans) + 1)
                skip = 0 if n[0] else 1  # -1 only where it has tokens
                k = len(spans) + 1 - skip
                columns[0].append(np.full(k, i))
                for c, values in zip(columns[1:], (np.arange(-1, len(spans))[skip:], np.append(-1, a)[skip:], np.append(-1, b)[skip:], n[skip:], crossing[skip:], np.full(k, len(to))), strict=True):
                    c.append(values)
            flat = [np.concatenate(c) for c in columns]
            names = [f.split()[0] for f in _COUNT.split(", ")]
            arrays = [batch.column("doc_id").take(pa.array(flat[0])), pa.array(flat[1].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in flat[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts.mapInArrow(run, _COUNT)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
