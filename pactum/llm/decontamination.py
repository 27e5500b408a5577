"""Benchmark decontamination by winnowing.

Of every 6 consecutive 5-word grams the one of least hash is kept (all of them
at ties), in benchmark items and documents alike, so a shared span of 10 words
or more always shares a kept gram. Kept grams of a document that an item keeps
too are extended: each 10-word window around them is looked up among the
windows of the items. An item of fewer words, but not none, is one window; such
windows are too short for the guarantee and are looked up at every position.

Hashes have 64 bits. The items' index is built on executors in blocks of a set
number of bytes and stored in the shared folder; a task holds one block at a
time, so neither driver nor task memory grows with the benchmark. With one block,
tasks look their grams up in it. With several, the fingerprints of texts that a
bitmap lets through are joined with those of the blocks by a shuffle, and only
the pairs of text and block that meet there are extended, block by block, so no
block is read but for its hits; equal texts are joined once.

Cases: a null text has no words; null item_ids make hits but are not listed;
repeated item rows count once; documents keep one result a row, whatever their
doc_id; an empty benchmark leaves all documents clean. Other columns stay as they
are; ``contaminated`` puts those called like its results under free names.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import bounded, fields, filesystem, free_name, materialize, own_columns, ranges, set_aside, shared_dir, sliced, table, utf8
from pactum.llm.words import WORD_PATTERN, grams, hash_words, member

SPAN = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
FOUND = ("n_words", "n_hit", "items")


def kept(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some window of consecutive ones."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for i in range(1, window):
        np.minimum(least, hashes[i : n + i], out=least)
    chosen = np.zeros(len(hashes), bool)
    for i in range(window):
        chosen[i : n + i] |= hashes[i : n + i] == least
    return np.flatnonzero(chosen)


def _inside(starts: np.ndarray, size: int, bounds: np.ndarray) -> np.ndarray:
    """Of the runs of ``size`` words at starts, those within one text."""
    return starts[starts + size <= bounds[np.searchsorted(bounds, starts, "right")]] if len(starts) else starts


def _index(texts: list, ids: list, span: int, gram: int) -> bytes:
    """Kept grams and windows of some items as one npz."""
    import pyarrow as pa

    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    words, bounds = hash_words(raw, offsets)
    sizes = np.diff(bounds)
    names = sorted({x for x in ids if x is not None})
    number = {x: i for i, x in enumerate(names)} | {None: -1}
    label = np.array([number[x] for x in ids], np.int64)
    out = {"names": np.array(names, dtype=str), "shorts": np.unique(sizes[(sizes > 0) & (sizes < span)])}
    every = grams(words, gram)
    prints = [np.zeros(0, np.uint64)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= span:
            own = every[a : b - gram + 1]
            prints.append(own[kept(own, span - gram + 1)])
    out["prints"] = np.unique(np.concatenate(prints))
    for size in [span, *out["shorts"].tolist()]:
        chosen = np.flatnonzero(sizes >= span if size == span else sizes == size)
        per = sizes[chosen] - size + 1
        at = ranges(bounds[chosen], per)
        hashes = grams(words, size)[at] if len(at) else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([hashes, np.repeat(label[chosen], per).astype(np.uint64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
        out[f"windows{size}"], out[f"items{size}"] = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
    buffer = io.BytesIO()
    np.savez(buffer, **out)
    return buffer.getvalue()


def index(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Names of the index blocks, each below block_bytes of item text or one item."""
    spark, folder = benchmark.sparkSession, shared_dir(benchmark.sparkSession, "winnow")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def build(batches):
        import pyarrow as pa

        ids, texts, n = [], [], 0
        task = TaskContext.get()

        def store():
            fs, path = filesystem(folder)
            fs.create_dir(path, recursive=True)
            name = f"{path}/block-{task.partitionId()}-{n}"
            with fs.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(_index(texts, ids, span, gram))
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            return pa.RecordBatch.from_pydict({"block": [f"{folder}/block-{task.partitionId()}-{n}"]})

        size = 0
        for batch in batches:
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= block_bytes:
                    yield store()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield store()

    made = materialize(items.repartition(blocks, F.xxhash64("item_id", "text")).mapInArrow(build, "block string"), "winnow-blocks")
    return sorted(r.block for r in made.collect())


def _load(name: str, kept_blocks: dict = {}) -> dict:  # noqa: B006  the last block stays in the worker
    if name not in kept_blocks:
        kept_blocks.clear()
        fs, path = filesystem(name)
        with fs.open_input_file(path) as source:
            kept_blocks[name] = dict(np.load(io.BytesIO(source.read())))
    return kept_blocks[name]


def scan(raw, offsets, blocks: list[str], span: int = SPAN, gram: int = GRAM):
    """(words, hit words, item names) of each text, and the words' hit flags with their bounds."""
    words, bounds = hash_words(raw, offsets)
    hit = np.zeros(len(words) + 1, np.int64)
    found: dict[int, set] = {}
    full = grams(words, span)
    every = grams(words, gram)
    window = span - gram + 1
    prints = kept(every, window)  # windows over text ends only add grams, which are then looked up in vain
    for name in blocks:
        part = _load(name)
        at = prints[member(every[prints], part["prints"])]
        starts = np.unique((at[:, None] - np.arange(window)[None, :]).ravel())
        looked = [(span, _inside(starts[(starts >= 0) & (starts < len(full))], span, bounds), full)]
        for size in part["shorts"].tolist():
            short = grams(words, size)
            looked.append((size, _inside(np.arange(len(short)), size, bounds), short))
        for size, starts, hashes in looked:
            windows = part[f"windows{size}"]
            starts = starts[member(hashes[starts], windows)] if len(starts) else starts
            if not len(starts):
                continue
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + size, -1)
            owner = np.searchsorted(bounds, starts, "right") - 1
            low, high = np.searchsorted(windows, hashes[starts]), np.searchsorted(windows, hashes[starts], "right")
            items = part[f"items{size}"]
            pairs = {(o, a, b) for o, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True)}
            for o, a, b in pairs:
                found.setdefault(o, set()).update(str(part["names"][i]) for i in items[a:b].tolist() if i >= 0)
    flags = np.cumsum(hit)[:-1] > 0
    sums = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(bounds), np.diff(sums[bounds]), found, flags, bounds


def _bitmap(fingerprints: DataFrame, folder: str) -> str:
    """A file of bits, one set for each fingerprint's leading bits: about 16 a fingerprint, 256 MB at most."""
    bits = int(min(31, max(16, np.ceil(np.log2(max(1, fingerprints.count()))) + 4)))

    def build(batches):
        import pyarrow as pa

        seen = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = (batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"bits.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(seen.tobytes())
        yield pa.RecordBatch.from_pydict({"name": [f"{folder}/{name}"]})

    return materialize(fingerprints.select("hash").coalesce(1).mapInArrow(build, "name string"), "bitmap").first()["name"]


def _passing(name: str, kept_bits: dict = {}):  # noqa: B006  the bits stay in the worker
    if name not in kept_bits:
        kept_bits.clear()
        fs, path = filesystem(name)
        with fs.open_input_file(path) as source:
            kept_bits[name] = np.frombuffer(source.read(), np.uint8)
    seen = kept_bits[name]
    shift = np.uint64(64 - (len(seen).bit_length() + 2))

    def passing(hashes):
        at = (hashes >> shift).astype(np.int64)
        return (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return passing


def _joined(docs: DataFrame, blocks: list[str], span: int, gram: int, names: tuple[str, str, str]) -> DataFrame:
    """The results by a join of fingerprints, for an index of several blocks."""
    spark = docs.sparkSession
    window = span - gram + 1
    key = free_name([*docs.columns, *names], "text_key")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for number in batch.column("block").to_pylist():
                part = _load(blocks[number])
                found = [(span, part["prints"]), *((n, np.unique(part[f"windows{n}"])) for n in part["shorts"].tolist())]
                for size, hashes in found:
                    for at in range(0, len(hashes), 100_000):
                        own = hashes[at : at + 100_000].view(np.int64)
                        yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(own), size), pa.int32()), "hash": own, "block": pa.array(np.full(len(own), number), pa.int32())})

    numbers = spark.range(len(blocks)).select(F.col("id").cast("int").alias("block")).repartition(len(blocks), "block")
    fingerprints = materialize(numbers.mapInArrow(listed, "size int, hash long, block int"), "fingerprints")
    shorts = sorted(r["size"] for r in fingerprints.select("size").distinct().collect() if r["size"] != span)
    bits = _bitmap(fingerprints, shared_dir(spark, "winnow-bits"))
    keyed = docs.select(F.md5(text.cast("binary")).alias("key"), text.alias("text"))

    def printed(batches):
        import pyarrow as pa

        passing = _passing(bits)
        for batch in sliced(batches, size=2 << 20):
            words, bounds = hash_words(*utf8(batch.column("text")))
            every = grams(words, gram)
            at = kept(every, window)
            found = [(span, at, every[at]), *((n, _inside(np.arange(max(0, len(words) - n + 1)), n, bounds), grams(words, n)) for n in shorts)]
            for size, starts, hashes in found:
                hashes = hashes if size == span else hashes[starts]
                some = passing(hashes)
                owner = np.searchsorted(bounds, starts[some], "right") - 1
                rows = np.unique(np.stack([owner.astype(np.uint64), hashes[some]], 1), axis=0)
                if len(rows):
                    yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(rows[:, 0].astype(np.int64))), "size": pa.array(np.full(len(rows), size), pa.int32()), "hash": rows[:, 1].copy().view(np.int64)})

    met = keyed.mapInArrow(printed, "key string, size int, hash long").distinct().join(fingerprints, ["size", "hash"])
    pairs = materialize(met.select("key", "block").distinct(), "winnow-pairs")
    hit = materialize(pairs.select("key").distinct(), "winnow-keys")
    texts = keyed.join(bounded(hit), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    dealt = texts.join(pairs, "key").repartitionByRange("block", "key").sortWithinPartitions("block")

    def extended(batches):
        import pyarrow as pa

        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in sliced(batches, size=2 << 20):
            block = batch.column("block").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                _, _, found, flags, bounds = scan(*utf8(part.column("text")), [blocks[int(block[a])]], span, gram)
                runs = []
                for i in range(part.num_rows):
                    own = np.concatenate([[0], flags[bounds[i] : bounds[i + 1]].astype(np.int8), [0]])
                    change = np.diff(own)
                    runs.append([{"start": x, "stop": y} for x, y in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)])
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "runs": pa.array(runs, run), "items": pa.array([sorted(found.get(i, ())) for i in range(part.num_rows)], pa.list_(pa.string()))})

    every = dealt.mapInArrow(extended, "key string, runs array<struct<start:long,stop:long>>, items array<string>")
    runs = F.array_sort(F.flatten(F.collect_list("runs")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop"))
    add = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(r["start"], s["stop"]))).alias("n"), F.greatest(s["stop"], r["stop"]).alias("stop"))
    found = every.groupBy("key").agg(runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = materialize(found.select("key", F.aggregate("runs", start, add)["n"].alias("n"), "items"), "winnow-hits")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = docs.withColumn(names[0], F.regexp_count(lowered, F.lit(WORD_PATTERN)).cast("long")).withColumn(key, F.md5(text.cast("binary")))
    hits = found.select(F.col("key").alias(key), F.col("n").alias(names[1]), F.col("items").alias(names[2]))
    none = F.array().cast("array<string>")
    out = whole.join(bounded(hits, 50_000), key, "left").withColumns({names[1]: F.coalesce(F.col(names[1]), F.lit(0).cast("long")), names[2]: F.coalesce(F.col(names[2]), none)})
    return out.select(*own_columns(docs), *names)


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit and items (ids as strings, sorted), one row for each of docs."""
    return _marked(set_aside(docs, FOUND), benchmark, span, gram, block_bytes, FOUND)


def _marked(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, block_bytes: int, names: tuple[str, str, str]) -> DataFrame:
    """docs with the three results under these names."""
    blocks = index(benchmark, span, gram, block_bytes)
    if len(blocks) > 1:
        return _joined(docs, blocks, span, gram, names)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, size=2 << 20):
            raw, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            n, hits, found, _, _ = scan(raw, offsets, blocks, span, gram)
            items = pa.array([sorted(found.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(hits), items], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{fields(docs)}, `{names[0]}` long, `{names[1]}` long, `{names[2]}` array<string>")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with an item, with their own columns."""
    names = tuple(free_name(docs.columns, n) for n in FOUND)
    return _marked(docs, benchmark, SPAN, GRAM, BLOCK_BYTES, names).filter(F.col(names[1]) == 0).select(*own_columns(docs))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH item AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
item_window AS (
    SELECT item_id, least(len(w), {SPAN}) AS size, list_slice(w, i, i + least(len(w), {SPAN}) - 1) AS words
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN}, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
    SELECT r, i, size, list_slice(w, i, i + size - 1) AS words
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)),
hit AS (SELECT d.r, d.i, d.size, t.item_id FROM doc_window d JOIN item_window t ON d.size = t.size AND d.words = t.words),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
