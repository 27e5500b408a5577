"""Near-duplicate join: a MinHash LSH forest, then exact Jaccard of word shingles.

Texts with equal sets of five-word shingles are one class of copies, and one
representative of each goes on. In each of TREES trees its signature is a path of
DEPTH symbols, minimum hashes. A tree's paths are kept as sorted tries: those that
agree in their first symbols, a node, are put together and sorted by the rest, so
that the common prefix of two paths gives the level at which they part. Matched
prefixes are shortened from the whole path symbol by symbol, each level adding
the pairs that part there, until the recall of pairs at the threshold, 1 - (1 -
threshold^length)^TREES, reaches the target. At 0.8 and 0.9999 that is after four
symbols; a pair above the threshold has still more. The stop does not depend on
the corpus around a pair, so small and large inputs lose equally little. A pair
under common nodes of several trees counts in the first of them.

A node of at most BLOCK members (and BLOCK_BYTES of shingles) is compared where it
stands. A larger one is dealt into blocks, each written once to the shared folder;
the task of a block reads the others of its node there, so what is shuffled grows
with the members and not with their pairs, a node of any size is spread over
tasks, every pair of it is compared and no pair becomes a row. Only members with
a pair get their shingle sets. What leaves a comparison is at most one row a
member: the weight of its exact matches and the least representative it is
linked with there. Components come from alternating large-star and small-star
steps over those links; the least neighbours of a step are broadcast while they
are few, else joined from a table, so that a hub's edges can be split.

Cases: a text of one to four words has one shingle (all its words); texts with
no word, null included, are copies of each other; a class goes by its least
doc_id, repeated ones included; a class without one gets a negative id that
depends on its shingles alone; each row of a repeated doc_id is a document of its
own; an empty table gives no rows; other columns are ignored by ``join`` and kept
by ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import BROADCAST_ROWS, bounded, fields, filesystem, materialize, mix64, own_columns, random64, shared_dir, sliced, table, utf8, whole_groups
from pactum.llm.words import shingle_sets

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9999
BLOCK = 256
BLOCK_BYTES = 16 << 20
#: Symbols of 16 bits that a path may have below its node.
_BELOW = 4


def levels(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """Prefix lengths from the whole path to the one at which pairs at the threshold reach the target recall."""
    out = [depth]
    while out[-1] > 1 and 1 - (1 - threshold ** out[-1]) ** trees < recall:
        out.append(out[-1] - 1)
    return out


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The prefix length at which shortening stops."""
    return levels(threshold, trees, depth, recall)[-1]


def signatures(sets: list[np.ndarray], trees: int, stop: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set and tree the node (a hash of ``stop`` minimum hashes) and the path below it, 16 bits a symbol."""
    depth = min(depth, stop + _BELOW)
    n, k = len(sets), trees * depth
    a, b = random64(k, 31) | np.uint64(1), random64(k, 37)
    least = np.empty((n, k), np.uint64)
    for i, s in enumerate(sets):
        if not len(s):
            least[i] = 0
            continue
        low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 512):
            x = s[at : at + 512]
            h = x[None, :] * a[:, None]
            h += b[:, None]
            np.minimum(low, h.min(axis=1), out=low)
        least[i] = low
    least = least.reshape(n, trees, depth)
    nodes = np.tile(np.arange(1, trees + 1, dtype=np.uint64), (n, 1))
    for d in range(stop):
        nodes = mix64(nodes * np.uint64(0x9E3779B97F4A7C15) + least[:, :, d])
    tails = np.zeros((n, trees), np.uint64)
    for i, d in enumerate(range(stop, depth)):
        tails |= (mix64(least[:, :, d]) >> np.uint64(48)) << np.uint64(48 - 16 * i)
    return nodes, tails


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell shingle sets apart, whatever their order."""
    low = np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
    high = np.array([mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return low.view(np.int64), high.view(np.int64)


def _profiles(docs: DataFrame, words: int, trees: int, stop: int, depth: int) -> DataFrame:
    """doc_id, fingerprint and size of the shingle set, nodes and tails by tree."""

    def run(batches):
        import pyarrow as pa

        def listed(x):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * trees, pa.int32()), pa.array(x.view(np.int64).ravel()))

        for batch in sliced(batches, size=2 << 20):
            raw, offsets = utf8(batch.column("text"))
            sets = list(shingle_sets(raw, offsets, words))
            nodes, tails = signatures(sets, trees, stop, depth)
            low, high = _fingerprints(sets)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "low": low, "high": high, "size": sizes, "nodes": listed(nodes), "tails": listed(tails)})

    return docs.mapInArrow(run, "doc_id long, low long, high long, size long, nodes array<long>, tails array<long>")


_MEMBER = "rep long, n_docs long, nodes array<long>, tree int, node long, tail long, block int, n_blocks int"
NODE, DEALT = ["tree", "node"], ["tree", "node", "block"]


class _Block:
    """Members of one node, or of a block of it."""

    def __init__(self, batch):
        def column(name):
            return batch.column(batch.schema.get_field_index(name))

        self.tree, self.batch = column("tree")[0].as_py(), batch
        self.reps, self.weight, tail = (column(n).to_numpy(zero_copy_only=False) for n in ("rep", "n_docs", "tail"))
        self.nodes = column("nodes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        self.tails = tail.view(np.uint64)
        self.sets = [np.frombuffer(x, np.uint64) for x in column("shingles").to_pylist()] if "shingles" in batch.schema.names else []
        self.sizes = np.array([len(s) for s in self.sets])


def _parting(left: _Block, right: _Block, steps: list[int]) -> np.ndarray:
    """The prefix length at which each pair (left x right) is met: where its paths part; 0 if an earlier tree has it."""
    x = left.tails[:, None] ^ right.tails[None, :]
    level = np.full(x.shape, steps[-1], np.int8)
    for i in range(min(steps[0] - steps[-1], _BELOW)):
        level += x < np.uint64(1 << (48 - 16 * i)) if i < 3 else x == 0
    for t in range(left.tree):
        level[left.nodes[:, t][:, None] == right.nodes[:, t][None, :]] = 0
    if left is right:
        np.fill_diagonal(level, 0)
    return level


def _groups(batches, keys):
    for batch, bounds in whole_groups(batches, keys):
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield batch.slice(i, j - i)


def _needed(steps):
    def run(batches):
        """Members of a node that have a pair of their own there."""
        import pyarrow as pa

        for batch in _groups(batches, NODE):
            own = _Block(batch)
            keep = _parting(own, own, steps).any(axis=1)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _stored(folder: str):
    def run(batches):
        """Each block of a large node as a file; a row names it."""
        import pyarrow as pa
        from pyspark import TaskContext

        for batch in _groups(batches, DEALT):
            fs, path = filesystem(folder)
            fs.create_dir(path, recursive=True)
            first = batch.select([*DEALT, "n_blocks"]).slice(0, 1)
            name = "/".join([path, "-".join(str(c[0]) for c in first.columns[:3])])
            part = f"{name}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(part) as out, pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            fs.move(part, name)
            yield first

    return run


def _others(folder: str, row: dict, numbers):
    """(number, block) of those blocks of a row's node that have members left."""
    import pyarrow as pa

    fs, path = filesystem(folder)
    for b in numbers:
        try:
            with fs.open_input_file(f"{path}/{row['tree']}-{row['node']}-{b}") as source, pa.ipc.open_stream(source) as reader:
                yield b, _Block(reader.read_next_batch())
        except FileNotFoundError:
            continue


def _needed_across(folder: str, steps):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                _, own = next(_others(folder, row, [row["block"]]))
                keep = _parting(own, own, steps).any(axis=1)
                for _, other in _others(folder, row, (b for b in range(row["n_blocks"]) if b != row["block"])):
                    if keep.all():
                        break
                    keep |= _parting(own, other, steps).any(axis=1)
                if keep.any():
                    yield own.batch.filter(pa.array(keep))

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, left x right."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left]).reshape(len(left), len(right))
    members = np.unique(np.concatenate([left, right]))
    where = {int(m): i for i, m in enumerate(members)}
    values = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    unique, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in no intersection
    code, owner = (np.cumsum(shared) - 1)[code][shared[code]], owner[shared[code]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total, step = np.zeros((len(left), len(right)), np.float32), 4096
    l, r = [where[int(m)] for m in left], [where[int(m)] for m in right]
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(code, at), np.searchsorted(code, at + step)
        x = np.zeros((len(members), step), np.float32)
        x[owner[a:b], code[a:b] - at] = 1
        total += x[l] @ x[r].T
    return total.astype(np.int64)


class _Links:
    """Weight of exact matches and least linked member of two blocks (or one), level by level."""

    def __init__(self, left: _Block, right: _Block, steps: list[int], threshold: float):
        self.one = left is right
        self.reps = left.reps if self.one else np.concatenate([left.reps, right.reps])
        weight = left.weight if self.one else np.concatenate([left.weight, right.weight])
        sets = left.sets if self.one else left.sets + right.sets
        sizes = left.sizes if self.one else np.concatenate([left.sizes, right.sizes])
        a = np.arange(len(left.reps))
        b = a if self.one else len(a) + np.arange(len(right.reps))
        parting = _parting(left, right, steps)
        linked = np.zeros(parting.shape, bool)
        for level in steps:
            at = parting == level
            x, y = np.flatnonzero(at.any(axis=1)), np.flatnonzero(at.any(axis=0))
            if len(x):
                both = _overlaps(sets, a[x], b[y])
                linked[np.ix_(x, y)] |= at[np.ix_(x, y)] & (both / (sizes[a[x]][:, None] + sizes[b[y]][None, :] - both) >= threshold)
        self.links, self.label = np.zeros(len(self.reps), np.int64), self.reps.copy()
        if not linked.any():
            return
        self.links[a] += linked @ weight[b]
        if not self.one:
            self.links[b] += linked.T @ weight[a]
        far = np.iinfo(np.int64).max
        while True:  # the components of these two blocks
            before = self.label.copy()
            self.label[a] = np.minimum(self.label[a], np.where(linked, self.label[b][None, :], far).min(axis=1))
            self.label[b] = np.minimum(self.label[b], np.where(linked, self.label[a][:, None], far).min(axis=0))
            if (before == self.label).all():
                return

    def rows(self):
        import pyarrow as pa

        some = np.flatnonzero(self.links)
        return pa.RecordBatch.from_pydict({"rep": self.reps[some], "links": self.links[some], "least": self.label[some]})


def _verify(steps, threshold: float):
    def run(batches):
        for batch in _groups(batches, NODE):
            own = _Block(batch)
            yield _Links(own, own, steps, threshold).rows()

    return run


def _verify_across(folder: str, steps, threshold: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, own = next(_others(folder, row, [row["block"]]))
                yield _Links(own, own, steps, threshold).rows()
                for _, other in _others(folder, row, range(row["block"] + 1, row["n_blocks"])):
                    yield _Links(own, other, steps, threshold).rows()

    return run


def _written(members: DataFrame, folder: str) -> DataFrame:
    """A row for each block of large nodes, spread over tasks, as each is much work."""
    placed = members.repartition(*DEALT).sortWithinPartitions(*DEALT, "tail")
    rows = materialize(placed.mapInArrow(_stored(folder), "tree int, node long, block int, n_blocks int"), "blocks")
    return rows.repartition(max(1, min(rows.count(), 4 * members.sparkSession.sparkContext.defaultParallelism)), *DEALT)


def components(edges: DataFrame, name: str = "stars", most: int = BROADCAST_ROWS) -> DataFrame:
    """(node, least) of every node that has an edge (a, b): the least node it is connected with.

    Large-star and small-star steps in turn; each round is written to the
    shared folder, and the work ends when a round leaves the edges unchanged.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    signature, count = None, edges.count()
    # An aggregate joined with what it was made from would put all edges of a hub into one task: it is broadcast, or a table.
    apart = lambda df: F.broadcast(df) if 2 * count <= most else materialize(df, name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialize(small, name)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(row) == signature or row[0] == row[2] and _flat(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
        signature, count = tuple(row), row[0]


def _flat(edges: DataFrame) -> bool:
    """Whether no least node is itself linked to a lesser one: then all are stars."""
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _classes(docs: DataFrame, threshold: float, words: int, trees: int, depth: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs with doc_id, id, node, class_id, n_links; doc_ids that are null or repeated).

    node: the least id of a class, whatever its rows' doc_ids.
    """
    steps = levels(threshold, trees, depth, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(_profiles(docs, words, trees, steps[-1], steps[0]), "profiles")
    # A doc_id that is null or repeated can't name a node; its rows go by a negative hash of their shingles.
    unclear = materialize(made.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").select("doc_id"), "unclear")
    some_unclear = not unclear.isEmpty()
    profiles = made.withColumn("id", F.col("doc_id"))
    if some_unclear:
        of = made["doc_id"].eqNullSafe(unclear["doc_id"])
        profiles = profiles.join(bounded(unclear), of, "left_anti").unionByName(made.join(bounded(unclear), of, "left_semi").withColumn("id", -1 - F.shiftrightunsigned("low", 2)))
    reps = profiles.groupBy("low", "high", "nodes", "tails", "size").agg(F.min("id").alias("rep"), F.min("doc_id").alias("named"), F.count("*").alias("n_docs"))
    reps = materialize(reps, "representatives")
    # Only members of nodes that have several get their other nodes back.
    paths = F.posexplode(F.arrays_zip("nodes", "tails")).alias("tree", "path")
    members = reps.filter("size > 0").select("rep", "size", paths).select("rep", "size", "tree", F.col("path.nodes").alias("node"), F.col("path.tails").alias("tail"))
    crowded = members.groupBy("tree", "node").agg(F.count("*").alias("m"), F.sum("size").alias("s")).filter("m > 1")
    crowded = crowded.select("tree", "node", F.ceil(F.greatest(F.col("m") / block, F.col("s") * 8 / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    together = materialize(members.join(crowded, ["tree", "node"]).select("rep", "tree", "node", "tail", "n_blocks"), "members")
    dealt = together.join(reps.select("rep", "n_docs", "nodes"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    dealt = dealt.select("rep", "n_docs", "nodes", "tree", "node", "tail", "block", "n_blocks")
    by_node = dealt.filter("n_blocks = 1").repartition(*NODE).sortWithinPartitions(*NODE, "tail")
    needed = materialize(by_node.mapInArrow(_needed(steps), _MEMBER), "candidates")
    large = not together.filter("n_blocks > 1").isEmpty()
    every = needed
    if large:
        folder = shared_dir(docs.sparkSession, "forest")
        across = _written(dealt.filter("n_blocks > 1"), f"{folder}/paths").mapInArrow(_needed_across(f"{folder}/paths", steps), _MEMBER)
        across = materialize(across, "candidates")
        every = needed.unionByName(across)
    chosen = materialize(every.select("rep").distinct(), "chosen")
    texts = docs.withColumnRenamed("doc_id", "rep").join(bounded(chosen), "rep", "left_semi")
    if some_unclear:
        others = docs.join(bounded(unclear), docs["doc_id"].eqNullSafe(unclear["doc_id"]), "left_semi").withColumn("rep", F.lit(None).cast("long")).select("rep", "text")
        texts = texts.unionByName(others)
    shingles = _sets(texts, words)
    if some_unclear:  # else every chosen representative has one row
        shingles = shingles.groupBy("rep").agg(F.min("shingles").alias("shingles"))
    if large:
        shingles = materialize(shingles, "shingles")
    found = "rep long, links long, least long"
    links = needed.join(shingles, "rep").repartition(*NODE).sortWithinPartitions(*NODE, "tail").mapInArrow(_verify(steps, threshold), found)
    if large:
        blocks = _written(across.join(shingles, "rep"), f"{folder}/sets")
        links = links.unionByName(blocks.mapInArrow(_verify_across(f"{folder}/sets", steps, threshold), found))
    links = materialize(links, "links")
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(links.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    n_links = (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    classes = reps.join(linked, "rep", "left").join(label, reps["rep"] == label["node"], "left").select("low", "high", F.coalesce("least", "rep").alias("node"), n_links, "named")
    if some_unclear:
        # A class that holds such rows goes by its least doc_id all the same.
        names = materialize(classes.groupBy("node").agg(F.min("named").alias("least")).filter("least is not null and least <> node"), "names")
        classes = classes.join(bounded(names), "node", "left").withColumn("class_id", F.coalesce("least", "node"))
    else:
        classes = classes.withColumn("class_id", F.col("node"))
    classes = classes.select("low", "high", "node", "class_id", "n_links")
    return profiles.select("doc_id", "id", "low", "high").join(classes, ["low", "high"]).select("doc_id", "id", "node", "class_id", "n_links"), unclear


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs.

    class_id: the least doc_id of those connected by links; n_links: how many
    other rows reach the threshold, copies included.
    """
    return _classes(docs, threshold, words, trees, depth, recall, block)[0].select("doc_id", "class_id", "n_links")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """Shingle sets by rep; where that is null, by the hash that their profile has."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, size=2 << 20):
            raw, offsets = utf8(batch.column("text"))
            every = list(shingle_sets(raw, offsets, words))
            low = _fingerprints(every)[0].view(np.uint64)
            rep = batch.column("rep")
            made = -1 - (low >> np.uint64(2)).astype(np.int64)
            node = np.where(np.asarray(rep.is_null()), made, rep.fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"rep": node, "shingles": pa.array([s.tobytes() for s in every], pa.binary())})

    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class: the one of least doc_id.

    Where that id is null or repeated, the first by text and hash of the whole row.
    """
    found, unclear = _classes(docs, threshold, words, trees, depth, recall, block)
    found = materialize(found, "classes")
    lost = materialize(found.filter("id = doc_id and class_id <> doc_id").select(F.col("doc_id").alias("_lost")), "lost")
    numbered = docs["doc_id"].cast("long")
    clear = docs.join(bounded(lost), numbered == lost["_lost"], "left_anti")
    if unclear.isEmpty():
        return clear
    clear = clear.join(bounded(unclear), numbered.eqNullSafe(unclear["doc_id"]), "left_anti").select(*own_columns(docs))
    row = F.struct(*own_columns(docs)).alias("row")
    some = docs.join(bounded(unclear), numbered.eqNullSafe(unclear["doc_id"]), "left_semi").select(numbered.alias("doc_id"), docs["text"].cast("string").alias("text"), row)

    def number(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            raw, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            low = _fingerprints(list(shingle_sets(raw, offsets, words)))[0].view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(-1 - (low >> np.uint64(2)).astype(np.int64))], names=[*batch.schema.names, "id"])

    heads = found.filter("id <> doc_id or doc_id is null").filter("doc_id = class_id or doc_id is null and class_id = node").select("doc_id", "id", "node").distinct()
    heads = materialize(heads, "heads").withColumnsRenamed({"doc_id": "_d", "id": "_i"})
    rows = some.mapInArrow(number, f"{fields(some)}, id long")
    rows = rows.join(bounded(heads), (rows["id"] == heads["_i"]) & rows["doc_id"].eqNullSafe(heads["_d"]))
    # An aggregate keeps one row a group before the shuffle, however many share a text.
    first = F.min_by("row", F.struct(F.xxhash64("text"), "text", F.xxhash64("row"))).alias("row")
    return clear.unionByName(rows.groupBy("node").agg(first).select("row.*"))


def op3_minhash_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Exact join through the shingles themselves, for unique doc_ids that are not null.
OP3_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS}, 0) + 2)) AS i FROM doc WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_sizes AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM both_sizes t JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE t.n / (x.n + y.n - t.n) >= {THRESHOLD}
    UNION ALL
    SELECT x.doc_id, y.doc_id FROM doc x JOIN doc y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links
FROM (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a) USING (doc_id)
"""
