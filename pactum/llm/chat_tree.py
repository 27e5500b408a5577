"""Chat formatting as prefix trees.

Conversations whose first turns are equal share those turns: sorted by the
hashes of their turns, they stand in depth-first order of the tree that they
form, and a task that streams them emits each turn once, as a segment below the
turn before it. The sort key of a turn holds the first KEYED hashes; where
conversations still share a turn there, the key is continued by the hashes at
which their paths part, however deep. A segment has its token ids, the position
of its first token (counted along its own conversation), the token runs of its
ancestors, which are all that its tokens may attend to besides themselves, and
the loss run. A row for each conversation names the runs of its path.

Every output shard (a range of the sorted conversations) is a forest of its own,
so a very common first turn is emitted once a shard and no task has to hold it
alone. A conversation streams through one task, whose memory grows with the turns
at its front that another conversation shares, not with the others.

A turn reads ``<s>role\\ntext</s>``, a user's text stands in ``[INST] ``...
`` [/INST]``. Inside roles and texts a backslash is doubled, and one is put after
the first character of each control string, that of the template and the special
ones of the tokenizer, so none is left and no text can make a special id; both are undone by
``plain``. The loss run is an assistant's text alone, tokenised apart from its marks.

Cases: a null text or role is an empty one; turns of equal number stand in order
of role, then text, repeated rows count each, null numbers first; a null conv_id
is one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactum.llm import bpe
from pactum.llm.common import materialize, ranged, sliced, table

KEYED = 16
CONTROL = "</s>[INST] ok [/INST]"
_RUNS = "array<struct<start:long,stop:long>>"
_SEGMENT = f"shard int, seq long, depth long, conv_id long, start long, position long, loss_from int, loss_to int, shared boolean, ids array<int>, runs {_RUNS}"
#: What marks turns in the template.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]")


def marked(special: list[str] | tuple[str, ...] = ()) -> re.Pattern:
    """Backslashes and first characters of control strings: the template's and a tokenizer's special ones."""
    return re.compile("|".join([r"\\", *(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in (*MARKS, *special) if m)]))


_MARKED = marked()


def escaped(text: str, marks: re.Pattern = _MARKED) -> str:
    return marks.sub(lambda m: m[0] + "\\", text)


def plain(text: str) -> str:
    """Undo ``escaped``: of two backslashes one stays, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def escaped_role(role: str, marks: re.Pattern = _MARKED) -> str:
    return escaped(role, marks).replace("\n", "\\n")


def plain_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\"}.get(m[1], ""), role)


def parts(role: str, text: str, marks: re.Pattern = _MARKED) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, and what stands after it."""
    user = role == "user"
    return f"<s>{escaped_role(role, marks)}\n" + "[INST] " * user, escaped(text, marks), " [/INST]" * user + "</s>"


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (turn.startswith("<s>") and turn.endswith("</s>")):
        raise ValueError("not a formatted turn")
    role, _, text = turn[3:-4].partition("\n")
    role = plain_role(role)
    if role == "user":
        text = text.removeprefix("[INST] ").removesuffix(" [/INST]")
    return role, plain(text)


def _chained(batches):
    """Turns with their node (a hash of all turns so far) and their conversation's sort key."""
    import pyarrow as pa
    import xxhash

    conv, index, node, waiting, key = object(), 0, b"", [], b""

    def rows(ready):
        names = ("key", "conv_id", "idx", "node", "role", "text")
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
        return pa.RecordBatch.from_pydict({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*ready, strict=True), strict=True)})

    for batch in sliced(batches, size=4 << 20):
        ready = []
        for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if c != conv:
                ready += [(key, *x) for x in waiting]
                conv, index, node, waiting, key = c, 0, b"", [], b""
            own = role.encode()
            node = xxhash.xxh3_128_digest(node + len(own).to_bytes(8, "big") + own + text.encode())
            if index < KEYED:
                key += node[:8]
            waiting.append((c, index, node, role, text))
            index += 1
            if index >= KEYED:
                ready += [(key, *x) for x in waiting]
                waiting = []
        if ready:
            yield rows(ready)
    if waiting:
        yield rows([(key, *x) for x in waiting])


def _parting(chained: DataFrame) -> DataFrame | None:
    """conv_id, the rest of its sort key and its last shared turn, for conversations that share their KEYED-th; none where no two do.

    The rest holds, in order, the shared nodes that fewer conversations pass than
    the node before: those at which paths part. A path that is alone from there on
    comes first.
    """
    deep = chained.filter(F.col("idx") >= KEYED - 1).select("conv_id", "idx", "node")
    common = materialize(deep.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "common-turns")
    if common.isEmpty():
        return None
    order = W.partitionBy("conv_id").orderBy("idx")
    before = deep.join(common, "node").withColumn("before", F.lag("n").over(order))
    parted = F.when(F.col("n") < F.col("before"), F.struct("idx", F.hex(F.substring("node", 1, 8)).alias("h")))
    own = before.groupBy("conv_id").agg(F.array_sort(F.collect_list(parted)).alias("l"), F.max("idx").alias("shared_to"))
    return materialize(own.select("conv_id", F.unhex(F.array_join("l.h", "")).alias("rest"), "shared_to"), "parting")


def _joined(runs: tuple, start: int, stop: int) -> tuple:
    """runs with one more, put together with the last where they touch."""
    if runs and runs[-1][1] == start:
        return (*runs[:-1], (runs[-1][0], stop))
    return (*runs, (start, stop))


def _emit(path: str):
    def run(batches):
        import pyarrow as pa

        shard, seq, at = TaskContext.get().partitionId(), 0, 0
        coder = bpe.encoder(path)
        marks = marked(coder.special)
        stack: list[tuple] = []  # node, runs through it, position after it, of turns that others may share
        tail: tuple = (b"", (), 0)  # the same of the last turn
        conv, depth = object(), 0

        def ending():
            nonlocal seq
            seq += 1
            return (shard, seq, depth, conv, 0, tail[2], -1, -1, False, [], [{"start": a, "stop": b} for a, b in tail[1]])

        def rows(ready):
            names = [x.split()[0] for x in _SEGMENT.split(f", runs {_RUNS}")[0].split(", ")] + ["runs"]
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            return pa.RecordBatch.from_pydict({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*ready, strict=True), strict=True)})

        started = False
        for batch in sliced(batches, size=2 << 20):
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "idx", "node", "role", "text", "shared_to")]
            # First which turns are new here, then their tokens at once.
            known, new = [x[0] for x in stack], []
            for _, i, node, _, _, limit in zip(*columns, strict=True):
                there = i < len(known) and known[i] == node
                new.append(not there)
                if not there and i <= limit:
                    known[i:] = [node]
            texts = [p for r, t, n in zip(columns[3], columns[4], new, strict=True) if n for p in parts(r, t, marks)]
            ids, offsets = coder.encode(texts)
            ids, offsets, k, ready = ids.astype(np.int32), offsets.tolist(), 0, []
            for c, i, node, role, _, limit, fresh in zip(*columns, new, strict=True):
                if started and c != conv:
                    ready.append(ending())
                if c != conv:
                    conv, depth, started, tail = c, 0, True, (b"", (), 0)
                if fresh:
                    a, b, e, z = offsets[k : k + 4]
                    k += 3
                    loss = (b - a, e - a) if role == "assistant" else (-1, -1)
                    seq += 1
                    ready.append((shard, seq, depth, None, at, tail[2], *loss, i <= limit, ids[a:z], [{"start": x, "stop": y} for x, y in tail[1]]))
                    tail = (node, _joined(tail[1], at, at + z - a), tail[2] + z - a)
                    at += z - a
                    if i <= limit:
                        stack[depth:] = [tail]
                else:
                    tail = stack[depth]
                depth += 1
            if ready:
                yield rows(ready)
        if started:
            yield rows([ending()])

    return run


def forest(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Segments and conversation rows of all turns (conv_id, turn, role, text), written to the shared folder.

    A row with ids is a segment; its ``depth`` is the number of turns before it, and
    where it isn't ``shared``, no other conversation goes on from it. A row without is the end of conversation ``conv_id``, of ``depth`` turns.
    """
    path = vocabulary or bpe.vocabulary_path()
    empty = F.lit("")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    chained = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    chained = materialize(chained.mapInArrow(_chained, "key binary, conv_id long, idx long, node binary, role string, text string"), "turns")
    order, rest = ["key"], _parting(chained)
    limit = F.lit(KEYED - 1).cast("long")
    if rest is not None:
        rest = rest.withColumnRenamed("conv_id", "_c")
        chained = chained.join(rest, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumns({"rest": F.coalesce("rest", F.lit(b"")), "shared_to": F.coalesce("shared_to", limit)})
        order += ["rest"]
    else:
        chained = chained.withColumn("shared_to", limit)
    ordered = ranged(chained, F.octet_length("text"), *order, "conv_id").sortWithinPartitions(*order, "conv_id", "idx")
    return materialize(ordered.mapInArrow(_emit(path), _SEGMENT), "chat-tree")


class _Path:
    """Running digests of a conversation's turns; children copy their parent's."""

    def __init__(self):
        self.turns, self.loss, self.loss_chars, self.chars, self.tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def then(self, role: str, text: str, formatted: int, loss: str, tokens: int) -> _Path:
        out = _Path.__new__(_Path)
        out.turns, out.loss = self.turns.copy(), self.loss.copy()
        out.turns.update(f"{role}\n{text}\n".encode())
        out.loss.update(loss.encode())
        out.loss_chars, out.chars, out.tokens = self.loss_chars + len(loss), self.chars + formatted, self.tokens + tokens
        return out


def read(segments: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of every conversation, from the segments on its path alone."""
    path = vocabulary or bpe.vocabulary_path()
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        import pyarrow as pa

        library, shard, stack, tail, at = bpe.encoder(path).library, None, [], None, 0
        for batch in batches:
            rows = batch.to_pylist()
            texts = library.decode_batch([r["ids"] for r in rows], skip_special_tokens=False)
            losses = library.decode_batch([r["ids"][max(r["loss_from"], 0) : max(r["loss_to"], 0)] for r in rows], skip_special_tokens=False)
            done = []
            for r, text, loss in zip(rows, texts, losses, strict=True):
                if r["shard"] != shard:
                    shard, stack, tail, at = r["shard"], [_Path()], None, 0
                n = r["depth"]
                state = tail if tail is not None and n == at else stack[n]
                if sum(x["stop"] - x["start"] for x in r["runs"]) != state.tokens or r["position"] != state.tokens:
                    raise ValueError("attention runs do not match the path")
                if r["ids"]:
                    tail, at = state.then(*parsed(text), len(text), plain(loss), len(r["ids"])), n + 1
                    if r["shared"]:
                        stack[n + 1 :] = [tail]
                else:
                    tail = None
                    done.append((r["conv_id"], n, state.turns.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars))
            if done:
                names = [x.split()[0] for x in out.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_pydict({m: pa.array(list(c), k) for m, k, c in zip(names, kinds, zip(*done, strict=True), strict=True)})

    return segments.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(run, out)


def op10_chat_tree(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return read(forest(turns.unionByName(control)))


_T = "coalesce(role, '') AS role, coalesce(text, '') AS text"
_ESCAPE = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>|\|endoftext\|>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
OP10_SQL = f"""
WITH t AS (SELECT conv_id, turn, {_T} FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
    CAST(sum(8 + length(replace({_ESCAPE.format('role')}, chr(10), '\\n')) + length({_ESCAPE.format('text')}) + CASE WHEN role = 'user' THEN 15 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
