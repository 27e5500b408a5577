"""Chat trees and motion-JPEG: exact round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import chat_tree, media

TURN = "conv_id long, turn long, role string, text string"
SPECIAL = ["<|endoftext|>"]
MARKS = chat_tree.marked(SPECIAL)
PARTS = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "a", "\n", "<", "[", "/", "s>", "n", "é", " "]


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    for _ in range(20000):
        text, role = ("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))) for _ in range(2))
        e = chat_tree.escaped(text)
        assert chat_tree.plain(e) == text and not [c for c in ("<s>", "</s>", "[INST]", "[/INST]") if c in e]
        e = chat_tree.escaped(text.replace("é", SPECIAL[0]), MARKS)
        assert chat_tree.plain(e) == text.replace("é", SPECIAL[0]) and SPECIAL[0] not in e
        for r in (role, "user", "assistant", ""):
            assert chat_tree.parsed("".join(chat_tree.parts(r, text))) == (r, text)


def expected(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    found = []
    for c, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        formatted = sum(len("".join(chat_tree.parts(r, t, MARKS))) for r, t in turns)
        found.append((c is None, c or 0, len(turns), whole, len(said), hashlib.sha256(said.encode()).hexdigest(), formatted))
    return sorted(found)


def got(df):
    return sorted((r.conv_id is None, r.conv_id or 0, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in df.collect())


def chats(n=60, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        shared = rng.randint(0, 6)
        for t in range(rng.randint(1, 9)):
            role = ("user", "assistant")[t % 2]
            rows.append((c, t, role, f"turn {t} of all" if t < shared else f"{''.join(rng.choice(PARTS) for _ in range(12))} {rng.randint(0, 3)}"))
    return rows


def test_trees_round_trip_and_share(spark):
    rows = chats() + [(500, 0, "user", None), (500, 0, None, "x"), (500, None, "assistant", ""), (None, 1, "sys\ntem", "<|endoftext|>"), (7, 0, "user", "again"), (7, 0, "user", "again"), (600, 0, "assistant", "é" * 4000)]
    segments = chat_tree.forest(spark.createDataFrame(rows, TURN).withColumn("depth", F.lit("own")))
    assert got(chat_tree.read(segments)) == expected(rows)
    own = segments.filter("size(ids) > 0")
    assert own.count() < len(rows)  # shared turns once
    for r in own.collect():
        assert 50256 not in r.ids  # no text makes a special id
        assert all(x.stop <= y.start for x, y in zip(r.runs, r.runs[1:], strict=False)) and sum(x.stop - x.start for x in r.runs) == r.position and all(x.stop <= r.start for x in r.runs)


def test_turns_beyond_the_keyed_ones_are_emitted_once(spark):
    """Branches at the 19th, 31st and 41st turn, in turns of conv_id, one path that ends early and one that is null."""
    def said(c, t):
        return f"{t}" if t < 18 else f"{t} {c % 2}" if t < 30 else f"{t} {c % 4}" if t < 40 else f"{t} {c % 8}"

    rows = [(c, t, ("user", "assistant")[t % 2], said(c, t)) for c in range(16) for t in range(50)]
    rows += [(90, t, ("user", "assistant")[t % 2], said(0, t)) for t in range(25)] + [(None, t, ("user", "assistant")[t % 2], said(1, t)) for t in range(45)]
    segments = chat_tree.forest(spark.createDataFrame(rows, TURN))
    assert got(chat_tree.read(segments)) == expected(rows)
    turns = {}
    for c, t, role, text in rows:
        turns.setdefault(c, []).append((role, text))
    own = segments.filter("size(ids) > 0").count()
    ends = segments.filter("size(ids) = 0").select("shard", "conv_id").collect()
    assert own == len({(r.shard, tuple(turns[r.conv_id][:n])) for r in ends for n in range(1, len(turns[r.conv_id]) + 1)})


def test_very_long_shared_fronts(spark):
    """1,500 shared turns, then two branches, then one branch again."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{t}" if t < 1500 else f"{t} {c % 2}" if t < 1510 else f"{t} {c}") for c in range(6) for t in range(1520)]
    segments = chat_tree.forest(spark.createDataFrame(rows, TURN))
    assert got(chat_tree.read(segments)) == expected(rows)
    shards = segments.filter("size(ids) = 0").groupBy("shard").agg(F.collect_list("conv_id").alias("c")).collect()
    assert segments.filter("size(ids) > 0").count() == sum(1500 + 10 * len({c % 2 for c in r.c}) + 10 * len(r.c) for r in shards)


@pytest.mark.parametrize("shared", [1, 3])
def test_trees_beyond_the_shared_turns(monkeypatch, shared):
    """The same generators that tasks run, here in one process, where no turn beyond a low one is said to be shared."""
    from pactum.llm import bpe

    monkeypatch.setattr(chat_tree, "KEYED", 2)
    monkeypatch.setattr(chat_tree, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    import pyarrow as pa

    rows = chats(30, 5) + [(900, t, "user", f"long {t}") for t in range(70)] + [(901, t, "user", f"long {t}") for t in range(70)]
    rows.sort()
    turns = pa.RecordBatch.from_pydict({"conv_id": [r[0] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    chained = pa.Table.from_batches(list(chat_tree._chained([turns]))).sort_by([("key", "ascending"), ("conv_id", "ascending"), ("idx", "ascending")])
    chained = chained.append_column("shared_to", pa.array([shared] * len(chained), pa.int64()))
    batches = chained.combine_chunks().to_batches(max_chunksize=23)
    segments = list(chat_tree._emit(bpe.vocabulary_path())(batches))
    run = {}

    class Frame:
        def repartition(self, *a):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, f, schema):
            run["f"] = f
            return self

    chat_tree.read(Frame())
    out = [r for b in run["f"](segments) for r in b.to_pylist()]
    have = sorted((False, r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in out)
    assert have == expected(rows)


def test_empty_conversations(spark):
    assert chat_tree.read(chat_tree.forest(spark.createDataFrame([], TURN))).count() == 0


def test_chat_query_matches_its_sql(same_rows):
    assert same_rows(chat_tree.op10_chat_tree, chat_tree.OP10_SQL)


def payloads():
    rng = np.random.default_rng(1)
    return [media.padded(x) for x in (b"", b"a", b"\xff" * 640, bytes(range(256)) * 40, rng.integers(0, 256, 7000, np.uint8).tobytes(), b"\x00\xff" * 3000)]


def test_media_round_trip():
    for p, m in zip(payloads(), media.encode(payloads()), strict=True):
        d = media.described(m)
        assert d["payload"] == p and d["damaged"] == 0 and d["frames"] == -(-len(p) // (64 * media.ROWS))


def test_media_round_trip_in_small_groups(monkeypatch):
    whole = media.encode(payloads())
    monkeypatch.setattr(media, "TOGETHER", 2)
    assert media.encode(payloads()) == whole
    assert [media.described(m)["payload"] for m in whole] == payloads()


def test_full_decoding_gives_constant_blocks():
    m = media.encode([media.padded(bytes(range(200)))])[0]
    a, b = media.frames(m)["frames"][0]
    small, full = media.decode([m[a:b]])[0], media.decode([m[a:b]], full=True)[0]
    assert (np.kron(small, np.ones((8, 8), np.uint8)) == full).all()


def jpeg(pixels, restart=0, color=False):
    """An independent, slow baseline encoder with AC terms: all codes 8 bits long, quantiser 1."""
    h, w = pixels.shape
    basis = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    bits, out, before = [], b"", [0, 0, 0]

    def put(v, n):
        bits.extend((v >> k) & 1 for k in range(n - 1, -1, -1))

    def number(v, run, dc):
        size = int(abs(v)).bit_length()
        put(size if dc else run * 16 + size, 8)
        put(v if v >= 0 else v + (1 << size) - 1, size)

    def flush():
        nonlocal out, bits
        bits += [1] * (-len(bits) % 8)
        data = np.packbits(bits).tobytes() if bits else b""
        out += data.replace(b"\xff", b"\xff\x00")
        bits = []

    def block(values, part):
        terms = np.rint(basis @ (values.astype(float) - 128) @ basis.T).astype(int).ravel()[zigzag]
        number(int(terms[0]) - before[part], 0, True)
        before[part] = int(terms[0])
        run = 0
        last = max([k for k in range(64) if terms[k]], default=0)
        for k in range(1, last + 1):
            if terms[k]:
                number(int(terms[k]), run, False)
                run = 0
            elif run == 15:
                put(0xF0, 8)
                run = 0
            else:
                run += 1
        if last < 63:
            put(0, 8)

    step = 16 if color else 8
    padded = np.pad(pixels, ((0, -h % step), (0, -w % step)), mode="edge")
    units = [(y, x) for y in range(0, padded.shape[0], step) for x in range(0, padded.shape[1], step)]
    for i, (y, x) in enumerate(units):
        if restart and i and i % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            before = [0, 0, 0]
        for dy in range(0, step, 8):
            for dx in range(0, step, 8):
                block(padded[y + dy : y + dy + 8, x + dx : x + dx + 8], 0)
        if color:
            block(np.full((8, 8), 100), 1)
            block(np.full((8, 8), 50), 2)
    flush()
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    parts = [(1, 0x22 if color else 0x11, 0)] + ([(2, 0x11, 0), (3, 0x11, 0)] if color else [])
    dc = [s for s in range(12)]
    ac = [s for s in range(255)]
    table = lambda kind, symbols: seg(0xC4, bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, h, w, len(parts)) + b"".join(bytes(p) for p in parts)) + table(0, dc) + table(16, ac)
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + seg(0xDA, bytes([len(parts)]) + b"".join(bytes([p[0], 0]) for p in parts) + bytes([0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("restart,color", [(0, False), (3, False), (0, True), (2, True)])
def test_general_baseline_frames(restart, color):
    rng = np.random.default_rng(7)
    images = [np.clip(np.add.outer(np.arange(37) * 3, np.arange(45) * 2) + rng.integers(-20, 20, (37, 45)), 0, 255).astype(np.uint8) for _ in range(3)]
    data = [jpeg(x, restart, color) for x in images]
    for want, got_ in zip(images, media.decode(data, full=True), strict=True):
        assert got_.shape == want.shape and np.abs(got_.astype(int) - want).max() <= 2
    small = media.decode(data)[0]
    assert small.shape == (5, 6) and abs(int(small[0, 0]) - images[0][:8, :8].mean()) <= 1
    broken = data[1][: len(data[1]) // 2]
    mixed = media.decode([data[0], broken, b"", b"\xff\xd8nothing"], full=True)
    assert mixed[0] is not None and mixed[2] is None and mixed[3] is None


def video(levels):
    frames = [np.full((1, 64), v, np.uint8) for v in levels]
    data, stops = media.entropy(np.concatenate(frames), np.arange(len(frames)))
    bodies = [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    return media._container([media._header(1) + b + b"\xff\xd9" for b in bodies], 512, 8, 0)


def test_shots_and_clip_rows(spark):
    m = video([10] * 20 + [200] * 30 + [90] * 5)
    rows = media.clips(spark.createDataFrame([(1, bytearray(m), "x"), (2, None, "y"), (3, bytearray(b"junk"), "z")], "id int, media binary, clip string").withColumnRenamed("clip", "name")).orderBy("clip").collect()
    assert [(r.id, r.name, r.clip, r.n_frames, r.start_s, r.end_s, r.mean_luma) for r in rows] == [(1, "x", 0, 20, 0.0, 0.8, 10.0), (1, "x", 1, 30, 0.8, 2.0, 200.0), (1, "x", 2, 5, 2.0, 2.2, 90.0)]


def test_frames_without_or_with_a_foreign_index():
    m = video([1, 2, 3])
    want = media.frames(m)["frames"]
    assert len(want) == 3
    bare = m[: m.index(b"idx1")]
    assert media.frames(bare)["frames"] == want
    at = m.index(b"idx1") + 8
    base = m.index(b"movi")
    index = b"".join(struct.pack("<4sIII", b"00dc", 16, base + o, n) for _, _, o, n in (struct.unpack("<4sIII", m[at + 16 * i : at + 16 * i + 16]) for i in range(3)))
    assert media.frames(m[:at] + index)["frames"] == want
    with pytest.raises(ValueError):
        media.frames(b"RIFF0000WAVE")


def test_media_query(spark, case_dir, documents, odd):
    folder = case_dir(documents=documents(odd + [(20, "é text"), (21, "é text")], "media n_bytes"))
    rows = media.op1_media(spark, folder).collect()
    text = {i: t for i, t in odd + [(20, "é text"), (21, "é text")] if i is not None}
    assert len(rows) == len(odd) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        raw = (text[r.doc_id] or "").encode()
        p = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(p) % 64 == 0 and r.media_bytes > 0
    same = [r for r in rows if r.doc_id in (20, 21)]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature
    stored = media.texts_to_media(documents(odd)).collect()
    assert len(stored) == len(odd) and all(media.described(bytes(r.media))["payload"] for r in stored)
