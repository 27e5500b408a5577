"""AVI motion-JPEG columns: RIFF indexes, intra-frame decoding, shots, timed clips.

``frames`` finds the frames of an AVI by its index (``idx1``, else OpenDML
``ix`` chunks, else a walk over ``movi``); ``decode`` decodes baseline JPEG
frames, all restart intervals of a batch side by side with array operations, to
one sample a block (the exact block means, an image of an eighth the size) or to
full samples; ``shots`` cuts where the difference of luma histograms exceeds a
threshold that adapts to the differences before it; ``clips`` gives a row a shot.

``encode`` stores bytes as a grey motion-JPEG: one block for each byte, of DC
quantiser 8, so that every sample of the block is that byte exactly; one restart
interval for each 64 bytes. The byte count stands in the INFO list, as the last
frame may end with rows of zeros.

Frames without Huffman tables, as many cameras write them, get the standard's
own. Cases: null and empty texts make 64 zero bytes; a frame that isn't decodable
baseline JPEG counts in ``damaged`` and is skipped in clips, and makes the payload
null; a null or damaged container gives no clips; equal bytes give equal media;
an empty table gives no rows; ``clips`` keeps other columns, those called like
its own under free names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import fields, own_columns, set_aside, sliced, table

ROW = 64
ROWS = 32
RATE = 25
BINS = 32
#: Frames that are coded at once.
TOGETHER = 512
LOOKBACK = 12
FLOOR = 0.08
DEVIATIONS = 3.0


# ------------------------------------------------------------------ writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    """Everything of a grey frame of ``rows`` x 64 blocks before its entropy-coded data."""
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)))  # every DC size in 4 bits
        + _segment(0xC4, b"\x10" + bytes([1, *[0] * 15]) + b"\x00")  # the end of a block in one
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


_SIZE = np.array([int(x).bit_length() for x in range(256)], np.int64)


def entropy(samples: np.ndarray, frame_of: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of rows x 64 samples; frame_of: each row's frame. Gives all data and where frames end."""
    n = len(samples)
    d = np.diff(samples.astype(np.int64), axis=1, prepend=np.full((n, 1), 128))
    size = _SIZE[np.abs(d)]
    word = ((size << size) | np.where(d > 0, d, d + (1 << size) - 1)) << 1
    length = size + 5
    pad = -length.sum(axis=1) % 8
    word = np.c_[word, (1 << pad) - 1].astype(np.uint16)
    length = np.c_[length, pad].astype(np.uint8)
    left = (word << (16 - length)).astype(">u2")
    bits = np.unpackbits(left.view(np.uint8).reshape(-1, 2), axis=1)[:, :13]
    packed = np.packbits(bits[np.arange(13)[None, :] < length.reshape(-1, 1)])
    ends = np.cumsum(length.sum(axis=1, dtype=np.int64)) // 8
    last = np.append(frame_of[1:] != frame_of[:-1], True)
    stuffed = packed == 0xFF
    extra = np.zeros(len(packed) + 1, np.int64)
    extra[1:] = stuffed
    extra[ends[:-1]] += 2 * ~last[:-1]
    place = np.arange(len(packed)) + np.cumsum(extra)[:-1]
    out = np.zeros(int(place[-1]) + 1 + int(stuffed[-1]), np.uint8)
    out[place] = packed
    marks = ends[:-1][~last[:-1]]
    first = np.searchsorted(frame_of, frame_of)  # each frame's first row
    number = (np.arange(n) - first) % 8
    at = place[marks] - 2
    out[at] = 0xFF
    out[at + 1] = 0xD0 + number[:-1][~last[:-1]]
    stops = np.append(place[ends[:-1][last[:-1]]], len(out))
    return out.tobytes(), stops


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _container(frames: list[bytes], width: int, height: int, n_bytes: int) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(n_bytes).encode() + b"\0"))
    at, index = 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + info + movi + _chunk(b"idx1", b"".join(index)))


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % ROW or (0 if data else ROW))


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload; payloads have positive multiples of 64 bytes."""
    shapes, parts = [], []
    for p in payloads:
        rows = len(p) // ROW
        n = -(-rows // ROWS)
        height = -(-rows // n)
        shapes.append((n, height))
        parts += np.split(np.frombuffer(p.ljust(n * height * ROW, b"\0"), np.uint8).reshape(-1, ROW), n)
    bodies = []
    for at in range(0, len(parts), TOGETHER):
        some = parts[at : at + TOGETHER]
        data, stops = entropy(np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some]))
        bodies += [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
    at, out = 0, []
    for p, (n, height) in zip(payloads, shapes, strict=True):
        head = _header(height)
        out.append(_container([head + body + b"\xff\xd9" for body in bodies[at : at + n]], ROW * 8, height * 8, len(p)))
        at += n
    return out


# ------------------------------------------------------------------ reading


def _chunks(data: bytes, at: int, end: int):
    """(name, list type, first byte, end) of the chunks in a range."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        stop = min(at + 8 + size, end)
        kind = data[at + 8 : at + 12] if name in (b"RIFF", b"LIST") else b""
        yield name, kind, at + 8 + (4 if kind else 0), stop
        at = stop + (size & 1)


def frames(data: bytes) -> dict:
    """Frame ranges, seconds a frame and the INFO comment of an AVI; ValueError if it is none."""
    found: dict = {"step": 1 / RATE, "comment": b"", "frames": []}
    movi, index, open_index = [], b"", []
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")

    def walk(at, end):
        nonlocal index
        for name, kind, a, b in _chunks(data, at, end):
            if kind == b"movi":
                movi.append((a - 4, b))
            if kind in (b"AVI ", b"AVIX", b"hdrl", b"strl", b"INFO"):
                walk(a, b)
            elif name == b"avih":
                found["step"] = int.from_bytes(data[a : a + 4], "little") / 1e6 or 1 / RATE
            elif name == b"strh" and data[a : a + 4] == b"vids" and b - a >= 28:
                scale, rate = struct.unpack("<II", data[a + 20 : a + 28])
                found["step"] = scale / rate if scale and rate else found["step"]
            elif name == b"ICMT":
                found["comment"] = data[a:b].rstrip(b"\0")
            elif name == b"idx1":
                index = data[a:b]

    walk(0, len(data))
    if index and movi:
        entries = [struct.unpack("<4sIII", index[i : i + 16]) for i in range(0, len(index) - 15, 16)]
        video = [(o, n) for name, _, o, n in entries if name[2:] in (b"dc", b"db")]
        base = movi[0][0]
        if video and data[base + video[0][0] + 2 : base + video[0][0] + 4] not in (b"dc", b"db"):
            base = 0  # some writers count from the file's first byte
        found["frames"] = [(base + o + 8, base + o + 8 + n) for o, n in video]
        return found
    for a, b in movi:
        for name, kind, x, y in _chunks(data, a + 4, b):
            for name, x, y in [(name, x, y)] if kind != b"rec " else [(n, i, j) for n, _, i, j in _chunks(data, x, y)]:
                if name[2:] in (b"dc", b"db"):
                    found["frames"].append((x, y))
                elif name[:2] == b"ix" and y - x >= 24:
                    n, base = struct.unpack("<I", data[x + 4 : x + 8])[0], struct.unpack("<Q", data[x + 12 : x + 20])[0]
                    for i in range(n):
                        o, size = struct.unpack("<II", data[x + 24 + 8 * i : x + 32 + 8 * i])
                        open_index.append((base + o, base + o + (size & 0x7FFFFFFF)))
    if open_index:
        found["frames"] = sorted(open_index)
    return found


def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    """length * 256 + symbol for each 16 bits that may come next; 0: no code."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


# The Huffman tables of the JPEG standard's annex K, by class and number: counts by length, then symbols. Fixed values.
_STANDARD = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a "
        "34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a "
        "92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da "
        "e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a "
        "35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a "
        "92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da "
        "e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


def _parse(head: bytes) -> dict:
    """Tables and layout from a frame's bytes before its entropy-coded data."""
    out: dict = {"quantisers": {}, "codes": {}, "restart": 0}
    at = 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                out["quantisers"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["codes"][body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            if body[0] != 8 or not out["height"] or not out["width"]:
                raise ValueError("not 8-bit baseline")
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        at += 2 + size
    if "parts" not in out or set(out.get("scan", ())) != {p[0] for p in out["parts"]}:
        raise ValueError("not one interleaved scan")
    if not out["codes"]:
        out["codes"] = {k: _table(bytes.fromhex(counts), bytes.fromhex(symbols)) for k, (counts, symbols) in _STANDARD.items()}
    return out


def _data_start(data: bytes) -> int:
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        at, marker = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big"), data[at + 1]
        if marker == 0xDA:
            return at
    raise ValueError("no scan")


_ORDER = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))  # zigzag
_BASIS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode(images: list[bytes], full: bool = False) -> list:
    """Luma samples (rows x columns) of each JPEG, an eighth the size unless full; None where one isn't decodable."""
    out: list = [None] * len(images)
    groups: dict[bytes, list[int]] = {}
    starts = {}
    for i, data in enumerate(images):
        try:
            starts[i] = _data_start(data)
            groups.setdefault(data[: starts[i]], []).append(i)
        except (ValueError, IndexError):
            continue
    for head, members in groups.items():
        try:
            layout = _parse(head)
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        for at in range(0, len(members), TOGETHER):
            _decode_some(out, images, starts, layout, members[at : at + TOGETHER], full)
    return out


def _decode_some(out: list, images: list[bytes], starts: dict, layout: dict, members: list[int], full: bool) -> None:
    """Planes of some frames of one layout; after a failure each half by itself, down to the damaged frame."""
    try:
        for i, plane in zip(members, _planes(layout, [images[i][starts[i] :] for i in members], full), strict=True):
            out[i] = plane
    except (ValueError, IndexError, KeyError):
        if len(members) > 1:
            half = len(members) // 2
            _decode_some(out, images, starts, layout, members[:half], full)
            _decode_some(out, images, starts, layout, members[half:], full)


def _lanes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers, where restart intervals begin, and each one's image."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begin = np.cumsum(sizes) - sizes
    after = np.append(raw[1:], 0)
    mark = np.flatnonzero((raw == 0xFF) & (after != 0) & (after != 0xFF))
    image = np.searchsorted(begin, mark, "right") - 1
    kept = np.ones(len(raw), bool)
    kept[np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1] = False
    kept[mark] = False
    kept[np.minimum(mark + 1, len(raw) - 1)] = False
    restart = (after[mark] & 0xF8) == 0xD0
    ends = np.full(len(bodies), 0) + begin + sizes
    for m, i in zip(mark[~restart][::-1].tolist(), image[~restart][::-1].tolist(), strict=True):
        ends[i] = m  # the first marker that is no restart ends the data
    for e, b, s in zip(ends.tolist(), begin.tolist(), sizes.tolist(), strict=True):
        kept[e : b + s] = False
    inside = restart & (mark < ends[image])
    first = np.concatenate([begin, mark[inside] + 2])
    owner = np.concatenate([np.arange(len(bodies)), image[inside]])
    order = np.argsort(first, kind="stable")
    moved = np.concatenate([[0], np.cumsum(kept)])
    return raw[kept], moved[np.minimum(first[order], len(raw))], owner[order]


def _planes(layout: dict, bodies: list[bytes], full: bool) -> list:
    parts = layout["parts"]
    one = len(parts) == 1
    pattern = [(c, x, y) for c, p in enumerate(parts) for y in range(1 if one else p[2]) for x in range(1 if one else p[1])]
    wide, high = (1, 1) if one else (max(p[1] for p in parts), max(p[2] for p in parts))
    across, down = -(-layout["width"] // (8 * wide)), -(-layout["height"] // (8 * high))
    units, step = across * down, layout["restart"] or across * down
    per = -(-units // step)
    raw, first, owner = _lanes(bodies)
    if len(first) != per * len(bodies) or (np.bincount(owner, minlength=len(bodies)) != per).any():
        raise ValueError("restart intervals are missing")
    lanes, k = len(first), len(pattern)
    count = np.tile(np.minimum(step, units - np.arange(per) * step), len(bodies))
    b = np.concatenate([raw, np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(raw) + 8
    window = np.zeros(n, np.uint64)
    for i in range(8):
        window |= b[i : n + i] << np.uint64(56 - 8 * i)
    at, limit = first * 8, np.append(first[1:], len(raw)) * 8
    luma = np.zeros((lanes, step, sum(c == 0 for c, _, _ in pattern)), np.int32)
    terms = np.zeros((*luma.shape, 64), np.int32) if full else None
    before = np.zeros((len(parts), lanes), np.int64)
    direct = [layout["codes"][layout["scan"][p[0]][0]] for p in parts]
    alternate = [layout["codes"][16 + layout["scan"][p[0]][1]] for p in parts]

    def symbols(of, active):
        """(symbol, value of its extra bits) next in each active lane, which then stands after them."""
        p = at[active]
        word = window[np.minimum(p >> 3, n - 1)] << (p & 7).astype(np.uint64)
        got = of[(word >> np.uint64(48)).astype(np.int64)]
        if not got.all():
            raise ValueError("no such code")
        length, symbol = (got >> 8).astype(np.uint64), got & 255
        size = (symbol & 15).astype(np.uint64)
        extra = ((word << length) >> np.uint64(1) >> (np.uint64(63) - size)).astype(np.int64)
        at[active] = p + (length + size).astype(np.int64)
        size = size.astype(np.int64)
        return symbol, np.where((extra << 1 >> size == 0) & (size > 0), extra - (1 << size) + 1, extra)

    for unit in range(step):
        active = np.flatnonzero(count > unit) if count.min() <= unit else slice(None)
        slot = 0
        for c, _, _ in pattern:
            _, value = symbols(direct[c], active)
            before[c, active] += value
            if c == 0:
                luma[active, unit, slot] = before[0, active]
            rest, place = np.arange(lanes)[active], np.zeros(lanes, np.int64)
            while len(rest):
                symbol, value = symbols(alternate[c], rest)
                run, size = symbol >> 4, symbol & 15
                place[rest] += np.where((size == 0) & (run < 15), 64, run + 1)
                if full and c == 0:
                    some = (size > 0) & (place[rest] < 64)
                    terms[rest[some], unit, slot, place[rest[some]]] = value[some]
                rest = rest[place[rest] < 63]
            slot += c == 0
    if (at > limit).any():
        raise ValueError("data ends early")
    quantiser = layout["quantisers"][parts[0][3]]
    x, y = (1, 1) if one else parts[0][1:3]
    rows, columns = -(-layout["height"] // 8), -(-layout["width"] // 8)
    shape = (len(bodies), per * step, y, x)
    if not full:
        samples = np.clip((luma.astype(np.int64) * quantiser[0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
        blocks = samples.reshape(shape)[:, :units].reshape(len(bodies), down, across, y, x).transpose(0, 1, 3, 2, 4)
        return list(blocks.reshape(len(bodies), down * y, across * x)[:, :rows, :columns])
    terms[..., 0] = luma
    square = np.zeros(terms.shape, np.float64)
    square[..., _ORDER] = terms * quantiser
    pixels = np.einsum("ux,...uv,vy->...xy", _BASIS, square.reshape(*terms.shape[:-1], 8, 8), _BASIS)
    pixels = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8)
    blocks = pixels.reshape(*shape, 8, 8)[:, :units].reshape(len(bodies), down, across, y, x, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    return list(blocks.reshape(len(bodies), down * y * 8, across * x * 8)[:, : layout["height"], : layout["width"]])


def shots(planes: list, bins: int = BINS, lookback: int = LOOKBACK, floor: float = FLOOR, deviations: float = DEVIATIONS) -> list[tuple[int, int]]:
    """(first frame, end) of each shot: cuts where a histogram difference exceeds what the ones before it let expect."""
    if not planes:
        return []
    histograms = np.array([np.bincount(p.ravel() >> 3 if bins == 32 else (p.ravel().astype(int) * bins) >> 8, minlength=bins) / p.size for p in planes])
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for i, d in enumerate(steps.tolist()):
        past = steps[max(since, i - lookback) : i]
        limit = floor if not len(past) else max(floor, float(past.mean() + deviations * past.std()))
        if d > limit:
            cuts.append(i + 1)
            since = i + 1
    return list(zip(cuts, [*cuts[1:], len(planes)], strict=True))


def described(data: bytes | None) -> dict:
    """Payload (of ``encode``'s media; null where a frame is damaged) and clips of an AVI."""
    empty = {"payload": b"", "clips": [], "damaged": 0, "frames": 0}
    try:
        found = frames(data or b"")
    except (ValueError, struct.error):
        return empty
    planes = decode([data[a:b] for a, b in found["frames"]])
    return _summary(found, planes)


def _summary(found: dict, planes: list) -> dict:
    good = [p for p in planes if p is not None]
    size = int(found["comment"]) if found["comment"].isdigit() else 0
    payload = None if len(good) < len(planes) else b"".join(p.tobytes() for p in good)[:size]
    clips = [
        {"clip": i, "start_s": a * found["step"], "end_s": b * found["step"], "n_frames": b - a, "mean_luma": float(np.mean([p.mean() for p in good[a:b]]))}
        for i, (a, b) in enumerate(shots(good))
    ]
    return {"payload": payload, "clips": clips, "damaged": len(planes) - len(good), "frames": len(good)}


def encoded(batches):
    """Batches of doc_id, text with the AVI of each text as ``media``."""
    import pyarrow as pa

    for batch in sliced(batches, size=1 << 20):
        texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"").to_pylist()
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(encode([padded(t) for t in texts]), pa.large_binary())})


def digested(batches):
    """Batches of doc_id, n_bytes, media with what is read back from the media."""
    import pyarrow as pa

    for batch in batches:
        media = batch.column("media").to_pylist()
        found = [frames(m) for m in media]
        planes = decode([m[a:b] for m, f in zip(media, found, strict=True) for a, b in f["frames"]])
        at, rows = 0, []
        for m, f in zip(media, found, strict=True):
            n = len(f["frames"])
            s = _summary(f, planes[at : at + n])
            at += n
            p = s["payload"]
            if p is None:
                raise ValueError("stored media is damaged")
            feature = f"{s['frames']} frames;" + ";".join(f"{c['start_s']:.2f}-{c['end_s']:.2f}:{c['mean_luma']:.3f}" for c in s["clips"])
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})


def texts_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's bytes as an AVI, for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoded, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each shot of each AVI in ``column``, with the other columns of media."""
    made = ("clip", "start_s", "end_s", "n_frames", "mean_luma")
    media = set_aside(media, tuple(n for n in made if n != column))
    others = [c for c in media.columns if c != column]
    rest = media.drop(column)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, text=column):
            at, rows = [], []
            for i, m in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                for c in described(m)["clips"]:
                    at.append(i)
                    rows.append(c)
            if rows:
                kept = batch.select(others).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *(pa.array([r[n] for r in rows], k) for n, k in (("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32()), ("mean_luma", pa.float64())))],
                    names=[*others, *made],
                )

    return media.select(*own_columns(rest), column).mapInArrow(run, ", ".join([*([fields(rest)] if others else []), "clip int, start_s double, end_s double, n_frames int, mean_luma double"]))


def op1_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One task writes the media of a few texts and reads them back, so they need not pass through the JVM.
    return docs.mapInArrow(lambda batches: digested(encoded(batches)), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
