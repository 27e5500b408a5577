"""Exact byte-level BPE of whole texts at corpus speed.

The tokenizers library encodes every distinct pre-token once for each worker;
repeats are gathered from a bounded cache with array operations. The cache is
found by a hash and then compared character by character; a text with a pre-token
that merely has another's hash goes to the library whole. Pre-tokens are the runs
that the vocabulary's own split pattern yields; BPE never joins across them, so
the ids equal those of encoding the whole text. A text with Latin letters, with control characters or with a special token's string goes to
the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from pactum.llm.common import random64, ranges

VOCABULARY = "byte_bpe_50k.json"
_TOP = 0x250
_CACHE = 3_000_000
_PASS = 1 << 19
#: New pre-tokens that are learnt at once.
_TOGETHER = 8000
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts as one flat array with offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = np.full(_TOP, _OTHER, np.uint8)
        for c in range(_TOP):
            if c in (9, 10, 13, 32):
                kind[c] = _SPACE
            elif c < 32 or 0x7F <= c <= 0xA0:
                kind[c] = _ODD
            elif regex.match(r"\p{L}", chr(c)):
                kind[c] = _LETTER
            elif regex.match(r"\p{N}", chr(c)):
                kind[c] = _NUMBER
        self.kind = kind
        self.value = random64(_TOP, 7)
        base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, mask + 1))
        self.power = self.back = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)
        self.text_at = np.zeros(0, np.int64)
        self.text_length = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint16)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins and the end); end: an id put after each text."""
        if len(self.keys) > _CACHE:
            self.clear()
        parts, counts, group, size = [], [], [], 0
        for text in texts:
            if group and size + len(text) > _PASS:
                self._flush(group, end, parts, counts)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            self._flush(group, end, parts, counts)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, self.dtype)), offsets

    def _flush(self, group, end, parts, counts) -> None:
        pieces, owner = [], []
        for i, text in enumerate(group):
            for piece in self._split(text):
                pieces.append(piece)
                owner.append(i)
            if not text:
                owner.append(i)
                pieces.append("")
        ids, lengths = self._pass(pieces)
        per_text = np.bincount(owner, weights=lengths, minlength=len(group)).astype(np.int64)
        if end is not None:
            with_end = np.empty(len(ids) + len(group), self.dtype)
            stops = np.cumsum(per_text + 1) - 1
            mask = np.ones(len(with_end), bool)
            mask[stops] = False
            with_end[mask] = ids
            with_end[stops] = end
            ids, per_text = with_end, per_text + 1
        parts.append(ids)
        counts.append(per_text)

    @staticmethod
    def _split(text: str):
        """A very long text in parts that begin with a space between two letters."""
        at = 0
        while len(text) - at > 4 * _PASS:
            to = text.rfind(" ", at + 1, at + _PASS)
            while to > at and not (text[to - 1].isalpha() and text[to + 1].isalpha()):
                to = text.rfind(" ", at + 1, to)
            if to <= at:
                break
            yield text[at:to]
            at = to
        if at < len(text):
            yield text[at:]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _pass(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        odd = np.flatnonzero((chars >= _TOP) | (self.kind[np.minimum(chars, _TOP - 1)] == _ODD))
        whole = set(np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist())
        for s in self.special:
            whole |= {i for i, t in enumerate(texts) if s in t}
        if whole:
            plain = [i for i in range(len(texts)) if i not in whole]
            ids, counts = self._plain([texts[i] for i in plain])
            starts = np.cumsum(counts) - counts
            results = dict(zip(plain, ((ids[a : a + n]) for a, n in zip(starts, counts, strict=True)), strict=True))
            rest = sorted(whole)
            results |= {i: np.array(x, self.dtype) for i, x in zip(rest, self._library([texts[i] for i in rest]), strict=True)}
            out = [results[i] for i in range(len(texts))]
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return self._plain(texts, chars, lengths)

    def _plain(self, texts, chars=None, lengths=None) -> tuple[np.ndarray, np.ndarray]:
        if chars is None:
            chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not len(chars):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        starts = self._starts(chars, offsets)
        n = len(chars)
        if len(self.power) < n:
            grow = np.full(n, self.base, np.uint64)
            grow[0] = 1
            self.power = np.cumprod(grow)
            grow[1:] = self.inverse
            self.back = np.cumprod(grow)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.value[chars] * self.power[:n], out=sums[1:])
        stops = np.append(starts[1:], n)
        keys = (sums[stops] - sums[starts]) * self.back[starts] + (stops - starts).astype(np.uint64)
        del sums
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        slots = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = slots < len(self.keys)
        known[inside] = self.keys[slots[inside]] == unique[inside]
        if not known.all():
            keys_, own = unique[~known], first[~known]
            for a in range(0, len(keys_), _TOGETHER):  # a bounded number of Python objects at once
                at = own[a : a + _TOGETHER]
                self._learn(keys_[a : a + _TOGETHER], chars, starts[at], stops[at])
            slots = np.searchsorted(self.keys, unique)
        size = self.length[slots][inverse]
        ids = self.pool[ranges(self.at[slots][inverse], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        per_text = np.diff(ends[np.searchsorted(starts, offsets)])
        bad = self._unlike(chars, starts, stops, slots, inverse)
        if not len(bad):
            return ids, per_text
        wrong = set((np.searchsorted(offsets, starts[bad], "right") - 1).tolist())
        where = np.cumsum(per_text) - per_text
        out = [np.array(self._library([t])[0], self.dtype) if i in wrong else ids[where[i] : where[i] + per_text[i]] for i, t in enumerate(texts)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _unlike(self, chars, starts, stops, slots, inverse) -> np.ndarray:
        """Pre-tokens whose cached entry is of another text, compared some thousands at a time."""
        out = []
        for a in range(0, len(starts), 1 << 15):
            b = min(a + (1 << 15), len(starts))
            own, n = slots[inverse[a:b]], stops[a:b] - starts[a:b]
            if (self.text_length[own] == n).all():
                same = self.text[ranges(self.text_at[own], n)] == chars[starts[a] : stops[b - 1]]
                if not same.all():
                    out.append(np.unique(np.searchsorted(starts, starts[a] + np.flatnonzero(~same), "right") - 1))
                continue
            for i, s, m in zip(range(a, b), own.tolist(), n.tolist(), strict=True):
                at = self.text_at[s]
                if self.text_length[s] != m or (self.text[at : at + m] != chars[starts[i] : stops[i]]).any():
                    out.append(np.array([i]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _starts(self, chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, by the byte-level split pattern."""
        n = len(chars)
        kind = self.kind[chars]
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        head = head[:n]
        run = head.copy()
        run[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        start = run.copy()
        after = np.flatnonzero(run & ~space & ~head)
        after = after[space[after - 1]]
        start[after - 1] = True  # the last white space before a word stands alone or joins it
        start[after[chars[after - 1] == 32]] = False
        quote = np.flatnonzero(run & (chars == 39))
        if len(quote):
            quote = quote[(quote + 1 < n)]
            quote = quote[head[quote] | (chars[np.maximum(quote - 1, 0)] != 32)]
            quote = quote[(kind[quote + 1] == _LETTER) & ~head[quote + 1]]
            one = chars[quote + 1]
            two = np.where((quote + 2 < n) & ~np.append(head, True)[np.minimum(quote + 2, n)], chars[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for mask, size in ((short, 2), (long & ~short, 3)):
                q = quote[mask]
                start[q + 1] = False
                q = q[q + size < n]
                q = q[(kind[q + size] == _LETTER) & ~head[q + size]]
                start[q + size] = True
        return np.flatnonzero(start)

    def _learn(self, keys, chars, starts, stops) -> None:
        strings = [chars[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        found: list = [None] * len(strings)
        joined = [i for i, s in enumerate(strings) if len(s) > 1 and s[0] == " " and s[1:].isalpha()]
        for a in range(0, len(joined), 500):
            part = joined[a : a + 500]
            encoding = self.library.encode("".join(strings[i] for i in part), add_special_tokens=False)
            where = np.array(encoding.word_ids)
            if len(where) and where[-1] == len(part) - 1:
                cuts = np.searchsorted(where, np.arange(len(part) + 1))
                ids = np.array(encoding.ids, self.dtype)
                for j, i in enumerate(part):
                    found[i] = ids[cuts[j] : cuts[j + 1]]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self._library([strings[i] for i in rest]), strict=True):
            found[i] = np.array(ids, self.dtype)
        length = np.array([len(x) for x in found], np.int64)
        at = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, *found])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.length = np.insert(self.length, where, length)
        self.text_at = np.insert(self.text_at, where, len(self.text) + np.cumsum(stops - starts) - (stops - starts))
        self.text_length = np.insert(self.text_length, where, stops - starts)
        self.text = np.concatenate([self.text, chars[ranges(starts, stops - starts)].astype(np.uint16)])


def encoder(path: str, _kept: dict = {}) -> Encoder:  # noqa: B006  one encoder for each worker
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
