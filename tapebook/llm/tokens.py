"""Token ids by the tokenizers library, with a cache of the pieces that words repeat.

In the pre-tokenisation of both vocabularies a single space or line feed between two other characters ends a token, and
ASCII punctuation after an ASCII letter or digit starts one.  So a text's ids are the ids of its pieces in a row, and a
worker lets the library encode each distinct piece once.  Pieces of up to 16 bytes are found in a numpy table by all
their bytes, so known words cost no Python object; longer ones in a dictionary.  Texts with runs of spaces, or pieces
that border on other white space, are encoded whole.  Tests hold both ways against each other.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from tapebook.llm.common import Chunk, block, chunks, eights, mix

#: Pieces that a worker remembers; beyond it, it starts anew.
CACHE = 600_000
#: Pieces of more bytes are looked up one by one, and kept up to KEPT bytes.
SHORT, KEPT = 15, 256
#: Pieces that the library encodes in one text, and what may stand between them.
TOGETHER, MARKS = 40, ("\n", " ~ ", " ^ ", " | ")

_END = 0xFF  # in no UTF-8 text: stands before and between the texts of a chunk
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, 0x0A, _END]] = False
_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[0x30:0x3A] = _ASCII_WORD[0x41:0x5B] = _ASCII_WORD[0x61:0x7B] = True
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_PUNCTUATION = _VISIBLE & ~_ASCII_WORD
_PUNCTUATION[0x27] = False  # an apostrophe may belong to the letters after it

_encoders: dict[str, Encoder] = {}


class _Table:
    """Pieces of up to 15 bytes, as two numbers that tell them apart, to row numbers; open addressing."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros(1 << bits, np.int32)

    def find(self, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Row numbers; -2 where unknown."""
        out = np.full(len(h), -2, np.int32)
        todo, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            there = self.high[at]
            hit = (there == high[todo]) & (self.low[at] == low[todo])
            out[todo[hit]] = self.rows[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & int(self.mask)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, h: np.ndarray, rows: np.ndarray) -> None:
        """Distinct new pieces."""
        todo, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.high[at] == 0)
            place, first = np.unique(at[free], return_index=True)
            taken = todo[free[first]]
            self.low[place], self.high[place], self.rows[place] = low[taken], high[taken], rows[taken]
            on = np.ones(len(todo), bool)
            on[free[first]] = False
            todo, at = todo[on], (at[on] + 1) & int(self.mask)


class Encoder:
    """Whole texts to ids (uint32 arrays)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = next((m for m in MARKS if self._parts(m)), None)
        self.clear()

    def clear(self) -> None:
        self.table, self.rows, self.used = _Table(21), 0, 0
        self.longer: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, mark: str) -> bool:
        """Whether texts around the mark keep their own ids, with one id between them."""
        some = ["a", " a", ",", " ,", "1", " 1", "'s", "Ab", " é", "$.", "漢"]
        own = self.whole([*some, mark])
        joined = self.whole([a + mark + b for a in some for b in some])
        return len(own[-1]) == 1 and joined == [x + own[-1] + y for x in own[:-1] for y in own[:-1]]

    def _each(self, pieces: list[str]) -> list[list[int]]:
        """Ids of every piece: some hundred in one text, with the mark between them, and apart where they do not come out even."""
        if self.mark is None:
            return self.whole(pieces)
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        (between,), *found = self.whole([self.mark, *map(self.mark.join, groups)])
        out: list[list[int]] = []
        for group, ids in zip(groups, found):
            at = [-1, *(i for i, x in enumerate(ids) if x == between), len(ids)]
            out += [ids[a + 1 : z] for a, z in zip(at, at[1:])] if len(at) == len(group) + 1 else self.whole(group)
        return out

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encode new pieces; their row numbers, -1 for those that may not stand alone."""
        skip = buf[start] == _END
        first = buf[start + skip]
        glued = (first == 0x20) | (first == 0x0A)
        inner = buf[np.minimum(start + skip + glued, len(buf) - 1)]
        plain = _VISIBLE[inner] & _VISIBLE[buf[end - 1]]
        texts = [buf[s:e].tobytes().decode() for s, e in zip((start + skip).tolist(), end.tolist())]
        for i in np.flatnonzero(~plain).tolist():
            t = texts[i][1:] if glued[i] else texts[i]
            plain[i] = not (t[0].isspace() or t[-1].isspace()) and t[0].isprintable() and t[-1].isprintable()
        broken = plain & (first == 0x0A)  # a line feed beside the mark would not be a single one
        known: list[list[int]] = [[]] * len(texts)
        for some, encoded in ((plain & ~broken, self._each), (broken, self.whole)):
            at = np.flatnonzero(some).tolist()
            for i, ids in zip(at, encoded([texts[i] for i in at])):
                known[i] = ids
        known = [known[i] for i in np.flatnonzero(plain)]
        flat = np.fromiter(chain.from_iterable(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(size) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        rows = np.full(len(texts), -1, np.int32)
        rows[plain] = np.arange(self.rows, self.rows + len(size))
        self.start[self.rows : self.rows + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.rows : self.rows + len(size)] = size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.rows = self.used + len(flat), self.rows + len(size)
        return rows

    def _short(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row numbers of pieces of at most SHORT bytes."""
        values, size = eights(buf), end - begin
        low, high = block(values, begin, size), size.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(size > 8)
        high[more] |= block(values, begin[more] + 8, size[more] - 8)
        h = mix(low ^ mix(high))
        rows = self.table.find(low, high, h)
        while len(new := np.flatnonzero(rows == -2)):
            at = new[np.unique(h[new], return_index=True)[1]]  # of different pieces with one hash one now, the others after it
            rows[at] = self._learn(buf, begin[at], end[at])
            self.table.add(low[at], high[at], h[at], rows[at])
            rows[new] = self.table.find(low[new], high[new], h[new])
        return rows

    def _long(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row numbers of longer pieces."""
        texts = [buf[s:e].tobytes() for s, e in zip(begin.tolist(), end.tolist())]
        places: dict[bytes, int] = {}
        for i, t in enumerate(texts):
            if t not in self.longer:
                places.setdefault(t, i)
        if places:
            at = np.array(list(places.values()))
            learned = self._learn(buf, begin[at], end[at]).tolist()
            self.longer.update((t, r) for t, r in zip(places, learned) if len(t) <= KEPT)
            places = dict(zip(places, learned))
        return np.array([self.longer[t] if t in self.longer else places[t] for t in texts], np.int32)

    def encode_chunk(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts in a row, and where each text's begin and the last one's end."""
        if self.rows > CACHE:
            self.clear()
        buf = np.concatenate((np.array([_END], np.uint8), c.buf))
        buf[c.off[1:]] = _END
        solid, word, mark = _SOLID[buf], _ASCII_WORD[buf], _PUNCTUATION[buf]
        turn = word[:-1] & mark[1:]
        after = ~solid[:-1]
        start = np.flatnonzero(solid[1:] & (after | turn)) + 1
        end = np.flatnonzero(solid[:-1] & (~solid[1:] | turn)) + 1
        glue = after[start - 1]
        begin = start - glue
        of = np.searchsorted(start, c.off + 1)
        long = end - begin > SHORT
        rows = np.empty(len(begin), np.int32)
        rows[~long] = self._short(buf, begin[~long], end[~long])
        rows[long] = self._long(buf, begin[long], end[long])
        breaks = np.concatenate(([0], np.cumsum(~solid)))
        units = np.concatenate(([0], np.cumsum(glue)))
        odd = units[of[1:]] - units[of[:-1]] != breaks[c.off[1:] + 1] - breaks[c.off[:-1] + 1]
        bad = np.concatenate(([0], np.cumsum(rows < 0)))
        odd |= bad[of[1:]] != bad[of[:-1]]
        odd &= np.diff(c.off) > 1
        rows = np.maximum(rows, 0)
        size = self.size[rows]
        if odd.any():
            size[np.repeat(odd, np.diff(of))] = 0
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(stop[-1]) + np.repeat(self.start[rows] - stop[:-1], size)]
        at = stop[of]
        if not odd.any():
            return ids, at
        strange = np.flatnonzero(odd)
        raw = c.buf.tobytes()
        longer = self.whole([raw[c.off[i] : c.off[i + 1] - 1].decode() for i in strange])
        parts, last = [], 0
        count = np.diff(at)
        for i, more in zip(strange.tolist(), longer):
            parts += [ids[last : at[i]], np.array(more, np.uint32)]
            last, count[i] = at[i], len(more)
        return np.concatenate([*parts, ids[last:]]), np.concatenate(([0], np.cumsum(count)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for c in chunks(pa.array(texts, pa.string())):
            ids, at = self.encode_chunk(c)
            out += [ids[a:z] for a, z in zip(at[:-1], at[1:])]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; it and its cache live as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
