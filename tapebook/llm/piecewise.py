"""Operator 12: document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text.  A byte is a boundary of level k if the hash ends in k zero bits, so
every boundary of a level is one of the level below, and a chunk is what lies between two.  A chunk's symbol has twelve
bits, written as two characters.  The level of a text is the lowest with at most PIECES boundaries: no signature is longer
than that, whatever the text, and none is cut off.  A fingerprint holds the signatures of that level and the two above,
so that texts whose lengths or contents differ have a level in common; they are compared at the lowest such level, by
edit distance over symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapebook.llm.common import CHUNK_BYTES, columns, cut, grown

WINDOW = 7
PIECES = 64
REPEAT = 32
LEVELS = 3
_SYMBOLS = 1 << 12
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_NUMBER = np.zeros(256, np.int16)
_NUMBER[_LETTERS] = np.arange(64)
#: Bytes that are hashed at once; only three bytes a byte of text are kept.
_STEP = CHUNK_BYTES + 64
_FACTOR = 0x9E3779B1


@dataclass
class Print:
    """Signatures of the levels first, first + 1, ...: arrays of symbols. At level k chunks are about 2**k bytes long."""

    first: int
    signatures: list[np.ndarray]

    def __str__(self) -> str:
        return ":".join([str(1 << self.first), *(_letters(s) for s in self.signatures)])


def _letters(symbols: np.ndarray) -> str:
    return _LETTERS[np.stack((symbols >> 6, symbols & 63), 1).ravel()].tobytes().decode()


def parsed(fingerprint: str) -> Print:
    size, *parts = fingerprint.split(":")
    each = [_NUMBER[np.frombuffer(p.encode(), np.uint8)].reshape(-1, 2) for p in parts]
    return Print(int(size).bit_length() - 1, [p[:, 0] * 64 + p[:, 1] for p in each])


def _rolled(b: np.ndarray) -> np.ndarray:
    """Mixed 32-bit hashes of all runs of seven bytes: entry i is that of b[i : i + 7]."""
    m = [np.uint32(pow(_FACTOR, k, 1 << 32)) for k in (1, 2)]
    one = b.astype(np.uint32)
    two = one[:-1] * m[0] + one[1:]
    four = two[:-2] * m[1] + two[2:]
    return _mixed((four[:-3] * m[1] + two[4:-1]) * m[0] + one[6:])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def _told_apart(h: np.ndarray, at: np.ndarray) -> None:
    """Runs of bytes that come again within REPEAT bytes of the one before, as in a word said over and over, get other hashes:
    the second, the third and so on in such a chain differ. Else a text that repeats itself would have all its boundaries at
    one place of its period, or none. at: where texts begin; chains end there."""
    key = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64))
    again = np.flatnonzero(np.diff(key) <= REPEAT) + 1
    place, before = ((key[k] & np.uint64(0xFFFFFFFF)).astype(np.int64) for k in (again, again - 1))
    same = np.searchsorted(at, place, "right") == np.searchsorted(at, before, "right")
    again, place = again[same], place[same]
    head = np.flatnonzero(np.concatenate(([True], np.diff(again) != 1))[: len(again)])
    nth = np.arange(len(again)) - np.repeat(head, np.diff(np.concatenate((head, [len(again)])))) + 1
    h[place] = _mixed(h[place] + nth.astype(np.uint32) * np.uint32(_FACTOR))


def _hashed(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte from the seventh on: the level up to which it is a boundary, and its share of a chunk's symbol. Chains of
    repeats are followed within _STEP bytes, which several texts together never exceed."""
    n = len(buf) - WINDOW + 1
    level, share = np.zeros(max(n, 0), np.uint8), np.zeros(max(n, 0), np.uint16)
    for a in range(0, n, _STEP):
        h = _rolled(buf[a : min(n, a + _STEP) + WINDOW - 1])
        _told_apart(h, at - a)
        level[a : a + len(h)] = np.bitwise_count((h & (~h + np.uint32(1))) - np.uint32(1))
        share[a : a + len(h)] = h >> np.uint32(16)
    return level, share


def _print(level: np.ndarray, share: np.ndarray) -> Print:
    """The fingerprint of one text from what _hashed says of its bytes."""
    n = len(level)
    if not n:
        return Print(0, [np.zeros(0, np.int16)] * LEVELS)
    reached = np.bincount(level, minlength=33)[::-1].cumsum()[::-1]  # bytes that are boundaries of level k
    first = int(np.argmax(reached <= PIECES))
    at = np.flatnonzero(level >= first)
    high = level[at]
    start = np.concatenate(([0], at + 1)) if not len(at) or at[-1] + 1 < n else np.concatenate(([0], at[:-1] + 1))
    total = np.add.reduceat(share, start, dtype=np.uint32)
    out = []
    for k in range(first, first + LEVELS):
        begin = np.flatnonzero(np.concatenate(([True], high[: len(start) - 1] >= k)))
        h = np.add.reduceat(total, begin, dtype=np.uint32) * np.uint32(_FACTOR)
        out.append((h >> np.uint32(20)).astype(np.int16))
    return Print(first, out)


def prints(texts: Sequence[str]) -> list[Print]:
    """Fingerprints of texts, over their UTF-8 bytes. Every text counts as standing behind six zero bytes. The empty text's
    has three empty signatures."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lead, out, i = bytes(WINDOW - 1), [], 0
    while i < len(raw):
        z, size = i, 0
        while z < len(raw) and (z == i or size + len(raw[z]) <= CHUNK_BYTES):
            size += len(raw[z]) + WINDOW - 1
            z += 1
        at = np.cumsum([0, *(len(t) + WINDOW - 1 for t in raw[i:z])])
        level, share = _hashed(np.frombuffer(b"".join(x for t in raw[i:z] for x in (lead, t)), np.uint8), at)
        out += [_print(level[a : a + len(t)], share[a : a + len(t)]) for a, t in zip(at.tolist(), raw[i:z])]
        i = z
    return out


# ---------------------------------------------------------------- comparison


def _distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edit distances of pairs of symbol arrays, the whole batch a row of the table at a time."""
    na, nb = (np.array([len(x) for x in s]) for s in (a, b))
    wide = int(nb.max(initial=0))
    left, right = np.full((len(a), int(na.max(initial=0))), -1, np.int16), np.full((len(a), wide), -2, np.int16)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    place = np.arange(wide + 1, dtype=np.int16)
    row = np.tile(place, (len(a), 1))
    out = nb.copy()
    for i in range(left.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (left[:, i, None] != right), out=new[:, 1:])
        row = np.minimum.accumulate(new - place, axis=1) + place
        done = np.flatnonzero(na == i + 1)
        out[done] = row[done, nb[done]]
    return out


def likeness(a: Sequence[Print], b: Sequence[Print]) -> np.ndarray:
    """Of each pair, 1 less the edit distance at the lowest common level over the longer signature's length: 0 (also without a
    common level) to 1 (also for two empty texts)."""
    out = np.zeros(len(a))
    pairs = []
    for i, (x, y) in enumerate(zip(a, b)):
        k = max(x.first, y.first)
        if k < min(x.first + len(x.signatures), y.first + len(y.signatures)):
            pairs.append((i, x.signatures[k - x.first], y.signatures[k - y.first]))
    for some in (pairs[k : k + 512] for k in range(0, len(pairs), 512)):
        at, left, right = map(list, zip(*some))
        size = np.array([max(len(x), len(y)) for x, y in zip(left, right)])
        out[at] = 1 - _distances(left, right) / np.maximum(size, 1)
    return out


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and fingerprint of each row's whole text; null is empty. Equal texts have equal fingerprints."""
    docs = columns(documents, *carry, "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [str(p) for p in prints([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], names=[*b.schema.names[:-1], "fingerprint"])

    return docs.mapInArrow(of, grown(docs.schema.fields[:-1], "fingerprint string"))


def compared(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """pairs with the likeness of its fingerprint columns a and b; null where one of them is null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (t.column(c).to_pylist() for c in (a, b))
            both = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            found: list[float | None] = [None] * len(x)
            for i, v in zip(both, likeness([parsed(x[i]) for i in both], [parsed(y[i]) for i in both]).tolist()):
                found[i] = v
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(found, pa.float64())], names=[*t.schema.names, name])

    return pairs.mapInArrow(of, grown(pairs.schema.fields, f"{name} double"))


# ---------------------------------------------------------------- each document, its edited text and the next one

_NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edited(text: str, after: str) -> str:
    """text, its last half (rounded down, code points) replaced by the first as many of the text behind it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _measured(texts: list[str], after: list[str], own: list[Print], behind: list[Print]) -> list[list]:
    """The columns _NAMES of texts, each of which has another behind it."""
    changed = [edited(t, n) for t, n in zip(texts, after)]
    new = prints(changed)
    digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [[len(t) for t in texts], digest, [str(p) for p in own], [str(p) for p in new], likeness(own, new).tolist(), likeness(own, behind).tolist()]


def report(documents: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows stand by descending doc_id, null last, rows of one doc_id by a hash of their texts; behind the last stands the first
    (one row stands behind itself). Null text is empty. Texts are moved once: partitions are ranges of that order, each is walked
    with one row held back, and only its first and last text are written, for the ranges beside it."""
    docs = columns(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text")
    schema = f"part int, doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first boolean, text string"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["part", "doc_id", *_NAMES, "first", "text"]

    def edge(part: pa.Array, ids: pa.Array, text: str, first: bool) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in types]
        return pa.RecordBatch.from_arrays([part, ids, *none, pa.array([first]), pa.array([text], pa.string())], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before this batch: part, doc_id, text, fingerprint
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(2).to_pylist()
            own = prints(texts)
            part, ids = b.column(0), b.column(1)
            if held is None:
                yield edge(part.slice(0, 1), ids.slice(0, 1), texts[0], True)
            else:
                part, ids = pa.concat_arrays([held[0], part]), pa.concat_arrays([held[1], ids])
                texts, own = [held[2], *texts], [held[3], *own]
            n = len(texts) - 1
            if n:
                found = _measured(texts[:-1], texts[1:], own[:-1], own[1:])
                yield pa.RecordBatch.from_arrays([part.slice(0, n), ids.slice(0, n), *map(pa.array, found, types), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names=names)
            held = part.slice(n, 1), ids.slice(n, 1), texts[n], own[n]
        if held is not None:
            yield edge(held[0], held[1], held[2], False)

    rows = cut(ranged.mapInArrow(of, schema), "piecewise")
    firsts = rows.filter("first").select(F.col("part").alias("follows"), F.col("text").alias("after"))
    # the next part that has rows, of one row a part; behind the last the first
    parts = rows.filter("first").select("part")
    by_part = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("follows"))
    ends = rows.filter("NOT first").join(following, "part").join(firsts, "follows").select("doc_id", "text", "after")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, after = b.column(1).to_pylist(), b.column(2).to_pylist()
            found = _measured(texts, after, prints(texts), prints(after))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found, types)], names=["doc_id", *_NAMES])

    measured = f"doc_id {kind}, " + schema.split(", ", 2)[2].split(", first")[0]
    return rows.filter("first IS NULL").select("doc_id", *_NAMES).unionByName(ends.mapInArrow(end, measured))
