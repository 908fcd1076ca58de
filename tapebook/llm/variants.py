"""Operator 13: spelling variants, by dense tiles of common prefixes and suffixes.

Two words differ by one inserted, deleted or replaced code point if and only if their common prefix and suffix together
reach the longer length less one.  One of the two is then at least half of that, so words are dealt by their first half
and by their last half, for either length that the longer word may have; every pair meets in one such bucket or two, and
the first counts.  A bucket's words are rows of a padded matrix of code points, compared block by block; a large
bucket is cut into parts, and every two of them make a tile.  Only each word's number of near words and its best
leave a tile.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import LOWER, batch, chunks, columns, cut, drop_table, same_runs, span_hash, write_table

MIN_CHARS = 5
MIN_COUNT = 3
#: Of each run, one of so many loses a code point.
EVERY = 97
#: Words of a bucket that are compared as one part.
PART = 1024
#: Words that a task counts before it sends the counts on.
HELD = 200_000
#: Code points that are compared at once.
CELLS = 4_000_000

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: Longer runs are taken one by one.
_LONG = 64


# ---------------------------------------------------------------- words and their counts


def _register_table() -> np.ndarray:
    """What the register of a CRC-32 takes up for each value of its low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_REGISTER = _register_table()


def _runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of letters begin and end. U+00C0 to U+00FF are the characters whose first byte in UTF-8 is C3."""
    lead = low == 0xC3
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = _LETTER[low] | lead
    inside[2:-1] |= lead[:-1]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def _crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, register: np.ndarray) -> np.ndarray:
    """CRC-32 of the runs low[start:end], each behind what its register has seen: a byte of all runs at a time."""
    out = register.copy()
    size = end - start
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        r = out[live]
        out[live] = _REGISTER[(r ^ low[start[live] + at]) & np.uint32(0xFF)] ^ (r >> np.uint32(8))
        at += 1
        live = live[size[live] > at]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(register[i]) ^ 0xFFFFFFFF)
    return out


def _add(counts: dict[bytes, int], low: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Count the runs; equal hashes are checked on the bytes."""
    _, first, ids, n = np.unique(span_hash(low, start, end), return_index=True, return_inverse=True, return_counts=True)
    head = first[ids]
    size = end - start
    if (size == size[head]).all() and same_runs(low, start, start[head], size).all():
        start, end = start[first], end[first]
    else:
        n = np.ones(len(start), np.int64)
    for s, e, k in zip(start.tolist(), end.tolist(), n.tolist()):
        word = low[s:e].tobytes()
        counts[word] = counts.get(word, 0) + k


def word_counts(documents: DataFrame, min_chars: int = MIN_CHARS, every: int = EVERY) -> DataFrame:
    """(word, n): how often each result of min_chars code points or more stands in the whole texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z only); where `every` divides the CRC-32 of "<doc_id>:<run>",
    code point crc % length is deleted. A null doc_id is written as nothing; null and empty texts have no runs. Tasks count before
    anything is shuffled, and send counts on whenever they hold HELD words."""
    docs = columns(documents, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            return batch(schema, pa.array(list(counts), pa.binary()).cast(pa.string()), list(counts.values()))

        for b in batches:
            known = np.array([zlib.crc32(f"{d}:".encode()) for d in b.column(0).to_pylist()], np.uint32) ^ np.uint32(0xFFFFFFFF)
            for c in chunks(b.column(1)):
                low = LOWER[c.buf]
                start, end = _runs(low)
                text = np.searchsorted(c.off, start, "right") - 1 + c.first
                h = _crcs(low, start, end, known[text])
                lead = np.concatenate(([0], np.cumsum(low == 0xC3)))
                chars = end - start - (lead[end] - lead[start])
                cut_one = h % np.uint32(every) == 0
                whole = ~cut_one & (chars >= min_chars)
                _add(counts, low, start[whole], end[whole])
                for i in np.flatnonzero(cut_one & (chars > min_chars)).tolist():
                    run = low[start[i] : end[i]].tobytes().decode()
                    k = int(h[i]) % len(run)
                    word = (run[:k] + run[k + 1 :]).encode()
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > HELD:
                    yield sent()
                    counts.clear()
        yield sent()

    return docs.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- tiles


def _near_pairs(left: np.ndarray, size: np.ndarray, end: np.ndarray, part: np.ndarray, crossed: np.ndarray, by_suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one tile that differ by one edit. left: padded code points, as wide as the longer word of a pair;
    end: where the row's tile ends; crossed: whether the tile compares two parts. Row i meets i + 1, i + 2, ... of its tile, all
    rows at once; of pairs dealt by suffix only those count that a prefix does not bring together as well."""
    wide = left.shape[1]
    right = left.copy()
    short = np.flatnonzero(size < wide)
    right[short, 1:], right[short, 0] = left[short, :-1], 0
    right = np.ascontiguousarray(right[:, ::-1])
    long = size == wide
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    live, k = np.arange(len(left)), 1
    step = max(1, CELLS // wide)
    while len(live := live[live + k < end[live]]):
        some = live[(long[live] | long[live + k]) & (~crossed[live] | (part[live] != part[live + k]))]
        for a in range(0, len(some), step):
            i = some[a : a + step]
            j = i + k
            prefix = (left[i] != left[j]).argmax(axis=1)
            can = np.flatnonzero(~by_suffix[i] | (prefix < wide // 2))
            i, j, prefix = i[can], j[can], prefix[can]
            suffix = (right[i] != right[j]).argmax(axis=1)
            near = prefix + suffix >= wide - 1
            found.append((i[near], j[near]))
        k += 1
    i, j = map(np.concatenate, zip(*found))
    return i, j


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _matched(words: pa.Array, n: np.ndarray, wide: int, end: np.ndarray, part: np.ndarray, crossed: np.ndarray, by_suffix: np.ndarray) -> pa.RecordBatch:
    """Of the words of tiles whose longer words have `wide` code points: how many are near, and the best of them."""
    text = words.to_pylist()
    size = np.array([len(t) for t in text])
    left = np.zeros((len(text), wide), np.uint8)
    left[np.arange(wide) < size[:, None]] = np.frombuffer("".join(text).encode("latin-1"), np.uint8)
    i, j = _near_pairs(left, size, end, part, crossed, by_suffix)
    own, other = np.concatenate((i, j)), np.concatenate((j, i))
    _, rank = np.unique(left.view(f"S{wide}").ravel(), return_inverse=True)
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
    count = np.diff(np.concatenate((first, [len(own)])))
    return batch(_NEAR, words.take(pa.array(own[first])), count, n[other[first]], words.take(pa.array(other[first])))


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n; words distinct, of code points below 256) that have near ones: how many, and
    the one of largest n (ties: smallest in code-point order).

    Buckets of more than `part` words become tiles of two parts each, dealt to any tasks. No pair leaves a tile."""
    size = F.length("word")
    keys = []
    for more in (0, 1):
        n = size + more
        half = F.floor(n / 2).cast("int")
        keys += [F.struct(F.lit(side).alias("side"), n.alias("wide"), key.alias("key")) for side, key in (("prefix", F.substring("word", F.lit(1), half)), ("suffix", F.substring("word", -half, half)))]
    keyed = words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*")
    bucket = ["side", "wide", "key"]
    counted = keyed.groupBy(*bucket).agg(F.count("*").alias("members"), F.max(F.length("word")).alias("longest"))
    useful = counted.filter("members > 1 AND longest = wide").select(*bucket, F.ceil(F.col("members") / part).cast("int").alias("parts"))
    dealt = keyed.join(useful, bucket).withColumn("part", F.expr("pmod(xxhash64(word), parts)").cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("part", x).alias("a"), F.greatest("part", x).alias("b")))
    each = dealt.select(*bucket, "word", "n", "part", F.explode(tiles).alias("tile"))
    grouped = each.groupBy("tile", *bucket).agg(F.collect_list(F.struct("word", "n", "part")).alias("members"))
    rows = grouped.select("wide", (F.col("side") == "suffix").alias("by_suffix"), (F.col("tile.a") != F.col("tile.b")).alias("crossed"), "members")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column(0).to_numpy()
            for wide in np.unique(widths).tolist():
                some = b.filter(pa.array(widths == wide))
                by_suffix, crossed = (some.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                members = some.column(3)
                many = members.value_lengths().to_numpy(zero_copy_only=False)
                flat = members.flatten()
                n, own = (flat.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                yield _matched(flat.field(0), n, wide, np.repeat(np.cumsum(many), many), own, np.repeat(crossed, many), np.repeat(by_suffix, many))

    near = rows.mapInArrow(of, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


# ---------------------------------------------------------------- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Ways are halved, so rounds grow with the logarithm of the longest;
    each is written, and the one before it removed. Forms must not go round in a circle (here their n doubles at each step)."""
    spark = forms.sparkSession
    now = forms.select("word", F.col("form").alias("root"))
    schema = now.schema
    path = write_table(now, "roots")
    while True:
        now = spark.read.schema(schema).parquet(path)
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if now.join(ahead, "root", "left_semi").first() is None:
            return now
        after = write_table(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
        drop_table(spark, path)
        path = after


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): form is the near word of largest n, if that is at least twice the
    word's; root is where forms end, the word itself without a form. form_n is null without a form."""
    known = words.join(near_words(words), "word", "left")
    clear = F.col("form_n") >= 2 * F.col("n")
    named = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("form")).alias("form"), F.when(clear, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(named.filter("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(documents: DataFrame) -> DataFrame:
    """The variants among all words of MIN_CHARS code points and MIN_COUNT occurrences or more. No such word: no rows."""
    return grouped(cut(word_counts(documents).filter(F.col("n") >= MIN_COUNT), "words"))
