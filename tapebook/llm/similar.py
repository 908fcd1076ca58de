"""Near-duplicates by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash links within two bits reach near-identical texts only (texts of similarity 0.8 differ in 5 to 14 of 64 bits).
This pass goes beyond them: 16 bands of 4 minimum hashes bring candidates together (a pair of similarity 0.8 meets with
probability 0.9998), parity sketches rule out what cannot be similar, the rest is verified on whole texts, and verified
links make components.

A bucket's members are compared with two heads of it first.  Buckets whose members are then still in several components
are gone through pair by pair: every pair over two components whose parity sketches do not rule the similarity out is
verified, a growing share of all pairs a round, so that what has become one component is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm import simhash
from tapebook.llm.common import LOWER, SPACED, Chunk, chunks, columns, cut, discarding, mix, packed, span_hash, unpacked, window_hash, words
from tapebook.llm.graph import components

BANDS, ROWS = 16, 4
#: Bits of a parity sketch.
BITS = 1024
#: At most about so many members of a bucket meet so many others in one group.
LEFT, RIGHT = 2048, 8192
#: With more open pairs than these, the shares of all pairs that rounds go up to.
AT_ONCE = 10_000_000
SHARES = (1 / 32, 1.0)
#: A document's text goes to its pairs' tasks once for so many pairs.
SHARE = 256
_ODD = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).reshape(BANDS, ROWS)


def shingles(c: Chunk, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles (fewer words: the whole sequence; none: nothing), and where each text's begin."""
    low = LOWER[c.buf]
    w = words(c, SPACED)
    h = span_hash(low, w.start, w.end)
    n = np.diff(w.of)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    of = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(of[-1], np.uint64)
    for k in range(1, size + 1):
        some = np.flatnonzero(n == k if k < size else n >= size)
        if len(some):
            place = np.arange(count[some].sum()) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            out[np.repeat(of[some], count[some]) + place] = window_hash(h, k)[np.repeat(w.of[some], count[some]) + place]
    return out, of


def _bands(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Per text its band keys (texts without shingles: zeros)."""
    full = np.flatnonzero(np.diff(of))
    out = np.zeros((len(of) - 1, BANDS), np.int64)
    for b in range(BANDS if len(full) else 0):
        key = np.zeros(len(full), np.uint64)
        for r in range(ROWS):
            key = mix(key + np.minimum.reduceat(h * _ODD[b, r], of[full]))
        out[full, b] = key.view(np.int64)
    return out


def _parities(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each text's shingles the number of different ones, and for each of BITS places whether an odd number of them falls
    there. Two sets differ in at least as many shingles as their sketches in bits."""
    n = len(of) - 1
    text = np.repeat(np.arange(n), np.diff(of))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))[: len(h)]
    text, h = text[fresh], h[fresh]
    odd = np.bincount(text * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=n * BITS) & 1
    return np.bincount(text, minlength=n), [row.tobytes() for row in np.packbits(odd.astype(bool).reshape(n, BITS), axis=1)]


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(node, bands, many, bits) of docs (node, text): band keys, number of different shingles, parities. Texts without words
    have no row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                h, at = shingles(c, size)
                keys = _bands(h, at)
                many, bits = _parities(h, at)
                some = np.flatnonzero(many)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys[some].ravel()))
                node = b.column(0).slice(c.first, c.n).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([node, lists, pa.array(many[some]), pa.array([bits[i] for i in some], pa.binary())], names=["node", "bands", "many", "bits"])

    return docs.mapInArrow(of, "node long, bands array<long>, many long, bits binary")


def buckets(sketches: DataFrame) -> DataFrame:
    """(band, key, node, n, score): the members of buckets with several; n of this bucket, score the sum of all the node's."""
    keyed = sketches.select("node", F.posexplode("bands").alias("band", "key"))
    several = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    member = keyed.join(several, ["band", "key"])
    score = member.groupBy("node").agg(F.sum("n").alias("score"))
    return cut(member.join(score, "node").select("band", "key", "node", "n", "score"), "buckets", "lz4")


def candidates(rated: DataFrame) -> DataFrame:
    """(u, v): each document u with two others of each band bucket that it is in: the smallest node, and the one that shares
    most buckets with others (the original of a group of copies). Linear in a bucket's size; open_pairs() has the rest."""
    heads = rated.groupBy("band", "key").agg(F.min("node").alias("least"), F.max(F.struct("score", "node")).alias("most"))
    pairs = rated.join(heads.select("band", "key", "least", F.col("most.node").alias("most")), ["band", "key"])
    return pairs.select(F.col("node").alias("u"), F.explode(F.array("least", "most")).alias("v")).filter("u <> v").distinct()


def _can(away: np.ndarray, mu: np.ndarray, mv: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of so many shingles, whose sketches are so many bits apart, can reach the similarity."""
    return away * (1 + similarity) <= (mu + mv) * (1 - similarity) + 1e-6


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that their sketches do not rule out."""
    side = lambda n: sketches.select(F.col("node").alias(n), F.col("many").alias(f"m{n}"), F.col("bits").alias(f"b{n}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "mu", "mv", "bu", "bv")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mu, mv = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            bu, bv = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (4, 5))
            yield b.filter(pa.array(_can(np.bitwise_count(bu ^ bv).sum(axis=1, dtype=np.int64), mu, mv, similarity))).select([0, 1])

    return both.mapInArrow(of, "u long, v long")


def open_buckets(rated: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (band, key, node, root) of the buckets that may have untested pairs, and those buckets (band, key, main, lefts,
    n): members are in several components, and there are more than three (of three, the heads have met all)."""
    member = rated.filter("n > 3").join(found, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    member = cut(member, "members", "lz4")
    parts = member.groupBy("band", "key", "root").agg(F.count("*").alias("c"))
    whole = parts.groupBy("band", "key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("n")).filter("main.c < n")
    return member, cut(whole.select("band", "key", F.col("main.root").alias("main"), (F.col("n") - F.col("main.c")).alias("lefts"), "n"), "open", "lz4")


def open_pairs(member: DataFrame, opened: DataFrame, sketches: DataFrame, low: float, high: float, similarity: float) -> DataFrame:
    """(u, v): the pairs of a bucket's members of different components, of the share low to high of all pairs, that can reach
    the similarity by their sketches. Members outside the bucket's largest component meet all members, in bounded groups."""
    rows = member.join(opened, ["band", "key"]).join(sketches.select("node", "many", "bits"), "node")
    rows = rows.withColumns({"lefts": F.ceil(F.col("lefts") / LEFT), "rights": F.ceil(F.col("n") / RIGHT), "is_main": F.col("root") == F.col("main")})
    place = F.xxhash64("node", "band")
    each = ["node", "root", "many", "bits", "is_main"]
    left = rows.filter("NOT is_main").select("band", "key", F.pmod(place, "lefts").alias("i"), F.explode(F.expr("sequence(0L, rights - 1)")).alias("j"), F.lit(True).alias("left"), *each)
    right = rows.select("band", "key", F.explode(F.expr("sequence(0L, lefts - 1)")).alias("i"), F.pmod(place, "rights").alias("j"), F.lit(False).alias("left"), *each)
    groups = left.unionAll(right).groupBy("band", "key", "i", "j").agg(F.collect_list(F.struct("left", *each)).alias("members")).select("members")
    first, last = np.uint64(int(low * 2**53)), np.uint64(int(high * 2**53))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                inner = b.column(0)[k].values
                is_left, node, root, many, is_main = (inner.field(f).to_numpy(zero_copy_only=False) for f in (0, 1, 2, 3, 5))
                bits = np.frombuffer(b"".join(inner.field(4).to_pylist()), np.uint64).reshape(-1, BITS // 64)
                x, y = np.flatnonzero(is_left), np.flatnonzero(~is_left)
                name = node.view(np.uint64)
                step = max(1, 500_000 // max(1, len(y)))
                for a in range(0, len(x), step):
                    some = x[a : a + step, None]
                    share = ((name[some] ^ name[y]) * _ODD[0, 0]) >> np.uint64(11)
                    i, j = np.nonzero((root[some] != root[y]) & (is_main[y] | (node[some] < node[y])) & (share >= first) & (share < last))
                    i, j = x[a + i], y[j]
                    for z in range(0, len(i), 50_000):
                        u, v = i[z : z + 50_000], j[z : z + 50_000]
                        away = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
                        can = _can(away, many[u], many[v], similarity)
                        u, v = node[u[can]], node[v[can]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return groups.mapInArrow(of, "u long, v long").distinct()


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) + 1e-9 < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common + 1e-9 >= similarity * (len(x) + len(y) - common)


def verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets reach the similarity, taken on whole texts.

    A pair carries the text of u; that of v comes before SHARE or so of its pairs, sorted to one task, which goes through
    them one after another: it holds one set besides a batch, however many pairs v has."""
    text = lambda n: docs.select(F.col("node").alias(n), "text")
    shares = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = pairs.join(shares, "v").select("u", "v", F.pmod(F.xxhash64("u"), "shares").alias("share"))
    heads = dealt.select("v", "share").distinct().join(text("v"), "v").select("v", "share", F.lit(None).cast("bigint").alias("u"), "text")
    rows = heads.unionByName(dealt.join(text("u"), "u").select("v", "share", "u", "text"))
    in_order = rows.repartition("v", "share").sortWithinPartitions("v", "share", F.col("u").asc_nulls_first()).select("v", "u", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for b in batches:
            v, u = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep: list[int] = []
            for c in chunks(b.column(2)):
                h, at = shingles(c, size)
                for i in range(c.n):
                    own = np.unique(h[at[i] : at[i + 1]])
                    if u[c.first + i] is None:
                        head = own
                    elif _alike(own, head, similarity):
                        keep.append(c.first + i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], names=["u", "v"])

    return in_order.mapInArrow(of, "u long, v long")


def grouped(docs: DataFrame, size: int, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes of docs (node, text; nodes distinct) that are similar to others, or linked by known edges."""
    with discarding():
        return cut(_grouped(docs, size, similarity, known), "grouped", keep=True)


def _grouped(docs: DataFrame, size: int, similarity: float, known: DataFrame | None) -> DataFrame:
    sketches = cut(sketched(docs, size), "sketches", "lz4")
    rated = buckets(sketches)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs", "lz4")
        asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        with discarding():
            texts = cut(docs.join(asked, "node", "left_semi"), "pair-texts")  # of candidates only
            return cut(verified(pairs, texts, size, similarity), "similar", "lz4", keep=True)

    # one pair of each document first: in a group of copies that makes most others needless before their texts are moved
    pairs = cut(possible(candidates(rated), sketches, similarity), "candidates", "lz4")
    first = pairs.groupBy("u").agg(F.min("v").alias("v"))
    links = linked(first)
    found = cut(components(links if known is None else links.unionAll(known)), "first-classes", "lz4")
    root_of = lambda n: found.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    apart = pairs.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").filter("coalesce(ru, u) <> coalesce(rv, v)")
    new = linked(apart.select("u", "v"))
    if new.first() is not None:
        found = joined(found, new)
    low = 0.0
    while low < 1:
        member, opened = open_buckets(rated, found)
        work = opened.agg(F.sum(F.col("lefts") * F.col("n"))).first()[0]
        if not work:
            break
        high = 1.0 if work <= AT_ONCE else min(s for s in SHARES if s > low)
        new = linked(open_pairs(member, opened, sketches, low, high, similarity))
        if new.first() is not None:
            found = joined(found, new)
        low = high
    return found


def joined(found: DataFrame, new: DataFrame) -> DataFrame:
    """found (node, root), with the components that new edges (u, v) link as one: only their roots are gone through again."""
    root_of = lambda n: found.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    between = new.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    moved = cut(components(between.filter("u <> v").distinct()), "moved", "lz4")
    known = found.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(known.unionByName(moved.join(found.select("node"), "node", "left_anti")), "classes", "lz4")


def one_of_similar(documents: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents with one document of each component of similar ones: the smallest doc_id's (null first); columns as they
    were. Texts without words are similar to nothing. Rows alike in doc_id and text count as one document and share its fate."""
    docs = columns(documents, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("node"), "text")
    docs = cut(docs.dropDuplicates(["node"]), "texts")
    found = grouped(docs.select("node", "text"), size, similarity)
    ids = found.join(docs.select("node", "doc_id"), "node")
    first = ids.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("root", "first.node")
    dropped = found.join(first, ["root", "node"], "left_anti").select(F.col("node").alias("_node"))
    rows = packed(documents, "doc_id").withColumn("_node", F.xxhash64("doc_id", "text"))
    return unpacked(rows.join(dropped, "_node", "left_anti"), documents)


def one_of_near(documents: DataFrame, radius: int = 2, shingle: int = 3, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents with one row of each component over SimHash links and similar pairs together: the smallest doc_id's (null
    first, then by text hash); columns as they were. Equal texts are one node. Of rows with the same doc_id and text one stays."""
    keys = [F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64("text", "doc_id").alias("_b")]
    docs = columns(documents, "doc_id", "text").withColumn("node", F.xxhash64("text"))
    with discarding():
        found = cut(_near(docs, radius, shingle, size, similarity), "near", keep=True)
    ids = docs.select("doc_id", "node", *keys).join(found, "node", "left")
    kept = ids.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "_a", "_b")).alias("first")).select("first._a", "first._b")
    rows = packed(documents, "doc_id").withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64("text", "doc_id")})
    return unpacked(rows.join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]), documents)


def _near(docs: DataFrame, radius: int, shingle: int, size: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes of docs (doc_id, text, node) that are linked to others in either way."""
    texts = cut(docs.select("node", "text").dropDuplicates(["node"]), "texts")
    prints = cut(simhash.fingerprints(texts, ("node",), shingle), "simhash")
    class_of = prints.join(simhash.rooted(prints, radius), "fp").select("node", "root")
    heads = class_of.groupBy("root").agg(F.min("node").alias("v"))
    known = cut(class_of.join(heads, "root").filter("node <> v").select(F.col("node").alias("u"), "v"), "simhash-links")
    return grouped(texts, size, similarity, known)
