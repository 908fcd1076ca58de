"""Operator 2: SimHash near-duplicates, linked through BK-trees over shards of the fingerprints.

Two fingerprints that differ in at most `radius` bits agree on at least blocks-radius of their equal bit blocks, so
every choice of that many blocks deals the fingerprints into shards that hold each pair at least once.  A shard gets
its own BK-tree (children keyed by the integer distance to the parent) and every member follows only the edges within
the radius.  Shards that are too large for one tree are dealt again by their free bits, as often as it takes.  Trees
travel to their shard's task, not to all executors: together they grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import LOWER, SPACED, batch, chunks, columns, cut, discarding, grown, packed, spaced, unpacked, words
from tapebook.llm.graph import components

SEED = 42
#: A shard with more members is dealt again by its free bits.
SHARD = 4096


# ---------------------------------------------------------------- fingerprints


def _bit_counts(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of the values of[i]:of[i+1] have each bit, most significant first."""
    out = np.zeros((len(of) - 1, 64), dtype=np.int64)
    full = np.flatnonzero(np.diff(of))
    step = 1 << 16
    for a in range(0, len(h), step):
        z = min(len(h), a + step)
        bits = np.unpackbits(h[a:z].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        here = full[np.searchsorted(of[full + 1], a, "right") : np.searchsorted(of[full], z)]
        out[here] += np.add.reduceat(bits, np.maximum(of[here] - a, 0), axis=0, dtype=np.int32)
    return out


def _fingerprints(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for c in chunks(column):
        c.buf = LOWER[c.buf]
        flat, w = spaced(c, words(c, SPACED))
        n = np.diff(w.of)
        count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
        of = np.concatenate(([0], np.cumsum(count)))
        first = np.arange(of[-1]) + np.repeat(w.of[:-1] - of[:-1], count)
        last = np.minimum(first + shingle, np.repeat(w.of[1:], count)) - 1
        raw = flat.tobytes()
        places = map(slice, w.start[first].tolist(), w.end[last].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(raw.__getitem__, places), repeat(SEED)), dtype=np.uint64, count=int(of[-1]))
        bits = 2 * _bit_counts(h, of) > count[:, None]
        yield np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The carried columns and fp (64 bits as a long) of each row's whole text.

    Words are runs without ASCII white space, A-Z lower-cased; a bit is set if it is in over half of the XXH64 values
    (seed 42) of the shingles, repeats counted. Fewer words than a shingle: the whole sequence. None, or null: zero. A text
    of any length is taken whole, its bits counted in parts of 65,536 shingles."""
    docs = columns(documents, *carry, "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.concatenate([*_fingerprints(b.column("text"), shingle), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])

    return docs.mapInArrow(of, grown(docs.schema.fields[:-1], "fp long"))


# ---------------------------------------------------------------- shards and trees


class BKTree:
    """Distinct 64-bit values; node k's children are keyed by their distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        work = [np.arange(len(values))] if len(values) else []
        while work:
            group = work.pop()  # its first member is the node, the rest its descendants
            rest = group[1:]
            away = np.bitwise_count(values[rest] ^ values[group[0]])
            for d in np.unique(away):
                below = rest[away == d]
                self.children[group[0]][int(d)] = int(below[0])
                work.append(below)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it); each query follows only the edges that can hold a match."""
        work = [(0, np.arange(len(queries)))] if len(self.values) else []
        while work:
            node, asked = work.pop()
            away = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            hit = asked[away <= radius]
            if len(hit):
                yield node, hit
            for d, child in self.children[node].items():
                go = asked[np.abs(away - d) <= radius]
                if len(go):
                    work.append((child, go))


def _join(label: np.ndarray, members: np.ndarray) -> None:
    """Give the classes of the members their smallest label."""
    if len(members) > 1:
        seen = label[members]
        low = seen.min()
        if (seen != low).any():
            label[np.isin(label, seen)] = low


def classes(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct values, the position of its class: linked within the radius, directly or not."""
    label = np.arange(len(values))
    for _, hit in BKTree(values).within(values, radius):
        _join(label, hit)
    return label


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _link_shards(shards: DataFrame, radius: int) -> DataFrame:
    """shards (members array<long>) -> edges from members to their class."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(b.num_rows):
                fp = b.column(0)[i].values.to_numpy()
                label = classes(fp.view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(len(fp)))
                us.append(fp[moved])
                vs.append(fp[label[moved]])
            yield batch(_EDGES, np.concatenate(us), np.concatenate(vs))

    return shards.select("members").mapInArrow(of, "u long, v long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """The bits in n nearly equal runs, as masks; empty runs fall away."""
    return [m for k in range(n) if (m := sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(df: DataFrame, onward: dict[int, list[int]]) -> DataFrame:
    """df (fp, mask), one row for each mask that its mask goes on to: mask, and key, what it shows of fp."""
    to = F.create_map(*[x for m, more in onward.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in more]))])
    return df.select("fp", F.explode(to[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, radius: int = 2, blocks: int = 4, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column fp, distinct) reachable by steps of at most radius bits.

    Shards of one member are dropped before any is gathered. Those of more than `shard` members are dealt again by radius + 1
    blocks of their free bits, one of which every near pair shares; a few such rounds leave fewer free bits than make up that
    many members."""
    masks = [sum(some) for some in combinations(_blocks(list(range(64)), blocks), blocks - radius)]
    dealt = _deal(fps.select("fp", F.lit(0).cast("long").alias("mask")), {0: masks})
    found = []
    while True:
        counted = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        several = cut(dealt.join(counted, ["mask", "key"]), "shards", "lz4")
        fits = (F.col("n") <= shard) | (F.bit_count(F.bitwise_not("mask")) <= radius)
        found.append(_link_shards(several.filter(fits).groupBy("mask", "key").agg(F.collect_list("fp").alias("members")), radius))
        many = several.filter(~fits)
        if many.first() is None:
            return reduce(DataFrame.unionAll, found)
        onward = {m: [m | k for k in _blocks([b for b in range(64) if not m >> b & 1], radius + 1)] for m in masks}
        masks = sorted({k for more in onward.values() for k in more})
        dealt = _deal(many.select("fp", "mask"), onward)


def rooted(docs: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of every fingerprint of docs: equal roots are reachable from one another."""
    own = docs.select("fp").distinct()
    with discarding():
        comps = cut(components(links(own, radius)), "simhash-roots", keep=True)
    return own.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of documents: doc_id, fp, component_id: the smallest doc_id reachable over links, itself included.

    Equal fingerprints (empty texts too) are linked. Repeated rows stay; a null doc_id gets its component's smallest id,
    or null if the component has none."""
    docs = cut(fingerprints(documents, shingle=shingle), "simhash")
    roots = rooted(docs, radius)
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(ids, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for radius 2 and 3-word shingles."""
    df = near_duplicates(documents)
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """documents with one row of each component: the smallest doc_id's (null first, then by text hash); columns as they were.

    Of rows with the same doc_id and text one stays, whichever."""
    keys = [F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64("text", "doc_id").alias("_b")]
    docs = cut(fingerprints(documents.select("doc_id", "text", *keys), ("doc_id", "_a", "_b"), shingle), "simhash")
    roots = rooted(docs, radius)
    first = F.min(F.struct("doc_id", "_a", "_b")).alias("first")
    per_fp = docs.groupBy("fp").agg(first).join(roots, "fp")
    kept = per_fp.groupBy("root").agg(F.min("first").alias("first")).select("first._a", "first._b")
    rows = packed(documents, "doc_id").withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64("text", "doc_id")})
    return unpacked(rows.join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]), documents)
