"""Operator 11: hard negatives by lists that the anchors of a cluster share.

Anchors of one label are clustered by direction.  Over a block of candidates every cluster sorts the candidates once by
an upper bound of their score with any member, |x| cos(max(0, angle to the centre - the cluster's spread)); each member
walks that list until the bound shows that nothing behind it can enter the member's result, so the result is exact.

The anchors are taken in slices of bounded bytes, each broadcast; every slice costs a scan of the candidates for its
positives and one for its negatives.  Before each, the anchors walk over the anchors themselves: the last place found
there is a floor below which the scan keeps nothing, so that what tasks send on does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapebook.llm.common import batch, columns, cut
from tapebook.llm.offsets import with_offset

SCALE = 256
#: The directions are fitted on at most so many anchors; they steer how far lists are walked, never what is found.
SAMPLE = 2048
CENTRES = 16
#: Anchors of one cluster that share a list.
MEMBERS = 256
#: Bytes of anchors that are broadcast at once.
SLICE_BYTES = 16_000_000
#: Bytes of candidates that are sorted at once.
BLOCK_BYTES = 4_000_000

_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Radians, and a share of the product of the lengths, by which rounding may mislead the bound.
_SLACK = 1e-6
_FOUND = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


# ---------------------------------------------------------------- vectors


def matrix(column: pa.Array, width: int | None = None, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a column of lists, as doubles: shorter ones are filled with zeros, longer ones cut at the width
    (where every anchor has zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == width).all():
        out = flat.reshape(len(size), width)
    else:
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros((len(size), width))
        some = place < width
        out[np.repeat(np.arange(len(size)), size)[some], place[some]] = flat[some]
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -1e300, 1e300)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by doubles where no sum can reach 2**53, else by whole numbers of any size,
    held at the ends of the 64-bit range."""
    if not exact(a, x):
        whole = np.vectorize(int, otypes=[object])
        found = whole(a).reshape(a.shape) @ whole(x).reshape(x.shape).T if a.shape[1] else np.zeros((len(a), len(x)), object)
        return np.clip(found, _LOWEST + 1, _HIGHEST).astype(np.int64)
    return (a @ x.T).astype(np.int64)


def exact(a: np.ndarray, x: np.ndarray) -> bool:
    return np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1] < 2.0**53


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def _angles(x: np.ndarray, length: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Radians between the rows and the centres; a row of zeros lies on every centre."""
    cosine = (x / np.maximum(length, 1)[:, None]) @ centres.T
    return np.where(length[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0)


def centres_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions or fewer, by spherical k-means from rows far from one another."""
    length = _lengths(x)
    unit = (x / np.maximum(length, 1)[:, None])[length > 0]
    if not len(unit):
        return np.zeros((1, x.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(k, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centre = unit[chosen]
    for _ in range(rounds):
        own = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        size = np.sqrt((total**2).sum(axis=1))
        centre = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], centre)
    return centre


# ---------------------------------------------------------------- the walk


@dataclass
class Cluster:
    """Anchors of one label around one direction. Query first + m * windows + w asks for member m's best `many` candidates
    whose score lies in low[m, w] .. high[m, w]."""

    label: int
    centre: int
    spread: float
    ids: np.ndarray
    x: np.ndarray
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: int


class Best:
    """The best `many` (score, then smaller id) of each query of a cluster so far; a pair (score, id) counts once."""

    def __init__(self, low: np.ndarray, many: int):
        self.low, self.many = low, many
        self.score = np.full((low.size, many), _LOWEST)
        self.ids = np.zeros((low.size, many), np.int64)

    def needed(self) -> np.ndarray:
        """The score that a candidate must reach for each query."""
        return np.maximum(self.low, self.score[:, -1].reshape(self.low.shape))

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        asked = np.unique(q)
        old = self.score[asked] > _LOWEST
        q = np.concatenate((q, np.repeat(asked, old.sum(axis=1))))
        score = np.concatenate((score, self.score[asked][old]))
        ids = np.concatenate((ids, self.ids[asked][old]))
        order = np.lexsort((ids, ~score, q))
        q, score, ids = q[order], score[order], ids[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])))
        q, score, ids = q[new], score[new], ids[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.many
        self.score[asked] = _LOWEST
        self.score[q[top], place[top]], self.ids[q[top], place[top]] = score[top], ids[top]


def walk(c: Cluster, best: Best, ids: np.ndarray, x: np.ndarray, bound: np.ndarray) -> int:
    """Members take what they need from candidates (ids, x) of which none scores more with a member than the member's length
    times bound. Returns how many scores were taken."""
    order = np.argsort(-bound, kind="stable")
    at, step, taken = 0, 64, 0
    while at < len(order):
        needed = best.needed()
        live = np.flatnonzero(c.length * bound[order[at]] + 1 >= needed.min(axis=1))
        if not len(live):
            break
        some = order[at : at + step]
        found = scores(c.x[live], x[some])
        taken += found.size
        other = c.ids[live][:, None] != ids[some]
        hits = []
        for w in range(needed.shape[1]):
            m, k = np.nonzero(other & (found >= needed[live, w, None]) & (found <= c.high[live, w, None]))
            hits.append((live[m] * needed.shape[1] + w, found[m, k], ids[some][k]))
        q, score, near = map(np.concatenate, zip(*hits))
        if len(q):
            best.add(q, score, near)
        at, step = at + step, min(2 * step, 1024)
    return taken


def bounds(length: np.ndarray, angle: np.ndarray, spread: float) -> np.ndarray:
    return length * (np.cos(np.maximum(0, angle - spread - _SLACK)) + _SLACK**1.5)


def _scan(candidates: DataFrame, clusters: list[Cluster], centres: np.ndarray, same: bool, many: int, scale: int) -> DataFrame:
    """(q, score, vec_id): each task's best for every query, among candidates of the same label or of others."""
    shared = candidates.sparkSession.sparkContext.broadcast((clusters, centres))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, directions = shared.value
        width = directions.shape[1]
        best = [Best(c.low, many) for c in asked]

        def take(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            ids, label = (t.column(k).to_numpy() for k in (0, 1))
            x = matrix(t.column(2), width, scale)
            length = _lengths(x)
            angle = _angles(x, length, directions)
            for c, b in zip(asked, best):
                some = np.flatnonzero((label == c.label) == same)
                if len(some):
                    sure = exact(c.x, x[some])
                    bound = bounds(length[some], angle[some, c.centre], c.spread) if sure else np.full(len(some), np.inf)
                    walk(c, b, ids[some], x[some], bound)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows * (8 * width + 32)
            if size >= BLOCK_BYTES:
                take(held)
                held, size = [], 0
        if held:
            take(held)
        for c, b in zip(asked, best):
            q, k = np.nonzero(b.score > _LOWEST)
            yield batch(_FOUND, q + c.first, b.score[q, k], b.ids[q, k])

    found = candidates.mapInArrow(of, "q long, score long, vec_id long")
    best_first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= many)


# ---------------------------------------------------------------- anchors


def _placed(anchors: DataFrame, centres: np.ndarray, scale: int) -> DataFrame:
    """anchors with the centre nearest in angle and that angle."""
    width = centres.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width, scale)
            angle = _angles(x, _lengths(x), centres)
            own = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(angle[np.arange(len(own)), own])], names=[*b.schema.names, "centre", "angle"])

    kind = anchors.schema["embedding"].dataType.simpleString()
    return anchors.mapInArrow(of, f"vec_id long, label long, embedding {kind}, centre int, angle double")


def _in_slices(anchors: DataFrame, centres: np.ndarray, width: int, scale: int) -> Iterator[pa.Table]:
    """The anchors by label, centre and angle, in slices of at most SLICE_BYTES, of which the driver holds one at a time."""
    by = ["label", "centre", "angle", "vec_id"]
    ordered = _placed(anchors, centres, scale).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    table = cut(ordered, "anchors").withColumns({"part": F.shiftright("_id", 33), "first": F.col("_id").bitwiseAND((1 << 33) - 1)})
    totals = table.groupBy("part").agg(F.count("*").alias("total"))
    at = with_offset(table, totals).withColumn("at", F.col("base") + F.col("first"))
    each = max(1, SLICE_BYTES // (8 * width + 64))
    for k in range(0, at.count(), each):
        yield at.filter(F.col("at").between(k, k + each - 1)).orderBy("at").select("vec_id", "label", "embedding", "centre", "angle").toArrow()


def _clusters(t: pa.Table, width: int, scale: int) -> list[Cluster]:
    ids, label, centre, angle = (t.column(k).to_numpy() for k in (0, 1, 3, 4))
    x = matrix(t.column(2), width, scale)
    length = _lengths(x)
    starts = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (centre[1:] != centre[:-1]))))
    out = []
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
        for k in range(a, z, MEMBERS):
            s = slice(k, min(z, k + MEMBERS))
            n = s.stop - k
            out.append(Cluster(int(label[k]), int(centre[k]), float(angle[s].max()), ids[s], x[s], length[s], np.full((n, 1), _LOWEST), np.full((n, 1), _HIGHEST), k))
    return out


def _last_places(found: DataFrame, n: int, many: int) -> np.ndarray:
    """For each of n queries the score at the last of `many` places, or the lowest number."""
    out = np.full(n, _LOWEST)
    t = found.filter(F.col("rank") == many).select("q", "score").toArrow()
    out[t.column(0).to_numpy()] = t.column(1).to_numpy()
    return out


def _raised(clusters: list[Cluster], floors: np.ndarray) -> list[Cluster]:
    for c in clusters:
        c.low = np.maximum(c.low, floors[c.first : c.first + c.low.size].reshape(c.low.shape))
    return clusters


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows without a null id, label, vector or component, or a component that is not finite."""
    rows = columns(embeddings, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of embeddings (vec_id, label,
    embedding) that is an anchor, and each of its first `positives` other rows of the same label, the first `negatives` rows of
    other labels whose score is at least percent/100 of the positive's and not over it.

    Scores are inner products of floor(scale * x); higher come first, equal ones by smaller vec_id. Rows with a null or
    non-finite part are left out (usable()). A vector shorter than another counts as filled with zeros. Rows of one vec_id are
    never another's positive or negative of themselves; repeated rows count once, as candidates and as anchors. An anchor without
    positives, or without rows in the range, has no row; an empty table gives none. Scores beyond 64 bits are held at its ends."""
    rows = usable(embeddings)
    asked = cut(rows.filter(is_anchor).distinct(), "anchor-rows")
    width = asked.agg(F.max(F.size("embedding"))).first()[0] or 0
    sample = matrix(asked.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0), width, scale)
    centres = centres_of(np.clip(sample, -1e100, 1e100), min(CENTRES, max(1, len(sample) // 128)))
    found = [_of_slice(rows, asked, _clusters(t, width, scale), centres, positives, negatives, percent, scale) for t in _in_slices(asked, centres, width, scale)]
    if not found:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionAll, found)


def _of_slice(rows: DataFrame, asked: DataFrame, clusters: list[Cluster], centres: np.ndarray, positives: int, negatives: int, percent: int, scale: int) -> DataFrame:
    n = sum(len(c.ids) for c in clusters)
    seen = _last_places(_scan(asked, clusters, centres, True, positives, scale), n, positives)
    near = _scan(rows, _raised(clusters, seen), centres, True, positives, scale).toArrow()
    q, score, ids, rank = (near.column(k).to_numpy() for k in range(4))
    top, name = np.full((n, positives), _LOWEST), np.zeros((n, positives), np.int64)
    top[q, rank - 1], name[q, rank - 1] = score, ids
    # ceil(percent * top / 100) without overflow; nothing lies between the bounds of a negative score, or of no positive
    low = np.where(top >= 0, top // 100 * percent - (-(top % 100 * percent) // 100), _HIGHEST)
    for c in clusters:
        own = slice(c.first, c.first + len(c.ids))
        c.low, c.high, c.first = low[own], top[own], c.first * positives
    seen = _last_places(_scan(asked, clusters, centres, False, negatives, scale), n * positives, negatives)
    found = cut(_scan(rows, _raised(clusters, seen), centres, False, negatives, scale), "negatives")
    anchor = np.concatenate([c.ids for c in clusters])
    pairs = pa.table({"q": np.arange(n * positives), "anchor_id": np.repeat(anchor, positives), "positive_id": name.ravel(), "positive_score": top.ravel()})
    known = rows.sparkSession.createDataFrame(pairs)
    return found.join(known, "q").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The query's labels: of every seventh vec_id the label is one further, so that near rows of other labels exist."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows."""
    return mine(relabelled(columns(embeddings, "vec_id", "label", "embedding")), F.col("vec_id") % 100 == 0)


#: DuckDB: every anchor against every row. Scores are whole numbers below 2**53, so sums of doubles are exact.
SQL = """
WITH rows AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
