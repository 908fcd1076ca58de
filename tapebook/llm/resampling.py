"""Operator 3: quality by importance resampling.

Two bag-of-hashed-n-gram models are counted: the target's over labelled good documents, the raw one over every document.
A document's log weight is the sum of its n-grams' log ratios, and the k documents with the largest log weight plus
Gumbel noise are a sample, without replacement, in proportion to the weights.  k is the number of documents whose weight
reaches the threshold that tells the labelled good from the labelled bad best.

The models have as many buckets as the square root of the corpus's bytes times BUCKETS_BY says: the table grows with the
corpus (2**13 buckets at 25 MB, 2**24 at 100 TB) and can still be broadcast.  Log ratios are whole numbers of 1/UNIT, so
that a text's weight does not depend on where it stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import ALNUM, Chunk, chunks, columns, cut, grown, mix, packed, span_hash, unpacked

#: Buckets of unigrams and bigrams: the power of two at or over the root of so many times the corpus's bytes, LEAST at least.
BUCKETS_BY, LEAST = 2, 1 << 12
#: Log weights are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: A counting task gives a row for each bucket it has seen, so there are at most so many tasks for each core.
TASKS = 8
#: Labelled rows that are used at most, chosen by the hash of their doc_id.
MAX_LABELS = 50_000
SEED = 17

_KIND = np.where(ALNUM, 1, 2).astype(np.int8)
_KIND[:0x21] = 0
_SAME = np.uint64(0x5265706561746564)


def _ngrams(c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chunk's unigrams and bigrams in text order, and where each text's begin.

    Tokens are runs of letters, digits and non-ASCII characters, or of ASCII punctuation. A token equal to the one
    before it counts as a repetition, whatever it is: made-up or rare words have no counts of their own."""
    kind = np.concatenate(([0], _KIND[c.buf]))
    turn = kind[1:] != kind[:-1]
    start = np.flatnonzero(turn & (kind[1:] > 0))
    end = np.flatnonzero(np.concatenate((turn[1:], [True])) & (kind[1:] > 0)) + 1
    of = np.searchsorted(start, c.off)
    h = span_hash(c.buf, start, end)
    inner = np.ones(len(h), bool)
    inner[of[:-1][of[:-1] < len(h)]] = False
    same = np.concatenate(([False], h[1:] == h[:-1]))[: len(h)] & inner
    h = np.where(same, _SAME, h)
    pair = mix(np.concatenate((np.zeros(1, np.uint64), h[:-1]))[: len(h)] * np.uint64(3) + h)
    grams = np.empty(2 * len(h), np.int64)
    grams[0::2] = (h % np.uint64(buckets)).astype(np.int64)
    grams[1::2] = (np.where(inner, pair, mix(h + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
    return grams, 2 * of


@dataclass
class Ratio:
    """Log ratio of each bucket in units of 1 / UNIT, and the weight that tells good from bad."""

    by_bucket: np.ndarray
    threshold: float


def bucket_count(documents: DataFrame) -> int:
    """How many buckets the models of these documents have."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST, 1 << math.ceil(math.log2(max(1, BUCKETS_BY * size)) / 2))


def _tally(total: np.ndarray, grams: np.ndarray) -> None:
    if len(total) <= 4 * len(grams):
        total += np.bincount(grams, minlength=len(total))
    else:
        np.add.at(total, grams, 1)


def _counts(labelled: DataFrame, buckets: int) -> np.ndarray:
    """(text, quality) -> counts of the raw and the target model; counted in each task, summed by bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            good = np.array([q == 1 for q in b.column(1).to_pylist()], bool)
            for c in chunks(b.column(0)):
                grams, at = _ngrams(c, buckets)
                _tally(total[0], grams)
                if (some := good[c.first : c.first + c.n]).any():
                    _tally(total[1], grams[np.repeat(some, np.diff(at))])
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "raw", "target"])

    few = labelled.coalesce(TASKS * labelled.sparkSession.sparkContext.defaultParallelism)
    counted = few.mapInArrow(of, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows, out = counted.toArrow(), np.zeros((2, buckets))
    out[:, rows["bucket"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return out


def _weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs (doc_id, ..., text) -> the same columns with n_grams, log_weight and noisy_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for c in chunks(b.column("text")):
                grams, at = _ngrams(c, len(shared.value))
                n.append(np.diff(at))
                total = np.concatenate(([0], np.cumsum(shared.value[grams])))
                weight.append(total[at[1:]] - total[at[:-1]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(n)), pa.array(np.concatenate(weight) / UNIT)], names=[*b.schema.names, "n_grams", "log_weight"])

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.mapInArrow(of, grown(docs.schema.fields, "n_grams long, log_weight double")).withColumn("noisy_weight", F.col("log_weight") - F.log(-F.log(uniform)))


def _threshold(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight at which balanced accuracy on labelled rows is best: the middle of the best gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight)
    w, g = weight[order], good[order]
    right = np.concatenate(([0], np.cumsum(~g))) / (~g).sum() + (g.sum() - np.concatenate(([0], np.cumsum(g)))) / g.sum()
    k = int(np.argmax(right))
    return float(w[0] - 1 if k == 0 else w[-1] + 1 if k == len(w) else (w[k - 1] + w[k]) / 2)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    known = columns(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, smooth: float = 1.0) -> Ratio:
    """Both models and the threshold. The raw model counts every document; at most max_labels labelled rows are used.

    Without labels of both kinds every document passes; texts are taken whole, null as empty."""
    labelled = columns(documents, "doc_id", "text").join(F.broadcast(_sample(labels, max_labels)), "doc_id", "left")
    buckets = bucket_count(documents)
    raw, target = _counts(labelled.select("text", "quality"), buckets)
    ratio = np.log((target + smooth) / (target.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))
    units = np.rint(ratio * UNIT).astype(np.int64)
    known = _weighed(labelled.filter("quality IS NOT NULL"), units).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("log_weight").alias("w"))
    rows = known.toPandas()  # a row for each labelled doc_id that is used: max_labels at most
    return Ratio(units, _threshold(rows["w"].to_numpy(float), rows["quality"].to_numpy() == 1))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value of a double column (k from 1): four rounds of counts by sixteen bits of its ordered form."""
    if k < 1:
        return np.inf

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(raw < 0, ~(raw & 0x7FFFFFFFFFFFFFFF), raw))], names=["key"])

    keys = cut(df.select(F.col(column).cast("double")).dropna().mapInArrow(keyed, "key long"), "keys")
    found = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift)
        inside = keys if shift == 48 else keys.filter(F.shiftright("key", shift + 16) == found)
        for r in sorted(inside.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r["d"]):
            if k <= r["count"]:
                found = r["d"]
                break
            k -= r["count"]
        else:
            return -np.inf
    raw = np.int64(found) if found >= 0 else np.int64(~found | np.int64(-(1 << 63)))
    return float(np.array([raw], np.int64).view(np.float64)[0])


def resampled(documents: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), max_labels: int = MAX_LABELS) -> DataFrame:
    """The carried columns (doc_id among them, text if it is named) with n_grams, log_weight, noisy_weight and kept (in the
    sample). Texts are weighed once; what is carried is written with their weights.

    The sample has as many documents as reach the threshold; rows that tie with the last one are all in. Equal texts have
    equal weights, and the noise is a function of doc_id (null is one value), so that repeated rows share their fate. Empty
    texts have weight 0."""
    ratio = fit(documents, labels, max_labels)
    rows = _weighed(columns(documents, *dict.fromkeys((*carry, "text"))), ratio.by_bucket)
    weighed = cut(rows.select(*carry, "n_grams", "log_weight", "noisy_weight"), "weights", "lz4")
    k = weighed.filter(F.col("log_weight") >= ratio.threshold).count()
    last = kth_largest(weighed, "noisy_weight", k)
    return weighed.withColumn("kept", F.col("noisy_weight") >= last)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_grams, log_weight, kept."""
    return resampled(documents, labels).select("doc_id", "n_grams", "log_weight", "kept")


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in the sample, columns as they were."""
    return unpacked(resampled(packed(documents, "doc_id"), labels, carry=("_row", "doc_id", "text")).filter("kept"), documents)
