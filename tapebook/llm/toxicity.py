"""Operator 1: toxicity by a counterfactual-regularised classifier.

A sparse logistic regression over words and word beginnings (each counted twice at most).  Every labelled text has
counterfactual copies that differ in a neutral mention of a group: one that names a group names another of the same kind
instead; one that names none gets a mention put in, and then another of the same kind in its place.  Training penalises
the squared change of the score between a text and its copies, so that a neutral mention of a group moves no score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import ALNUM, LOWER, Chunk, chunks, columns, cut, grown, span_hash, words

#: Labelled rows that are used for fitting at most, chosen by the hash of their doc_id.
MAX_TRAIN = 12_000
#: Features that the model looks at, those most over-represented in toxic texts.
MAX_FEATURES = 4096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

#: Rows that a table of group terms may have.
MAX_TERMS = 10_000

#: Terms that name groups, by kind; the default of fit()'s terms.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender", "nonbinary"), ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("africans", "europeans", "asians", "americans", "arabs", "indians"),
    ("mexican", "chinese", "german", "french", "spanish", "turkish", "polish", "indian", "russian", "japanese", "korean", "african", "arab", "italian", "nigerian"),
    ("immigrants", "natives", "refugees", "migrants"), ("disabled", "deaf", "blind", "autistic"), ("elderly", "young", "teenage"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "atheisten"), ("ausländer", "deutsche", "flüchtlinge"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "athées"), ("étrangers", "français", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "ateos"), ("extranjeros", "españoles", "refugiados"),
)


def groups_of(terms: DataFrame | tuple[tuple[str, ...], ...]) -> tuple[tuple[str, ...], ...]:
    """The terms by kind, of a table (kind, term) of at most MAX_TERMS rows, or as they are. Kinds of one term have nothing to
    swap and fall away."""
    if not isinstance(terms, DataFrame):
        return terms
    rows = columns(terms, "kind", "term").dropna().distinct().orderBy("kind", "term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} group terms")
    kinds: dict = {}
    for r in rows:
        kinds.setdefault(r["kind"], []).append(r["term"].lower())
    return tuple(tuple(t) for t in kinds.values() if len(t) > 1)


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    """Each term's successor in its kind."""
    return {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}


def swapped(text: str, table: dict[str, str]) -> str | None:
    """The lower-cased text with each group's name replaced, or None if it names none."""
    pattern = _pattern(tuple(table))
    out, n = pattern.subn(lambda m: table[m[0]], text.lower())
    return out if n else None


def mentioned(text: str, table: dict[str, str]) -> tuple[str, str]:
    """The text with a mention of a group put in, and with that of another; which ones depends on the text only."""
    terms = sorted(table)
    term = terms[zlib.crc32(text.encode()) % len(terms)]
    return f"{text} {term}", f"{text} {table[term]}"


_patterns: dict[tuple[str, ...], re.Pattern] = {}


def _pattern(terms: tuple[str, ...]) -> re.Pattern:
    if terms not in _patterns:
        _patterns[terms] = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")(?!\w)")
    return _patterns[terms]


# ---------------------------------------------------------------- features


def _features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, text) of all words and word beginnings, repeats included."""
    low = LOWER[c.buf]
    w = words(c, ALNUM)
    text = np.repeat(np.arange(c.n), np.diff(w.of))
    hashes, of = [span_hash(low, w.start, w.end)], [text]
    for k in PREFIXES:
        longer = np.flatnonzero(w.end - w.start > k)
        hashes.append(span_hash(low, w.start[longer], w.start[longer] + k) ^ np.uint64(k))
        of.append(text[longer])
    return np.concatenate(hashes), np.concatenate(of)


def _distinct(h: np.ndarray, text: np.ndarray, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each pair as often as it stands there, but at most so many times."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    few = np.ones(len(h), bool)
    few[most:] = (h[most:] != h[:-most]) | (text[most:] != text[:-most])
    return h[few], text[few]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and a filter over the hashes' top bits. pairs: how many counterfactual pairs
    it was trained with, of texts that name a group (swapped) and of those that name none (inserted)."""

    hashes: np.ndarray
    weight: np.ndarray
    bias: float
    pairs: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def known(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(feature position, text) of each known feature of each text, at most twice."""
        h, text = _features(c)
        some = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        h, text = h[some], text[some]
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        ok = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return _distinct(at[ok], text[ok], 2)

    def score(self, c: Chunk) -> np.ndarray:
        at, text = self.known(c)
        z = self.bias + np.bincount(text, weights=self.weight[at], minlength=c.n)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


# ---------------------------------------------------------------- fitting


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text leaves 2 when divided by 4. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    known = columns(labels, "doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = columns(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _counted(train: DataFrame) -> DataFrame:
    """(feature, n texts with it, toxic ones among them)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.array(b.column(1).to_pylist(), np.int64)
            for c in chunks(b.column(0)):
                h, text = _distinct(*_features(c))
                names, inverse = np.unique(h, return_inverse=True)
                hit = np.bincount(inverse, weights=toxic[c.first + text], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(names))), pa.array(hit)], names=["feature", "n", "hit"])

    return train.select("text", "toxic").mapInArrow(of, "feature long, n long, hit long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))


def _chosen(train: DataFrame, most: int, least: int = 3) -> np.ndarray:
    n, pos = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not pos or pos == n:
        return np.zeros(0, np.uint64)
    p = pos / n
    z = (F.col("hit") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    rows = _counted(train).filter(F.col("hit") >= least).withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "feature").limit(most).select("feature").collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def _term_features(table: dict[str, str]) -> np.ndarray:
    return np.unique(np.concatenate([_features(c)[0] for c in chunks(pa.array(sorted(table)))] or [np.zeros(0, np.uint64)]))


def _known_lists(texts: list[str], model: Model) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for c in chunks(pa.array(texts, pa.string())):
        at, text = model.known(c)
        out += np.split(at, np.searchsorted(text, np.arange(1, c.n)))
    return out


def _change(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[float]]:
    """The features whose counts differ between two texts, and by how much."""
    names, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    by = np.bincount(inverse[: len(a)], minlength=len(names)) - np.bincount(inverse[len(a) :], minlength=len(names))
    return names[by != 0].tolist(), by[by != 0].astype(float).tolist()


_EXAMPLES = "toxic int, own array<long>, named boolean, changes array<struct<at:array<long>,by:array<double>>>"


def _examples(train: DataFrame, hashes: np.ndarray, table: dict[str, str]) -> tuple:
    """Known features of the training texts, and what changes in their counterfactual copies: one small row per text.

    A text that names a group has one change (to its swapped copy), another text two (to a mention, and from it to another)."""
    shared = train.sparkSession.sparkContext.broadcast((hashes, table))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, swap = shared.value
        model = Model(names, np.zeros(len(names)), 0.0)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            other = [swapped(t, swap) if swap else None for t in texts]
            put = [mentioned(t, swap) if swap else (t, t) for t in texts]
            own, named, one, two = (_known_lists(x, model) for x in (texts, [t or "" for t in other], [p[0] for p in put], [p[1] for p in put]))
            changes = []
            for i, t in enumerate(other):
                pairs = [(own[i], named[i])] if t is not None else [(own[i], one[i]), (one[i], two[i])] if swap else []
                changes.append([dict(zip(("at", "by"), _change(x, y))) for x, y in pairs])
            kinds = pa.list_(pa.struct([("at", pa.list_(pa.int64())), ("by", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.list_(pa.int64())), pa.array([t is not None for t in other]), pa.array(changes, kinds)], names=["toxic", "own", "named", "changes"])

    rows = train.select("text", F.col("toxic").cast("int")).mapInArrow(of, _EXAMPLES).toArrow().to_pydict()  # max_train rows at most
    return np.array(rows["toxic"], float), rows["own"], np.array(rows["named"], bool), [(c["at"], c["by"]) for cs in rows["changes"] for c in cs]


class _Sparse:
    """Rows of present features with a value each; products with vectors on either side."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate([*map(np.asarray, rows), np.zeros(0)]).astype(np.int64)
        self.value = np.concatenate([*values, np.zeros(0)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.value, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row] * self.value, minlength=self.width)


def train_weights(
    y: np.ndarray, own: list, changes: list[tuple[list, list]], width: int, fairness: float = 5.0, l2: float = 1e-5, l1: float = 5e-5, rounds: int = 600
) -> tuple[np.ndarray, float]:
    """Weights w and bias b by accelerated proximal gradient. The objective: the mean log loss of own against y, plus fairness
    times the mean squared change of the score over changes (feature places, by how much), plus l2/2 |w|^2 and l1 |w|."""
    x = _Sparse(own, [np.ones(len(r)) for r in own], width)
    d = _Sparse([a for a, _ in changes], [np.asarray(v) for _, v in changes], width)
    n, m = max(len(y), 1), max(len(changes), 1)
    v, c = np.ones(width) / (width + 1) ** 0.5, 1 / (width + 1) ** 0.5
    for _ in range(30):  # the largest curvature, for the step
        z = x.dot(v) + c
        u, e = 0.25 * x.back(z) / n + 2 * fairness * d.back(d.dot(v)) / m + l2 * v, 0.25 * z.sum() / n
        size = (u @ u + e * e) ** 0.5
        v, c = (u / size, e / size) if size else (v, c)
    step = 1 / (1.1 * size + 1e-9)
    rate = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    wz, bz, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(x.dot(wz) + bz, -60, 60))) - y
        g = x.back(r) / n + 2 * fairness * d.back(d.dot(wz)) / m + l2 * wz
        moved = wz - step * g
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        newb = bz - step * r.sum() / n
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        wz, bz = new + (t - 1) / after * (new - w), newb + (t - 1) / after * (newb - b)
        w, b, t = new, newb, after
    return w, float(b)


def fit(
    documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, fairness: float = 5.0, terms: DataFrame | tuple[tuple[str, ...], ...] = IDENTITY
) -> Model:
    """A model from at most max_train labelled rows outside the held-out quarter. terms: what names groups (see groups_of).

    Of rows with one doc_id the smallest text counts, and it is toxic if one of its labels says so; rows with a null id or
    label are no labels. Without toxic (or without other) labels there are no features, and every text is scored with the
    training rate."""
    train = cut(_training(documents, labels, max_train), "toxic-train")
    table = swaps(groups_of(terms))
    hashes = _chosen(train, max_features)
    if len(hashes):
        hashes = np.union1d(hashes, _term_features(table))
    y, own, named, changes = _examples(train, hashes, table)
    pairs = {"swapped": int(named.sum()), "inserted": len(changes) - int(named.sum())}
    if not len(hashes):
        rate = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return Model(hashes, np.zeros(0), float(np.log(rate / (1 - rate))), pairs)
    w, b = train_weights(y, own, changes, len(hashes), fairness)
    return Model(hashes, w, b, pairs)


def scored(documents: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and score of each row's whole text; only the text goes into it. Null is scored as empty."""
    docs = columns(documents, *carry, "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.concatenate([*(shared.value.score(c) for c in chunks(b.column(b.num_columns - 1))), np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], "score"])

    return docs.mapInArrow(of, grown(docs.schema.fields[:-1], "score double"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of 0.3). Repeated rows stay, with one score each."""
    df = scored(documents, fit(documents, labels))
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
