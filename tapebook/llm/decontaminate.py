"""Operator 6: benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z.  A window is
13 consecutive words of a benchmark item; an item with fewer words, but not none, is one window.
The windows' hashes are broadcast in slices of bounded size; each text's windows are hashed in bulk,
looked up, and every hit is verified against the window's words before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import ALNUM, LOWER, Chunk, Words, batch, chunks, columns, cut, grown, packed, span_hash, unpacked, window_hash, words

WINDOW = 13
#: Broadcast at most this many bytes of benchmark windows at once; a larger benchmark is taken in several slices.
SLICE_BYTES = 32_000_000

_WINDOWS = pa.schema([("item_id", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])


def _lowered(chunk: Chunk) -> tuple[np.ndarray, Words, np.ndarray]:
    low = LOWER[chunk.buf]
    w = words(chunk, ALNUM)
    return low, w, span_hash(low, w.start, w.end)


def _text_of(low: np.ndarray, w: Words, first: int, size: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(w.start[first : first + size], w.end[first : first + size]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct (item_id, window): item_id (string), size in words, hash, words joined by spaces.

    Null and wordless items have none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for c in chunks(b.column(1)):
                low, w, h = _lowered(c)
                out = []
                for i in range(c.n):
                    a, z = int(w.of[i]), int(w.of[i + 1])
                    size = min(window, z - a)
                    if size and ids[c.first + i] is not None:
                        starts = np.arange(a, z - size + 1)
                        hashes = window_hash(h[a:z], size).view(np.int64)
                        out += [(ids[c.first + i], size, int(x), _text_of(low, w, s, size)) for s, x in zip(starts.tolist(), hashes)]
                if out:
                    yield batch(_WINDOWS, *map(list, zip(*out)))

    rows = columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    return rows.mapInArrow(of, "item_id string, size int, hash long, words binary").distinct()


def _slices(windows: DataFrame, limit: int) -> Iterator[list]:
    """The windows with the items they belong to, in slices whose bytes stay under the limit. Streams: one slice at a time is held."""
    merged = windows.groupBy("size", "hash", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    held, size = [], 0
    for r in merged.toLocalIterator():
        held.append((r["size"], r["hash"], bytes(r["words"]), r["items"]))
        size += 64 + len(r["words"]) + sum(map(len, r["items"]))
        if size > limit:
            yield held
            held, size = [], 0
    yield held


def _index(rows: list) -> dict:
    """By window size: sorted hashes, and what each hash stands for."""
    by_size: dict[int, dict[int, list]] = {}
    for size, h, text, items in rows:
        by_size.setdefault(size, {}).setdefault(h & 0xFFFFFFFFFFFFFFFF, []).append((text, items))
    return {size: (np.array(sorted(known), dtype=np.uint64), known) for size, known in by_size.items()}


def _hits(c: Chunk, index: dict, filters: dict) -> tuple[np.ndarray, Words, dict[int, set]]:
    """Which words of the chunk are hit, and each text's items."""
    low, w, h = _lowered(c)
    cover = np.zeros(len(w.start) + 1, dtype=np.int32)
    items: dict[int, set] = {}
    for size, (hashes, known) in index.items():
        found = window_hash(h, size)
        near = np.flatnonzero(filters[size][(found >> np.uint64(44)).astype(np.int64)])
        near = near[np.isin(found[near], hashes)] if len(near) else near
        text = np.searchsorted(w.of, near, "right") - 1
        near, text = near[(ok := near + size <= w.of[text + 1])], text[ok]  # a window lies in one text
        for s, t in zip(near.tolist(), text.tolist()):
            here = _text_of(low, w, s, size)
            for wanted, ids in known[int(found[s])]:
                if wanted == here:
                    cover[s] += 1
                    cover[s + size] -= 1
                    items.setdefault(t, set()).update(ids)
    return np.cumsum(cover[:-1]) > 0, w, items


def _scan(docs: DataFrame, rows: list, keep_text: bool) -> DataFrame:
    """Per row of docs (key, text): n_words, spans of hit words [first, last) by word and by byte, items."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    out = grown(docs.schema.fields[:-1], "n_words long, hit array<long>, cut array<long>, items array<string>" + (", text string" if keep_text else ""))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared.value)
        filters = {}
        for size, (hashes, _) in index.items():
            filters[size] = np.zeros(1 << 20, dtype=bool)
            filters[size][(hashes >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            n_words, hit, cuts, items = [], [], [], []
            for c in chunks(b.column("text")):
                covered, w, found = _hits(c, index, filters)
                n_words += np.diff(w.of).tolist()
                for i in range(c.n):
                    if i not in found:
                        hit.append([])
                        cuts.append([])
                        items.append([])
                        continue
                    a = int(w.of[i])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered[a : w.of[i + 1]].astype(np.int8), [0]))))
                    first, last = edge[0::2], edge[1::2]
                    hit.append(edge.tolist())
                    cuts.append(np.stack([w.start[a + first], w.end[a + last - 1]], 1).ravel().__sub__(c.off[i]).tolist())
                    items.append(sorted(found[i]))
            more = [b.column("text")] if keep_text else []
            carried = [b.column(k) for k in range(b.num_columns - 1)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*carried, pa.array(n_words, pa.int64()), pa.array(hit, longs), pa.array(cuts, longs), pa.array(items, pa.list_(pa.string())), *more], names=[*b.schema.names[:-1], "n_words", "hit", "cut", "items", *["text"] * keep_text])

    return docs.mapInArrow(of, out)


def scan(documents: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of documents: the carried columns, n_words, hit (word spans, flat first/last pairs), cut
    (the same spans in UTF-8 bytes), items (ids with occurring windows, sorted as strings), and text if kept.

    Null and empty texts have no words. Repeated rows give repeated rows. An empty benchmark hits nothing.
    The benchmark is broadcast in slices of slice_bytes, of which the driver holds two at most; with more than one slice
    the documents are written once with a row id, each slice's spans too, and the spans are merged by that id."""
    docs = columns(documents, *carry, "text")
    slices = _slices(benchmark_windows(benchmark, window), slice_bytes)
    first, more = next(slices), next(slices, None)
    if more is None:
        return _scan(docs, first, keep_text)
    rows = cut(docs.withColumn("_nth", F.monotonically_increasing_id()), "decon-docs")
    bare = rows.select("_nth", "text")
    found = reduce(DataFrame.unionByName, [cut(_scan(bare, p, False), "decon-slice") for p in chain((first, more), slices)])
    spans = "array<long>"
    merged = found.groupBy("_nth").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hit")).alias("hit"),
        F.flatten(F.collect_list("cut")).alias("cut"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    pairs = "transform(filter(sequence(0, size({c}) - 1), i -> i % 2 = 0 and size({c}) > 0), i -> struct({c}[i] as a, {c}[i + 1] as z))"
    union = (
        "flatten(transform(aggregate(array_sort({p}), cast(array() as array<struct<a: bigint, z: bigint>>), (done, x) -> "
        "if(size(done) > 0 and element_at(done, -1).z >= x.a, concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).a as a, "
        "greatest(element_at(done, -1).z, x.z) as z))), concat(done, array(x)))), x -> array(x.a, x.z)))"
    )
    for c in ("hit", "cut"):
        merged = merged.withColumn(c, F.expr(union.format(p=pairs.format(c=c))).cast(spans))
    return rows.join(merged, "_nth").select(*carry, "n_words", "hit", "cut", "items", *["text"] * keep_text)


def _measures(df: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(sequence(0, size(hit)), 0L, (n, i) -> n + coalesce(if(i % 2 = 1, get(hit, i) - get(hit, i - 1), 0L), 0L))")
    return df.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are a twentieth or more)."""
    df = _measures(scan(documents, benchmark))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def _without(column: pa.Array, cuts: pa.Array) -> list[str | None]:
    out = []
    for text, spans in zip(column.to_pylist(), cuts.to_pylist()):
        if not spans:
            out.append(text)
            continue
        raw, at, kept = text.encode(), 0, []
        for a, z in zip(spans[0::2], spans[1::2]):
            kept.append(raw[at:a])
            at = z
        out.append(b"".join([*kept, raw[at:]]).decode())
    return out


def clean(documents: DataFrame, benchmark: DataFrame, mode: str = "document") -> DataFrame:
    """Documents without contamination, columns as they were.

    mode "document" drops contaminated documents and leaves the rest as it is; mode "span" keeps every document and
    cuts the hit spans out of the text (n_chars follows, if there is such a column)."""
    df = _measures(scan(packed(documents), benchmark, carry=("_row",), keep_text=True))
    if mode == "document":
        return unpacked(df.filter(~F.col("contaminated")), documents)
    if mode != "span":
        raise ValueError(f"mode is document or span, not {mode}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_without(b.column(2), b.column(3)), pa.string())], names=["_row", "_new", "text"])

    rows = df.select("_row", (F.size("cut") > 0).alias("_new"), "text", "cut")
    return unpacked(rows.mapInArrow(of, grown(rows.schema.fields[:2], "text string")), documents)


def _sql(window: int = WINDOW) -> str:
    """DuckDB: windows as joined words, positions by join."""
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    taken = words.format(lower.format("text"))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {taken} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {taken} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {window}) AS size, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {window} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS t
       FROM (SELECT r, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, dw.size, item_id FROM dw JOIN bw ON bw.t = dw.t AND bw.size = dw.size),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r)"""


SQL = _sql()
