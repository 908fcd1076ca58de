"""Shared pieces: written cut points, byte-level word scans and vectorised hashes.

Texts travel to Python in Arrow batches.  A batch is walked in chunks of bounded bytes; inside a
chunk every step is a numpy operation over the raw UTF-8 bytes, so no per-word Python object exists
unless an operator needs one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 500_000
BATCH_ROWS = 1000
BATCH_BYTES = "8m"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word when words are separated by ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a word made of ASCII letters, digits and any non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


# ---------------------------------------------------------------- written cut points


@lru_cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a local session (one JVM, as in tests) gets
    a temporary folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = _own_folder()
    return found.rstrip("/")


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def discarding() -> Iterator[None]:
    """Tables that write_table() and cut() write inside go when the block ends: nothing that is used behind it may read them, but
    by way of a table written with keep=True."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            drop_table(spark, path)


def write_table(df: DataFrame, label: str, codec: str = "zstd", keep: bool = False) -> str:
    """Write df as Parquet in the shared folder and return its path: later stages reread it, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append((df.sparkSession, path))
    return path


def cut(df: DataFrame, label: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, label, codec, keep))


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: fewer rows than the default of 10,000, in the JVM and in Python at once. The session keeps
    the setting: plans are lazy and read it when they run."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever they are called, never meet an operator's own."""
    _small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def packed(documents: DataFrame, *also: str) -> DataFrame:
    """_row (all columns but text, as one), the columns named besides, and text: nothing in documents can clash with what
    an operator adds."""
    _small_batches(documents.sparkSession)
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    return documents.select(F.struct(*rest).alias("_row"), *also, "text")


def unpacked(df: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of documents again; n_chars, if there is such a column, follows a text that has changed (column _new)."""
    new = "_new" in df.columns
    text = F.when(F.col("_new"), F.length("text")) if new else None
    out = []
    for f in documents.schema.fields:
        own = F.col("text") if f.name == "text" else F.col("_row")[f.name]
        if new and f.name == "n_chars":
            own = F.coalesce(text.cast(f.dataType), own)
        out.append(own.alias(f.name))
    return df.select(*out)


def grown(fields: list[T.StructField], more: str) -> T.StructType:
    """A schema of fields and of columns told as "name type, ..."."""
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


# ---------------------------------------------------------------- chunks of texts


@dataclass
class Chunk:
    """Texts first .. first+n-1 of a batch; text i is buf[off[i]:off[i+1]], with one \\n added at its end."""

    first: int
    n: int
    buf: np.ndarray
    off: np.ndarray


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of about limit bytes (a longer text is a chunk of its own). Null is empty."""
    texts = as_texts(column)
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        base = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, base + limit, "right")))
        part = pc.binary_join_element_wise(texts.slice(first, last - first), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        _, offsets, data = part.buffers()
        off = np.frombuffer(offsets, dtype=np.int64, count=len(part) + 1 + part.offset)[part.offset :]
        buf = np.frombuffer(data, dtype=np.uint8, count=int(off[-1]))[int(off[0]) :]
        yield Chunk(first, last - first, buf, off - off[0])
        first = last


@dataclass
class Words:
    """Word w of a chunk is buf[start[w]:end[w]]; text i has words of[i] .. of[i+1]-1."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray


def words(chunk: Chunk, table: np.ndarray) -> Words:
    """Maximal runs of bytes that the table marks (each text ends with an unmarked byte, so none spans two texts)."""
    inside = np.zeros(len(chunk.buf) + 1, dtype=np.int8)
    inside[1:] = table[chunk.buf]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[0::2], edges[1::2]
    return Words(start, end, np.searchsorted(start, chunk.off))


def spaced(chunk: Chunk, w: Words) -> tuple[np.ndarray, Words]:
    """The chunk's words with exactly one space after each, and their places there."""
    size = w.end - w.start + 1
    end = np.cumsum(size)
    start = end - size
    take = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(w.start - start, size)
    out = chunk.buf[take]
    out[end - 1] = 0x20
    return out, Words(start, end - 1, w.of)


# ---------------------------------------------------------------- hashes

#: Longer runs are hashed one by one.
LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; different values stay different."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(buf: np.ndarray) -> np.ndarray:
    """For every place of buf, and the one behind it, the next eight bytes as a number (zeros beyond the end)."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))


def block(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of eights(buf), those at the places, with only the first size bytes (0 to 8, more counts as 8)."""
    return values[at] & _MASKS[np.minimum(size, 8)]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs buf[start:end], equal for equal runs wherever they stand.

    Runs of up to LONG bytes take eight at a time, each mixed in before the next; longer ones are hashed by XXH64. There is
    no table that grows with a text, and no algebra by which whole families of runs collide."""
    size = end - start
    values = eights(buf)
    h = mix(block(values, start, size) + size.astype(np.uint64) * _STEP)
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        h[live] = mix(h[live] * _STEP + block(values, start[live] + at, size[live] - at))
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[s:e], 42) for s, e in zip(start[long].tolist(), end[long].tolist())), np.uint64, len(long))
    return h


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values in a row: entry i is that of h[i : i + size]."""
    n = max(0, len(h) - size + 1)
    out, done, part, width = None, 0, h, 1
    while True:
        if size & width:
            out = part[:n] if out is None else mix(out * _STEP + part[done : done + n])
            done += width
        if done == size or not n:
            return out[:n] + np.uint64(size) if n else np.zeros(0, np.uint64)
        part, width = mix(part[:-width] * _STEP + part[width:]), 2 * width


def same_runs(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of `size` bytes at the places a and b are equal, byte by byte."""
    values = eights(buf)
    same = block(values, a, size) == block(values, b, size)
    live, at = np.flatnonzero(same & (size > 8) & (size <= LONG)), 8
    while len(live):
        same[live] = block(values, a[live] + at, size[live] - at) == block(values, b[live] + at, size[live] - at)
        at += 8
        live = live[same[live] & (size[live] > at)]
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        same[long] = [raw[i : i + n] == raw[j : j + n] for i, j, n in zip(a[long].tolist(), b[long].tolist(), size[long].tolist())]
    return same


def run_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Small numbers of the byte runs: the same for equal runs and for no others (hashes are checked on the bytes)."""
    _, first, ids = np.unique(span_hash(buf, start, end), return_index=True, return_inverse=True)
    size, head = end - start, first[ids]
    if (size == size[head]).all() and same_runs(buf, start, start[head], size).all():
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(buf[s:e].tobytes(), len(known)) for s, e in zip(start.tolist(), end.tolist())], np.int64)


def batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)
