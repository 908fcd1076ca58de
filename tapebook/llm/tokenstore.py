"""Operator 9: token ids in files of independent rANS blocks.

The store is a folder with `model` (the shared frequency table) and `blocks`, both Parquet so that any store that Spark
reaches can hold them.  A block holds whole documents in ascending doc_id order, about BLOCK ids, interleaved over LANES
coder states; it carries its documents' ids and sizes, checkpoints for starting in its middle, and checksums of its ids
and of the table it was coded with.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapebook.llm.common import drop_table, shared_dir, write_table
from tapebook.llm.offsets import with_offset
from tapebook.llm.packing import END, id_width, tokenized
from tapebook.llm.rans import Coded, Model, decode, encode
from tapebook.llm.tokens import vocabulary

VOCABULARY = "word_bpe_49k.json"
BLOCK = 1 << 18
LANES = 1024
EVERY = 128

_BLOCKS = (
    "part int, block int, first long, n_tokens long, doc_id array<{}>, sizes array<long>, lanes int, words binary, "
    "steps array<int>, places array<int>, states binary, ids_crc32 long, model_crc32 long"
)


def _counts(tokens: DataFrame, width: str) -> DataFrame:
    """(id, n) over all ids: each batch is counted in place, so the shuffle holds counts only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            here = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width))
            if len(here) > len(total):
                total, here = here, total
            total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _model(spark: SparkSession, path: str) -> tuple[Model, int]:
    """The table of a store: as many rows as the vocabulary has ids at most."""
    rows = spark.read.parquet(path).orderBy("id").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"]] = rows["n"]
    model = Model(counts)
    return model, zlib.crc32(model.freq.astype("<u8").tobytes())


def write(documents: DataFrame, out: str, path: str | None = None, block: int = BLOCK, lanes: int = LANES, end: int | None = END) -> None:
    """Encode every row's whole text into the store out (a folder). Rows are in ascending doc_id order, null first; equal
    doc_ids are ordered by their ids' hash. Null and empty texts have the end id alone; an empty table gives a store without
    blocks. A document is in one block whole, however long it is."""
    spark = documents.sparkSession
    path = path or vocabulary(VOCABULARY)
    width = id_width(path)
    tokens_at = write_table(tokenized(documents, path, end).select("doc_id", "ids"), "tokens")
    tokens = spark.read.parquet(tokens_at)
    _counts(tokens, width).write.parquet(f"{out}/model")
    shared = spark.sparkContext.broadcast(_model(spark, f"{out}/model"))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table_crc = shared.value
        part, number, done = TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.int64)
            few = max(1, min(lanes, len(ids) // 64))
            c = encode(ids, model, few, EVERY)
            row = [part, number, done, len(ids), docs, [len(x) for x in held], few, c.words.astype("<u4").tobytes(), c.steps.tolist(), c.places.tolist(), c.states.astype("<u8").tobytes(), zlib.crc32(ids.astype("<u4").tobytes()), table_crc]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(doc_kind), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        doc_kind = pa.int64()
        for b in batches:
            doc_kind = b.column(0).type
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc)
                held.append(np.frombuffer(raw, width))
                size += len(held[-1])
                if size >= block:
                    yield flush()
                    number, done, docs, held, size = number + 1, done + size, [], [], 0
        if size:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    blocks = tokens.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(of, _BLOCKS.format(kind))
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")
    drop_table(spark, tokens_at)


_CODED = ("n_tokens", "lanes", "words", "steps", "places", "states")


def _coded(row: dict) -> Coded:
    lanes = row["lanes"].as_py()
    steps, places = (np.array(row[k].as_py(), np.int32) for k in ("steps", "places"))
    states = np.frombuffer(row["states"].as_py(), "<u8").reshape(-1, lanes).astype(np.uint64)
    return Coded(row["n_tokens"].as_py(), lanes, np.frombuffer(row["words"].as_py(), "<u4"), steps, places, states)


def _placed(spark: SparkSession, store: str) -> DataFrame:
    """The store's blocks, first counted over all of them."""
    blocks = spark.read.parquet(f"{store}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return with_offset(blocks, totals).withColumn("first", F.col("base") + F.col("first"))


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of every document.

    A block whose table or ids do not match its checksums raises."""
    shared = spark.sparkContext.broadcast(_model(spark, f"{store}/model"))
    placed = _placed(spark, store).select("first", "doc_id", "sizes", "ids_crc32", "model_crc32", *_CODED)
    kind = placed.schema["doc_id"].dataType.elementType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table_crc = shared.value
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(k)[r] for k, n in enumerate(b.schema.names)}
                ids = decode(_coded(row), model).astype("<u4")
                if (table_crc, zlib.crc32(ids.tobytes())) != (row["model_crc32"].as_py(), row["ids_crc32"].as_py()):
                    raise ValueError("a block does not match its checksum")
                size = np.array(row["sizes"].as_py(), np.int64)
                at = np.concatenate(([0], np.cumsum(size)))
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([row["doc_id"].values, pa.array(row["first"].as_py() + at[:-1]), pa.array(size), raw], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(of, f"doc_id {kind}, start long, n_tokens long, ids binary")


def stretch(spark: SparkSession, store: str, start: int, stop: int) -> DataFrame:
    """at, ids: the ids start .. stop-1 of the whole store, a row for each block that has some (at: the place of its first).

    A block is entered at the last checkpoint before the stretch and left at the next one behind it. Checksums cover whole
    blocks, so only the table's is tested here."""
    shared = spark.sparkContext.broadcast(_model(spark, f"{store}/model"))
    here = _placed(spark, store).filter((F.col("first") < stop) & (F.col("first") + F.col("n_tokens") > start)).select("first", "model_crc32", *_CODED)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table_crc = shared.value
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(k)[r] for k, n in enumerate(b.schema.names)}
                if table_crc != row["model_crc32"].as_py():
                    raise ValueError("a block does not match its checksum")
                c, first = _coded(row), row["first"].as_py()
                a, z = max(start - first, 0), min(stop - first, c.n)
                begins = c.steps.astype(np.int64) * c.lanes
                one, other = int(np.searchsorted(begins, a, "right")) - 1, int(np.searchsorted(begins, z, "left"))
                ids = decode(c, model, one, other)[a - begins[one] : z - begins[one]]
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([ids.astype("<u4").tobytes()])], names=["at", "ids"])

    return here.mapInArrow(of, "at long, ids binary")


def report(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write a store in the shared folder, read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    store = f"{shared_dir(spark)}/tokenstore-{uuid.uuid4().hex}"
    write(documents, store, path)
    return read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
