"""Operator 10: concatenate and cut.

Pass one tokenises each partition once and writes its documents' ids with their running counts; the partitions' totals
give every partition a global offset by one prefix sum.  Pass two cuts the global id stream every `length` ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import chunks, columns, cut
from tapebook.llm.offsets import with_offset
from tapebook.llm.tokens import encoder, vocabulary

LENGTH = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"


def tokenized(documents: DataFrame, path: str, end: int | None = END) -> DataFrame:
    """part, first (ids of the part before this document), doc_id, n_tokens, ids (little-endian unsigned 16- or 32-bit
    integers, the end id included) per row. Null and empty texts have the end id alone.

    part and first are of one run of the partition, so write the result before using them."""
    docs = columns(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(path), TaskContext.get().partitionId(), 0
        width = id_type(enc.library.get_vocab_size())
        for b in batches:
            for c in chunks(b.column(1)):
                ids, at = enc.encode_chunk(c)
                ids = ids.astype(width)
                if end is not None:
                    ids = np.insert(ids, at[1:], end)
                    at = at + np.arange(len(at))
                n = np.diff(at)
                offsets = pa.py_buffer((at * np.dtype(width).itemsize).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), c.n, [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(c.n, part, np.int32)), pa.array(done + at[:-1]), b.column(0).slice(c.first, c.n), pa.array(n), raw], names=["part", "first", "doc_id", "n_tokens", "ids"])
                done += int(at[-1])

    return docs.mapInArrow(of, f"part int, first long, doc_id {kind}, n_tokens long, ids binary")


def id_type(size: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if size <= 1 << 16 else "<u4"


def id_width(path: str) -> str:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(path).get_vocab_size())


_PIECES = "doc_id {}, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, end: int | None = END) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, boundary (the piece is cut
    off from another part of its document), ids (little-endian unsigned 32-bit).

    Sequence s holds ids s*length .. (s+1)*length-1 of all documents in a row; only the last sequence is short.
    Every id of every row lies in exactly one piece; repeated rows are packed as often as they stand there; a row with a
    null doc_id is packed under it. Without an end id, documents without ids have no piece. An empty table gives no rows."""
    path = path or vocabulary(VOCABULARY)
    width = id_width(path)
    table = cut(tokenized(documents, path, end), "packing")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    placed = with_offset(table, totals).select("doc_id", (F.col("base") + F.col("first")).alias("at"), "ids")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, raw, ats = [], b.column(2).to_pylist(), b.column(1).to_pylist()
            for i, at in enumerate(ats):
                ids = np.frombuffer(raw[i], width).astype("<u4")
                done, n = 0, len(ids)
                while done < n:
                    seq, off = divmod(at + done, length)
                    size = min(length - off, n - done)
                    rows.append((i, done, size, n, seq, off, size < n, ids[done : done + size].tobytes()))
                    done += size
            if rows:
                row, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), *map(pa.array, rest)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids"])

    return placed.mapInArrow(of, _PIECES.format(kind))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, at most `length` ids): the pieces of each sequence joined in their order."""
    joined = "aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (done, x) -> concat(done, x.ids))"
    return pieces.groupBy("sequence_id").agg(F.expr(joined).alias("ids"))


def report(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    p = pack(documents, path)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
