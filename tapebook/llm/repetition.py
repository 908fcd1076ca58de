"""Operator 7: quality rules with suffix-array repetition.

A suffix array over each text's words gives the maximal repeated runs of words as its LCP intervals; the union of the
runs of MIN_RUN words or more is the repeated part.  A text is kept if it passes the base rules, the repeated part is at
most MAX_COVERED of its words, and the longest repeated run is at most MAX_RUN words and MAX_RUN_SHARE of its words.
The shares are the smallest multiples of a twentieth that keep every document labelled good and passing the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import SPACED, Chunk, chunks, columns, grown, run_ids, words
from tapebook.llm.suffixes import covered, repeats

MIN_RUN = 6
MAX_COVERED = 0.3
MAX_RUN = 100
MAX_RUN_SHARE = 0.15

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_run_words", "longest_run")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _dup_lines(c: Chunk, word: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(c.buf == 0x0A)
    start = np.concatenate(([0], end[:-1] + 1))
    total = np.concatenate(([0], np.cumsum(word)))
    used = total[end] > total[start]
    start, end = start[used], end[used]
    text = np.searchsorted(c.off, start, "right") - 1
    line = run_ids(c.buf, start, end)
    order = np.lexsort((line, text))
    text, line = text[order], line[order]
    again = np.concatenate(([False], (text[1:] == text[:-1]) & (line[1:] == line[:-1])))[: len(text)]
    return np.bincount(text[again], minlength=c.n)


def _measure(c: Chunk, min_run: int) -> list[np.ndarray]:
    word = SPACED[c.buf]
    w = words(c, SPACED)
    run = repeats(run_ids(c.buf, w.start, w.end), w.of)
    three = covered(np.where(run >= 3, 3, 0), w.of)
    longer = np.where(run >= min_run, run, 0)
    longest = np.zeros(c.n, np.int64)
    full = np.flatnonzero(np.diff(w.of))
    if len(full):
        longest[full] = np.maximum.reduceat(longer, w.of[full])
    chars = word & ((c.buf & 0xC0) != 0x80)
    return [np.diff(w.of), _sums(chars, c.off), _sums(_SYMBOL[c.buf], c.off), _dup_lines(c, word), _sums(three, w.of), _sums(covered(longer, w.of), w.of), longest]


def measures(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",), min_run: int = MIN_RUN) -> DataFrame:
    """The carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in 3-word windows that stand
    twice or more), n_run_words (words in repeated runs of min_run or more), longest_run. Null and empty texts: zeros. Words and lines are compared by
    their bytes; a text of any length is measured whole."""
    docs = columns(documents, *carry, "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_measure(c, min_run) for c in chunks(b.column(b.num_columns - 1))]
            cols = [np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(len(_NAMES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, cols)], names=[*b.schema.names[:-1], *_NAMES])

    return docs.mapInArrow(of, grown(docs.schema.fields[:-1], ", ".join(f"{n} long" for n in _NAMES)))


def judged(measured: DataFrame, max_covered: float = MAX_COVERED, max_run: int = MAX_RUN, max_run_share: float = MAX_RUN_SHARE) -> DataFrame:
    """measured with base_failed and kept."""
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    covered_ok = F.col("n_run_words") <= F.col("n_words") * max_covered
    run_ok = (F.col("longest_run") <= max_run) & (F.col("longest_run") <= F.col("n_words") * max_run_share)
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & covered_ok & run_ok)


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the five base measures, base_failed, kept, and n_run_words and longest_run."""
    return judged(measures(documents)).select("doc_id", *_NAMES[:5], "base_failed", "kept", *_NAMES[5:])

