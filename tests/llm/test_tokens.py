import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tapebook.llm import packing, tokenstore
from tapebook.llm.rans import Model, decode, encode
from tapebook.llm.tokens import Encoder, vocabulary

ODD = ["a  b", " a", "a ", "a\n b", "a \nb", "it's", " ", "\n", "a b c", "é é x ́y", "a​ b", "don't. 'll x", "x.'s y", "a | b", "$$$ a", "12 345. x", "a　b", "<|endoftext|> a", "ab. cd.\nEf gh", "a\x1c b", "﻿ a", "x—, y", "ǅ ß İ", "a\r\nb", "1'2 a'b", "\U0001f600, \U0001f600"]


@lru_cache
def loaded(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t


def library(name, text):
    return loaded(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_s_ids(name):
    e, r = Encoder(vocabulary(name)), random.Random(5)
    alphabet = ["a", "B", "the", "é", "1", ",", ".", "'", "'s", " ", " ", " ", "\n", "$", "漢", "\t", " ", "\U0001f600", "-", "́", "~", "^", "|"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(1500)]
    for text, got in zip(texts, e.encode(texts)):
        assert got.tolist() == library(name, text), repr(text)


@pytest.mark.parametrize("n, lanes, every", [(1, 1, 4), (5, 8, 2), (1000, 7, 16), (5000, 64, 8)])
def test_rans_round_trip(n, lanes, every):
    ids = np.random.default_rng(n).zipf(1.3, n) % 500
    model = Model(np.bincount(ids, minlength=600))
    c = encode(ids, model, lanes, every)
    assert model.freq.sum() == 1 << 20 and (decode(c, model) == ids).all()
    for k in range(len(c.steps)):  # from every checkpoint, and between two
        assert (decode(c, model, k) == ids[c.steps[k] * lanes :]).all()
        if k + 1 < len(c.steps):
            assert (decode(c, model, k, k + 1) == ids[c.steps[k] * lanes : c.steps[k + 1] * lanes]).all()
    alone = Model(np.bincount([3, 3]))
    assert (decode(encode(np.array([3, 3, 3]), alone, 2, 1), alone) == 3).all()


def brute(rows, name):
    out = [(d, np.array([*library(name, t or ""), 1], "<u4")) for d, t in rows]
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


def test_store(spark, hard):
    from conftest import HARD

    want, start = [], 0
    for d, ids in brute(HARD, tokenstore.VOCABULARY):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenstore.report(hard).collect()), key=str) == sorted(want, key=str)


def test_store_blocks_and_checksums(spark, hard, tmp_path):
    tokenstore.write(hard, f"{tmp_path}/s", block=100, lanes=4)
    blocks = spark.read.parquet(f"{tmp_path}/s/blocks")
    assert blocks.count() > 1 and tokenstore.read(spark, f"{tmp_path}/s").count() == hard.count()
    from pyspark.sql import functions as F

    blocks.withColumn("ids_crc32", F.col("ids_crc32") + 1).write.parquet(f"{tmp_path}/t/blocks")
    spark.read.parquet(f"{tmp_path}/s/model").write.parquet(f"{tmp_path}/t/model")
    with pytest.raises(Exception, match="checksum"):
        tokenstore.read(spark, f"{tmp_path}/t").collect()


def test_stretches_from_checkpoints(spark, hard, tmp_path):
    tokenstore.write(hard, f"{tmp_path}/s", block=2000, lanes=4)
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(tokenstore.read(spark, f"{tmp_path}/s").collect(), key=lambda r: r["start"])])
    r = random.Random(2)
    for start, stop in [(0, len(whole)), (0, 1), (len(whole) - 1, len(whole) + 5), *(sorted(r.sample(range(len(whole)), 2)) for _ in range(4))]:
        rows = sorted(tokenstore.stretch(spark, f"{tmp_path}/s", start, stop).collect(), key=lambda x: x["at"])
        assert rows[0]["at"] == start and np.concatenate([np.frombuffer(x["ids"], "<u4") for x in rows]).tolist() == whole[start:stop].tolist()
    assert tokenstore.stretch(spark, f"{tmp_path}/s", len(whole), len(whole) + 9).count() == 0


def test_packing(spark, hard):
    from conftest import HARD

    pieces = [r.asDict() for r in packing.pack(hard, length=64).collect()]
    tape = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] <= 64 - p["offset"] and p["boundary"] == (p["length"] < p["doc_tokens"])
        tape[p["sequence_id"], p["offset"]] = len(ids)
    at = 0
    for (seq, off), n in sorted(tape.items()):  # gapless, all but the last sequence full
        assert seq * 64 + off == at
        at += n
    docs = brute(HARD, packing.VOCABULARY)
    assert at == sum(len(ids) for _, ids in docs)
    for d in {d for d, _ in docs}:
        mine = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == d)
        joined = b"".join(x for _, x in mine)
        want = [ids.tobytes() for i, ids in docs if i == d]
        assert len(joined) == sum(map(len, want)) and (len(want) > 1 or joined == want[0])
    full = packing.sequences(packing.pack(hard, length=64)).collect()
    assert sum(len(r["ids"]) // 4 for r in full) == at and max(len(r["ids"]) for r in full) == 256


def test_nothing(spark, empty):
    assert packing.report(empty).count() == 0 and tokenstore.report(empty).count() == 0
