"""The shared hashes: words that make polynomial hashes collide, long runs, and what a long text costs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_tokens import library

from tapebook.llm import common, repetition, resampling, similar, simhash, toxicity
from tapebook.llm.tokens import Encoder, vocabulary


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def one(texts):
    return next(common.chunks(pa.array(texts), 1 << 30))


@pytest.mark.parametrize("x, y", PAIRS)
def test_thue_morse_words(x, y):
    c = one([x, y, f"{x}\n{y}", f"{x} {y}"])
    w = common.words(c, common.SPACED)
    assert len(set(common.span_hash(c.buf, w.start, w.end).tolist())) == 2
    assert common.run_ids(c.buf, w.start, w.end).tolist() in ([0, 1, 0, 1, 0, 1], [1, 0, 1, 0, 1, 0])
    assert repetition._measure(c, 6)[3].tolist() == [0, 0, 0, 0]
    h, of = similar.shingles(c)
    assert h[of[0]] != h[of[1]]


def test_token_ids_of_thue_morse_words():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(vocabulary(name))
        texts = [f"{p} a {q}" for x, y in PAIRS for p, q in ((x, y), (y, x))]
        for text, got in zip(texts, e.encode(texts)):
            assert got.tolist() == library(name, text)


def test_runs_of_every_length():
    r = np.random.default_rng(1)
    words = [r.integers(1, 3, n, np.uint8) for n in range(1, 140) for _ in range(3)]
    buf = np.concatenate([x for w in words for x in (w, w)])
    end = np.cumsum([len(w) for w in words for _ in (0, 1)])
    start = end - np.repeat([len(w) for w in words], 2)
    h = common.span_hash(buf, start, end)
    assert (h[0::2] == h[1::2]).all() and len(set(h.tolist())) == len({w.tobytes() for w in words})
    assert common.same_runs(buf, start[0::2], start[1::2], end[0::2] - start[0::2]).all()
    n = np.minimum(end[:-1] - start[:-1], end[1:] - start[1:])
    want = [buf[a : a + k].tobytes() == buf[b : b + k].tobytes() for a, b, k in zip(start[:-1], start[1:], n)]
    assert common.same_runs(buf, start[:-1], start[1:], n).tolist() == want
    ids = common.run_ids(buf, start, end)
    names = [buf[a:z].tobytes() for a, z in zip(start, end)]
    assert len(set(zip(ids.tolist(), names))) == len(set(names)) == len(set(ids.tolist()))


def test_colliding_hashes_are_told_apart(monkeypatch):
    """Were all hashes equal, ids and counts of lines would still be right."""
    monkeypatch.setattr(common, "span_hash", lambda buf, start, end: np.zeros(len(start), np.uint64))
    c = one(["a b a\na b a\nc"])
    w = common.words(c, common.SPACED)
    assert common.run_ids(c.buf, w.start, w.end).tolist() == [0, 1, 0, 0, 1, 0, 2]
    assert repetition._measure(c, 6)[3].tolist() == [1]


def test_windows():
    h = np.arange(1, 40, dtype=np.uint64)
    for size in range(1, 20):
        a = common.window_hash(h, size)
        assert len(a) == 40 - size and len(set(a.tolist())) == len(a)
        assert (common.window_hash(h[3:], size) == a[3:]).all()
    assert len(common.window_hash(h[:3], 5)) == 0


def test_memory_of_a_long_text():
    """What a text of 4 MB costs each operator's step, in bytes per byte of it (README)."""
    r = np.random.default_rng(3)
    syllables = np.array([x + y for x in "bcdfghjklmnprstv" for y in ("a", "e", "in", "or ", "us ", "on. ")])
    text = "".join(r.choice(syllables, 1_800_000))[:4_000_000]
    c = one([text])
    steps = {
        "words": lambda: common.span_hash(c.buf, *(lambda w: (w.start, w.end))(common.words(c, common.SPACED))),
        "shingles": lambda: similar.shingles(c),
        "ngrams": lambda: resampling._ngrams(c, 1 << 16),
        "features": lambda: toxicity._features(c),
        "repetition": lambda: repetition._measure(c, 6),
        "fingerprint": lambda: list(simhash._fingerprints(pa.array([text]), 3)),
    }
    cost = {}
    for name, step in steps.items():
        tracemalloc.start()
        step()
        cost[name] = tracemalloc.get_traced_memory()[1] / len(text)
        tracemalloc.stop()
    print({k: round(v, 1) for k, v in cost.items()})
    assert max(cost.values()) < 60
