"""Static range asymmetric numeral system over numpy lanes: 64-bit states, 32-bit words, a 20-bit frequency table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SHIFT = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)
_FULL = np.uint64(31 - BITS + 32)


class Model:
    """Frequencies scaled to 2**20 slots; every id that occurs has at least one."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.float64)
        share = np.floor(counts / max(counts.sum(), 1) * (1 << BITS)).astype(np.int64)
        freq = np.where(counts > 0, np.maximum(share, 1), 0)
        rest = (1 << BITS) - int(freq.sum())
        if counts.any():
            for k in np.argsort(-freq, kind="stable"):  # a few of the most frequent ids take up the rounding
                if not rest:
                    break
                step = rest if rest > 0 else max(rest, 1 - int(freq[k]))
                freq[k] += step
                rest -= step
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


@dataclass
class Coded:
    """words, and a checkpoint every so many steps: the lanes' states before it and its place in words."""

    n: int
    lanes: int
    words: np.ndarray
    steps: np.ndarray
    places: np.ndarray
    states: np.ndarray


def encode(ids: np.ndarray, model: Model, lanes: int, every: int) -> Coded:
    """Lane k takes ids k, k+lanes, ...; ids are coded last to first so that they are read first to last."""
    n = len(ids)
    steps = -(-n // lanes)
    sym = np.full(steps * lanes, ids[-1], dtype=np.int64)
    sym[:n] = ids
    sym = sym.reshape(steps, lanes)
    x = np.full(lanes, _LOW)
    out, marks, done = [], [], 0
    for t in range(steps, -1, -1):
        if t < steps and (t % every == 0):
            marks.append((t, done, x.copy()))
        if t == 0:
            break
        f = model.freq[sym[t - 1]]
        over = x >= f << _FULL
        if over.any():
            out.append(x[over].astype(np.uint32))
            done += len(out[-1])
            x[over] >>= _WORD
        q = x // f
        x = (q << _SHIFT) + (x - q * f) + model.first[sym[t - 1]]
    marks.reverse()
    words = np.concatenate([*reversed(out), np.zeros(0, np.uint32)])
    return Coded(n, lanes, words, np.array([m[0] for m in marks], np.int32), np.array([len(words) - m[1] for m in marks], np.int32), np.stack([m[2] for m in marks]))


def decode(c: Coded, model: Model, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids between checkpoint first and checkpoint last (default: to the end); each stretch is decoded on its own."""
    total = -(-c.n // c.lanes)
    at, place, x = int(c.steps[first]), int(c.places[first]), c.states[first].copy()
    stop = total if last is None or last >= len(c.steps) else int(c.steps[last])
    out = np.empty((stop - at, c.lanes), np.uint32)
    for t in range(stop - at):
        slot = x & _MASK
        s = model.symbol[slot.astype(np.int64)]
        out[t] = s
        x = model.freq[s] * (x >> _SHIFT) + slot - model.first[s]
        need = x < _LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << _WORD) | c.words[place : place + k].astype(np.uint64)
            place += k
    return out.ravel()[: c.n - at * c.lanes]
