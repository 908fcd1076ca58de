"""Suffix arrays over the words of many texts at once, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, longest common prefix of each with the one before it) for small word numbers; text i has
    of[i]:of[i+1].

    Suffixes are ordered within their text, texts one after another; no prefix reaches over a text's end. Ranks are kept
    once per doubling, in four bytes a word: as many times as the longest repeat's length has bits."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(of)
    text = np.repeat(np.arange(len(size)), size)
    stop = np.repeat(of[1:], size)
    first = ids.astype(np.int64) + text * (int(ids.max()) + 1)
    sa = np.argsort(first, kind="stable")
    sorted_first = first[sa]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], sorted_first[1:] != sorted_first[:-1])), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    levels, k = [], 1
    place = np.arange(n)
    while True:
        levels.append(rank.astype(np.int32))
        start = rank[sa[place]]
        many = np.bincount(start, minlength=n)[start] > 1
        place = place[many]
        if not len(place):
            break
        at = sa[place]
        after = at + k
        inside = after < stop[at]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        major = rank[at]
        order = np.lexsort((second, major))
        at, major, second = at[order], major[order], second[order]
        sa[place] = at
        fresh = np.concatenate(([True], (major[1:] != major[:-1]) | (second[1:] != second[:-1])))
        rank[at] = np.maximum.accumulate(np.where(fresh, place, 0))
        k *= 2
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, done = sa[pair - 1], sa[pair], np.zeros(len(pair), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + done, b + done
        inside = (x < stop[a]) & (y < stop[b])
        same = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        done += same * (1 << j)
    lcp[pair] = done
    return sa, lcp


def repeats(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest run from it that stands elsewhere in its text too (overlaps count).

    That is the depth of the innermost LCP interval that holds the suffix: the larger of its two neighbouring LCPs."""
    sa, lcp = suffix_array(ids, of)
    out = np.zeros(len(ids), np.int64)
    out[sa] = np.maximum(lcp, np.concatenate((lcp[1:], [0]))[: len(lcp)])
    return out


def covered(length: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which words the union of the spans [i, i+length[i]) covers (spans end in their text)."""
    n = len(length)
    reach = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + length[at], -1)
    return np.cumsum(reach[:-1]) > 0
