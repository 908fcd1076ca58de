import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapebook.llm import negatives, piecewise, variants

from conftest import HARD, LONG

# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows):
    """rows (vec_id, label, vector), all usable: every anchor against every row, in whole numbers of any size."""
    wide = max((len(v) for _, _, v in rows), default=0)
    rows = sorted({(i, l, tuple(int(np.floor(256 * float(x))) for x in (*v, *[0.0] * (wide - len(v))))) for i, l, v in rows})
    out = set()
    for a, label, x in rows:
        if a % 100:
            continue
        each = {(-max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(x, y)))), i, m == label) for i, m, y in rows if i != a}
        first = lambda some: sorted(some)[:5]
        for s, p, _ in first(e for e in each if e[2]):
            for rank, (t, n, _) in enumerate(first(e for e in each if not e[2] and 80 * -s <= 100 * -e[0] <= 100 * -s), 1):
                out.add((a, p, rank, n, -s, -t))
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, l, v, 1.0, "x") for i, l, v in rows], f"vec_id long, label int, embedding array<{kind}>, score double, q string")


def mined(df):
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("members, block, slice_bytes", [(256, 4_000_000, 16_000_000), (2, 2_000, 600)])
def test_negatives_equal_brute_force(spark, monkeypatch, members, block, slice_bytes):
    monkeypatch.setattr(negatives, "MEMBERS", members)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(negatives, "SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 6))
    rows = []
    for i in range(900):
        k = int(rng.integers(4))
        v = (centre[k] + rng.normal(size=6) * 0.3).astype(np.float32)
        rows.append((i * 25, (k + int(rng.random() < 0.3)) % 4, [float(x) for x in v]))
    rows += [(100_000 + i, 1, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(0, 300, 20)]  # one vector many times: ties by vec_id
    rows += [(200_000 + i, 2, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(300_000, 1, [0.0] * 6), (300_001, 2, [0.0] * 6), (300_100, 3, [-0.1] * 6), (-100, 0, [1.0] * 6)]
    rows += rows[:40]  # repeated rows count once
    assert mined(vectors(spark, rows).repartition(5)) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(500, None, [1.0]), (600, 1, None), (None, 1, [1.0]), (700, 1, [None, 1.0]), (800, 1, [nan]), (900, 1, [inf, 0.0]), (1000, 1, [-inf])]
    fine = [(100, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.9, 0.1, 7.0]), (4, 1, []), (5, 2, []), (200, 2, []), (300, 9, [1.0])]
    assert mined(vectors(spark, odd + fine)) == brute_negatives(fine)
    huge = [(100, 1, [1e30, 1.0]), (1, 1, [1e30]), (2, 2, [9e29]), (3, 2, [1e-3]), (4, 1, [1.0]), (5, 2, [0.9]), (200, 1, [2e15, 3e15]), (6, 1, [2e15, 2e15]), (7, 2, [1.9e15, 2e15])]
    assert mined(vectors(spark, huge, "double")) == brute_negatives(huge)
    assert mined(vectors(spark, [])) == set() and mined(vectors(spark, odd)) == set() and mined(vectors(spark, [(100, 1, [1.0])])) == set()
    assert negatives.report(vectors(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_a_walk_ends_early_and_loses_nothing():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4000, 4)))
    length, a = np.sqrt((x**2).sum(axis=1)), x[:20]
    centres = (a.sum(axis=0) / np.linalg.norm(a.sum(axis=0)))[None]
    near = np.flatnonzero(negatives._angles(a, length[:20], centres)[:, 0] < 0.9)
    spread = negatives._angles(a[near], length[near], centres)[:, 0].max()
    c = negatives.Cluster(0, 0, spread, np.arange(len(near)) + 10**6, a[near], length[near], np.full((len(near), 1), negatives._LOWEST), np.full((len(near), 1), negatives._HIGHEST), 0)
    best = negatives.Best(c.low, 5)
    taken = negatives.walk(c, best, np.arange(len(x)), x, negatives.bounds(length, negatives._angles(x, length, centres)[:, 0], spread))
    assert (best.score == -np.sort(-(a[near] @ x.T).astype(np.int64), axis=1)[:, :5]).all() and taken < len(near) * len(x) / 2


def test_negatives_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(negatives.SQL)
    got = negatives.report(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert want.columns == got.columns and sorted(want.fetchall()) == sorted(tuple(r) for r in got.collect())


# ---------------------------------------------------------------- piecewise fingerprints


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, u in enumerate(x):
        new = [i + 1]
        for j, v in enumerate(y):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (u != v)))
        row = new
    return row[-1]


def plain_print(text):
    """The fingerprint of a short text (no chain longer than _STEP bytes), one byte after another."""
    mask = 0xFFFFFFFF

    def mixed(h):
        h ^= h >> 16
        h = h * 0x7FEB352D & mask
        h ^= h >> 15
        h = h * 0x846CA68B & mask
        return h ^ h >> 16

    b = bytes(6) + text.encode()
    hashes, seen = [], {}
    for i in range(len(b) - 6):
        h = 0
        for x in b[i : i + 7]:
            h = (h * 0x9E3779B1 + x) & mask
        h = mixed(h)
        at, nth = seen.get(h, (-100, 0))
        nth = nth + 1 if i - at <= piecewise.REPEAT else 0
        seen[h] = (i, nth)
        hashes.append(mixed(h + nth * 0x9E3779B1 & mask) if nth else h)
    ends = lambda h, k: h & ((1 << k) - 1) == 0
    first = next(k for k in range(33) if sum(ends(h, k) for h in hashes) <= piecewise.PIECES)
    out = []
    for k in range(first, first + piecewise.LEVELS):
        pieces, now = [], []
        for h in hashes:
            now.append(h >> 16)
            if ends(h, k):
                pieces, now = [*pieces, now], []
        pieces += [now] if now else []
        out.append(np.array([(sum(p) & mask) * 0x9E3779B1 % (1 << 32) >> 20 for p in pieces], np.int16).reshape(-1))
    return str(piecewise.Print(first, out))


TEXTS = [t or "" for _, t in HARD] + ["ab", "\0", "x\0\0", "Eres " * 400, "a" * 5000, "line of words\n" * 90, "héé漢字" * 3]


def test_fingerprints_equal_a_plain_version():
    r = random.Random(1)
    texts = [t for t in TEXTS if len(t) < 10_000] + ["".join(r.choice("ab cdé") for _ in range(r.randrange(600))) for _ in range(40)]
    assert [str(p) for p in piecewise.prints(texts)] == [plain_print(t) for t in texts]
    assert all(str(piecewise.parsed(str(p))) == str(p) for p in piecewise.prints(texts))


def test_fingerprints_depend_on_the_text_alone(monkeypatch):
    alone = [str(piecewise.prints([t])[0]) for t in TEXTS]
    assert [str(p) for p in piecewise.prints(TEXTS)] == alone == [str(p) for p in piecewise.prints(TEXTS[::-1])][::-1]
    assert all(len(s) <= piecewise.PIECES + 1 for p in piecewise.prints([*TEXTS, LONG * 5]) for s in p.signatures)


def test_distances_equal_a_plain_version():
    rng = np.random.default_rng(2)
    some = [rng.integers(0, 3, rng.integers(0, 9)).astype(np.int16) for _ in range(600)]
    assert piecewise._distances(some[:300], some[300:]).tolist() == [levenshtein(a.tolist(), b.tolist()) for a, b in zip(some[:300], some[300:])]


def test_likeness_follows_what_is_shared():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    text, other = " ".join(words[:2000]), " ".join(words[2000:])
    near = lambda a, b: float(piecewise.likeness(piecewise.prints([a]), piecewise.prints([b]))[0])
    assert near(text, text) == 1 and near("", "") == 1 and near("", text) == 0 and near(text, other) < 0.1
    assert near(text, text.replace(words[1000], "changed", 1)) > 0.9 and 0.3 < near(text, piecewise.edited(text, other)) < 0.7
    assert near("Eres " * 400, piecewise.edited("Eres " * 400, other)) > 0.3


@pytest.mark.parametrize("parts", [1, 7])
def test_piecewise_rows(spark, docs_of, parts):
    rows = HARD + [(20 + i, f"text {i} " * i) for i in range(25)]
    docs = docs_of(rows).repartition(parts)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        p, q, n = piecewise.prints([t, new, after])
        want.append((str(d), len(t), digest(new), str(p), str(q), round(float(piecewise.likeness([p], [q])[0]), 9), round(float(piecewise.likeness([p], [n])[0]), 9)))
    got = [(str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in piecewise.report(docs).collect()]
    assert sorted(got) == sorted(want)


def test_piecewise_columns(spark, docs_of, hard, empty):
    assert piecewise.report(empty).count() == 0 and piecewise.report(hard).columns == ["doc_id", *piecewise._NAMES]
    one = piecewise.report(docs_of([(1, "only one text")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    fp = piecewise.fingerprints(hard)
    same = fp.filter("doc_id = 6").select("fingerprint").distinct()
    assert same.count() == 1 and fp.count() == len(HARD)
    pairs = fp.select("fingerprint", F.lit("1:::").alias("b"), F.lit(None).cast("string").alias("c"))
    assert piecewise.compared(pairs, "fingerprint", "c").filter("likeness IS NULL").count() == len(HARD)
    assert piecewise.compared(pairs, "fingerprint", "b").filter("likeness = 1").count() == 2


# ---------------------------------------------------------------- spelling variants


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, every=97, min_count=3):
    lower = {k: k + 32 for k in range(65, 91)}
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            counts[run if h % every else run[:k] + run[k + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(a, key=lambda v: (-counts[v], v)) for w, a in around.items() if a}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "-", root(w), n, len(around[w]), counts[form[w]] if w in form else -1) for w, n in counts.items())


def told(df):
    return sorted((r["word"], r["form"] or "-", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def variant_rows():
    r = random.Random(8)
    base = ["abcde", "abcdé", "ÀBcde", "aaaaaa", "aaaaa", "aaaab", "information", "naïveté", "straße"]
    words = []
    for _ in range(4000):
        w = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + r.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("abc") + w[k + 1 :]])
        words.append(r.choice([w, w.upper(), w.title()]))
    return HARD + [(50 + i, " ".join(words[i * 100 : i * 100 + 100]) + ", x1y÷z") for i in range(40)] + [(None, "Abcde abcde ABCDE")]


@pytest.mark.parametrize("part, cells, held", [(1024, 4_000_000, 200_000), (3, 50, 20)])
def test_variants_equal_brute_force(spark, docs_of, monkeypatch, part, cells, held):
    monkeypatch.setattr(variants, "CELLS", cells)
    monkeypatch.setattr(variants, "HELD", held)
    monkeypatch.setattr(variants.near_words, "__defaults__", (part,))
    rows = variant_rows()
    got = told(variants.report(docs_of(rows).repartition(3)))
    assert got == brute_variants(rows) and sum(g[4] > 3 for g in got) > 20 and any(g[1] != "-" and g[1] != g[2] for g in got)


def test_counts_with_many_deletions_and_long_runs(spark, docs_of):
    run = "long" * 50_000
    rows = [(i, f"Wörter {run} {run}a ÿÀ-Ünder word{i}") for i in range(60)]
    counts = {r["word"]: r["n"] for r in variants.word_counts(docs_of(rows), every=3).collect()}
    want = collections.Counter()
    for d, t in rows:
        for x in re.findall("[A-Za-z\u00C0-\u00FF]+", t):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{d}:{x}".encode())
            k = h % len(x)
            want[x if h % 3 else x[:k] + x[k + 1 :]] += 1
    assert counts == {w: n for w, n in want.items() if len(w) >= 5}


def test_long_chains_of_forms(spark):
    word = lambda k: "a" * k + "b" * (12 - k)
    rows = [(word(k), 3 * 2**k) for k in range(13)] + [("zzzzz", 3)]
    got = told(variants.grouped(spark.createDataFrame(rows, "word string, n long")))
    assert [g for g in got if g[0] == word(0)] == [(word(0), word(1), word(12), 3, 1, 6)] and ("zzzzz", "-", "zzzzz", 3, 0, -1) in got


def test_variants_of_nothing(spark, docs_of, empty):
    assert variants.report(empty).count() == 0 and variants.report(docs_of([(1, None), (2, ""), (3, "abcd")])).count() == 0
    assert variants.report(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
