import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from tapebook.llm import simhash, similar
from tapebook.llm.graph import components


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values, radius):
    label = list(range(len(values)))
    for _ in values:
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def near_values(r, n):
    centres = [r.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        v = r.choice(centres)
        for _ in range(r.randrange(9)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_trees(seed):
    values = near_values(random.Random(seed), 70)
    array = np.array(values, np.uint64)
    want = brute_classes(values, 2)
    assert simhash.classes(array, 2).tolist() == want
    tree = simhash.BKTree(array)
    hits = {(n, int(q)) for n, qs in tree.within(array, 2) for q in qs}
    assert hits == {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if (x ^ y).bit_count() <= 2}


@pytest.mark.parametrize("shard", [4096, 20])
def test_links_over_shards(spark, shard):
    values = near_values(random.Random(9), 120)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard=shard)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_classes(values, 2)
    got = [root.get(v, v) for v in signed]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(120) for j in range(i))


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in pairs for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_report(spark, hard):
    from conftest import HARD

    rows = [r.asDict() for r in simhash.report(hard).collect()]
    want = sorted((str(d), f"{brute_fp(t):016x}") for d, t in HARD)
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == want
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[2] == 1 and by[4] == by[5] == by[3] == 3 and by[None] is None and by[6] == 6
    assert simhash.fingerprints(hard).count() == len(HARD)


def test_one_of_each(spark, hard, empty):
    kept = simhash.one_of_each(hard)
    assert kept.columns == hard.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 6, 7, 8, 9, None]))
    assert simhash.one_of_each(empty).count() == 0 and simhash.report(empty).count() == 0


def test_similar_against_brute_force(spark, docs_of):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 120]))]
        for _ in range(r.randrange(1, 6)):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((k, " ".join(text)))
            k += 1
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    kept = {x["doc_id"] for x in similar.one_of_similar(docs_of(rows)).collect()}
    assert kept == {i for i in label if label[i] == i}


def test_similar_hard(spark, hard, empty):
    kept = similar.one_of_similar(hard)
    assert kept.columns == hard.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 6, 7, 8, 9, None]))
    assert similar.one_of_similar(empty).count() == 0


def edited_copies(n, r, edits=3, size=200):
    """n copies of one text that is not among them, each with some words replaced."""
    base = [f"w{r.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        text = list(base)
        for k in r.sample(range(size), edits):
            text[k] = f"x{r.randrange(10**6)}"
        out.append(" ".join(text))
    return base, out


def exact_classes(texts):
    """Over all pairs, by counts of common shingles."""
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    place = {}
    rows = np.zeros((len(sets), len(set().union(*sets))), np.float32)
    for i, s in enumerate(sets):
        rows[i, [place.setdefault(g, len(place)) for g in s]] = 1
    common, size = rows @ rows.T, np.array([len(s) for s in sets])
    near = common >= 0.8 * (size[:, None] + size - common) - 1e-4
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label, len(sets)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def test_two_hundred_variants_of_an_absent_original(spark, docs_of):
    """Recall of true links, and components, as over all pairs."""
    for seed in (1,):
        texts = edited_copies(200, random.Random(seed), edits=3, size=150)[1]
        want = exact_classes(texts)
        kept = {x["doc_id"] for x in similar.one_of_similar(docs_of(list(enumerate(texts)))).collect()}
        assert kept == {i for i, c in enumerate(want) if c == i}


def test_heads_come_once_for_many_pairs(spark, docs_of, monkeypatch):
    """Pairs of one document over several shares of its pairs, on both sides of a batch."""
    monkeypatch.setattr(similar, "SHARE", 3)
    base, texts = edited_copies(40, random.Random(8), edits=1)
    docs = spark.createDataFrame([(0, " ".join(base)), *enumerate(texts, 1), (99, "else"), (98, None)], "node long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 41)] + [(99, 0), (98, 0), (0, 99)], "u long, v long")
    assert sorted(map(tuple, similar.verified(pairs, docs, 5, 0.8).collect())) == [(k, 0) for k in range(1, 41)]
    sketches = similar.sketched(docs, 5)
    assert sketches.count() == 42 and sorted(r["u"] for r in similar.possible(pairs, sketches, 0.8).collect()) == list(range(1, 41))


def test_thousand_copies_without_their_original(spark, docs_of, monkeypatch):
    monkeypatch.setattr(similar, "AT_ONCE", 0)
    monkeypatch.setattr(similar, "LEFT", 100)
    monkeypatch.setattr(similar, "RIGHT", 300)
    texts = edited_copies(1000, random.Random(5))[1]
    want = {i for i, c in enumerate(exact_classes(texts)) if c == i}
    assert len(want) < 50
    kept = {x["doc_id"] for x in similar.one_of_similar(docs_of(list(enumerate(texts)))).collect()}
    assert kept == want


def test_links_of_documents_that_simhash_drops(spark, docs_of, hard):
    """The original (5) goes for a copy (3) within two bits; what is similar to the original only (7) is of the group too."""
    r = random.Random(11)
    share = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b)))
    while True:
        base = [f"w{r.randrange(5000)}" for _ in range(600)]
        near = base[:300] + ["new"] + base[301:]
        if (brute_fp(" ".join(base)) ^ brute_fp(" ".join(near))).bit_count() <= 2:
            break
    far = [f"x{k}" for k in range(66)] + base[66:]
    assert share(base, far) >= 0.8 > share(near, far)
    rows = [(5, " ".join(base)), (3, " ".join(near)), (7, " ".join(far)), (8, " ".join(base)), (9, "apart from all of them")]
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()} == {3, 9}
    kept = corpus_pipeline.near_dedup(spark, hard, "")
    assert kept.columns == hard.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(map(str, [1, 3, 6, 7, 8, 9, None]))
