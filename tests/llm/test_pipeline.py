import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_filters import brute_hits, brute_spans

import __spark_entry__ as entry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_one_by_one(spark, sf):
    """Each stage against a brute-force version on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out = out.cache()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        gone = text.keys() - after.keys()
        if name == "quality":
            assert {d for d in gone if labels.get(d) == 1} == set() and {d for d in after if labels.get(d) == 0} == set()
        elif name == "near_dedup":
            norm = lambda d: re.sub(r"[\x20\x09-\x0D]+", " ", text[d].translate(LOWER)).strip(" ")  # noqa: B023, E731
            first = {}
            for d in sorted(text):
                first.setdefault(norm(d), d)
            assert {d for d in text if first[norm(d)] != d} <= gone  # exact copies go
            words = {d: norm(d).split(" ") for d in text}
            sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
            kept = sorted(after)
            near = [(a, b) for i, a in enumerate(kept) for b in kept[:i] if text[a].strip() and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert near == []
            assert all(max(len(sets[d] & sets[k]) / len(sets[d] | sets[k]) for k in text if k != d) >= 0.7 for d in gone)
        elif name == "decontamination":
            assert gone == {d for d, t in text.items() if brute_hits(t, items)[4]}
        else:
            assert not gone
            for d, t in text.items():
                spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(t)[0].split(",") if s]
                merged = []
                for a, z in spans:
                    if merged and merged[-1][1] > a:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                for a, z in reversed(merged):
                    t = t[:a] + "[SECRET]" + t[z:]
                assert after[d] == t
        if name != "secret_scan":
            assert all(after[d] == text[d] for d in after)
        docs, text = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    per = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in per} == text.keys() and all(r["n"] == r["m"] for r in per)


def test_registered(spark, sf):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secret_scan", "packing"]
