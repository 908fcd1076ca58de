import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tapebook.plans import queries

NAMES = ("normalize_orders", "event_tape", "order_lifecycle", "book_top10_at_quotes", "missing_order_report", "validation_summary", "seek_batch_all", "bucket_snapshots", "b_missing_reason_counts", "csv_roundtrip", "b_book_top10_at_quotes", "enriched_missing_orders", "file_encodings", "missing_session_files", "mixed_session_files", "import_report", "diagnostics_output", "rejected_rows", "quarantine_counts", "books_at", "published_runs", "merged_mismatch_groups", "merged_validation_summary", "merged_match_by_window", "merged_visible_summary", "parquet_roundtrip", "path_sessions")


def told(value):
    return "-" if value is None or value != value else str(round(float(value), 9)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(told(r[n]) for n in names) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(n) for n in names]
    assert sorted(rel.columns) == names and got == sorted(tuple(told(r[k]) for k in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_replay_query_has_sql():
    assert queries.QUERIES.keys() <= entry.oracle_sql().keys()


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"


def said(code, cwd):
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(cwd)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split(), out.stderr


def test_entry_without_a_module_that_the_operators_need():
    replay = len(queries.QUERIES)
    told, why = said("import sys; sys.modules['xxhash'] = None; " + SAY, ROOT)
    assert told == [str(replay), str(replay), "False"] and "xxhash" in why


def test_entry_and_tests_without_the_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    told, _ = said(SAY, tmp_path / "r")
    assert told[2] == "False" and told[0] == told[1]
    said("import sys, pytest; sys.exit(pytest.main(['tests', '-q', '--collect-only', '-p', 'no:cacheprovider']))", tmp_path / "r")
