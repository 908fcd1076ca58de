import pytest
from pyspark.sql import functions as F

from tapebook.plans import jobs
from tapebook.plans.tapes import raw_a
from tapebook.schemas import FILES
from tapebook.sources.session_csv import first_rows, inspect, listed, missing_files, mixed_sessions, nul_counts, numbered, read_csv, read_kind
from tapebook.sources.session_tables import read_sessions, write_sessions


@pytest.fixture(scope="module")
def source(spark, sf, tmp_path_factory):
    """Two sessions of tape A as their three files each, in GB18030 and UTF-8 with a NUL and a blank last header."""
    root = tmp_path_factory.mktemp("sessions")
    tables = dict(zip(("quotes", "orders", "trades"), raw_a(spark, sf)))
    frames = {k: t.orderBy("seq").toPandas() for k, t in tables.items()}
    keys = [set(zip(f["万得代码"], f["自然日"])) for f in frames.values()]
    for (symbol, day), encoding in zip(sorted(set.intersection(*keys))[:2], ("gb18030", "utf-8-sig")):
        folder = root / f"{symbol}-{day.strip()}"
        folder.mkdir()
        for kind, f in frames.items():
            mine = f[(f["万得代码"] == symbol) & (f["自然日"] == day)].sort_values("seq").drop(columns="seq")
            text = ",".join(mine.columns) + ",\n" + "".join(",".join(map(str, r)) + ",\n" for r in mine.itertuples(index=False))
            (folder / FILES[kind]).write_bytes(text.replace(symbol, symbol[:3] + "\0" + symbol[3:], 1).encode(encoding))
    return str(root), frames


def test_inspect(spark, source):
    rows = inspect(spark, source[0]).collect()
    assert len(rows) == 6 and {r["encoding"] for r in rows} == {"gb18030", "utf-8-sig"} and all(r["nul_count"] == 1 for r in rows)


def test_read_and_check(spark, source):
    raw = read_kind(spark, source[0], "orders")
    orders = numbered(raw)
    assert orders.filter(F.col("万得代码").contains("\0")).count() == 0 and not any(c.startswith("_c") for c in orders.columns)
    per = orders.groupBy("dir").agg(F.count("*").alias("n"), F.max("seq").alias("m"), F.min("seq").alias("a")).collect()
    assert len(per) == 2 and all(r["n"] == r["m"] and r["a"] == 1 for r in per)
    assert missing_files(listed(spark, source[0])).count() == 0
    assert mixed_sessions(raw, read_kind(spark, source[0], "trades")).count() == 0
    firsts = {r["dir"]: (r["万得代码"], r["自然日"].strip()) for r in orders.filter("seq = 1").collect()}
    assert {r["dir"]: (r["symbol"], r["date"]) for r in first_rows(raw).collect()} == firsts


def test_mixed_sessions_fail_the_import(spark, source, tmp_path):
    import shutil
    from pathlib import Path

    one, two = sorted(Path(source[0]).iterdir())
    for folder, trades in ((one, one), (two, one)):
        to = tmp_path / folder.name
        to.mkdir()
        for kind in ("quotes", "orders", "trades"):
            shutil.copy((trades if kind == "trades" else folder) / FILES[kind], to / FILES[kind])
    raw = {k: read_kind(spark, str(tmp_path), k) for k in FILES}
    found = mixed_sessions(*raw.values()).collect()
    assert len(found) == 1 and found[0]["dir"].endswith(two.name) and len(found[0]["sessions"]) == 2
    with pytest.raises(ValueError, match="different sessions"):
        jobs.check_source(spark, str(tmp_path), raw)
    (tmp_path / one.name / FILES["orders"]).unlink()
    with pytest.raises(ValueError, match="files are missing"):
        jobs.check_source(spark, str(tmp_path), raw)


def test_file_order_over_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = read_csv(spark, str(tmp_path / "a.csv"))
        assert rows.filter("cast(v as long) <> seq").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_faults(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / FILES["orders"]).write_text("a,b\n1\0,2\n")
    assert missing_files(listed(spark, str(tmp_path))).first()["missing"] == sorted([FILES["quotes"], FILES["trades"]])
    raw = spark.createDataFrame([("p", "a\0\0b")], "path string, x string")
    assert nul_counts(raw).first()["nul_count"] == 2
    with pytest.raises(FileNotFoundError):
        read_kind(spark, str(tmp_path), "trades")


def test_import_and_diagnose(spark, source, tmp_path):
    out = str(tmp_path)
    jobs.import_sessions(spark, source[0], out)
    quotes, points = read_sessions(spark, out, "quotes"), read_sessions(spark, out, "visible_orderbook_checkpoints")
    assert points.count() == 20 * quotes.count() > 0
    report = spark.read.json(f"{out}/import_report").collect()
    assert len(report) == 2 and all(r["visible"]["quote_anchor_match_rate"] == 1.0 and len(r["artifacts"]) >= 5 and len(r["files"]) == 3 for r in report)
    assert all(sum("NUL bytes removed" in w for w in r["warnings"]) == 3 for r in report)
    jobs.diagnose(spark, out)
    assert spark.read.parquet(f"{out}/diagnostics/residual_mismatch_groups").agg(F.sum("mismatch_count")).first()[0] == read_sessions(spark, out, "validation_report").count()
    ask = quotes.limit(1).select(F.lit(1).cast("long").alias("request_id"), "symbol", "trade_date", "ts_ms", F.lit(10).cast("long").alias("depth"))
    assert jobs.answer(spark, out, ask).first()["status"] == "found"
    before = read_sessions(spark, out, "trades").count()
    one = read_sessions(spark, out, "trades").limit(1)
    write_sessions(spark.createDataFrame(one.collect(), one.schema), out, "trades")
    assert 0 < read_sessions(spark, out, "trades").count() <= before


def plain_encoding(content):
    """By the whole file at once."""
    bare = content.replace(b"\0", b"")
    for name in ("utf-8-sig", "gb18030"):
        try:
            bare.decode(name)
            return name, len(content) - len(bare)
        except UnicodeDecodeError:
            pass
    return None, len(content) - len(bare)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_encodings_whatever_the_splits(spark, tmp_path, size):
    """Files of broken and whole characters of one to four bytes, line ends and NULs, cut at every byte (a split of one byte)."""
    import random

    r = random.Random(size)
    bits = ["a,", "1\n", "\r\n", "é", "中", "\U0001f600", "\n"]
    kinds = [b"\0", b"\n", b"\xef\xbb\xbfa\n", "中\n".encode("gb18030")[:1], "中".encode()[:2] + b"\n" + "中".encode()[2:], b"\xed\xa0\x80", b"\x81\x30\x81", b"\x81\x30\x81\x30\n"]
    for _ in range(25):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 12)))
        raw = bytearray(text.encode(r.choice(["utf-8", "gb18030"])))
        for _ in range(r.choice([0, 0, 1])):
            raw[r.randrange(len(raw))] = r.choice([0, 0x0A, 0x81, 0xFF, 0xC3])
        kinds.append(bytes(raw))
    for i, content in enumerate(kinds):
        (tmp_path / f"{i}.csv").write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"\xff")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["nul_count"]) for r in inspect(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"{i}.csv": plain_encoding(c) for i, c in enumerate(kinds)} and len({e for e, _ in got.values()}) == 3


def test_row_numbers_over_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(1, 400 * k + 2)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = read_csv(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 3 + 1200 and all(int(r["a"]) == r["seq"] for r in rows)
    assert len({r["task"] for r in rows if r["path"].endswith("2.csv")}) > 1


CELLS = ["", " ", "7", "-7", "+7", "1.5", "x", "9223372036854775807", "9223372036854775808", "91400130", "9h15", "0", "\u30009\0", "1e3", "12345678901", "-5", "九"]


def test_problems_are_what_strict_typing_fails_on(spark):
    from tapebook.functions.cells import int_problem, parse_ts_ms, time_problem, to_int

    def fails(cell, *typed):
        df = spark.createDataFrame([(cell,)], "c string").coalesce(1)
        try:
            df.select(*[t(F.col("c")).alias(str(i)) for i, t in enumerate(typed)]).collect()
            return False
        except Exception:
            return True

    rows = spark.createDataFrame([(c,) for c in [*CELLS, None]], "c string").select("c", int_problem(F.col("c")).alias("i"), time_problem(F.col("c")).alias("t")).collect()
    for r in rows:
        assert (r["i"] is not None) == fails(r["c"], to_int) and (r["t"] is not None) == fails(r["c"], parse_ts_ms, to_int), r
    assert {r["i"] for r in rows} == {None, "out of range", "not a whole number"} and {r["t"] for r in rows} == {None, "blank time", "out of range", "not a whole number", "not a clock time"}


def test_quarantine_and_its_limit(spark, source, tmp_path):
    """Spoilt cells of one folder: rejected with file and place, the rest imported; over the limit nothing but the record is written."""
    import shutil
    from pathlib import Path

    shutil.copytree(source[0], tmp_path / "in")
    folder = sorted((tmp_path / "in").iterdir())[1]
    at = folder / FILES["orders"]
    lines = at.read_bytes().split(b"\n")
    header = lines[0].decode().split(",")
    for k, column in ((2, "委托数量"), (2, "委托价格"), (4, "时间")):
        cells = lines[k].decode().split(",")
        cells[header.index(column)] = "?" if column != "时间" else ""
        lines[k] = ",".join(cells).encode()
    at.write_bytes(b"\n".join(lines))
    with pytest.raises(Exception):
        jobs.import_sessions(spark, str(tmp_path / "in"), str(tmp_path / "strict"))
    with pytest.raises(ValueError, match="over 1 rows cannot be typed"):
        jobs.import_sessions(spark, str(tmp_path / "in"), str(tmp_path / "few"), 1)
    assert [p.name for p in Path(tmp_path / "few").iterdir()] == ["rejected_rows"]
    jobs.import_sessions(spark, str(tmp_path / "in"), str(tmp_path / "out"), 2)
    bad = spark.read.parquet(str(tmp_path / "out" / "rejected_rows")).collect()
    assert sorted((r["kind"], r["seq"], r["column"], r["reason"]) for r in bad) == [("orders", 2, "price_int", "not a whole number"), ("orders", 2, "qty", "not a whole number"), ("orders", 4, "ts_ms", "blank time")]
    assert all(r["path"].endswith(FILES["orders"]) and r["dir"].endswith(folder.name) for r in bad)
    whole = sum(len(p.read_bytes().strip().split(b"\n")) - 1 for p in (tmp_path / "in").glob(f"*/{FILES['orders']}"))
    assert read_sessions(spark, str(tmp_path / "out"), "orders").count() == whole - 2


def test_seeks_open_asked_sessions_only(spark, source, tmp_path):
    """The other session's files hold no Parquet: whoever opens one fails."""
    out = str(tmp_path / "out")
    jobs.import_sessions(spark, source[0], out)
    first, other = read_sessions(spark, out, "quotes").select("symbol", "trade_date").distinct().orderBy("symbol", "trade_date").collect()
    asked = lambda *keys: spark.createDataFrame([(i, *k, 86_400_000, 10) for i, k in enumerate(keys)], "request_id long, symbol string, trade_date long, ts_ms long, depth long")
    want = {(r["symbol"], r["trade_date"]): str(r.asDict(True) | {"request_id": 0}) for r in jobs.answer(spark, out, asked(first, other)).collect()}
    for table in ("visible_orderbook_checkpoints", "checkpoint_times"):
        for f in (tmp_path / "out" / table / f"symbol={other['symbol']}" / f"date={other['trade_date']}").rglob("*.parquet"):
            f.write_bytes(b"not Parquet")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    for ties in ("last", "all"):
        assert jobs.answer(spark, out, asked(first), ties).first()["status"] == "found"
    assert str(jobs.answer(spark, out, asked(first)).first().asDict(True) | {"request_id": 0}) == want[tuple(first)]
    with pytest.raises(Exception):
        jobs.answer(spark, out, asked(other)).collect()
