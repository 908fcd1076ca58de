"""Published runs, stored book states and stored counts, against plain Python and the operators that read everything."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapebook.operators import rollups, states, validate
from tapebook.plans import jobs
from tapebook.sources import session_tables
from tapebook.sources.session_tables import current, new_run, publish, read_sessions, superseded, write_sessions

TIMES = "symbol string, trade_date long, ts_ms long, event_id long"
CHANGES = "symbol string, trade_date long, side string, price_int long, ts_ms long, event_id long, delta long"
REQUESTS = "request_id long, symbol string, trade_date long, ts_ms long, depth long"


def times(spark, *rows):
    return spark.createDataFrame(list(rows), TIMES)


def kept(spark, root):
    return sorted(tuple(r) for r in read_sessions(spark, root, "checkpoint_times").collect())


def test_a_run_is_seen_when_it_is_published(spark, tmp_path):
    root, run = str(tmp_path), new_run()
    write_sessions(times(spark, ("A", 1, 10, 1), ("A", 2, 10, 1)), root, "checkpoint_times")
    before = kept(spark, root)
    more = times(spark, ("A", 2, 77, 1), ("B", 1, 5, 1))
    write_sessions(more, root, "checkpoint_times", run)
    assert kept(spark, root) == before and len(before) == 2
    assert read_sessions(spark, root, "checkpoint_times", run).count() == 2
    publish(more, root, run, ["checkpoint_times"])
    assert kept(spark, root) == [("A", 1, 10, 1), ("A", 2, 77, 1), ("B", 1, 5, 1)]
    gone = superseded(spark, root, "checkpoint_times").collect()
    assert [(r["symbol"], r["trade_date"]) for r in gone] == [("A", 2)] and gone[0]["run"] != run


def test_a_session_that_a_new_run_empties(spark, tmp_path):
    """The marker names the session for a table in which the run wrote nothing: its old rows go."""
    root = str(tmp_path)
    write_sessions(times(spark, ("A", 1, 10, 1), ("B", 1, 10, 1)), root, "checkpoint_times")
    publish(times(spark, ("A", 1, 0, 0)), root, new_run(), ["checkpoint_times"])
    assert kept(spark, root) == [("B", 1, 10, 1)]


@pytest.mark.parametrize("named", [0, 2, 1000])
def test_named_and_joined_runs_are_the_same(spark, tmp_path, monkeypatch, named):
    root = str(tmp_path)
    for k in range(4):
        write_sessions(times(spark, *[("A", day, k, 1) for day in range(k, 4)]), root, "checkpoint_times")
    monkeypatch.setattr(session_tables, "NAMED", named)
    assert kept(spark, root) == [("A", day, day, 1) for day in range(4)]


def test_a_run_without_sessions(spark, tmp_path):
    root = str(tmp_path)
    write_sessions(times(spark, ("A", 1, 10, 1)), root, "checkpoint_times")
    write_sessions(times(spark), root, "checkpoint_times")
    assert kept(spark, root) == [("A", 1, 10, 1)]


def random_changes(seed):
    """Changes whose level sums never fall under zero, at few times and prices, some of which cancel out."""
    r, held, rows = random.Random(seed), defaultdict(int), []
    for event in range(300):
        day, side, price, ts = r.randrange(2), r.choice("BS"), r.randrange(90, 97), 100 + event // 3 * r.choice([1, 1, 7])
        ts = max([ts, *[x[4] for x in rows if x[1] == day]])
        delta = r.choice([5, 3, -held[day, side, price]])
        held[day, side, price] += delta
        rows.append(("X", day, side, price, ts, event, delta))
    return rows


def plain_book(rows, day, ts, depth):
    level = defaultdict(int)
    for _, d, side, price, at, _, delta in rows:
        if d == day and at <= ts:
            level[side, price] += delta
    out = []
    for side, name in (("B", "bid"), ("S", "ask")):
        best = sorted((p for (s, p), q in level.items() if s == side and q > 0), reverse=side == "B")
        out += [(name, i + 1, p, level[side, p]) for i, p in enumerate(best[:depth])]
    return sorted(out)


@pytest.mark.parametrize("block_ms", [1, 13, 100, 10**6])
def test_books_at_equals_a_plain_sum(spark, block_ms):
    rows = random_changes(block_ms)
    net = states.net_changes(spark.createDataFrame(rows, CHANGES), block_ms).cache()
    ends = states.spans(net, block_ms)
    asked = [(i, "X", i % 2, ts, 1 + i % 9) for i, ts in enumerate([0, 99, 100, 100, 101, 113, 150, 151, 199, 200, 260, 399, 800, 10**7])]
    odd = [(90, "X", 7, 200, 5), (91, None, 0, 200, 5), (92, "X", 0, None, 5), (93, "X", 0, 200, 0), (94, "X", None, 200, 5)]
    found = defaultdict(list)
    for r in states.books_at(spark.createDataFrame(asked + odd, REQUESTS), states.states(net, ends), ends).collect():
        found[r["request_id"]].append((r["side"], r["level"], r["price_int"], r["qty"]))
    assert {k: sorted(v) for k, v in found.items()} == {i: b for i, _, day, ts, depth in asked if (b := plain_book(rows, day, ts, depth))}


def test_a_request_opens_one_block(spark, tmp_path):
    """Every other block's files hold no Parquet: whoever opens one fails."""
    rows, root = random_changes(5), str(tmp_path)
    net = states.net_changes(spark.createDataFrame(rows, CHANGES), 50).cache()
    write_sessions(states.spans(net, 50), root, "book_spans")
    write_sessions(states.states(net, read_sessions(spark, root, "book_spans")), root, "book_states")
    files = [p for p in tmp_path.joinpath("book_states").rglob("*.parquet") if not ("date=1" in str(p) and "block=3" in str(p))]
    assert len(files) > 5
    for f in files:
        f.write_bytes(b"not Parquet")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    ask = lambda ts: spark.createDataFrame([(1, "X", 1, ts, 10)], REQUESTS)
    got = sorted((r["side"], r["level"], r["price_int"], r["qty"]) for r in jobs.books(spark, root, ask(175)).collect())
    assert got == plain_book(rows, 1, 175, 10) != []
    with pytest.raises(Exception):
        jobs.books(spark, root, ask(260)).collect()


def test_no_changes(spark):
    net = states.net_changes(spark.createDataFrame([], CHANGES))
    ends = states.spans(net)
    assert states.books_at(spark.createDataFrame([(1, "X", 1, 5, 10)], REQUESTS), states.states(net, ends), ends).count() == 0


def test_windows_of_parts_begin_at_whole_minutes(spark):
    parts = spark.createDataFrame([], session_tables.TABLES["quote_parts"])
    with pytest.raises(ValueError, match="whole minutes"):
        rollups.match_rates_by_window(parts, parts, {"w": (1, 60_000)})


def test_empty_parts(spark):
    empty = {t: spark.createDataFrame([], session_tables.TABLES[t]) for t in ("quote_parts", "mismatch_parts", "missing_parts", "visible_parts")}
    assert [tuple(r) for r in rollups.totals(empty["mismatch_parts"], empty["missing_parts"]).collect()] == [(0, 0, 0, 0)]
    assert all(r["mismatch_count"] == 0 and r["share_of_mismatch"] == 0 for r in rollups.window_shares(empty["mismatch_parts"]).collect())
    assert rollups.visible_summary(empty["visible_parts"]).count() == rollups.mismatch_groups(empty["mismatch_parts"]).count() == 0


class Stopped(Exception):
    pass


def test_import_that_stops_between_two_tables(spark, sf, tmp_path, monkeypatch):
    """Two sessions are imported; a second import of one of them, with other quantities, stops midway and then, tried again, ends."""
    from tapebook.plans.tapes import tape_a

    tape, root = tape_a(spark, sf), str(tmp_path)
    common = tape.quotes.join(tape.trades, ["symbol", "trade_date"], "left_semi").select("symbol", "trade_date").distinct()
    one, two = [f"{r['symbol']} {r['trade_date']}" for r in common.orderBy("symbol", "trade_date").limit(2).collect()]
    of = lambda *names: {k: getattr(tape, k).filter(F.concat_ws(" ", "symbol", "trade_date").isin(*names)) for k in ("quotes", "orders", "trades")}
    jobs.replay_sessions(spark, of(one, two), root)
    tables = ("quotes", "orders", "validation_report", "visible_orderbook_checkpoints", "book_states", "mismatch_parts")
    told = lambda: {t: sorted((f"{r['symbol']} {r['trade_date']}", str(r)) for r in read_sessions(spark, root, t).collect()) for t in tables}
    before = told()
    changed = of(one)
    changed["orders"] = changed["orders"].withColumn("qty", F.col("qty") + 1)
    plain = jobs.write_sessions

    def stops(df, out, table, run=None):
        if table == "missing_order_report":
            raise Stopped
        plain(df, out, table, run)

    with monkeypatch.context() as patched:
        patched.setattr(jobs, "write_sessions", stops)
        with pytest.raises(Stopped):
            jobs.replay_sessions(spark, changed, root)
    assert told() == before
    jobs.replay_sessions(spark, changed, root)
    after = told()
    for t in tables:
        assert [r for r in after[t] if r[0] == two] == [r for r in before[t] if r[0] == two] and (t == "quotes") == (after[t] == before[t])
    stored = {t: read_sessions(spark, root, t) for t in ("quotes", "validation_report", "missing_order_report", "quote_parts", "mismatch_parts", "missing_parts")}
    whole, parts = list(stored.values())[:3], list(stored.values())[3:]
    assert sorted(map(str, rollups.validation_summary(*parts).collect())) == sorted(map(str, validate.validation_summary(*whole).collect()))


def test_current_keeps_other_columns(spark, tmp_path):
    root = str(tmp_path)
    write_sessions(times(spark, ("A", 1, 10, 1)), root, "checkpoint_times")
    run = superseded(spark, root, "checkpoint_times").count()
    rows = spark.read.parquet(f"{root}/checkpoint_times").withColumnRenamed("date", "trade_date").withColumn("more", F.lit(run))
    assert current(rows, root, "checkpoint_times").columns == ["ts_ms", "event_id", "symbol", "trade_date", "more"]
