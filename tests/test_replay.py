import random

import duckdb
import pytest
from fold import fold
from pyspark.sql import functions as F

from tapebook.functions.cells import aggressor, clean, minute_label, or_unknown, parse_ts_ms, session_label, to_int
from tapebook.operators import book, diagnostics, seek, validate
from tapebook.operators.numbering import numbered_by
from tapebook.operators.tape import event_tape
from tapebook.plans import oracle
from tapebook.plans.tapes import tape_b_events
from tapebook.schemas import CHECKPOINTS, EVENTS, MISSING_ORDER_REPORT, QUOTES, ORDERS, TRADES, VALIDATION_REPORT


def rows_of(spark, schema, rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def event(i, kind, **more):
    return {"event_id": i, "symbol": "X.SZ", "trade_date": 20260424, "session": "auction", "ts_ms": i, "event_type": kind, "source_seq": i, "priority": 1} | more


def add(i, oid, side, price, qty, **more):
    return event(i, "order_add", exchange_order_id=oid, side=side, price_int=price, qty=qty, **more)


def trade(i, by, ask, bid, qty, **more):
    return event(i, "trade", aggressor_side=by, ask_order_id=ask, bid_order_id=bid, qty=qty, **more)


def book_at(spark, rows, t=10**9):
    changes, log = book.replay(rows_of(spark, EVENTS, rows))
    levels = {}
    for r in book.levels_at(changes, t).orderBy("side", "level").collect():
        levels.setdefault(r["side"], []).append((r["price_int"], r["qty"]))
    return levels, [r.asDict() for r in log.collect()]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("raw, want", [("91400130", 33240130), ("92500400", 33900400), (" 150000000　", 54000000)])
def test_times(spark, raw, want):
    assert one(spark, raw, parse_ts_ms) == want


def test_cells(spark):
    assert one(spark, "\0　a b \t", clean) == "a b"
    assert one(spark, None, clean) == ""
    assert one(spark, " ", to_int) is None and one(spark, " -7", to_int) == -7
    assert one(spark, "x", lambda c: to_int(c, strict=False)) is None
    assert one(spark, "b", aggressor) == "B" and one(spark, "x", aggressor) == "unknown"
    assert one(spark, "", or_unknown) == "unknown" and one(spark, "a", or_unknown) == "a"
    assert one(spark, "571", lambda c: minute_label(c.cast("bigint"))) == "09:31"
    for bad in ("x", ""):
        with pytest.raises(Exception):
            one(spark, bad, to_int if bad else parse_ts_ms)


def test_cleaning_equals_a_regular_expression(spark):
    """Every code point of the basic plane around a word, and numbers among signs, blanks, controls and NULs."""
    points = [chr(c) for c in range(0xFFFE) if not 0xD800 <= c < 0xE000]
    odd = ["7", "+7", "-0", "007", " 7", "7　", "\x017\x7f", "7\x85", "7\x001", "\0 7 \0", "7 1", "1.5", "1.", "+", "", " ", "９", "0x7", "1e3", "7L", "9223372036854775807", "9223372036854775808", "-9223372036854775809", None]
    df = spark.createDataFrame([(c + "a b" + c,) for c in points] + [(x,) for x in odd], "x string")
    by_pattern = F.regexp_replace(F.translate(F.coalesce("x", F.lit("")), "\0", ""), r"(?U)^\s+|\s+$", "")
    number = F.nullif(by_pattern, F.lit("")).try_cast("bigint")
    both = df.select("x", clean(F.col("x")).alias("c"), by_pattern.alias("p"), to_int(F.col("x"), strict=False).alias("i"), number.alias("n"))
    assert both.filter("NOT (c <=> p AND i <=> n)").collect() == []
    assert both.filter("n = 7").count() == 8 and both.filter("c = 'a b'").count() == 26
    for bad in ("1.5", "9223372036854775808", "7 1"):
        with pytest.raises(Exception):
            one(spark, bad, to_int)


def test_quotes_are_counted_over_ranges_without_any(spark):
    """Changes before the first quote, in ranges that have none, in the quotes' own ranges and behind the last, in ranges of five."""
    times = spark.createDataFrame([("a", 1, t) for t in (12, 13, 31)] + [("b", 1, 0)], "symbol string, trade_date long, ts_ms long")
    rows = spark.createDataFrame([("a", 1, t) for t in (0, 11, 12, 13, 14, 22, 30, 31, 34, 35)] + [("b", 1, 0), ("b", 1, 1), ("c", 1, 1)], "symbol string, trade_date long, ts_ms long").withColumn("is_quote", F.lit(False))
    both = rows.unionByName(times.withColumn("is_quote", F.lit(True)))
    got = {(r["symbol"], r["ts_ms"]): (r["at"], r["n"]) for r in book._indexed(both, times, 5).collect()}
    assert got == {("a", t): (at, 3) for t, at in ((0, 0), (11, 0), (12, 0), (13, 1), (14, 2), (22, 2), (30, 2), (31, 2), (34, 3))} | {("b", 0): (0, 1), ("b", 1): (1, 1)}


def test_asked_sessions_by_filter_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 1), ("c", None)], "symbol string, trade_date long")
    asked = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1), ("c", None)], "symbol string, trade_date long")
    for most in (seek.PRUNED, 1):
        monkeypatch.setattr(seek, "PRUNED", most)
        assert sorted(map(tuple, seek.of_sessions(df, asked).collect())) == [("a", 1), ("b", 2)]
        assert seek.of_sessions(df, asked.filter("symbol = 'd'")).count() == 0


def test_session_labels(spark):
    times = [33_299_999, 33_300_000, 33_900_000, 41_400_000, 46_800_000, 54_000_000]
    df = spark.createDataFrame([(t,) for t in times], "t long").orderBy("t").select(session_label(F.col("t")))
    assert [r[0] for r in df.collect()] == ["preopen", "auction", "continuous_am", "lunch", "continuous_pm", "close"]


def test_a_partly_filled_order_is_replaced_and_cancelled(spark):
    """Two sells of one price, one of them added again elsewhere while it still rests; then more is cancelled than rests."""
    rows = [
        add(3, "s7", "s", 2450, 300), add(4, "s8", "S", 2450, 120), trade(6, "B", "s8", "", 50), add(9, "s7", "S", 2465, 40),
        event(11, "order_cancel", exchange_order_id="s8", qty=90), trade(12, "B", "s7", "s8", 40), trade(15, "S", "b1", "b2", 5),
    ]
    levels, log = book_at(spark, rows)
    assert levels == {}
    assert [(r["event_id"], r["reason"], r["order_id"], r["requested_qty"], r["remaining_qty"]) for r in sorted(log, key=lambda r: r["event_id"])] == [
        (11, "qty_shortfall", "s8", 90, 70), (15, "missing_trade_order", "b2", None, None),
    ]
    assert book_at(spark, rows, 9)[0] == {"ask": [(2450, 70), (2465, 40)]}


def test_both_legs_of_an_unknown_aggressor(spark):
    """Whoever is named must be there; sessions do not see each other's orders; price 0 is a price."""
    other = {"trade_date": 20260511}
    rows = [add(1, "k", "b", 0, 6), add(2, "k", "S", 33, 9, **other), trade(3, "unknown", "", "k", 4), trade(4, "unknown", "k", "z", 2, **other)]
    levels, log = book_at(spark, rows)
    assert levels == {"bid": [(0, 2)], "ask": [(33, 7)]} and [(r["trade_date"], r["order_id"], r["ref_side"]) for r in log] == [(20260511, "z", "bid")]


def random_tape(seed, n=500):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(1, n + 1):
        t += r.random() < 0.4
        key = {"ts_ms": t, "trade_date": 20260424 + r.randrange(2)}
        oid, qty = r.choice(["", " ", None] + [str(k) for k in range(12)]), r.choice([None, 0, -1, 1, 2, 3, 5, 8])
        kind = r.random()
        if kind < 0.4:
            rows.append(add(i, oid, r.choice(["B", "S", "b", "s", "x", None]), r.choice([None, 0, 98, 99, 100, 101, 102]), qty) | key)
        elif kind < 0.55:
            rows.append(event(i, "order_cancel", exchange_order_id=oid, qty=qty) | key)
        elif kind < 0.85:
            rows.append(trade(i, r.choice(["B", "S", "unknown"]), r.choice(["", "1", "2", "3", "4"]), r.choice(["", "1", "2", "5"]), qty) | key)
        else:
            rows.append(event(i, r.choice(["quote", "session"]), priority=3) | key)
    rank = {"session": 0, "order_add": 1, "order_cancel": 1, "trade": 2, "quote": 3}
    out = []
    for day in (20260424, 20260425):
        mine = sorted((x for x in rows if x["trade_date"] == day), key=lambda x: (x["ts_ms"], rank[x["event_type"]], x["event_id"]))
        out += [x | {"event_id": k} for k, x in enumerate(mine, 1)]
    return out


@pytest.mark.parametrize("seed, block, depth, range_ms", [(1, 64, 10, 60_000), (2, 4, 10, 1), (3, 4, 2, 7)])
def test_windows_equal_the_fold(spark, seed, block, depth, range_ms):
    rows = random_tape(seed)
    changes, log = book.replay(rows_of(spark, EVENTS, rows))
    quotes = rows_of(spark, EVENTS, [x for x in rows if x["event_type"] == "quote"])
    got = {(r["trade_date"], r["ts_ms"], r["side"], r["level"]): (r["price_int"], r["qty"]) for r in book.top_at_quotes(changes, quotes, depth, block, range_ms).collect()}
    got_log = sorted((r["trade_date"], r["event_id"], r["reason"], str(r["order_id"]), str(r["ref_side"]), r["requested_qty"] or 0, r["remaining_qty"] or 0) for r in log.collect())
    want, want_log = {}, []
    for day in (20260424, 20260425):
        mine = [x for x in rows if x["trade_date"] == day]
        log, books = fold(mine)
        want_log += [(day, e, why, str(oid), str(ref), a or 0, b or 0) for e, why, oid, ref, a, b in log]
        at = {x["event_id"]: x["ts_ms"] for x in mine}
        for e, sides in books.items():
            for s, levels in sides.items():
                want |= {(day, at[e], "bid" if s == "B" else "ask", k): v for k, v in enumerate(levels[:depth], 1)}
    assert got == want and got_log == sorted(want_log)


@pytest.mark.parametrize("parts", [1, 6])
def test_numbers_by_ranges(spark, parts):
    """One key with most rows, a null key, and keys with one row, over several ranges."""
    r = random.Random(6)
    rows = [(r.choice(["big", "big", "big", "big", "two", None]), r.randrange(1000), i) for i in range(700)] + [("one", 5, 1)]
    df = spark.createDataFrame(rows, "k string, t long, i long").repartition(3)
    got = {(x["k"], x["t"], x["i"]): x["n"] for x in numbered_by(df, ["k"], ["t", "i"], "n", parts).collect()}
    want = {}
    for k in ("big", "two", None, "one"):
        want |= {x: n for n, x in enumerate(sorted(x for x in rows if x[0] == k), 1)}
    assert got == want and numbered_by(df.filter("t < 0"), ["k"], ["t", "i"], "n").count() == 0


def test_numbered_rows_stay_where_they_are(spark):
    """What ranges add is known before the rows are joined to it: they are not dealt out again."""
    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "k long, t long")
    plan = plan_of(numbered_by(df, ["k"], ["t"], "n", 4))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_tape_over_several_ranges(spark):
    rows = random_tape(9, 300)
    names = [c for c in EVENTS.fieldNames() if c not in ("event_id", "priority", "payload_ref", "event_type", "source_seq")]
    orders = rows_of(spark, ORDERS, [x | {"seq": i, "order_type": "A" if x["event_type"] == "order_add" else "D"} for i, x in enumerate(rows) if x["event_type"].startswith("order")])
    quotes = rows_of(spark, QUOTES, [quote(i, x["ts_ms"], {}, trade_date=x["trade_date"]) for i, x in enumerate(rows) if x["event_type"] == "quote"])
    trades = rows_of(spark, TRADES, [x | {"seq": i} for i, x in enumerate(rows) if x["event_type"] == "trade"])
    one, many = (sorted(map(str, event_tape(quotes, orders, trades, parts).select("event_id", "event_type", "source_seq", *names).collect())) for parts in (1, 8))
    assert one == many and len(one) > 200


def quote(seq, ts, levels, **more):
    row = {"symbol": "X.SZ", "exchange_code": "X", "trade_date": 20260424, "ts_ms": ts, "session": "auction", "seq": seq} | more
    for s in ("ask", "bid"):
        for i in range(1, 11):
            row[f"{s}_price_{i}_int"], row[f"{s}_qty_{i}"] = levels.get((s, i), (0, 0))
    return row


def compared(spark, events, quotes):
    e, q = rows_of(spark, EVENTS, events), rows_of(spark, QUOTES, quotes)
    changes, log = book.replay(e)
    return validate.compared(q, e, book.top_at_quotes(changes, q)), q, log


def test_empty_level_is_no_mismatch(spark):
    levels, quotes, log = compared(spark, [event(1, "quote", source_seq=1)], [quote(1, 1, {})])
    report = validate.validation_report(levels)
    assert report.count() == 0
    assert validate.validation_summary(quotes, report, log).first().asDict() == {"symbol": "X.SZ", "trade_date": 20260424, "checked_quotes": 1, "mismatch_count": 0, "price_mismatch_count": 0, "qty_mismatch_count": 0, "missing_order_count": 0}


def test_checkpoints_cost_what_differs(spark):
    """A price that differs costs both quantities, one that agrees their difference; two quotes of one time share a rebuilt book."""
    t = 47_000_123
    events = [add(2, "p", "B", 512, 70, ts_ms=t - 5), add(3, "q", "B", 509, 11, ts_ms=t - 4), event(8, "quote", source_seq=31, ts_ms=t), event(9, "quote", source_seq=32, ts_ms=t)]
    quotes = [quote(31, t, {("bid", 1): (512, 64), ("bid", 2): (510, 9)}), quote(32, t, {("bid", 1): (512, 70), ("bid", 2): (509, 11)})]
    levels, _, _ = compared(spark, events, quotes)
    points = validate.checkpoints(levels)
    assert points.count() == 40 and points.schema.fieldNames() == CHECKPOINTS.fieldNames()
    cost = {(r["checkpoint_id"], r["level"]): (r["raw_price_int"], r["raw_qty"], r["correction_cost"], r["correction_price_changed"]) for r in points.filter("side = 'bid' AND level < 3").collect()}
    assert cost == {("X.SZ-20260424-31", 1): (512, 70, 6, False), ("X.SZ-20260424-31", 2): (509, 11, 20, True), ("X.SZ-20260424-32", 1): (512, 70, 0, False), ("X.SZ-20260424-32", 2): (509, 11, 0, False)}
    summary = validate.visible_summary(points).first()
    assert (summary["checked_quotes"], summary["correction_cost"], summary["continuous_pm_match_rate"], summary["continuous_am_match_rate"]) == (2, 26, 1.0, 0.0)


def test_no_level_is_dealt_out_by_itself(spark):
    """Quotes and books meet as one row each: after the last shuffle come twenty rows a quote, the level missing in the book among them."""
    t = 47_000_123
    events = [add(1, "p", "B", 512, 70, ts_ms=t - 5), add(2, "q", "S", 520, 11, ts_ms=t - 4), event(8, "quote", source_seq=31, ts_ms=t), event(9, "quote", source_seq=32, ts_ms=t - 9)]
    quotes = [quote(31, t, {("bid", 1): (512, 70), ("ask", 1): (520, 10), ("ask", 2): (530, 1)}), quote(32, t - 9, {("bid", 1): (512, 70)})]
    levels, _, _ = compared(spark, events, quotes)
    plan = plan_of(levels)
    assert plan.index("Generate inline(array(") < plan.index("Exchange") and levels.count() == 40
    found = {(r["quote_seq"], r["side"], r["level"]): (r["actual_price_int"], r["actual_qty"], r["price_match"], r["qty_match"]) for r in levels.filter("level < 3").collect()}
    assert found[31, "bid", 1] == (512, 70, True, True) and found[31, "ask", 1] == (520, 11, True, False) and found[31, "ask", 2] == (None, None, False, False)
    assert found[32, "bid", 1] == (None, None, False, False) and found[31, "bid", 2] == (None, None, False, False)


def points_of(spark):
    """Three checkpoints of one session, the last two at one time, with four levels of asks and none of bids; and one of another day."""
    rows = []
    for day, seq, ts in ((20260424, 4, 36_000_500), (20260424, 9, 36_003_000), (20260424, 11, 36_003_000), (20260427, 2, 36_000_000)):
        for k in range(1, 5):
            rows.append({"symbol": "X.SZ", "trade_date": day, "checkpoint_id": f"{day}/{seq}", "quote_seq": seq, "event_id": 10 * seq, "ts_ms": ts, "session": "continuous_am", "source": "quote_anchor", "side": "ask", "level": k, "visible_price_int": 7000 + 5 * k, "visible_qty": seq * k, "correction_cost": k, "inter_quote_drift_abs_qty": 2 * k, "raw_price_match": k < 3, "raw_qty_match": None})
    return rows_of(spark, CHECKPOINTS, rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_order_is_sorted_once_and_a_session_never(spark, sf):
    events = tape_b_events(spark, sf)
    assert "Window" not in plan_of(events) and "Exchange" not in plan_of(events)
    plan = plan_of(book.lifecycle(book.legs(events)))
    assert plan.count(" Sort [") == 1 and plan.count("Exchange ") == 1


def test_events_of_tape_b_are_in_the_order_of_the_sql(spark, sf):
    """Lines of one order, time and priority by their columns, behind the order itself."""
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    numbered = oracle._with("SELECT symbol, event_id, event_type, qty, coalesce(nullif(exchange_order_id, ''), nullif(ask_order_id, ''), nullif(bid_order_id, '')) AS order_id, ts_ms FROM b_tape WHERE event_type <> 'quote'", oracle._B)
    want = [r[2:] for r in sorted(con.sql(numbered).fetchall(), key=lambda r: (r[4], r[1]))]
    rows = tape_b_events(spark, sf).filter("event_type <> 'quote'")
    ident = F.coalesce("exchange_order_id", F.expr("nullif(ask_order_id, '')"), F.expr("nullif(bid_order_id, '')"))
    got = rows.select("event_type", F.col("qty"), ident.alias("order_id"), "ts_ms", "event_id").orderBy("order_id", "event_id").drop("event_id").collect()
    assert [tuple(r) for r in got] == want and len(want) > 6000


def test_seek(spark):
    points = points_of(spark)
    asked = spark.createDataFrame(
        [(1, "X.SZ", 20260424, 36_000_500, 2), (2, "X.SZ", 20260424, 50_000_000, 10), (3, "X.SZ", 20260424, 36_000_499, 10), (4, "X.SZ", 20260427, 36_001_000, 0), (5, "Y.SZ", 20260424, 36_001_000, 3)],
        "request_id long, symbol string, trade_date long, ts_ms long, depth long",
    )
    last = {r["request_id"]: r for r in seek.seek(asked, points, "last").collect()}
    assert {k: r["status"] for k, r in last.items()} == {1: "found", 2: "found", 3: "before_first", 4: "empty", 5: "missing_session"}
    assert [(x["level"], x["price_int"], x["qty"], x["raw_price_match"], x["raw_qty_match"]) for x in last[1]["asks"]] == [(1, 7005, 4, True, False), (2, 7010, 8, True, False)] and last[1]["bids"] == []
    assert (last[2]["checkpoint_id"], len(last[2]["asks"]), last[2]["correction_cost"], last[2]["inter_quote_drift_abs_qty"]) == ("20260424/11", 4, 10, 20)
    both = {r["request_id"]: r for r in seek.seek(asked, points, "all").collect()}
    assert [x["qty"] for x in both[2]["asks"]] == [9, 11, 18, 22, 27, 33, 36, 44] and both[1]["asks"] == last[1]["asks"]
    assert seek.load_checkpoint(points, "X.SZ", 20260424, 36_003_000, 1)["quote_seq"] == 11
    for bad in (("X.SZ", 20260424, 36_000_499), ("Y.SZ", 20260424, 36_001_000), ("X.SZ", 20260427, 36_001_000, 0)):
        with pytest.raises(LookupError):
            seek.load_checkpoint(points, *bad)


def test_requests_share_their_answers(spark):
    """300 requests find one time: a list is made for each of the two depths, not for each request, and equal requests have rows of their own."""
    points = points_of(spark)
    rows = [(i, "X.SZ", 20260424, 36_003_000 + i % 7, 1 + 2 * (i % 2)) for i in range(300)] + [(7, "X.SZ", 20260424, 36_003_000, 3)] * 2
    asked = spark.createDataFrame(rows, "request_id long, symbol string, trade_date long, ts_ms long, depth long")
    made = seek._answers(seek.as_of(asked, seek.times_of(points)), points, "all", F.size)
    assert sorted((r["depth"], r["asks"], r["bids"], r["h"]["quote_seq"]) for r in made.collect()) == [(1, 2, 0, 9), (3, 6, 0, 9)]
    got = seek.seek(asked, points, "all", shown=F.size).collect()
    assert len(got) == 302 and {(r["depth"], r["asks"], r["bids"], r["status"], r["checkpoint_id"]) for r in got} == {(1, 2, 0, "found", "20260424/9"), (3, 6, 0, "found", "20260424/9")}
    assert sum(r["request_id"] == 7 for r in got) == 3


def test_diagnostics(spark):
    """Three mismatches of two minutes, the later one with more; two windows hold them, and the opening's first quote counts."""
    open_, late = 34_200_750, 53_900_000
    quotes = rows_of(spark, QUOTES, [quote(21, open_, {("bid", 3): (404, 7)}), quote(22, open_ + 3000, {}), quote(77, late, {("ask", 2): (410, 1)})])
    bad = {"symbol": "X.SZ", "trade_date": 20260424, "price_match": False, "qty_match": True}
    report = rows_of(
        spark, VALIDATION_REPORT,
        [
            bad | {"quote_seq": 21, "event_id": 40, "ts_ms": open_, "side": "bid", "level": 3, "expected_price_int": 404, "actual_price_int": 403, "expected_qty": 7, "actual_qty": 7},
            bad | {"quote_seq": 77, "event_id": 90, "ts_ms": late, "side": "ask", "level": 2, "expected_price_int": 410, "actual_price_int": 411, "expected_qty": 1, "actual_qty": 1},
            bad | {"quote_seq": 77, "event_id": 90, "ts_ms": late, "side": "ask", "level": 5, "expected_price_int": 0, "actual_price_int": 420, "expected_qty": 0, "actual_qty": 0},
        ],
    )
    log = rows_of(spark, MISSING_ORDER_REPORT, [{"symbol": "X.SZ", "trade_date": 20260424, "reason": w, "session": "lunch"} for w in ("qty_shortfall", "qty_shortfall", "invalid_trade_qty")])
    assert tuple(diagnostics.totals(report, log).first()) == (3, 3, 0, 3)
    shares = {r["window"]: (r["mismatch_count"], round(r["share_of_mismatch"], 6)) for r in diagnostics.window_shares(report).collect()}
    assert shares == {"09:15-09:30": (0, 0.0), "09:30-09:31": (1, 0.333333), "14:57-15:00": (2, 0.666667)}
    rich = diagnostics.enriched(report, quotes)
    buckets = [(r["minute"], r["mismatch_count"]) for r in diagnostics.top_buckets(rich).orderBy(F.desc("mismatch_count")).collect()]
    assert buckets == [("14:58", 2), ("09:30", 1)]
    shots = {r["minute"]: r for r in diagnostics.bucket_snapshots(rich, quotes, diagnostics.top_buckets(rich)).collect()}
    assert tuple(shots["14:58"]["raw_book_snapshot"]["ask"][1]) == (2, 411, 1) and tuple(shots["14:58"]["quote_snapshot"]["ask"][1]) == (2, 410, 1)
    assert tuple(shots["09:30"]["raw_book_snapshot"]["bid"][2]) == (3, 403, 7)
    opening = diagnostics.opening_alignment(report, quotes).first()
    assert (opening["opening_quote_seq"], opening["raw_mismatch_count"], opening["reproduced_mismatch_count"]) == (21, 1, 0)
    assert len(diagnostics.opening_snapshots(report, quotes).first()["opening_snapshot"]["bid"]) == 10
    assert diagnostics.mismatch_groups(rich).count() == 3 and {r["reason"]: r["missing_order_count"] for r in diagnostics.missing_groups(log).collect()} == {"qty_shortfall": 2, "invalid_trade_qty": 1}


def test_a_wanted_quote_that_is_absent_fails(spark):
    quotes = rows_of(spark, QUOTES, [quote(10, 34_200_000, {})])
    wanted = spark.createDataFrame([("X.SZ", 20260424, 11)], "symbol string, trade_date long, quote_seq long")
    with pytest.raises(Exception, match="no quote X.SZ 20260424 11"):
        diagnostics.snapshots(wanted, quotes, rows_of(spark, VALIDATION_REPORT, [])).collect()


def test_coverage(spark):
    orders = rows_of(spark, ORDERS, [{"symbol": "X", "trade_date": 1, "exchange_order_id": "1"}])
    trades = rows_of(spark, TRADES, [{"symbol": "X", "trade_date": 1, "aggressor_side": s, "ask_order_id": "1", "bid_order_id": "2"} for s in ("B", "S", "unknown")])
    got = {r["role"]: (r["checked"], r["missing"]) for r in diagnostics.order_ref_coverage(trades, orders).collect()}
    assert got == {"passive": (2, 1), "active": (2, 1)}


def test_empty_inputs(spark):
    levels, quotes, log = compared(spark, [], [])
    report = validate.validation_report(levels)
    points = validate.checkpoints(levels)
    rich = diagnostics.enriched(report, quotes)
    for df in (report, points, log, validate.visible_summary(points), diagnostics.mismatch_groups(rich), diagnostics.top_buckets(rich), diagnostics.opening_alignment(report, quotes)):
        assert df.count() == 0
    assert tuple(diagnostics.totals(report, log).first()) == (0, 0, 0, 0)
    assert validate.match_rates(quotes, report).first()["raw_match_rate"] == 0.0
    assert report.schema.fieldNames() == VALIDATION_REPORT.fieldNames() and log.schema.fieldNames() == MISSING_ORDER_REPORT.fieldNames()
