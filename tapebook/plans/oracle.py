"""DuckDB SQL for the queries. The book at quotes is written as a time join and a sum, not as the intervals that the Spark
jobs use, so that one mistake cannot pass twice."""

from __future__ import annotations

#: The clock windows again, from the rules and not from the library's schemas.
CLOCK_WINDOWS = {"09:15-09:30": (33300000, 34200000), "09:30-09:31": (34200000, 34260000), "09:31-11:30": (34260000, 41400000), "13:00-14:57": (46800000, 53820000), "14:57-15:00": (53820000, 54000000)}
CONTINUOUS_WINDOWS = {"continuous_am": (34260000, 41400000), "continuous_pm": (46800000, 53820000)}
DIAGNOSTIC_WINDOWS = {"09:15-09:30": (33300000, 34200000), "09:30-09:31": (34200000, 34260000), "14:57-15:00": (53820000, 54000000)}
OPENING = (34200000, 34260000)

_SCALARS = ("last_price_int", "last_qty", "last_amount", "trade_count", "cum_qty", "cum_amount", "high_int", "low_int", "open_int", "prev_close_int")
_K = "symbol, trade_date"


def _price(side: str, i: int) -> str:
    return str((10010 + 10 * (i - 1) if side == "ask" else 10000 - 10 * (i - 1)) if i <= 8 else 0)


def _qty(i: int) -> str:
    return f"CAST((e + {i}) % 6 * 100 AS BIGINT)" if i <= 8 else "CAST(0 AS BIGINT)"


_LEVELS = ", ".join(f"CAST({_price(s, i)} AS BIGINT) AS {s}_price_{i}_int, {_qty(i)} AS {s}_qty_{i}" for s in ("ask", "bid") for i in range(1, 11))

CTE: dict[str, str] = {}
CTE["base"] = """SELECT CAST(event_id AS BIGINT) AS e, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS et, ts,
CASE user_id % 3 WHEN 0 THEN '600000.SH' WHEN 1 THEN '000001.SZ' ELSE '300002.SZ' END AS symbol,
CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS trade_date,
CAST(33000000 + ((hour(ts) * 60 + minute(ts)) // 2) * 30000 AS BIGINT) AS ts_ms FROM events"""
CTE["kinds"] = """SELECT *, CASE WHEN et = 'purchase' THEN 'trade' WHEN et = 'signup' THEN 'quote' WHEN k = 0 THEN 'session' WHEN et = 'click' AND e % 4 < 2 THEN 'cancel' ELSE 'add' END AS kind FROM base"""
CTE["numbered"] = """SELECT *, CASE WHEN kind IN ('trade', 'quote') THEN kind ELSE 'order' END AS file,
substr(symbol, 1, 6) AS exchange_code,
CAST((ts_ms // 3600000) * 10000000 + (ts_ms // 60000) % 60 * 100000 + (ts_ms // 1000) % 60 * 1000 + ts_ms % 1000 AS BIGINT) AS time_raw,
CASE WHEN ts_ms < 33300000 THEN 'preopen' WHEN ts_ms < 33900000 THEN 'auction' WHEN ts_ms < 41400000 THEN 'continuous_am' WHEN ts_ms < 46800000 THEN 'lunch' WHEN ts_ms < 54000000 THEN 'continuous_pm' ELSE 'close' END AS session,
CASE WHEN e % 97 = 0 THEN 0 ELSE 100 * (1 + e % 3) END AS qty,
CASE WHEN e % 2 = 0 THEN 10000 - 10 * (k % 10) ELSE 10010 + 10 * (k % 10) END AS price_int FROM kinds"""
CTE["seqs"] = "SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, file ORDER BY e) AS seq FROM numbered"
_COMMON = "symbol, exchange_code, trade_date, time_raw, ts_ms, session, CAST(seq AS BIGINT) AS seq"
CTE["o"] = f"""SELECT {_COMMON}, CAST(e AS VARCHAR) AS order_no, CASE WHEN k = 99 THEN '' ELSE CAST(k % 30 AS VARCHAR) END AS exchange_order_id,
CASE kind WHEN 'add' THEN CASE WHEN e % 2 = 0 THEN 'A' ELSE '0' END WHEN 'cancel' THEN CASE WHEN e % 2 = 0 THEN 'D' ELSE '1' END ELSE 'U' END AS order_type,
CASE WHEN e % 2 = 0 THEN 'B' ELSE 'S' END AS side, CAST(price_int AS BIGINT) AS price_int, CAST(qty AS BIGINT) AS qty FROM seqs WHERE file = 'order'"""
CTE["t"] = f"""SELECT {_COMMON}, CAST(e AS VARCHAR) AS trade_id, '0' AS trade_code, '' AS order_code, CASE WHEN e % 5 = 0 THEN 'unknown' WHEN e % 5 < 3 THEN 'B' ELSE 'S' END AS aggressor_side,
CAST(price_int AS BIGINT) AS price_int, CAST(qty AS BIGINT) AS qty, CAST((k + e) % 30 AS VARCHAR) AS ask_order_id, CAST(k % 30 AS VARCHAR) AS bid_order_id FROM seqs WHERE file = 'trade'"""
CTE["q"] = f"SELECT {_COMMON}, {', '.join(f'CAST(e * {m} % 1000 AS BIGINT) AS {c}' for m, c in enumerate(_SCALARS, 1))}, CAST(1000 AS BIGINT) AS price_scale, {_LEVELS} FROM seqs WHERE file = 'quote'"
CTE["unordered"] = """SELECT symbol, exchange_code, trade_date, session, ts_ms, 'quote' AS event_type, 3 AS priority, seq AS source_seq, 'quotes:' || seq AS payload_ref, last_price_int, last_qty,
NULL AS exchange_order_id, NULL AS order_no, NULL AS order_type, NULL AS side, NULL AS price_int, NULL AS qty, NULL AS trade_id, NULL AS aggressor_side, NULL AS ask_order_id, NULL AS bid_order_id FROM q
UNION ALL SELECT symbol, exchange_code, trade_date, session, ts_ms, CASE WHEN order_type IN ('A', '0') THEN 'order_add' WHEN order_type IN ('D', '1') THEN 'order_cancel' ELSE 'session' END AS event_type,
CASE WHEN order_type IN ('A', '0', 'D', '1') THEN 1 ELSE 0 END, seq, 'orders:' || seq, NULL, NULL, exchange_order_id, order_no, order_type, side, price_int, qty, NULL, NULL, NULL, NULL FROM o
UNION ALL SELECT symbol, exchange_code, trade_date, session, ts_ms, 'trade', 2, seq, 'trades:' || seq, NULL, NULL, NULL, NULL, NULL, NULL, price_int, qty, trade_id, aggressor_side, ask_order_id, bid_order_id FROM t"""
CTE["tape"] = "SELECT CAST(row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts_ms, priority, source_seq) AS BIGINT) AS event_id, * REPLACE (CAST(priority AS BIGINT) AS priority) FROM unordered"

#: Tape B gives the same columns that the replay needs.
_B_ORDER = "'S' || CAST(o_orderkey % 20 AS VARCHAR)"
CTE["b_orders"] = f"""SELECT *, {_B_ORDER} AS symbol, CAST(33000000 + 9000 * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ts_ms, (o_orderkey // 20) % 2 = 0 AS buy FROM orders"""
CTE["b_lines"] = """SELECT *, 'S' || CAST(l_orderkey % 20 AS VARCHAR) AS symbol, CAST(33000000 + 9000 * date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ts_ms, (l_orderkey // 20) % 2 = 0 AS buy,
1000000000 + row_number() OVER (PARTITION BY l_orderkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq FROM lineitem"""
CTE["b_unordered"] = """SELECT symbol, ts_ms, 'order_add' AS event_type, 1 AS priority, o_orderkey AS source_seq, CAST(o_orderkey AS VARCHAR) AS exchange_order_id, CASE WHEN buy THEN 'B' ELSE 'S' END AS side,
CASE WHEN buy THEN 10000 - 10 * (o_custkey % 100) ELSE 10010 + 10 * (o_custkey % 100) END AS price_int, 100 * (1 + o_custkey % 5) AS qty, NULL AS aggressor_side, NULL AS ask_order_id, NULL AS bid_order_id FROM b_orders
UNION ALL SELECT symbol, ts_ms, 'quote', 3, o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM b_orders WHERE o_orderstatus = 'P'
UNION ALL SELECT symbol, ts_ms, CASE WHEN l_returnflag = 'R' THEN 'order_cancel' ELSE 'trade' END, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END, seq,
CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey AS VARCHAR) END, NULL, NULL, CAST(l_quantity AS BIGINT), CASE WHEN buy THEN 'S' ELSE 'B' END,
CASE WHEN l_returnflag <> 'R' THEN CASE WHEN buy THEN '' ELSE CAST(l_orderkey AS VARCHAR) END END, CASE WHEN l_returnflag <> 'R' THEN CASE WHEN buy THEN CAST(l_orderkey AS VARCHAR) ELSE '' END END FROM b_lines"""
CTE["b_tape"] = """SELECT CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, priority, source_seq) AS BIGINT) AS event_id, symbol, CAST(20240101 AS BIGINT) AS trade_date, 'tape_b' AS session, ts_ms, event_type,
CAST(source_seq AS BIGINT) AS source_seq, exchange_order_id, side, CAST(price_int AS BIGINT) AS price_int, CAST(qty AS BIGINT) AS qty, aggressor_side, ask_order_id, bid_order_id FROM b_unordered"""
CTE["b_q"] = "SELECT symbol, trade_date, ts_ms, source_seq AS seq FROM b_tape WHERE event_type = 'quote'"


def _replay(tape: str, q: str) -> dict[str, str]:
    """CTEs from a tape to its legs, lifecycle, deltas, log, and top ten at quotes."""
    ev = "symbol, trade_date, event_id, event_type, ts_ms, session, source_seq, price_int, qty"
    good = "exchange_order_id <> '' AND side IN ('B', 'S') AND price_int IS NOT NULL AND coalesce(qty, 0) > 0"
    null = "CAST(NULL AS VARCHAR)"
    leg = lambda oid, n, kind, side, req, ref, why, where: f"SELECT {ev}, {oid} AS order_id, {n} AS leg_no, '{kind}' AS kind, {side} AS side, {req} AS required, {ref} AS ref_side, {why} AS reason FROM {tape} WHERE {where}"
    ok = "event_type = 'trade' AND coalesce(qty, 0) > 0"
    lost = "'missing_trade_order'"
    parts = [
        leg("exchange_order_id", 0, "add", "side", "true", null, null, f"event_type = 'order_add' AND {good}"),
        leg("exchange_order_id", 0, "bad", null, "true", null, "'invalid_order_add'", f"event_type = 'order_add' AND NOT ({good})"),
        leg("exchange_order_id", 0, "remove", null, "true", null, "'missing_cancel_order'", "event_type = 'order_cancel' AND exchange_order_id <> '' AND coalesce(qty, 0) > 0"),
        leg("exchange_order_id", 0, "bad", null, "true", null, "'invalid_order_cancel'", "event_type = 'order_cancel' AND NOT (exchange_order_id <> '' AND coalesce(qty, 0) > 0)"),
        leg(null, 0, "bad", null, "true", null, "'invalid_trade_qty'", "event_type = 'trade' AND coalesce(qty, 0) <= 0"),
        leg("ask_order_id", "CASE WHEN aggressor_side = 'S' THEN 1 ELSE 0 END", "remove", null, "aggressor_side <> 'S'", "'ask'", lost, f"{ok} AND (aggressor_side = 'B' OR ask_order_id <> '')"),
        leg("bid_order_id", "CASE WHEN aggressor_side = 'S' THEN 0 ELSE 1 END", "remove", null, "aggressor_side <> 'B'", "'bid'", lost, f"{ok} AND (aggressor_side = 'S' OR bid_order_id <> '')"),
    ]
    by = "PARTITION BY symbol, trade_date, order_id"
    out = {"leg": "\nUNION ALL ".join(parts)}
    out["gens"] = f"SELECT *, sum(CASE WHEN kind = 'add' THEN 1 ELSE 0 END) OVER ({by} ORDER BY event_id, leg_no) AS gen FROM leg WHERE kind <> 'bad' AND order_id <> ''"
    out["taken"] = f"""SELECT *, first_value(side) OVER g AS book_side0, first_value(price_int) OVER g AS book_price0, first_value(qty) OVER g AS add_qty,
coalesce(sum(CASE WHEN kind = 'remove' THEN qty END) OVER ({by}, gen ORDER BY event_id, leg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS took FROM gens
WINDOW g AS ({by}, gen ORDER BY event_id, leg_no)"""
    out["rems"] = "SELECT *, CASE WHEN kind = 'add' OR gen = 0 THEN 0 ELSE greatest(add_qty - took, 0) END AS rem_before FROM taken"
    out["life0"] = "SELECT *, CASE WHEN kind = 'add' THEN 0 ELSE least(qty, rem_before) END AS removed, CASE WHEN gen > 0 THEN book_side0 END AS book_side, CASE WHEN gen > 0 THEN book_price0 END AS book_price FROM rems"
    out["life1"] = "SELECT *, CASE WHEN kind = 'add' THEN qty ELSE rem_before - removed END AS rem_after FROM life0"
    out["life"] = f"SELECT *, CASE WHEN kind = 'add' THEN lag(rem_after) OVER w END AS prev_rem, CASE WHEN kind = 'add' THEN lag(book_side) OVER w END AS prev_side, CASE WHEN kind = 'add' THEN lag(book_price) OVER w END AS prev_price FROM life1 WINDOW w AS ({by} ORDER BY event_id, leg_no)"
    out["dl"] = """SELECT symbol, trade_date, ts_ms, event_id, book_side AS side, book_price AS price_int, CAST(CASE WHEN kind = 'add' THEN qty ELSE -removed END AS BIGINT) AS delta FROM life WHERE kind = 'add' OR removed <> 0
UNION ALL SELECT symbol, trade_date, ts_ms, event_id, prev_side, prev_price, CAST(-prev_rem AS BIGINT) FROM life WHERE coalesce(prev_rem, 0) <> 0"""
    out["mlog"] = f"""SELECT symbol, trade_date, reason, event_id, event_type, ts_ms, session, source_seq, price_int, qty, order_id, ref_side, CAST(NULL AS BIGINT) AS requested_qty, CAST(NULL AS BIGINT) AS remaining_qty FROM leg
WHERE kind = 'bad' OR (kind = 'remove' AND order_id = '' AND required)
UNION ALL SELECT symbol, trade_date, CASE WHEN rem_before > 0 THEN 'qty_shortfall' ELSE reason END, event_id, event_type, ts_ms, session, source_seq, price_int, qty, order_id, ref_side,
CASE WHEN rem_before > 0 THEN qty END, CASE WHEN rem_before > 0 THEN CAST(removed AS BIGINT) END FROM life WHERE kind = 'remove' AND ((rem_before = 0 AND required) OR (rem_before > 0 AND qty > rem_before))"""
    out["sums"] = f"""SELECT z.symbol, z.trade_date, z.ts_ms, d.side, d.price_int, sum(d.delta) AS qty FROM (SELECT DISTINCT symbol, trade_date, ts_ms FROM {q}) z
JOIN (SELECT symbol, trade_date, side, price_int, ts_ms, sum(delta) AS delta FROM dl GROUP BY ALL) d ON d.symbol = z.symbol AND d.trade_date = z.trade_date AND d.ts_ms <= z.ts_ms GROUP BY ALL HAVING sum(d.delta) > 0"""
    out["top10"] = """SELECT symbol, trade_date, ts_ms, CASE side WHEN 'B' THEN 'bid' ELSE 'ask' END AS side, CAST(level AS BIGINT) AS level, price_int, CAST(qty AS BIGINT) AS qty FROM
(SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, ts_ms, side ORDER BY CASE side WHEN 'B' THEN -price_int ELSE price_int END) AS level FROM sums) WHERE level <= 10"""
    return out


_A = _replay("tape", "q")
_A["ql"] = " UNION ALL ".join(f"SELECT symbol, trade_date, seq, ts_ms, session, exchange_code, '{s}' AS side, CAST({i} AS BIGINT) AS level, {s}_price_{i}_int AS p, {s}_qty_{i} AS n FROM q" for s in ("ask", "bid") for i in range(1, 11))
_A["cmp"] = """SELECT ql.symbol, ql.trade_date, ql.seq AS quote_seq, tape.event_id, ql.ts_ms, ql.session, ql.exchange_code, ql.side, ql.level, p AS expected_price_int, top10.price_int AS actual_price_int, n AS expected_qty, top10.qty AS actual_qty,
p IS NOT DISTINCT FROM top10.price_int AS price_match, n IS NOT DISTINCT FROM top10.qty AS qty_match FROM ql
JOIN tape ON tape.symbol = ql.symbol AND tape.trade_date = ql.trade_date AND tape.event_type = 'quote' AND tape.source_seq = ql.seq
LEFT JOIN top10 ON top10.symbol = ql.symbol AND top10.trade_date = ql.trade_date AND top10.ts_ms = ql.ts_ms AND top10.side = ql.side AND top10.level = ql.level"""
_A["rep"] = "SELECT *, ts_ms // 60000 AS minute_bucket, lpad(CAST(ts_ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ts_ms // 60000 % 60 AS VARCHAR), 2, '0') AS minute FROM cmp WHERE NOT (coalesce(expected_price_int, 0) = 0 AND coalesce(expected_qty, 0) = 0 AND actual_price_int IS NULL) AND NOT (price_match AND qty_match)"
_A["cp0"] = "SELECT *, CASE WHEN price_match THEN abs(coalesce(expected_qty, 0) - coalesce(actual_qty, 0)) ELSE coalesce(expected_qty, 0) + coalesce(actual_qty, 0) END AS cost FROM cmp"
_A["cp"] = """SELECT symbol, trade_date, symbol || '-' || trade_date || '-' || quote_seq AS checkpoint_id, quote_seq, event_id, ts_ms, session, 'quote_anchor' AS source, side, level, expected_price_int AS visible_price_int, expected_qty AS visible_qty,
actual_price_int AS raw_price_int, actual_qty AS raw_qty, price_match AS raw_price_match, qty_match AS raw_qty_match, true AS quote_anchor_match, NOT price_match AS correction_price_changed, cost AS inter_quote_drift_abs_qty, cost AS correction_cost, cost AS correction_abs_qty FROM cp0"""
_A["req0"] = "SELECT e AS request_id, symbol, trade_date, ts_ms, 1 + e % 10 AS depth FROM base WHERE e % 7 = 0"
_A["req"] = "SELECT * FROM req0 UNION ALL SELECT -1, '999999.SH', trade_date, ts_ms, depth FROM req0 WHERE request_id = (SELECT min(request_id) FROM req0) UNION ALL SELECT -2, symbol, trade_date, 86400000, 0 FROM req0 WHERE request_id = (SELECT min(request_id) FROM req0)"
_A["sought"] = "SELECT r.*, (SELECT max(c.ts_ms) FROM q c WHERE c.symbol = r.symbol AND c.trade_date = r.trade_date AND c.ts_ms <= r.ts_ms) AS found_ts FROM req r"
_A["lastq"] = "SELECT symbol, trade_date, ts_ms, max(event_id) AS event_id FROM tape WHERE event_type = 'quote' GROUP BY ALL"
_FOUND = """SELECT a.request_id, a.symbol, a.trade_date, a.ts_ms AS asked_ts, a.depth, a.found_ts, cp.* EXCLUDE (symbol, trade_date, ts_ms) FROM sought a LEFT JOIN {cp} cp ON cp.symbol = a.symbol AND cp.trade_date = a.trade_date AND cp.ts_ms = a.found_ts AND cp.level <= a.depth"""
_A["found_all"] = _FOUND.format(cp="cp")
_A["cp_last"] = "SELECT cp.* FROM cp JOIN lastq USING (symbol, trade_date, ts_ms, event_id)"
_A["found_last"] = _FOUND.format(cp="cp_last")
_COUNTS = "count(*) AS mismatch_count, count(*) FILTER (WHERE NOT price_match) AS price_mismatch_count, count(*) FILTER (WHERE NOT qty_match) AS qty_mismatch_count"
_A["buckets"] = f"SELECT symbol, trade_date, exchange_code, session, minute_bucket, minute, {_COUNTS} FROM rep GROUP BY ALL ORDER BY mismatch_count DESC, symbol, trade_date, session, minute_bucket LIMIT 20"
_A["perq"] = "SELECT symbol, trade_date, minute_bucket, quote_seq, count(*) AS n FROM rep GROUP BY ALL"
_A["worst"] = """SELECT b.symbol, b.trade_date, b.exchange_code, b.session, b.minute, b.mismatch_count, p.quote_seq AS worst_quote_seq, p.n AS worst_quote_mismatch_count FROM buckets b JOIN
(SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, minute_bucket ORDER BY n DESC, quote_seq) AS r FROM perq) p ON p.r = 1 AND p.symbol = b.symbol AND p.trade_date = b.trade_date AND p.minute_bucket = b.minute_bucket"""
_A["opening"] = f"""SELECT o.symbol, o.trade_date, o.exchange_code, o.seq AS opening_quote_seq, o.ts_ms, count(r.level) AS raw_mismatch_count, count(r.level) FILTER (WHERE NOT r.price_match) AS raw_price_mismatch_count,
count(r.level) FILTER (WHERE NOT r.qty_match) AS raw_qty_mismatch_count, CAST(0 AS BIGINT) AS reproduced_mismatch_count FROM
(SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts_ms, seq) AS r FROM q WHERE ts_ms >= {OPENING[0]} AND ts_ms < {OPENING[1]}) o
LEFT JOIN rep r ON r.symbol = o.symbol AND r.trade_date = o.trade_date AND r.quote_seq = o.seq WHERE o.r = 1 GROUP BY ALL"""
_B = _replay("b_tape", "b_q")


def _with(body: str, replay: dict[str, str]) -> str:
    """body after the CTEs it needs, and those that they need."""
    import re

    every = CTE | replay
    wanted, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in every:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                todo.append(every[name])
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({every[n]})" for n in every if n in wanted) + "\n" + body


_RATES = "checked_quotes * 20 AS compared_levels, {r}".format(r=", ".join(f"CASE WHEN checked_quotes > 0 THEN 1 - {c} / (checked_quotes * 20) ELSE 0.0 END AS {n}" for c, n in (("mismatch_count", "raw_match_rate"), ("price_mismatch_count", "raw_price_match_rate"), ("qty_mismatch_count", "raw_qty_match_rate"))))
_IN = lambda windows: "CASE " + " ".join(f"WHEN ts_ms >= {a} AND ts_ms < {z} THEN '{n}'" for n, (a, z) in windows.items()) + " END"
_LEVELS_OUT = "count(level) AS n_levels, count(level) FILTER (WHERE side = 'ask') AS n_asks, CAST(coalesce(sum(correction_cost), 0) AS BIGINT) AS correction_cost, CAST(coalesce(sum(inter_quote_drift_abs_qty), 0) AS BIGINT) AS inter_quote_drift_abs_qty"
_SIDE = lambda side: f"coalesce(string_agg(level || ':' || coalesce(visible_price_int, 0) || ':' || coalesce(visible_qty, 0) || ':' || coalesce(CAST(raw_price_int AS VARCHAR), '-') || ':' || coalesce(CAST(raw_qty AS VARCHAR), '-') || ':' || coalesce(correction_cost, 0), ',' ORDER BY level, event_id) FILTER (WHERE side = '{side}'), '') AS {side}s"
_STATUS = "CASE WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.symbol = f.symbol AND q.trade_date = f.trade_date) THEN 'missing_session' WHEN found_ts IS NULL THEN 'before_first' WHEN count(level) = 0 THEN 'empty' ELSE 'found' END"
_SEEK = "SELECT request_id, symbol, trade_date, asked_ts, depth, {st} AS status, found_ts AS ts_ms, arg_min(checkpoint_id, struct_pack(s := side, l := level, e := event_id)) FILTER (WHERE level IS NOT NULL) AS checkpoint_id, {a}, {b}, CAST(coalesce(sum(correction_cost), 0) AS BIGINT) AS correction_cost, CAST(coalesce(sum(inter_quote_drift_abs_qty), 0) AS BIGINT) AS inter_quote_drift_abs_qty FROM {f} f GROUP BY request_id, symbol, trade_date, asked_ts, depth, found_ts"
_SHOT = lambda p, n: f"string_agg(side || ':' || level || ':' || coalesce(CAST({p} AS VARCHAR), '-') || ':' || coalesce(CAST({n} AS VARCHAR), '-'), ',' ORDER BY side, level)"
_SHOTS = "{own} AS {name}, {raw} AS raw_book_snapshot".format
_OVER = ("CASE WHEN price_match AND qty_match OR (coalesce(expected_price_int, 0) = 0 AND coalesce(expected_qty, 0) = 0 AND actual_price_int IS NULL) THEN expected_price_int ELSE actual_price_int END", "CASE WHEN price_match AND qty_match OR (coalesce(expected_price_int, 0) = 0 AND coalesce(expected_qty, 0) = 0 AND actual_price_int IS NULL) THEN expected_qty ELSE actual_qty END")
_REPORT = "symbol, trade_date, quote_seq, event_id, ts_ms, side, level, expected_price_int, actual_price_int, expected_qty, actual_qty, price_match, qty_match"

_BODIES = {
    "normalize_quotes": "SELECT * FROM q",
    "normalize_orders": "SELECT * FROM o",
    "normalize_trades": "SELECT * FROM t",
    "quote_levels": "SELECT symbol, trade_date, seq, side, level, p AS expected_price_int, n AS expected_qty FROM ql",
    "event_tape": "SELECT * FROM tape",
    "session_event_counts": "SELECT symbol, trade_date, count(*) FILTER (WHERE order_type NOT IN ('A', '0', 'D', '1')) AS session_event_count FROM o GROUP BY ALL",
    "order_legs": "SELECT symbol, trade_date, event_id, order_id, leg_no, kind, side, required, ref_side, reason FROM leg",
    "order_lifecycle": "SELECT symbol, trade_date, order_id, event_id, leg_no, kind, CAST(gen AS BIGINT) AS gen, book_side, book_price, CAST(rem_before AS BIGINT) AS rem_before, CAST(removed AS BIGINT) AS removed, CAST(rem_after AS BIGINT) AS rem_after, CAST(prev_rem AS BIGINT) AS prev_rem, prev_side, prev_price FROM life",
    "book_deltas": "SELECT symbol, trade_date, ts_ms, event_id, side, price_int, delta FROM dl",
    "book_levels_at": "SELECT symbol, trade_date, CASE side WHEN 'B' THEN 'bid' ELSE 'ask' END AS side, CAST(level AS BIGINT) AS level, price_int, qty FROM (SELECT symbol, trade_date, side, price_int, CAST(sum(delta) AS BIGINT) AS qty, row_number() OVER (PARTITION BY symbol, trade_date, side ORDER BY CASE side WHEN 'B' THEN -price_int ELSE price_int END) AS level FROM dl WHERE ts_ms <= 40000000 GROUP BY symbol, trade_date, side, price_int HAVING sum(delta) > 0) WHERE level <= 10",
    "book_top10_at_quotes": "SELECT * FROM top10",
    "missing_order_report": "SELECT * FROM mlog",
    "missing_reason_counts": "SELECT reason, count(*) AS missing_order_count FROM mlog GROUP BY reason",
    "validation_report": f"SELECT {_REPORT} FROM rep",
    "validation_summary": f"SELECT z.symbol, z.trade_date, checked_quotes, coalesce(mismatch_count, 0) AS mismatch_count, coalesce(price_mismatch_count, 0) AS price_mismatch_count, coalesce(qty_mismatch_count, 0) AS qty_mismatch_count, coalesce(missing_order_count, 0) AS missing_order_count FROM (SELECT symbol, trade_date, count(*) AS checked_quotes FROM q GROUP BY ALL) z LEFT JOIN (SELECT symbol, trade_date, {_COUNTS} FROM rep GROUP BY ALL) USING (symbol, trade_date) LEFT JOIN (SELECT symbol, trade_date, count(*) AS missing_order_count FROM mlog GROUP BY ALL) USING (symbol, trade_date)",
    "raw_match_rates": f"SELECT *, {_RATES} FROM (SELECT (SELECT count(*) FROM q) AS checked_quotes, {_COUNTS} FROM rep)",
    "raw_match_by_window": f"SELECT *, {_RATES} FROM (SELECT win AS \"window\", checked_quotes, coalesce(mismatch_count, 0) AS mismatch_count, coalesce(price_mismatch_count, 0) AS price_mismatch_count, coalesce(qty_mismatch_count, 0) AS qty_mismatch_count FROM (SELECT {_IN(CLOCK_WINDOWS)} AS win, count(*) AS checked_quotes FROM q GROUP BY 1) z LEFT JOIN (SELECT {_IN(CLOCK_WINDOWS)} AS win, {_COUNTS} FROM rep GROUP BY 1) USING (win) WHERE win IS NOT NULL)",
    "mismatch_by_side": "SELECT side, count(*) AS mismatch_count FROM rep GROUP BY side",
    "visible_checkpoints": "SELECT * FROM cp",
    "visible_summary": "SELECT symbol, trade_date, count(DISTINCT quote_seq) AS checked_quotes, count(*) AS checkpoint_rows, count(*) AS quote_anchor_match_count, 1.0 AS quote_anchor_match_rate, CAST(sum(correction_cost) AS BIGINT) AS inter_quote_drift_abs_qty, CAST(sum(correction_cost) AS BIGINT) AS correction_cost, CAST(sum(correction_cost) AS BIGINT) AS correction_abs_qty, count(*) FILTER (WHERE correction_price_changed) AS correction_price_change_count, "
    + ", ".join(f"CASE WHEN count(*) FILTER (WHERE ts_ms >= {a} AND ts_ms < {z}) > 0 THEN 1.0 ELSE 0.0 END AS {n}_match_rate" for n, (a, z) in CONTINUOUS_WINDOWS.items())
    + " FROM cp GROUP BY ALL",
    "seek_batch_all": _SEEK.format(st=_STATUS, a=_SIDE("ask"), b=_SIDE("bid"), f="found_all"),
    "seek_batch_last": _SEEK.format(st=_STATUS, a=_SIDE("ask"), b=_SIDE("bid"), f="found_last"),
    "seek_depth": f"SELECT request_id, depth, {_LEVELS_OUT} FROM found_last GROUP BY request_id, depth",
    "seek_status": f"SELECT status, count(*) AS n FROM (SELECT request_id, {_STATUS} AS status FROM found_last f GROUP BY request_id, symbol, trade_date, found_ts) GROUP BY status",
    "mismatch_groups": f"SELECT symbol, exchange_code, session, minute_bucket, minute, side, level, {_COUNTS} FROM rep GROUP BY ALL",
    "missing_groups": "SELECT reason, session, symbol, count(*) AS missing_order_count FROM mlog GROUP BY ALL",
    "window_shares": " UNION ALL ".join(f"SELECT '{n}' AS \"window\", count(*) FILTER (WHERE i) AS mismatch_count, count(*) FILTER (WHERE i AND NOT price_match) AS price_mismatch_count, count(*) FILTER (WHERE i AND NOT qty_match) AS qty_mismatch_count, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE i) / count(*) ELSE 0.0 END AS share_of_mismatch FROM (SELECT *, ts_ms >= {a} AND ts_ms < {z} AS i FROM rep)" for n, (a, z) in DIAGNOSTIC_WINDOWS.items()),
    "top_buckets": "SELECT * FROM buckets",
    "worst_quotes": "SELECT * FROM worst",
    "bucket_snapshots": f"SELECT w.*, s.* EXCLUDE (symbol, trade_date, quote_seq) FROM worst w JOIN (SELECT symbol, trade_date, quote_seq, {_SHOTS(own=_SHOT('expected_price_int', 'expected_qty'), name='quote_snapshot', raw=_SHOT(*_OVER))} FROM cmp GROUP BY symbol, trade_date, quote_seq) s ON s.symbol = w.symbol AND s.trade_date = w.trade_date AND s.quote_seq = w.worst_quote_seq",
    "opening_alignment": "SELECT * FROM opening",
    "opening_snapshots": f"SELECT w.*, s.* EXCLUDE (symbol, trade_date, quote_seq) FROM opening w JOIN (SELECT symbol, trade_date, quote_seq, {_SHOTS(own=_SHOT('expected_price_int', 'expected_qty'), name='opening_snapshot', raw=_SHOT(*_OVER))} FROM cmp GROUP BY symbol, trade_date, quote_seq) s ON s.symbol = w.symbol AND s.trade_date = w.trade_date AND s.quote_seq = w.opening_quote_seq",
    "diagnostic_totals": "SELECT count(*) AS mismatch_count, count(*) FILTER (WHERE NOT price_match) AS price_mismatch_count, count(*) FILTER (WHERE NOT qty_match) AS qty_mismatch_count, (SELECT count(*) FROM mlog) AS missing_order_count FROM rep",
    "order_ref_coverage": "SELECT role, count(*) AS checked, count(*) FILTER (WHERE o.id IS NULL) AS missing FROM (SELECT symbol, trade_date, 'passive' AS role, CASE aggressor_side WHEN 'B' THEN ask_order_id ELSE bid_order_id END AS id FROM t WHERE aggressor_side <> 'unknown' UNION ALL SELECT symbol, trade_date, 'active', CASE aggressor_side WHEN 'B' THEN bid_order_id ELSE ask_order_id END FROM t WHERE aggressor_side <> 'unknown') r LEFT JOIN (SELECT DISTINCT symbol, trade_date, exchange_order_id AS id FROM o WHERE exchange_order_id <> '') o USING (symbol, trade_date, id) GROUP BY role",
    "csv_roundtrip": "SELECT * FROM o",
    "parquet_roundtrip": "SELECT * FROM t",
    "path_sessions": "SELECT symbol, trade_date, count(*) AS row_count FROM t GROUP BY ALL",
    "import_counts": "SELECT 'quotes' AS artifact, symbol, trade_date, count(*) AS row_count FROM q GROUP BY ALL UNION ALL SELECT 'orders', symbol, trade_date, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'trades', symbol, trade_date, count(*) FROM t GROUP BY ALL",
}
_BODIES["enriched_missing_orders"] = """SELECT symbol, trade_date, event_id, reason, ref_side, order_id, ts_ms // 60000 AS minute_bucket,
lpad(CAST(ts_ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ts_ms // 60000 % 60 AS VARCHAR), 2, '0') AS minute FROM mlog"""
_BAD = {"q": ("quotes", "ask_price_3_int", "x1", "not a whole number"), "o": ("orders", "qty", "1.5", "not a whole number"), "t": ("trades", "price_int", "99999999999999999999", "out of range")}
_DAY = "CASE WHEN seq % 17 = 0 THEN 'day' ELSE CAST(trade_date AS VARCHAR) END"
_BODIES["rejected_rows"] = "\nUNION ALL ".join(
    f"""SELECT '{kind}' AS kind, symbol, {_DAY} AS trade_date, seq, CAST(nth AS INTEGER) AS nth, c[1] AS "column", c[2] AS cell, c[3] AS reason
FROM (SELECT symbol, trade_date, seq, unnest(bad) AS c, generate_subscripts(bad, 1) AS nth FROM (SELECT symbol, trade_date, seq, list_filter([
CASE WHEN seq % 13 = 0 THEN ['ts_ms', ' ', 'blank time'] WHEN seq % 19 = 0 THEN ['ts_ms', '9h15', 'not a whole number'] END,
CASE WHEN seq % 17 = 0 THEN ['trade_date', 'day', 'not a whole number'] END, CASE WHEN seq % 11 = 0 THEN ['{column}', '{cell}', '{why}'] END], lambda x: x IS NOT NULL) AS bad FROM {table}))"""
    for table, (kind, column, cell, why) in _BAD.items()
)
_BODIES["quarantine_counts"] = "\nUNION ALL ".join(
    f"""SELECT '{kind}' AS kind, symbol, count(*) AS all_rows, count(*) FILTER (WHERE NOT bad) AS accepted_rows, count(*) FILTER (WHERE bad) AS rejected_rows
FROM (SELECT symbol, seq % 11 = 0 OR seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0 AS bad FROM {table}) GROUP BY symbol"""
    for table, (kind, *_) in _BAD.items()
)
_BODIES["file_encodings"] = """SELECT symbol, trade_date, CASE symbol WHEN '600000.SH' THEN 'gb18030' ELSE 'utf-8-sig' END AS encoding,
count(*) FILTER (WHERE CAST(order_no AS BIGINT) % 7 = 0) AS nul_count FROM o GROUP BY symbol, trade_date"""
_BODIES["missing_session_files"] = """SELECT symbol || ' ' || trade_date AS dir, concat_ws(',', CASE WHEN NOT bool_or(k = 1) THEN '行情.csv' END, CASE WHEN NOT bool_or(k = 2) THEN '逐笔委托.csv' END,
CASE WHEN NOT bool_or(k = 3) THEN '逐笔成交.csv' END) AS missing FROM
(SELECT DISTINCT symbol, trade_date, 1 AS k FROM q UNION ALL SELECT DISTINCT symbol, trade_date, 2 FROM o WHERE trade_date % 2 = 0
UNION ALL SELECT DISTINCT symbol, trade_date, 3 FROM t WHERE symbol <> '300002.SZ') GROUP BY symbol, trade_date HAVING count(*) < 3"""
_BODIES["mixed_session_files"] = """SELECT dir, string_agg(s, ',' ORDER BY s) AS sessions FROM (SELECT DISTINCT dir || ' ' || trade_date AS dir, symbol || ' ' || trade_date AS s FROM
(SELECT symbol AS dir, symbol, trade_date FROM q UNION ALL
SELECT dir, arg_min(symbol, (seq, symbol)), trade_date FROM (SELECT CASE WHEN trade_date % 3 = 0 AND symbol = '600000.SH' THEN '000001.SZ' WHEN trade_date % 3 = 0 AND symbol = '000001.SZ' THEN '600000.SH' ELSE symbol END AS dir, symbol, trade_date, seq FROM o) GROUP BY dir, trade_date)) GROUP BY dir HAVING count(*) > 1"""
_TABLES = {"events": "tape", "missing_order_report": "mlog", "orders": "o", "quotes": "q", "trades": "t", "validation_report": "rep", "visible_orderbook_checkpoints": "cp"}
_BODIES["import_report"] = f"""SELECT v.*, a.artifacts, w.warnings, checkpoint_rows, quote_anchor_match_count, quote_anchor_match_rate, correction_cost, correction_price_change_count FROM ({_BODIES["validation_summary"]}) v
JOIN (SELECT symbol, trade_date, string_agg(t || ':' || n, ',' ORDER BY t) AS artifacts FROM
({" UNION ALL ".join(f"SELECT symbol, trade_date, '{n}' AS t, count(*) AS n FROM {c} GROUP BY symbol, trade_date" for n, c in _TABLES.items())}) GROUP BY symbol, trade_date) a USING (symbol, trade_date)
LEFT JOIN (SELECT q.symbol, q.trade_date, coalesce(any_value(CASE WHEN s.session_event_count > 0 THEN s.session_event_count || ' order rows became session events' END), '') AS warnings
FROM q LEFT JOIN ({_BODIES["session_event_counts"]}) s USING (symbol, trade_date) GROUP BY q.symbol, q.trade_date) w USING (symbol, trade_date)
LEFT JOIN ({_BODIES["visible_summary"]}) z USING (symbol, trade_date)"""
_BODIES["diagnostics_output"] = f"""SELECT 'residual_mismatch_groups' AS part, CAST(NULL AS VARCHAR) AS name, count(*) AS n, CAST(coalesce(sum(mismatch_count), 0) AS BIGINT) AS m FROM ({_BODIES["mismatch_groups"]})
UNION ALL SELECT 'residual_missing_groups', NULL, count(*), CAST(coalesce(sum(missing_order_count), 0) AS BIGINT) FROM ({_BODIES["missing_groups"]})
UNION ALL SELECT 'residual_top_time_buckets', NULL, count(*), CAST(coalesce(sum(mismatch_count), 0) AS BIGINT) FROM buckets
UNION ALL SELECT 'opening_alignment_report', NULL, count(*), CAST(coalesce(sum(raw_mismatch_count), 0) AS BIGINT) FROM opening
UNION ALL SELECT 'totals', '', missing_order_count, mismatch_count FROM ({_BODIES["diagnostic_totals"]})
UNION ALL SELECT 'time_window', "window", 0, mismatch_count FROM ({_BODIES["window_shares"]})
UNION ALL SELECT 'top_bucket', symbol || ' ' || trade_date || ' ' || minute, worst_quote_seq, mismatch_count FROM worst
UNION ALL SELECT 'opening', symbol || ' ' || trade_date, opening_quote_seq, raw_mismatch_count FROM opening"""
_BODIES["books_at"] = """SELECT request_id, symbol, trade_date, asked_ts, CASE side WHEN 'B' THEN 'bid' ELSE 'ask' END AS side, CAST(level AS BIGINT) AS level, price_int, qty FROM
(SELECT *, row_number() OVER (PARTITION BY request_id, side ORDER BY CASE side WHEN 'B' THEN -price_int ELSE price_int END) AS level FROM
(SELECT r.request_id, r.symbol, r.trade_date, r.ts_ms AS asked_ts, r.depth, dl.side, dl.price_int, CAST(sum(dl.delta) AS BIGINT) AS qty FROM req r
JOIN dl ON dl.symbol = r.symbol AND dl.trade_date = r.trade_date AND dl.ts_ms <= r.ts_ms GROUP BY ALL HAVING sum(dl.delta) > 0)) WHERE level <= depth"""
_BODIES["published_runs"] = """SELECT symbol, trade_date, count(*) AS row_count, CAST(sum(qty * CASE WHEN trade_date % 2 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS qty,
CAST(trade_date % 2 AS BIGINT) AS replaced_runs FROM t GROUP BY symbol, trade_date"""
_BODIES |= {f"merged_{k}": _BODIES[v] for k, v in {"mismatch_groups": "mismatch_groups", "validation_summary": "validation_summary", "match_by_window": "raw_match_by_window", "visible_summary": "visible_summary"}.items()}
SQL = {k: _with(v, _A) for k, v in _BODIES.items()}
SQL["b_book_top10_at_quotes"] = _with("SELECT * FROM top10", _B)
SQL["b_missing_reason_counts"] = _with("SELECT reason, count(*) AS missing_order_count FROM mlog GROUP BY reason", _B)
SQL["b_order_lifecycle_totals"] = _with("SELECT symbol, trade_date, kind, count(*) AS n, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(rem_after) AS BIGINT) AS rem_after FROM life GROUP BY ALL", _B)
