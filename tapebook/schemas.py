"""Fixed schemas and constants of the session tables. A session is one (symbol, trade_date)."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["symbol", "trade_date"]
DEPTH = 10
PRICE_SCALE = 1000
SIDES = ("ask", "bid")

#: Header -> column of the raw files.
COMMON_HEADERS = {"万得代码": "symbol", "交易所代码": "exchange_code", "自然日": "trade_date", "时间": "time"}
QUOTE_HEADERS = {
    "成交价": "last_price_int", "成交量": "last_qty", "成交额": "last_amount", "成交笔数": "trade_count", "当日累计成交量": "cum_qty",
    "当日成交额": "cum_amount", "最高价": "high_int", "最低价": "low_int", "开盘价": "open_int", "前收盘": "prev_close_int",
}
QUOTE_LEVEL_HEADERS = {"ask": ("申卖价", "申卖量"), "bid": ("申买价", "申买量")}
ORDER_HEADERS = {"委托编号": "order_no", "交易所委托号": "exchange_order_id", "委托类型": "order_type", "委托代码": "side", "委托价格": "price_int", "委托数量": "qty"}
TRADE_HEADERS = {
    "成交编号": "trade_id", "成交代码": "trade_code", "委托代码": "order_code", "BS标志": "aggressor_side", "成交价格": "price_int", "成交数量": "qty",
    "叫卖序号": "ask_order_id", "叫买序号": "bid_order_id",
}
FILES = {"quotes": "行情.csv", "orders": "逐笔委托.csv", "trades": "逐笔成交.csv"}

#: Event types of order_type codes, and the order of events at one time.
ORDER_TYPES = {"A": "order_add", "0": "order_add", "D": "order_cancel", "1": "order_cancel"}
PRIORITY = {"session": 0, "order_add": 1, "order_cancel": 1, "trade": 2, "quote": 3}

#: Clock windows in ms of the day, half-open.
SESSION_STARTS = (("preopen", 33_300_000), ("auction", 33_900_000), ("continuous_am", 41_400_000), ("lunch", 46_800_000), ("continuous_pm", 54_000_000))
CONTINUOUS_WINDOWS = {"continuous_am": (34_260_000, 41_400_000), "continuous_pm": (46_800_000, 53_820_000)}
CLOCK_WINDOWS = {"09:15-09:30": (33_300_000, 34_200_000), "09:30-09:31": (34_200_000, 34_260_000), "09:31-11:30": (34_260_000, 41_400_000), "13:00-14:57": (46_800_000, 53_820_000), "14:57-15:00": (53_820_000, 54_000_000)}
DIAGNOSTIC_WINDOWS = {k: CLOCK_WINDOWS[k] for k in ("09:15-09:30", "09:30-09:31", "14:57-15:00")}
OPENING = CLOCK_WINDOWS["09:30-09:31"]


STRING, BIGINT, BOOLEAN = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_BASE = dict(
    symbol=STRING, exchange_code=STRING, trade_date=BIGINT, time_raw=BIGINT, ts_ms=BIGINT, session=STRING, seq=BIGINT,
)
_SCALARS = {c: BIGINT for c in QUOTE_HEADERS.values()}
_LEVELS = {f"{s}_{what}": BIGINT for s in SIDES for i in range(1, DEPTH + 1) for what in (f"price_{i}_int", f"qty_{i}")}
_COUNTS = dict(mismatch_count=BIGINT, price_mismatch_count=BIGINT, qty_mismatch_count=BIGINT)

QUOTES = _struct(**_BASE, **_SCALARS, price_scale=BIGINT, **_LEVELS)
ORDERS = _struct(
    **_BASE,
    order_no=STRING, exchange_order_id=STRING, order_type=STRING, side=STRING, price_int=BIGINT, qty=BIGINT,
)
TRADES = _struct(
    **_BASE,
    trade_id=STRING, trade_code=STRING, order_code=STRING, aggressor_side=STRING, price_int=BIGINT, qty=BIGINT,
    ask_order_id=STRING, bid_order_id=STRING,
)
EVENTS = _struct(
    event_id=BIGINT, symbol=STRING, exchange_code=STRING, trade_date=BIGINT, session=STRING, ts_ms=BIGINT, event_type=STRING,
    priority=BIGINT, source_seq=BIGINT, payload_ref=STRING, last_price_int=BIGINT, last_qty=BIGINT, exchange_order_id=STRING,
    order_no=STRING, order_type=STRING, side=STRING, price_int=BIGINT, qty=BIGINT, trade_id=STRING, aggressor_side=STRING,
    ask_order_id=STRING, bid_order_id=STRING,
)
VALIDATION_REPORT = _struct(
    symbol=STRING, trade_date=BIGINT, quote_seq=BIGINT, event_id=BIGINT, ts_ms=BIGINT, side=STRING, level=BIGINT,
    expected_price_int=BIGINT, actual_price_int=BIGINT, expected_qty=BIGINT, actual_qty=BIGINT, price_match=BOOLEAN,
    qty_match=BOOLEAN,
)
MISSING_ORDER_REPORT = _struct(
    symbol=STRING, trade_date=BIGINT, reason=STRING, event_id=BIGINT, event_type=STRING, ts_ms=BIGINT, session=STRING,
    source_seq=BIGINT, price_int=BIGINT, qty=BIGINT, order_id=STRING, ref_side=STRING, requested_qty=BIGINT,
    remaining_qty=BIGINT,
)
CHECKPOINTS = _struct(
    symbol=STRING, trade_date=BIGINT, checkpoint_id=STRING, quote_seq=BIGINT, event_id=BIGINT, ts_ms=BIGINT, session=STRING,
    source=STRING, side=STRING, level=BIGINT, visible_price_int=BIGINT, visible_qty=BIGINT, raw_price_int=BIGINT, raw_qty=BIGINT,
    raw_price_match=BOOLEAN, raw_qty_match=BOOLEAN, quote_anchor_match=BOOLEAN, correction_price_changed=BOOLEAN,
    inter_quote_drift_abs_qty=BIGINT, correction_cost=BIGINT, correction_abs_qty=BIGINT,
)
BOOK_STATES = _struct(symbol=STRING, trade_date=BIGINT, block=BIGINT, side=STRING, price_int=BIGINT, ts_ms=BIGINT, qty=BIGINT)
BOOK_SPANS = _struct(symbol=STRING, trade_date=BIGINT, block_ms=BIGINT, first_block=BIGINT, last_block=BIGINT)
QUOTE_PARTS = _struct(symbol=STRING, trade_date=BIGINT, minute_bucket=BIGINT, checked_quotes=BIGINT)
MISMATCH_PARTS = _struct(
    symbol=STRING, trade_date=BIGINT, exchange_code=STRING, session=STRING, minute_bucket=BIGINT, minute=STRING, side=STRING,
    level=BIGINT, **_COUNTS,
)
MISSING_PARTS = _struct(symbol=STRING, trade_date=BIGINT, reason=STRING, session=STRING, minute_bucket=BIGINT, missing_order_count=BIGINT)
VISIBLE_PARTS = _struct(
    symbol=STRING, trade_date=BIGINT, minute_bucket=BIGINT, checked_quotes=BIGINT, checkpoint_rows=BIGINT,
    quote_anchor_match_count=BIGINT, inter_quote_drift_abs_qty=BIGINT, correction_cost=BIGINT, correction_price_change_count=BIGINT,
)
CHECKPOINT_TIMES = _struct(symbol=STRING, trade_date=BIGINT, ts_ms=BIGINT, event_id=BIGINT)
MISMATCH_GROUPS = _struct(
    symbol=STRING, exchange_code=STRING, session=STRING, minute_bucket=BIGINT, minute=STRING, side=STRING, level=BIGINT,
    **_COUNTS,
)
MISSING_GROUPS = _struct(
    reason=STRING, session=STRING, symbol=STRING, missing_order_count=BIGINT,
)
TOP_BUCKETS = _struct(
    symbol=STRING, trade_date=BIGINT, exchange_code=STRING, session=STRING, minute_bucket=BIGINT, minute=STRING,
    **_COUNTS,
)
OPENING_ALIGNMENT = _struct(
    symbol=STRING, trade_date=BIGINT, exchange_code=STRING, opening_quote_seq=BIGINT, ts_ms=BIGINT, raw_mismatch_count=BIGINT,
    raw_price_mismatch_count=BIGINT, raw_qty_mismatch_count=BIGINT, reproduced_mismatch_count=BIGINT,
)
