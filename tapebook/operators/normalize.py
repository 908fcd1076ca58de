"""Raw string tables (headers as in the files, and seq: the row's place in its file) to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapebook.functions.cells import aggressor, clean, or_unknown, parse_ts_ms, session_label, to_int
from tapebook.schemas import COMMON_HEADERS, DEPTH, ORDER_HEADERS, ORDERS, PRICE_SCALE, QUOTE_HEADERS, QUOTE_LEVEL_HEADERS, QUOTES, SIDES, TRADE_HEADERS, TRADES


def _common(strict: bool) -> dict[str, Column]:
    header = {v: F.col(k) for k, v in COMMON_HEADERS.items()}
    ts = parse_ts_ms(header["time"])
    return {
        "symbol": clean(header["symbol"]),
        "exchange_code": clean(header["exchange_code"]),
        "trade_date": to_int(header["trade_date"], strict),
        "time_raw": to_int(header["time"], strict),
        "ts_ms": ts,
        "session": session_label(ts),
        "seq": F.col("seq").cast("bigint"),
    }


def int_headers(kind: str) -> dict[str, str]:
    """header -> column of the cells of a kind (quotes, orders, trades) that must be whole numbers, the time among them."""
    own = {"quotes": QUOTE_HEADERS, "orders": ORDER_HEADERS, "trades": TRADE_HEADERS}[kind]
    common = {h: {"time": "time_raw"}.get(n, n) for h, n in COMMON_HEADERS.items() if n in ("trade_date", "time")}
    found = common | {h: n for h, n in own.items() if kind == "quotes" or n in ("price_int", "qty")}
    if kind == "quotes":
        found |= {f"{h}{i}": n.format(i) for s in SIDES for i in range(1, DEPTH + 1) for h, n in zip(QUOTE_LEVEL_HEADERS[s], (s + "_price_{}_int", s + "_qty_{}"))}
    return found


def _typed(raw: DataFrame, columns: dict[str, Column], schema) -> DataFrame:
    return raw.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def normalize_quotes(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Level-2 snapshots. strict: text that is no integer fails; else it is null."""
    columns = _common(strict) | {v: to_int(F.col(k), strict) for k, v in QUOTE_HEADERS.items()} | {"price_scale": F.lit(PRICE_SCALE)}
    for side in SIDES:
        price, qty = QUOTE_LEVEL_HEADERS[side]
        for i in range(1, DEPTH + 1):
            columns |= {f"{side}_price_{i}_int": to_int(F.col(f"{price}{i}"), strict), f"{side}_qty_{i}": to_int(F.col(f"{qty}{i}"), strict)}
    return _typed(raw, columns, QUOTES)


def normalize_orders(raw: DataFrame, strict: bool = True) -> DataFrame:
    cell = {v: F.col(k) for k, v in ORDER_HEADERS.items()}
    columns = _common(strict) | {
        "order_no": clean(cell["order_no"]),
        "exchange_order_id": clean(cell["exchange_order_id"]),
        "order_type": or_unknown(cell["order_type"]),
        "side": or_unknown(cell["side"]),
        "price_int": to_int(cell["price_int"], strict),
        "qty": to_int(cell["qty"], strict),
    }
    return _typed(raw, columns, ORDERS)


def normalize_trades(raw: DataFrame, strict: bool = True) -> DataFrame:
    cell = {v: F.col(k) for k, v in TRADE_HEADERS.items()}
    texts = {k: clean(cell[k]) for k in ("trade_id", "trade_code", "order_code", "ask_order_id", "bid_order_id")}
    columns = _common(strict) | texts | {"aggressor_side": aggressor(cell["aggressor_side"]), "price_int": to_int(cell["price_int"], strict), "qty": to_int(cell["qty"], strict)}
    return _typed(raw, columns, TRADES)


def quote_levels(quotes: DataFrame, *carry: str, prefix: str = "expected") -> DataFrame:
    """Twenty rows a quote: the carried columns, side, level, and the level's price and quantity."""
    level = [
        F.struct(F.lit(s).alias("side"), F.lit(i).cast("bigint").alias("level"), F.col(f"{s}_price_{i}_int").alias(f"{prefix}_price_int"), F.col(f"{s}_qty_{i}").alias(f"{prefix}_qty"))
        for s in SIDES
        for i in range(1, DEPTH + 1)
    ]
    return quotes.select(*carry, F.inline(F.array(*level)))
