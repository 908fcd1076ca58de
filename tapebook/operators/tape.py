"""The event tape: quotes, orders and trades of a session in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.operators.numbering import numbered_by
from tapebook.schemas import EVENTS, KEY, ORDER_TYPES, PRIORITY

_SHARED = ("symbol", "exchange_code", "trade_date", "session", "ts_ms")


def _event_type():
    kind = F
    for code, name in ORDER_TYPES.items():
        kind = kind.when(F.col("order_type") == code, name)
    return kind.otherwise("session")


def _projected(df: DataFrame, source: str, kind, *own: str) -> DataFrame:
    priority = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    rows = df.select(*_SHARED, kind.alias("event_type"), F.col("seq").alias("source_seq"), F.concat(F.lit(f"{source}:"), F.col("seq").cast("string")).alias("payload_ref"), *own)
    return rows.withColumn("priority", priority[F.col("event_type")].cast("bigint"))


def unordered_events(quotes: DataFrame, orders: DataFrame, trades: DataFrame) -> DataFrame:
    """The union of the three sources by name; no shuffle."""
    q = _projected(quotes, "quotes", F.lit("quote"), "last_price_int", "last_qty")
    o = _projected(orders, "orders", _event_type(), "exchange_order_id", "order_no", "order_type", "side", "price_int", "qty")
    t = _projected(trades, "trades", F.lit("trade"), "trade_id", "aggressor_side", "price_int", "qty", "ask_order_id", "bid_order_id")
    return q.unionByName(o, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)


def event_tape(quotes: DataFrame, orders: DataFrame, trades: DataFrame, parts: int | None = None) -> DataFrame:
    """Events with event_id from 1 in (ts_ms, priority, source_seq) order of their session. Ranges of that order are numbered apart
    (numbering), so a session that holds most of the rows is spread over tasks."""
    rows = unordered_events(quotes, orders, trades)
    return numbered_by(rows, KEY, ["ts_ms", "priority", "source_seq"], "event_id", parts).select(*EVENTS.fieldNames())


def session_event_counts(orders: DataFrame) -> DataFrame:
    """Order rows of a session that no order type code covers, and so became session events."""
    return orders.groupBy(*KEY).agg(F.count_if(_event_type() == "session").alias("session_event_count"))
