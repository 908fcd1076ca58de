"""Order-book tapes made of the given tables by integer expressions.

Tape A (from events) covers every kind of message, bad ones included, as raw string tables.  Tape B (from orders and
lineitem) is larger and typed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapebook.operators.normalize import normalize_orders, normalize_quotes, normalize_trades
from tapebook.operators.tape import event_tape
from tapebook.schemas import DEPTH, KEY, QUOTE_LEVEL_HEADERS


@dataclass
class Tape:
    quotes: DataFrame
    orders: DataFrame
    trades: DataFrame

    @property
    def events(self) -> DataFrame:
        return event_tape(self.quotes, self.orders, self.trades)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    half = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 2).cast("bigint")
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("e"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint").alias("k"),
        "event_type",
        F.element_at(F.array(*map(F.lit, ("600000.SH", "000001.SZ", "300002.SZ"))), (F.col("user_id") % 3 + 1).cast("int")).alias("symbol"),
        (F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")).cast("bigint").alias("trade_date"),
        (half * 30_000 + 33_000_000).alias("ts_ms"),
    )
    kind = F.when(F.col("event_type") == "purchase", "trade").when(F.col("event_type") == "signup", "quote").when(F.col("k") == 0, "session").when((F.col("event_type") == "click") & (e % 4 < 2), "cancel").otherwise("add")
    rows = rows.withColumn("kind", kind).withColumn("file", F.when(F.col("kind").isin("trade", "quote"), F.col("kind")).otherwise("order"))
    clock = F.col("ts_ms")
    hms = F.floor(clock / 3_600_000) * 10_000_000 + F.floor(clock / 60_000) % 60 * 100_000 + F.floor(clock / 1000) % 60 * 1000 + clock % 1000
    return rows.withColumn("time", hms.cast("bigint")).withColumn("seq", F.row_number().over(Window.partitionBy(*KEY, "file").orderBy("e")))


def _cell(value) -> F.Column:
    return F.concat(F.lit(" "), value.cast("string"))


def _raw(rows: DataFrame, **cells) -> DataFrame:
    common = [F.col("symbol").alias("万得代码"), F.substring("symbol", 1, 6).alias("交易所代码"), _cell(F.col("trade_date")).alias("自然日"), _cell(F.col("time")).alias("时间")]
    return rows.select(*common, "seq", *[v.alias(k) for k, v in cells.items()])


def raw_a(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw quotes, orders and trades of tape A."""
    base, e, k = _base_a(spark, sf_dir), F.col("e"), F.col("k")
    even = e % 2 == 0
    price = F.when(even, F.lit(10_000) - k % 10 * 10).otherwise(F.lit(10_010) + k % 10 * 10)
    qty = F.when(e % 97 == 0, F.lit(0)).otherwise((e % 3 + 1) * 100)
    kind = F.col("kind")
    code = F.when(kind == "add", F.when(even, "A").otherwise("0")).when(kind == "cancel", F.when(even, "D").otherwise("1")).otherwise("U")
    orders = _raw(
        base.filter("file = 'order'"),
        委托编号=_cell(e), 交易所委托号=F.when(k == 99, F.lit("")).otherwise((k % 30).cast("string")), 委托类型=code, 委托代码=F.when(even, "B").otherwise("S"), 委托价格=_cell(price), 委托数量=_cell(qty),
    )
    side = F.when(e % 5 == 0, F.lit("")).when(e % 5 < 3, "B").otherwise("s")
    trades = _raw(
        base.filter("file = 'trade'"),
        成交编号=_cell(e), 成交代码=F.lit("0"), 委托代码=F.lit(""), BS标志=side, 成交价格=_cell(price), 成交数量=_cell(qty), 叫卖序号=((k + e) % 30).cast("string"), 叫买序号=(k % 30).cast("string"),
    )
    scalars = {h: _cell((e * m) % 1000) for m, h in enumerate(("成交价", "成交量", "成交额", "成交笔数", "当日累计成交量", "当日成交额", "最高价", "最低价", "开盘价", "前收盘"), 1)}
    levels = {}
    for i in range(1, DEPTH + 1):
        for s, best in (("ask", 10_010 + 10 * (i - 1)), ("bid", 10_000 - 10 * (i - 1))):
            p, q = QUOTE_LEVEL_HEADERS[s]
            levels |= {f"{p}{i}": _cell(F.lit(best if i <= 8 else 0)), f"{q}{i}": _cell((e + i) % 6 * 100 if i <= 8 else F.lit(0))}
    return _raw(base.filter("file = 'quote'"), **scalars, **levels), orders, trades


def tape_a(spark: SparkSession, sf_dir: str) -> Tape:
    quotes, orders, trades = raw_a(spark, sf_dir)
    return Tape(normalize_quotes(quotes), normalize_orders(orders), normalize_trades(trades))


def spoilt_a(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw quotes, orders and trades of tape A with cells that cannot be typed: prices, quantities, times and dates, by seq."""
    bad = {"quotes": ("申卖价3", "x1"), "orders": ("委托数量", "1.5"), "trades": ("成交价格", "99999999999999999999")}
    seq = F.col("seq")
    out = {}
    for (kind, (header, cell)), raw in zip(bad.items(), raw_a(spark, sf_dir)):
        out[kind] = raw.withColumns({
            header: F.when(seq % 11 == 0, cell).otherwise(F.col(header)),
            "时间": F.when(seq % 13 == 0, " ").when(seq % 19 == 0, "9h15").otherwise(F.col("时间")),
            "自然日": F.when(seq % 17 == 0, "day").otherwise(F.col("自然日")),
        })
    return out


def requests_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seek requests from every seventh event, one for a session that is not there, and one of depth 0."""
    rows = _base_a(spark, sf_dir).filter("e % 7 = 0").select(F.col("e").alias("request_id"), *KEY, "ts_ms", (F.col("e") % 10 + 1).alias("depth"))
    first = rows.orderBy("request_id").limit(1)
    gone = first.select(F.lit(-1).cast("bigint").alias("request_id"), F.lit("999999.SH").alias("symbol"), "trade_date", "ts_ms", "depth")
    flat = first.select(F.lit(-2).cast("bigint").alias("request_id"), *KEY, F.lit(86_400_000).cast("bigint").alias("ts_ms"), F.lit(0).cast("bigint").alias("depth"))
    return rows.unionByName(gone).unionByName(flat)


def tape_b_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayable events of tape B with its quotes: one row per order (an add, and a quote if its status is P) and per
    lineitem (a cancel or a trade against the order's side).

    event_id is what a session's events are ordered by, not their number: a replay needs no more than an order's events in order, and
    a symbol has a twentieth of all rows, too many for a window. At one time and priority orders come before lines, these by their columns."""
    clock = lambda day: (F.datediff(F.to_date(day), F.lit("1995-01-01").cast("date")) * 9000 + 33_000_000).cast("bigint")
    symbol = lambda key: F.concat(F.lit("S"), (F.col(key) % 20).cast("string"))
    buy = lambda key: F.floor(F.col(key) / 20) % 2 == 0
    o = _table(spark, sf_dir, "orders")
    step = F.col("o_custkey") % 100 * 10
    day = F.lit(20240101).cast("bigint")
    add = o.select(
        symbol("o_orderkey").alias("symbol"), day.alias("trade_date"), clock("o_orderdate").alias("ts_ms"), F.lit("order_add").alias("event_type"), F.col("o_orderkey").cast("bigint").alias("source_seq"),
        F.col("o_orderkey").cast("string").alias("exchange_order_id"), F.when(buy("o_orderkey"), "B").otherwise("S").alias("side"),
        F.when(buy("o_orderkey"), F.lit(10_000) - step).otherwise(F.lit(10_010) + step).cast("bigint").alias("price_int"), ((F.col("o_custkey") % 5 + 1) * 100).cast("bigint").alias("qty"),
    )
    quote = o.filter("o_orderstatus = 'P'").select(symbol("o_orderkey").alias("symbol"), day.alias("trade_date"), clock("o_orderdate").alias("ts_ms"), F.lit("quote").alias("event_type"), F.col("o_orderkey").cast("bigint").alias("source_seq"))
    li = _table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    ident = F.col("l_orderkey").cast("string")
    cancel = F.col("l_returnflag") == "R"
    out = li.select(
        symbol("l_orderkey").alias("symbol"), day.alias("trade_date"), clock("l_shipdate").alias("ts_ms"), F.when(cancel, "order_cancel").otherwise("trade").alias("event_type"),
        F.col("l_orderkey").cast("bigint").alias("source_seq"), F.when(cancel, ident).alias("exchange_order_id"), F.col("l_quantity").cast("bigint").alias("qty"),
        F.when(~cancel, F.when(buy("l_orderkey"), "S").otherwise("B")).alias("aggressor_side"),
        F.when(~cancel, F.when(buy("l_orderkey"), "").otherwise(ident)).alias("ask_order_id"), F.when(~cancel, F.when(buy("l_orderkey"), ident).otherwise("")).alias("bid_order_id"),
        F.lit(1).alias("line"), *keys[1:],
    )
    rows = add.unionByName(out, allowMissingColumns=True).unionByName(quote, allowMissingColumns=True).withColumn("session", F.lit("tape_b"))
    priority = F.when(F.col("event_type") == "quote", 3).when(F.col("event_type") == "trade", 2).otherwise(1)
    rows = rows.withColumn("event_id", F.struct("ts_ms", priority.alias("priority"), F.coalesce("line", F.lit(0)).alias("line"), "source_seq", *keys[1:]))
    return rows.drop("line", *keys[1:])
