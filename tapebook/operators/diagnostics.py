"""What is left of the mismatches over all sessions: groups, windows, worst buckets and openings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.functions.cells import minute_bucket, minute_label, within
from tapebook.operators.normalize import quote_levels
from tapebook.operators.validate import mismatches
from tapebook.schemas import DIAGNOSTIC_WINDOWS, KEY, MISMATCH_GROUPS, MISSING_GROUPS, OPENING, OPENING_ALIGNMENT, TOP_BUCKETS

TOP = 20
_SNAPSHOT = "struct<ask:array<struct<level:bigint,price_int:bigint,qty:bigint>>,bid:array<struct<level:bigint,price_int:bigint,qty:bigint>>>"


def _minutes(df: DataFrame) -> DataFrame:
    return df.withColumn("minute_bucket", minute_bucket(F.col("ts_ms"))).withColumn("minute", minute_label(F.col("minute_bucket")))


def enriched(report: DataFrame, quotes: DataFrame) -> DataFrame:
    """Mismatches with their quote's exchange_code and session (null without a quote) and minute. Two quote columns travel, not forty."""
    known = quotes.select(*KEY, F.col("seq").alias("quote_seq"), "exchange_code", "session")
    return _minutes(report.join(known, [*KEY, "quote_seq"], "left"))


def enriched_missing(log: DataFrame) -> DataFrame:
    """Missing orders with their minute."""
    return _minutes(log)


def mismatch_groups(rich: DataFrame) -> DataFrame:
    """Counts by symbol (its days together), phase, minute, side and level."""
    return mismatches(rich, "symbol", "exchange_code", "session", "minute_bucket", "minute", "side", "level").select(*MISMATCH_GROUPS.fieldNames())


def missing_groups(log: DataFrame) -> DataFrame:
    """Counts by reason, phase and symbol."""
    return log.groupBy("reason", "session", "symbol").agg(F.count("*").alias("missing_order_count")).select(*MISSING_GROUPS.fieldNames())


def window_shares(report: DataFrame) -> DataFrame:
    """Mismatches of each diagnostic window and their share of all; a window without any has a row of zeros."""
    values = [F.count("*").alias("total")]
    for k, bounds in enumerate(DIAGNOSTIC_WINDOWS.values()):
        inside = within(F.col("ts_ms"), bounds)
        values += [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & ~F.col("price_match")).alias(f"p{k}"), F.count_if(inside & ~F.col("qty_match")).alias(f"q{k}")]
    share = lambda k: F.when(F.col("total") > 0, F.col(f"n{k}") / F.col("total")).otherwise(F.lit(0.0))
    rows = [F.struct(F.lit(name).alias("window"), F.col(f"n{k}").alias("mismatch_count"), F.col(f"p{k}").alias("price_mismatch_count"), F.col(f"q{k}").alias("qty_mismatch_count"), share(k).alias("share_of_mismatch")) for k, name in enumerate(DIAGNOSTIC_WINDOWS)]
    return report.agg(*values).select(F.inline(F.array(*rows)))


def top_buckets(rich: DataFrame, top: int = TOP) -> DataFrame:
    """The minutes with most mismatches, by session and phase."""
    by = ["symbol", "trade_date", "exchange_code", "session", "minute_bucket", "minute"]
    out = mismatches(rich, *by).select(*TOP_BUCKETS.fieldNames())
    return out.orderBy(F.desc("mismatch_count"), "symbol", "trade_date", "session", "minute_bucket").limit(top)


def worst_quotes(rich: DataFrame, buckets: DataFrame) -> DataFrame:
    """For each bucket (at most TOP rows, so broadcast) the quote of its minute with most mismatches, the smallest seq among equals."""
    minutes = buckets.select(*KEY, "minute_bucket").distinct()
    per_quote = rich.join(F.broadcast(minutes), [*KEY, "minute_bucket"]).groupBy(*KEY, "minute_bucket", "quote_seq").agg(F.count("*").alias("n"))
    worst = per_quote.groupBy(*KEY, "minute_bucket").agg(F.max(F.struct("n", (-F.col("quote_seq")).alias("q"))).alias("w"))
    rows = buckets.join(worst, [*KEY, "minute_bucket"])
    return rows.select("symbol", "trade_date", "exchange_code", "session", "minute", "mismatch_count", (-F.col("w.q")).alias("worst_quote_seq"), F.col("w.n").alias("worst_quote_mismatch_count"))


def _nested(levels: DataFrame, by: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Twenty level rows of each key to one row with a snapshot per entry of columns: name -> (price, qty)."""
    listed = lambda side, p, q: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("level", F.col(p).alias("price_int"), F.col(q).alias("qty")))))
    return levels.groupBy(*by).agg(*[F.struct(listed("ask", p, q).alias("ask"), listed("bid", p, q).alias("bid")).cast(_SNAPSHOT).alias(n) for n, (p, q) in columns.items()])


def snapshots(wanted: DataFrame, quotes: DataFrame, report: DataFrame, name: str = "quote_snapshot") -> DataFrame:
    """For wanted quotes (session, quote_seq): the quote as a snapshot, and the rebuilt book: the quote overlaid by its
    mismatches, nulls included. A wanted quote that is not there fails."""
    by = [*KEY, "quote_seq"]
    asked = wanted.select(*KEY, F.col("quote_seq").alias("seq")).distinct()
    rows = asked.join(quotes.withColumn("there", F.lit(True)), [*KEY, "seq"], "left")
    absent = F.raise_error(F.concat_ws(" ", F.lit("no quote"), "symbol", F.col("trade_date").cast("string"), F.col("seq").cast("string"))).cast("bigint")
    rows = rows.withColumn("seq", F.when(F.col("there"), F.col("seq")).otherwise(absent))
    levels = quote_levels(rows, *KEY, F.col("seq").alias("quote_seq"))
    mine = report.join(wanted.select(*by).distinct(), by, "left_semi").select(*by, "side", "level", F.col("actual_price_int").alias("a_price"), F.col("actual_qty").alias("a_qty"), F.lit(True).alias("differs"))
    laid = levels.join(mine, [*by, "side", "level"], "left")
    pick = lambda own, other: F.when(F.col("differs"), F.col(other)).otherwise(F.col(own))
    laid = laid.withColumns({"raw_price": pick("expected_price_int", "a_price"), "raw_qty": pick("expected_qty", "a_qty")})
    return _nested(laid, by, {name: ("expected_price_int", "expected_qty"), "raw_book_snapshot": ("raw_price", "raw_qty")})


def bucket_snapshots(rich: DataFrame, quotes: DataFrame, buckets: DataFrame) -> DataFrame:
    """worst_quotes with both snapshots."""
    worst = worst_quotes(rich, buckets)
    shots = snapshots(worst.withColumnRenamed("worst_quote_seq", "quote_seq"), quotes, rich)
    return worst.join(shots.withColumnRenamed("quote_seq", "worst_quote_seq"), [*KEY, "worst_quote_seq"])


def opening_alignment(report: DataFrame, quotes: DataFrame) -> DataFrame:
    """The first quote of the opening minute of each session that has one, and its mismatches (zeros if none)."""
    first = quotes.filter(within(F.col("ts_ms"), OPENING)).groupBy(*KEY).agg(F.min(F.struct("ts_ms", "seq", "exchange_code")).alias("q"))
    opening = first.select(*KEY, F.col("q.exchange_code").alias("exchange_code"), F.col("q.seq").alias("quote_seq"), F.col("q.ts_ms").alias("ts_ms"))
    counts = mismatches(report, *KEY, "quote_seq")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(f"raw_{c}")
    rows = opening.join(counts, [*KEY, "quote_seq"], "left").select(*KEY, "exchange_code", F.col("quote_seq").alias("opening_quote_seq"), "ts_ms", zero("mismatch_count"), zero("price_mismatch_count"), zero("qty_mismatch_count"), F.lit(0).cast("bigint").alias("reproduced_mismatch_count"))
    return rows.select(*OPENING_ALIGNMENT.fieldNames()).orderBy(*KEY)


def opening_snapshots(report: DataFrame, quotes: DataFrame) -> DataFrame:
    rows = opening_alignment(report, quotes)
    shots = snapshots(rows.withColumnRenamed("opening_quote_seq", "quote_seq"), quotes, report, "opening_snapshot")
    return rows.join(shots.withColumnRenamed("quote_seq", "opening_quote_seq"), [*KEY, "opening_quote_seq"])


def totals(report: DataFrame, log: DataFrame) -> DataFrame:
    """One row: mismatches, price and quantity mismatches, missing orders."""
    flag = lambda c: (~F.col(c)).cast("bigint")
    names = ("mismatch_count", "price_mismatch_count", "qty_mismatch_count", "missing_order_count")
    parts = report.select(F.lit(1), flag("price_match"), flag("qty_match"), F.lit(0)).unionAll(log.select(F.lit(0), F.lit(0), F.lit(0), F.lit(1))).toDF(*names)
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def order_ref_coverage(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Per role: how many trade order ids were looked up among the session's orders, and how many are not there.

    Passive is the ask of a buyer-initiated trade and the bid of a seller-initiated one; others are left out."""
    buy = F.col("aggressor_side") == "B"
    pair = F.array(F.struct(F.lit("passive").alias("role"), F.when(buy, F.col("ask_order_id")).otherwise(F.col("bid_order_id")).alias("id")), F.struct(F.lit("active").alias("role"), F.when(buy, F.col("bid_order_id")).otherwise(F.col("ask_order_id")).alias("id")))
    refs = trades.filter(F.col("aggressor_side").isin("B", "S")).select(*KEY, F.inline(pair))
    known = orders.select(*KEY, F.col("exchange_order_id").alias("id")).filter("id <> ''").distinct().withColumn("there", F.lit(True))
    return refs.join(known, [*KEY, "id"], "left").groupBy("role").agg(F.count("*").alias("checked"), F.count_if(F.col("there").isNull()).alias("missing"))
