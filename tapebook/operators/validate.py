"""Quotes against the rebuilt book, and the visible book's checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapebook.functions.cells import once, within
from tapebook.operators.normalize import quote_levels
from tapebook.schemas import CHECKPOINTS, CLOCK_WINDOWS, CONTINUOUS_WINDOWS, DEPTH, KEY, VALIDATION_REPORT

LEVELS = 2 * DEPTH


def compared(quotes: DataFrame, events: DataFrame, top: DataFrame) -> DataFrame:
    """Twenty rows a quote: the quote's level beside the rebuilt level of the same position (null if there is none).

    A book is one row of its time and meets the quotes as such; only then are quotes and book spread over the levels, so that no
    level is dealt out by itself."""
    ids = events.filter("event_type = 'quote'").select(*KEY, F.col("source_seq").alias("seq"), "event_id")
    place = F.when(F.col("side") == "ask", F.col("level")).otherwise(-F.col("level"))
    book = top.groupBy(*KEY, "ts_ms").agg(F.map_from_entries(F.collect_list(F.struct(place, F.struct("price_int", "qty")))).alias("book"))
    wide = quotes.join(ids, [*KEY, "seq"]).join(book, [*KEY, "ts_ms"], "left")
    rows = quote_levels(wide, *KEY, F.col("seq").alias("quote_seq"), "event_id", "ts_ms", "session", "book").withColumn("book", F.try_element_at("book", place))
    rows = rows.withColumns({"actual_price_int": F.col("book.price_int"), "actual_qty": F.col("book.qty")}).drop("book")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return rows.withColumns({"price_match": same("expected_price_int", "actual_price_int"), "qty_match": same("expected_qty", "actual_qty")})


def validation_report(levels: DataFrame) -> DataFrame:
    """The levels that differ; a quote's 0/0 or blank level without a rebuilt one is no difference."""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    empty = zero("expected_price_int") & zero("expected_qty") & F.col("actual_price_int").isNull()
    return levels.filter(~empty & ~(F.col("price_match") & F.col("qty_match"))).select(*VALIDATION_REPORT.fieldNames())


def mismatches(report: DataFrame, *by: str) -> DataFrame:
    return report.groupBy(*by).agg(F.count("*").alias("mismatch_count"), F.count_if(~F.col("price_match")).alias("price_mismatch_count"), F.count_if(~F.col("qty_match")).alias("qty_mismatch_count"))


def validation_summary(quotes: DataFrame, report: DataFrame, log: DataFrame) -> DataFrame:
    """Per session with events: checked quotes, mismatches, missing orders; clean sessions have zeros."""
    checked = quotes.groupBy(*KEY).agg(F.count("*").alias("checked_quotes"))
    missing = log.groupBy(*KEY).agg(F.count("*").alias("missing_order_count"))
    joined = checked.join(mismatches(report, *KEY), KEY, "left").join(missing, KEY, "left")
    return joined.na.fill(0)


def rates(df: DataFrame) -> DataFrame:
    rate = lambda c: F.when(F.col("compared_levels") > 0, 1 - F.col(c) / F.col("compared_levels")).otherwise(F.lit(0.0))
    return df.withColumn("compared_levels", F.col("checked_quotes") * LEVELS).withColumns(
        {"raw_match_rate": rate("mismatch_count"), "raw_price_match_rate": rate("price_mismatch_count"), "raw_qty_match_rate": rate("qty_mismatch_count")}
    )


def match_rates(quotes: DataFrame, report: DataFrame) -> DataFrame:
    """One row over all sessions: checked quotes, compared levels, mismatches and match rates."""
    flag = lambda c: (~F.col(c)).cast("bigint")
    names = ("checked_quotes", "mismatch_count", "price_mismatch_count", "qty_mismatch_count")
    parts = quotes.select(F.lit(1), F.lit(0), F.lit(0), F.lit(0)).unionAll(report.select(F.lit(0), F.lit(1), flag("price_match"), flag("qty_match"))).toDF(*names)
    return rates(parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]))


def window_of(ts_ms: Column, windows: dict[str, tuple[int, int]]) -> Column:
    """The first window that holds a time; null if none does."""

    def label(ts: Column) -> Column:
        found = F
        for name, bounds in windows.items():
            found = found.when(within(ts, bounds), name)
        return found.otherwise(F.lit(None).cast("string"))

    return once(ts_ms, label)


def match_rates_by_window(quotes: DataFrame, report: DataFrame, windows: dict[str, tuple[int, int]] = CLOCK_WINDOWS) -> DataFrame:
    """The rates in each clock window that has quotes."""
    in_window = lambda df: df.withColumn("window", window_of(F.col("ts_ms"), windows)).filter("window IS NOT NULL")
    checked = in_window(quotes).groupBy("window").agg(F.count("*").alias("checked_quotes"))
    return rates(checked.join(mismatches(in_window(report), "window"), "window", "left").na.fill(0))


def mismatch_by_side(report: DataFrame) -> DataFrame:
    return report.groupBy("side").agg(F.count("*").alias("mismatch_count"))


def checkpoints(levels: DataFrame) -> DataFrame:
    """All levels: the quote's as visible, the rebuilt ones as raw, and what correcting one into the other costs."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = F.when(F.col("price_match"), F.abs(zero("expected_qty") - zero("actual_qty"))).otherwise(zero("expected_qty") + zero("actual_qty"))
    columns = {
        "checkpoint_id": F.concat_ws("-", "symbol", F.col("trade_date").cast("string"), F.col("quote_seq").cast("string")),
        "source": F.lit("quote_anchor"),
        "visible_price_int": F.col("expected_price_int"), "visible_qty": F.col("expected_qty"), "raw_price_int": F.col("actual_price_int"), "raw_qty": F.col("actual_qty"),
        "raw_price_match": F.col("price_match"), "raw_qty_match": F.col("qty_match"), "quote_anchor_match": F.lit(True), "correction_price_changed": ~F.col("price_match"),
        "inter_quote_drift_abs_qty": cost, "correction_cost": cost, "correction_abs_qty": cost,
    }
    return levels.withColumns(columns).select(*CHECKPOINTS.fieldNames())


def visible_summary(points: DataFrame) -> DataFrame:
    """Per session: counts, sums and anchor match rates, overall and in the continuous windows (0 where there is nothing)."""
    match = F.col("quote_anchor_match")
    rate = lambda inside: F.coalesce(F.count_if(match & inside) / F.nullif(F.count_if(inside), F.lit(0)), F.lit(0.0))
    return points.groupBy(*KEY).agg(
        F.count_distinct("quote_seq").alias("checked_quotes"),
        F.count("*").alias("checkpoint_rows"),
        F.count_if(match).alias("quote_anchor_match_count"),
        rate(F.lit(True)).alias("quote_anchor_match_rate"),
        F.sum("inter_quote_drift_abs_qty").alias("inter_quote_drift_abs_qty"),
        F.sum("correction_cost").alias("correction_cost"),
        F.sum("correction_cost").alias("correction_abs_qty"),
        F.count_if("correction_price_changed").alias("correction_price_change_count"),
        *[rate(within(F.col("ts_ms"), w)).alias(f"{name}_match_rate") for name, w in CONTINUOUS_WINDOWS.items()],
    )
