"""Counts stored with each session, and reports merged from them: a diagnosis of all sessions reads counts, not levels.

Parts are sums by session, minute and group, so any set of sessions is merged by adding, and a replaced session brings its own.
All windows begin and end at whole minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapebook.functions.cells import minute_bucket
from tapebook.operators import diagnostics, validate
from tapebook.schemas import CLOCK_WINDOWS, CONTINUOUS_WINDOWS, DIAGNOSTIC_WINDOWS, KEY, MISMATCH_GROUPS, MISMATCH_PARTS, MISSING_GROUPS, MISSING_PARTS, QUOTE_PARTS, TOP_BUCKETS, VISIBLE_PARTS

_COUNTS = ("mismatch_count", "price_mismatch_count", "qty_mismatch_count")
_VISIBLE = ("checked_quotes", "checkpoint_rows", "quote_anchor_match_count", "inter_quote_drift_abs_qty", "correction_cost", "correction_price_change_count")


def _start() -> Column:
    return F.col("minute_bucket") * 60_000


def quote_parts(quotes: DataFrame) -> DataFrame:
    """Quotes by session and minute."""
    return quotes.groupBy(*KEY, minute_bucket(F.col("ts_ms")).alias("minute_bucket")).agg(F.count("*").alias("checked_quotes")).select(*QUOTE_PARTS.fieldNames())


def mismatch_parts(rich: DataFrame) -> DataFrame:
    """Mismatches (with phase and minute) by session, phase, minute, side and level."""
    return validate.mismatches(rich, *[c for c in MISMATCH_PARTS.fieldNames() if c not in _COUNTS]).select(*MISMATCH_PARTS.fieldNames())


def missing_parts(log: DataFrame) -> DataFrame:
    """Missing orders by session, phase, minute and reason."""
    names = MISSING_PARTS.fieldNames()
    return diagnostics.enriched_missing(log).groupBy(*names[:-1]).agg(F.count("*").alias("missing_order_count")).select(*names)


def visible_parts(points: DataFrame) -> DataFrame:
    """Checkpoints by session and minute; a quote is in one minute, so its count adds up too."""
    return points.groupBy(*KEY, minute_bucket(F.col("ts_ms")).alias("minute_bucket")).agg(
        F.count_distinct("quote_seq").alias("checked_quotes"),
        F.count("*").alias("checkpoint_rows"),
        F.count_if("quote_anchor_match").alias("quote_anchor_match_count"),
        F.sum("inter_quote_drift_abs_qty").alias("inter_quote_drift_abs_qty"),
        F.sum("correction_cost").alias("correction_cost"),
        F.count_if("correction_price_changed").alias("correction_price_change_count"),
    ).select(*VISIBLE_PARTS.fieldNames())


def _added(parts: DataFrame, by: list[str], *counts: str) -> DataFrame:
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])


def _all(parts: DataFrame, **sums: Column) -> DataFrame:
    """One row, zeros if there is no part."""
    return parts.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(n) for n, v in sums.items()])


def mismatch_groups(parts: DataFrame) -> DataFrame:
    """diagnostics.mismatch_groups, from parts."""
    names = MISMATCH_GROUPS.fieldNames()
    return _added(parts, [c for c in names if c not in _COUNTS], *_COUNTS).select(*names)


def missing_groups(parts: DataFrame) -> DataFrame:
    """diagnostics.missing_groups, from parts."""
    return _added(parts, ["reason", "session", "symbol"], "missing_order_count").select(*MISSING_GROUPS.fieldNames())


def top_buckets(parts: DataFrame, top: int = diagnostics.TOP) -> DataFrame:
    """diagnostics.top_buckets, from parts."""
    names = TOP_BUCKETS.fieldNames()
    out = _added(parts, [c for c in names if c not in _COUNTS], *_COUNTS).select(*names)
    return out.orderBy(F.desc("mismatch_count"), "symbol", "trade_date", "session", "minute_bucket").limit(top)


def window_shares(parts: DataFrame) -> DataFrame:
    """diagnostics.window_shares, from parts."""
    sums = {"total": F.col("mismatch_count")}
    for k, bounds in enumerate(DIAGNOSTIC_WINDOWS.values()):
        sums |= {f"{c}{k}": F.when(validate.within(_start(), bounds), F.col(c)) for c in _COUNTS}
    share = lambda k: F.when(F.col("total") > 0, F.col(f"mismatch_count{k}") / F.col("total")).otherwise(F.lit(0.0)).alias("share_of_mismatch")
    rows = [F.struct(F.lit(name).alias("window"), *[F.col(f"{c}{k}").alias(c) for c in _COUNTS], share(k)) for k, name in enumerate(DIAGNOSTIC_WINDOWS)]
    return _all(parts, **sums).select(F.inline(F.array(*rows)))


def totals(parts: DataFrame, missing: DataFrame) -> DataFrame:
    """diagnostics.totals, from parts."""
    return _all(parts, **{c: F.col(c) for c in _COUNTS}).crossJoin(_all(missing, missing_order_count=F.col("missing_order_count")))


def validation_summary(quotes: DataFrame, parts: DataFrame, missing: DataFrame) -> DataFrame:
    """validate.validation_summary, from the parts of quotes, mismatches and missing orders."""
    rows = _added(quotes, KEY, "checked_quotes").join(_added(parts, KEY, *_COUNTS), KEY, "left")
    return rows.join(_added(missing, KEY, "missing_order_count"), KEY, "left").na.fill(0)


def match_rates_by_window(quotes: DataFrame, parts: DataFrame, windows: dict[str, tuple[int, int]] = CLOCK_WINDOWS) -> DataFrame:
    """validate.match_rates_by_window, from parts; the windows begin and end at whole minutes."""
    if any(ms % 60_000 for bounds in windows.values() for ms in bounds):
        raise ValueError("windows of parts begin and end at whole minutes")
    inside = lambda df, *counts: _added(df.withColumn("window", validate.window_of(_start(), windows)).filter("window IS NOT NULL"), ["window"], *counts)
    return validate.rates(inside(quotes, "checked_quotes").join(inside(parts, *_COUNTS), "window", "left").na.fill(0))


def visible_summary(parts: DataFrame) -> DataFrame:
    """validate.visible_summary, from parts."""
    kept, rows = F.col("quote_anchor_match_count"), F.col("checkpoint_rows")
    rate = lambda inside: F.coalesce(F.sum(F.when(inside, kept)) / F.nullif(F.sum(F.when(inside, rows)), F.lit(0)), F.lit(0.0))
    sums = {c: F.sum(c) for c in _VISIBLE} | {"quote_anchor_match_rate": rate(F.lit(True)), "correction_abs_qty": F.sum("correction_cost")}
    sums |= {f"{name}_match_rate": rate(validate.within(_start(), w)) for name, w in CONTINUOUS_WINDOWS.items()}
    names = [*_VISIBLE[:3], "quote_anchor_match_rate", *_VISIBLE[3:5], "correction_abs_qty", _VISIBLE[5], *[f"{n}_match_rate" for n in CONTINUOUS_WINDOWS]]
    return parts.groupBy(*KEY).agg(*[sums[n].alias(n) for n in names])
