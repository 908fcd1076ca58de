"""The latest checkpoint at or before a time, for many requests at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapebook.schemas import DEPTH, KEY

#: Asked sessions that a filter names.
PRUNED = 1000
_LEVEL = ("level", "price_int", "qty", "source", "raw_price_int", "raw_qty", "raw_price_match", "raw_qty_match", "correction_cost", "inter_quote_drift_abs_qty")
_LEVELS = "array<struct<level:bigint,price_int:bigint,qty:bigint,source:string,raw_price_int:bigint,raw_qty:bigint,raw_price_match:boolean,raw_qty_match:boolean,correction_cost:bigint,inter_quote_drift_abs_qty:bigint>>"
_HEADER = ("checkpoint_id", "quote_seq", "event_id", "session")
_SUMS = ("correction_cost", "inter_quote_drift_abs_qty")


def times_of(points: DataFrame) -> DataFrame:
    """The index of checkpoints, apart from their levels: session, ts_ms, event_id of each."""
    return points.select(*KEY, "ts_ms", "event_id").distinct()


def as_of(requests: DataFrame, times: DataFrame) -> DataFrame:
    """requests (request_id, session, ts_ms, depth) with found_ts: the latest time of times (session, ts_ms, event_id) at or before it,
    and found_event: the greatest event_id there.

    Requests and times are one stream per session in which the last time seen is carried on: no range join."""
    latest = times.groupBy(*KEY, "ts_ms").agg(F.max("event_id").alias("event_id")).withColumn("found", F.struct("ts_ms", "event_id")).drop("event_id")
    both = requests.unionByName(latest, allowMissingColumns=True)
    order = Window.partitionBy(*KEY).orderBy("ts_ms", F.col("request_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("found", F.last("found", ignorenulls=True).over(order)).filter("request_id IS NOT NULL")
    return found.withColumns({"found_ts": F.col("found.ts_ms"), "found_event": F.col("found.event_id")}).drop("found")


def asked_of(requests: DataFrame, by: list[str] = KEY) -> Callable[[DataFrame], DataFrame]:
    """What keeps a table's rows whose session (or by) requests ask for; null keys are nobody's. Up to PRUNED of them are named in a filter,
    so that the folders of others are not even opened, and requests are not read again; more are joined. by: a symbol, then numbers."""
    keys = requests.select(*by).distinct()
    few = keys.limit(PRUNED + 1).collect()
    if len(few) > PRUNED:
        return lambda df: df.join(keys, by, "left_semi")
    known = [r for r in few if None not in tuple(r)]
    each = {k: sorted({r[k] for r in known}) for k in by}
    together = ["\0".join(map(str, r)) for r in known]

    def kept(df: DataFrame) -> DataFrame:
        for k, values in each.items():
            df = df.filter(F.col(k).isin(values))
        # The columns one by one name folders that no request asks for; together they do not.
        return df.filter(F.concat_ws("\0", *[F.col(k).cast("string") for k in by]).isin(together))

    return kept


def of_sessions(df: DataFrame, requests: DataFrame, by: list[str] = KEY) -> DataFrame:
    """df's rows whose session (or by) requests ask for."""
    return asked_of(requests, by)(df)


def _answers(asked: DataFrame, levels: DataFrame, ties: str, shown: Callable[[Column], Column]) -> DataFrame:
    """What is found at each session, found_ts and depth that asked has: h (the header), asks, bids and the sums over them.

    The levels of a time are listed once, whatever the depths asked of them, and each depth's lists are cut from these."""
    last = ties == "last"
    wanted = asked.filter("found_ts IS NOT NULL").groupBy(*KEY, "found_ts").agg(F.max("found_event").alias("found_event"), F.collect_set("depth").alias("depths"))
    rows = levels.filter("level IS NOT NULL").withColumnRenamed("ts_ms", "found_ts").join(wanted, [*KEY, "found_ts"])
    rows = rows.filter("event_id = found_event") if last else rows
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("visible_price_int", "visible_qty", "correction_cost", "inter_quote_drift_abs_qty")}
    values = {c: F.col(c) for c in _LEVEL} | {"price_int": zero["visible_price_int"], "qty": zero["visible_qty"], "correction_cost": zero["correction_cost"], "inter_quote_drift_abs_qty": zero["inter_quote_drift_abs_qty"]}
    values |= {c: F.coalesce(c, F.lit(False)) for c in ("raw_price_match", "raw_qty_match")}
    level = F.struct("level", "event_id", *[values[c].alias(c) for c in _LEVEL[1:]])
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, level))), lambda x: F.struct(*[x[c].alias(c) for c in _LEVEL]))
    first = lambda side: F.min_by(F.struct("level", "checkpoint_id", "quote_seq", "event_id", "session"), F.when(F.col("side") == side, F.struct("level", "event_id")))
    per = rows.groupBy(*KEY, "found_ts").agg(F.first("depths").alias("depths"), listed("ask").alias("asks"), listed("bid").alias("bids"), first("ask").alias("a"), first("bid").alias("b"))
    cut = lambda c: F.filter(c, lambda x: x["level"] <= F.col("depth")).alias(c)
    head = lambda c: F.when(F.col(f"{c}.level") <= F.col("depth"), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in _HEADER]))
    each = per.withColumn("depth", F.explode("depths")).select(*KEY, "found_ts", "depth", F.coalesce(head("a"), head("b")).alias("h"), cut("asks"), cut("bids"))
    total = lambda c: sum((F.aggregate(side, F.lit(0).cast("bigint"), lambda so_far, x: so_far + x[c]) for side in ("asks", "bids")), F.lit(0)).alias(c)
    return each.select(*KEY, "found_ts", "depth", "h", shown(F.col("asks")).alias("asks"), shown(F.col("bids")).alias("bids"), *[total(c) for c in _SUMS])


def seek(requests: DataFrame, points: DataFrame, ties: str = "all", times: DataFrame | None = None, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per request: its checkpoint's header (that of the first row by side and level, the smaller event_id first), asks and bids (level order,
    down to the request's depth), correction_cost and inter_quote_drift_abs_qty over the returned levels, and status: found, missing_session, before_first or empty.

    ties "all": the levels of all quotes at the latest time; "last": of the one with the greatest event_id. times: times_of(points),
    where it is stored. shown: what to make of asks and bids. Only the asked sessions are read, of both. Requests that find the same time
    to the same depth share an answer, which is made once and meets them at the end, so that no list is dealt out per request."""
    if ties not in ("all", "last"):
        raise ValueError(f"ties is all or last, not {ties}")
    shown = shown or (lambda levels: levels)
    mine = asked_of(requests)
    times = mine(times_of(points) if times is None else times)
    known = times.select(*KEY).distinct().withColumn("known", F.lit(True))
    asked = as_of(requests, times).withColumnRenamed("ts_ms", "asked_ts").join(known, KEY, "left")
    answers = _answers(asked, mine(points), ties, shown)
    found = asked.join(answers, [*KEY, "found_ts", "depth"], "left")
    status = F.when(F.col("known").isNull(), "missing_session").when(F.col("found_ts").isNull(), "before_first").when(F.col("h.event_id").isNull(), "empty").otherwise("found")
    none = shown(F.array().cast(_LEVELS))
    lists = [F.coalesce(c, none).alias(c) for c in ("asks", "bids")]
    return found.select("request_id", *KEY, "asked_ts", "depth", status.alias("status"), *[F.col(f"h.{c}").alias(c) for c in _HEADER], F.col("found_ts").alias("ts_ms"), *lists, *[F.coalesce(c, F.lit(0)).alias(c) for c in _SUMS])


def load_checkpoint(points: DataFrame, symbol: str, trade_date: int, ts_ms: int, depth: int = DEPTH, ties: str = "last"):
    """One request's Row. No session, no checkpoint so early, or no level: LookupError."""
    spark = points.sparkSession
    one = spark.createDataFrame([(0, symbol, trade_date, ts_ms, depth)], "request_id long, symbol string, trade_date long, ts_ms long, depth long")
    own = points.filter((F.col("symbol") == symbol) & (F.col("trade_date") == trade_date))
    row = seek(one, own, ties).first()
    if row["status"] != "found":
        raise LookupError(f"{row['status']}: {symbol} {trade_date} at {ts_ms}")
    return row
