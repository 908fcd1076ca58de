"""Order-book replay as windows.

The state of an order depends on that order's own events only, so a session needs no fold: an order's events are split
into generations by its adds, running sums clamp what each event removes, and the book at a time is a sum of deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapebook.schemas import DEPTH, KEY, MISSING_ORDER_REPORT

#: Quotes of a block: for each block the levels that cannot be among the best are left out before the rest is expanded.
BLOCK = 64
#: Quotes are counted by ranges of this length.
RANGE_MS = 60_000
_LEG_NAMES = ("order_id", "leg_no", "kind", "side", "required", "ref_side", "reason")
_LEG = "struct<order_id:string,leg_no:int,kind:string,side:string,required:boolean,ref_side:string,reason:string>"
_CONTEXT = ("event_id", "event_type", "ts_ms", "session", "source_seq", "price_int", "qty")


def _leg(order_id, leg_no, kind, side, required, ref_side, reason):
    values = [order_id, F.lit(leg_no), F.lit(kind), side, F.lit(required), F.lit(ref_side), F.lit(reason)]
    return F.struct(*[v.alias(n) for v, n in zip(values, _LEG_NAMES)]).cast(_LEG)


def legs(events: DataFrame) -> DataFrame:
    """One row per effect that an order or trade event may have on one order: kind add, remove, or bad (invalid input).

    One narrow explode; session and quote events have none."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own, side = text("exchange_order_id"), F.upper(text("side"))
    ask, bid = text("ask_order_id"), text("bid_order_id")
    none = F.lit(None).cast("string")
    some_qty = F.coalesce(F.col("qty") > 0, F.lit(False))
    good_add = (own != "") & side.isin("B", "S") & F.col("price_int").isNotNull() & some_qty
    add = F.when(good_add, F.array(_leg(own, 0, "add", side, True, None, None))).otherwise(F.array(_leg(own, 0, "bad", none, True, None, "invalid_order_add")))
    cancel = F.when((own != "") & some_qty, F.array(_leg(own, 0, "remove", none, True, None, "missing_cancel_order"))).otherwise(F.array(_leg(own, 0, "bad", none, True, None, "invalid_order_cancel")))
    aggressor = F.upper(text("aggressor_side"))
    part = lambda order, k, required, ref: _leg(order, k, "remove", none, required, ref, "missing_trade_order")
    named = lambda array: F.filter(array, lambda x: x["order_id"] != "")
    trade = (
        F.when(~some_qty, F.array(_leg(none, 0, "bad", none, True, None, "invalid_trade_qty")))
        .when(aggressor == "B", F.array(part(ask, 0, True, "ask"), part(bid, 1, False, "bid")))
        .when(aggressor == "S", F.array(part(bid, 0, True, "bid"), part(ask, 1, False, "ask")))
        .otherwise(named(F.array(part(ask, 0, True, "ask"), part(bid, 1, True, "bid"))))
    )
    kind = F.col("event_type")
    each = F.when(kind == "order_add", add).when(kind == "order_cancel", cancel).when(kind == "trade", trade)
    return events.filter(kind.isin("order_add", "order_cancel", "trade")).select(*KEY, *_CONTEXT, F.explode(each).alias("leg")).select(*KEY, *_CONTEXT, "leg.*")


def lifecycle(legs: DataFrame) -> DataFrame:
    """Legs of named orders with gen (adds of the order so far), book_side and book_price (where the order rests),
    rem_before, removed, rem_after, and what an add replaces: prev_rem at prev_side and prev_price.

    One shuffle and one sort, by session and order id. An order's last add carries what was taken from the order before it, so that
    generations need no windows of their own. Blank ids can rest nowhere and are left out; log() has their failures."""
    life = Window.partitionBy(*KEY, "order_id").orderBy("event_id", "leg_no")
    so_far, before = (life.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    is_add = F.col("kind") == "add"
    return (
        legs.filter((F.col("kind") != "bad") & (F.col("order_id") != ""))
        .withColumns({"gen": F.sum(is_add.cast("bigint")).over(so_far), "taken": F.coalesce(F.sum(F.when(~is_add, F.col("qty"))).over(before), F.lit(0))})
        .withColumn("own", F.last(F.when(is_add, F.struct("side", "price_int", "qty", "taken")), ignorenulls=True).over(so_far))
        .withColumns({"book_side": F.col("own.side"), "book_price": F.col("own.price_int")})
        .withColumn("rem_before", F.when(is_add | (F.col("gen") == 0), F.lit(0)).otherwise(F.greatest(F.col("own.qty") - (F.col("taken") - F.col("own.taken")), F.lit(0))).cast("bigint"))
        .withColumn("removed", F.when(is_add, F.lit(0)).otherwise(F.least("qty", "rem_before")).cast("bigint"))
        .withColumn("rem_after", F.when(is_add, F.col("qty")).otherwise(F.col("rem_before") - F.col("removed")))
        .withColumns({n: F.when(is_add, F.lag(c).over(life)) for n, c in (("prev_rem", "rem_after"), ("prev_side", "book_side"), ("prev_price", "book_price"))})
        .drop("own", "taken")
    )


def deltas(life: DataFrame) -> DataFrame:
    """Signed changes of level quantities: session, side (B or S), price_int, ts_ms, event_id, delta."""
    change = lambda side, price, qty: F.struct(F.col(side).alias("side"), F.col(price).alias("price_int"), qty.alias("delta"))
    own = F.when(F.col("kind") == "add", F.col("qty")).otherwise(-F.col("removed"))
    both = F.array(change("book_side", "book_price", own), change("prev_side", "prev_price", -F.coalesce("prev_rem", F.lit(0))))
    return life.select(*KEY, "ts_ms", "event_id", F.inline(F.filter(both, lambda x: x["delta"] != 0)))


def missing_order_log(legs: DataFrame, life: DataFrame) -> DataFrame:
    """One row per failing leg, with its event and reason."""
    bad = legs.filter((F.col("kind") == "bad") | (F.col("kind") == "remove") & (F.col("order_id") == "") & F.col("required"))
    bad = bad.withColumns({"requested_qty": F.lit(None).cast("bigint"), "remaining_qty": F.lit(None).cast("bigint")})
    gone = (F.col("rem_before") == 0) & F.col("required")
    short = (F.col("rem_before") > 0) & (F.col("qty") > F.col("rem_before"))
    failed = life.filter((F.col("kind") == "remove") & (gone | short)).withColumns(
        {"requested_qty": F.when(short, F.col("qty")), "remaining_qty": F.when(short, F.col("removed")), "reason": F.when(short, "qty_shortfall").otherwise(F.col("reason"))}
    )
    names = MISSING_ORDER_REPORT.fieldNames()
    return bad.select(*names).unionAll(failed.select(*names))


def ranked(levels: DataFrame, *by: str, depth) -> DataFrame:
    """side as ask or bid and level from the best price, at most depth (a number or a column) levels."""
    best = Window.partitionBy(*by, "side").orderBy(F.when(F.col("side") == "B", -F.col("price_int")).otherwise(F.col("price_int")))
    top = levels.withColumn("level", F.row_number().over(best).cast("bigint")).filter(F.col("level") <= depth)
    return top.withColumn("side", F.when(F.col("side") == "B", "bid").otherwise("ask"))


def levels_at(changes: DataFrame, ts_ms: int, depth: int = DEPTH) -> DataFrame:
    """The book of every session after all events up to a clock time."""
    left = changes.filter(F.col("ts_ms") <= ts_ms).groupBy(*KEY, "side", "price_int").agg(F.sum("delta").alias("qty")).filter("qty > 0")
    return ranked(left, *KEY, depth=depth).select(*KEY, "side", "level", "price_int", "qty")


def _indexed(rows: DataFrame, times: DataFrame, range_ms: int) -> DataFrame:
    """rows (session, ts_ms; is_quote: a quote time) with at, the number of quote times before their own, and n, that of the session's
    quote times; rows behind the last range with quotes are left out. times: the distinct quote times.

    A range of range_ms is counted by itself. What the ranges before it hold is added up once a session, over ranges and
    not over rows, and joined to them."""
    span = F.expr(f"ts_ms div {range_ms}")
    counts = times.groupBy(*KEY, span.alias("span")).agg(F.count("*").alias("here"))
    spans = counts.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("span", "here"))).alias("spans"), F.sum("here").alias("n"))
    # one pass over a session's ranges in order: the ranges from first to span - 1 are empty, so before holds for them
    none = F.expr("struct(0L AS next, 0L AS done, cast(array() AS array<struct<first: bigint, span: bigint, before: bigint, until: bigint>>) AS told)")

    def step(so_far, x):
        done = so_far["done"] + x["here"]
        here = F.struct(so_far["next"].alias("first"), x["span"].alias("span"), so_far["done"].alias("before"), done.alias("until"))
        return F.struct((x["span"] + 1).alias("next"), done.alias("done"), F.concat(so_far["told"], F.array(here)).alias("told"))

    told = spans.select(*KEY, "n", F.inline(F.aggregate("spans", none, step)["told"]))
    known = told.withColumn("at_span", F.explode(F.sequence("first", "span")))
    known = known.select(*KEY, "n", F.col("at_span").alias("span"), F.when(F.col("at_span") == F.col("span"), F.col("until")).otherwise(F.col("before")).alias("until"))
    left = Window.partitionBy(*KEY, "span").orderBy(F.desc("ts_ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("span", span).join(known, [*KEY, "span"])
    return placed.withColumn("at", F.col("until") - F.sum(F.col("is_quote").cast("int")).over(left)).drop("span", "until", "is_quote")


def top_at_quotes(changes: DataFrame, quotes: DataFrame, depth: int = DEPTH, block: int = BLOCK, range_ms: int = RANGE_MS) -> DataFrame:
    """The book at every distinct quote time: session, ts_ms, side, level, price_int, qty.

    Each change is put at the first quote time that sees it (the quote times behind it in its range of time, and those of the
    ranges before), changes of a level between two quotes are summed, and a level's quantity lasts from one to the next: no
    range join, and no window over a whole session. What lasts is cut at blocks of `block` quotes. In a block the depth-th best of the
    levels that last all of it is a bound: what is behind it is among the best of no quote there. Only what is left is expanded over
    the quotes; one dealing by block serves the bound, the expansion and the ranks."""
    distinct = quotes.select(*KEY, "ts_ms").distinct()
    slim = changes.groupBy(*KEY, "side", "price_int", "ts_ms").agg(F.sum("delta").alias("delta"))
    both = slim.withColumn("is_quote", F.lit(False)).unionByName(distinct.withColumn("is_quote", F.lit(True)), allowMissingColumns=True)
    times = _indexed(distinct.withColumn("is_quote", F.lit(True)), distinct, range_ms).withColumnRenamed("at", "qi")
    placed = _indexed(both, distinct, range_ms).filter("delta IS NOT NULL AND at < n")
    steps = placed.repartition(*KEY, "side", "price_int").groupBy(*KEY, "side", "price_int", "at").agg(F.sum("delta").alias("delta"), F.first("n").alias("n"))
    level = Window.partitionBy(*KEY, "side", "price_int").orderBy("at")
    lasting = steps.withColumns({"qty": F.sum("delta").over(level), "until": F.coalesce(F.lead("at").over(level), "n")}).filter("qty > 0")
    pieces = lasting.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (until - 1) div {block})")))
    first = F.col("block") * block
    pieces = pieces.select(
        *KEY, "block", "side", "price_int", "qty",
        F.when(F.col("side") == "B", -F.col("price_int")).otherwise(F.col("price_int")).alias("rank_by"),
        (F.greatest("at", first) - first).cast("int").alias("from_"),
        (F.least("until", first + block) - first).cast("int").alias("to_"),
    )
    moments = times.groupBy(*KEY, F.expr(f"qi div {block}").alias("block")).agg(F.array_sort(F.collect_list("ts_ms")).alias("moments"))
    here = pieces.join(moments, [*KEY, "block"]).withColumn("whole", F.col("to_") - F.col("from_") == F.size("moments"))
    side = Window.partitionBy(*KEY, "block", "side")
    best = F.row_number().over(side.orderBy(F.desc("whole"), "rank_by"))
    near = here.withColumn("nth", best).withColumn("bound", F.max(F.when(F.col("whole") & (F.col("nth") == depth), F.col("rank_by"))).over(side))
    near = near.filter("bound IS NULL OR rank_by <= bound")
    spread = near.select(*KEY, "block", "side", "price_int", "qty", F.explode(F.expr("slice(moments, from_ + 1, to_ - from_)")).alias("ts_ms"))
    return ranked(spread, *KEY, "block", "ts_ms", depth=depth).select(*KEY, "ts_ms", "side", "level", "price_int", "qty")


def replay(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deltas, missing-order log) of a tape."""
    each = legs(events)
    life = lifecycle(each)
    return deltas(life), missing_order_log(each, life)
