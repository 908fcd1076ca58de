"""The book at any time, from stored states: what rests at the start of a block of time, and the changes within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapebook.operators.book import ranked
from tapebook.operators.seek import of_sessions
from tapebook.schemas import BOOK_STATES, KEY

#: Length of a block: a session has some ten, each a file. A level that rests costs a row in every block.
BLOCK_MS = 1_800_000


def net_changes(changes: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Changes of a level's quantity summed at each time, with their block. What cancels out is left out."""
    net = changes.groupBy(*KEY, "side", "price_int", "ts_ms").agg(F.sum("delta").alias("qty")).filter("qty <> 0")
    return net.withColumn("block", F.expr(f"ts_ms div {block_ms}")).select(*BOOK_STATES.fieldNames())


def spans(net: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Each session's first and last block with a change."""
    ends = net.groupBy(*KEY).agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"))
    return ends.select(*KEY, F.lit(block_ms).cast("bigint").alias("block_ms"), "first_block", "last_block")


def states(net: DataFrame, spans: DataFrame) -> DataFrame:
    """net, and for every block up to the session's last one what each level holds at its start (null ts_ms): the sum of one
    block's rows with no time, or a time up to t, is the book at t. net is read twice, so it should be written.

    Blocks of a level are summed up before the window, which has a row a block and level."""
    per = net.groupBy(*KEY, "side", "price_int", "block").agg(F.sum("qty").alias("qty")).join(spans.select(*KEY, "last_block"), KEY)
    level = Window.partitionBy(*KEY, "side", "price_int").orderBy("block")
    held = per.withColumns({"until": F.coalesce(F.lead("block").over(level), "last_block"), "qty": F.sum("qty").over(level)})
    held = held.filter("qty <> 0 AND until > block").withColumns({"ts_ms": F.lit(None).cast("bigint"), "block": F.explode(F.expr("sequence(block + 1, until)"))})
    return net.unionByName(held.select(*BOOK_STATES.fieldNames()))


def books_at(requests: DataFrame, states: DataFrame, spans: DataFrame) -> DataFrame:
    """The book after all events up to each request's time: requests (request_id, session, ts_ms, depth) to request_id, session, asked_ts,
    side, level, price_int, qty, at most depth levels a side.

    A request reads one block of its session; blocks that none asks for are not opened. Unknown sessions, times before the
    first change (null ones too), empty books and depths under 1 have no rows. Equal requests have rows of their own if their ids differ."""
    known = requests.withColumnRenamed("ts_ms", "asked_ts").join(of_sessions(spans, requests), KEY)
    asked = known.withColumn("block", F.least(F.expr("asked_ts div block_ms"), "last_block")).filter("asked_ts IS NOT NULL AND block >= first_block")
    asked = asked.select("request_id", *KEY, "asked_ts", "depth", "block")
    mine = of_sessions(states, asked, [*KEY, "block"])
    seen = asked.join(mine, [*KEY, "block"]).filter("ts_ms IS NULL OR ts_ms <= asked_ts")
    by = ["request_id", *KEY, "asked_ts", "depth"]
    left = seen.groupBy(*by, "side", "price_int").agg(F.sum("qty").alias("qty")).filter("qty > 0")
    return ranked(left, *by, depth=F.col("depth")).select("request_id", *KEY, "asked_ts", "side", "level", "price_int", "qty")
