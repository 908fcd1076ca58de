"""Session tables as Parquet under <root>/<table>/symbol=S/date=D/run=R, and the markers that tell which run of a session is read.

Nothing is ever overwritten: a run adds its own folders, and its marker, one file written last, makes all its tables of all its
sessions the current ones at once. A run that ends before its marker is not seen."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapebook import schemas
from tapebook.schemas import KEY

TABLES: dict[str, T.StructType] = {
    "quotes": schemas.QUOTES,
    "orders": schemas.ORDERS,
    "trades": schemas.TRADES,
    "events": schemas.EVENTS,
    "validation_report": schemas.VALIDATION_REPORT,
    "missing_order_report": schemas.MISSING_ORDER_REPORT,
    "visible_orderbook_checkpoints": schemas.CHECKPOINTS,
    "checkpoint_times": schemas.CHECKPOINT_TIMES,
    "book_states": schemas.BOOK_STATES,
    "book_spans": schemas.BOOK_SPANS,
    "quote_parts": schemas.QUOTE_PARTS,
    "mismatch_parts": schemas.MISMATCH_PARTS,
    "missing_parts": schemas.MISSING_PARTS,
    "visible_parts": schemas.VISIBLE_PARTS,
}
#: Columns that are folders below the session's.
FOLDERS = {"book_states": ["block"]}
MARKERS = "published"
_MARKER = T.StructType().add("at", "string").add("run", "string").add("table", "string").add("symbol", "string").add("trade_date", "long")
#: Runs and replaced sessions that a filter names.
NAMED = 1000


def new_run() -> str:
    """An id of its own, which sorts behind those made before by the driver's clock."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_sessions(df: DataFrame, root: str, table: str, run: str | None = None) -> None:
    """Write df's sessions as those of a run, to be seen once publish() has named them. Without a run they are published at once
    and replace the sessions that df has; others stay. A session's rows are in one file (of each folder), by time, so that seeks prune."""
    names, own = TABLES[table].fieldNames(), run or new_run()
    folders = ["symbol", "date", *FOLDERS.get(table, [])]
    rows = df.select(*names).withColumn("date", F.col("trade_date")).drop("trade_date").repartition(*folders).withColumn("run", F.lit(own))
    order = folders + [c for c in ("ts_ms", "event_id", "quote_seq", "side", "level", "seq") if c in names]
    out = rows.sortWithinPartitions(*order).write.mode("append").option("compression", "zstd")
    out.partitionBy("symbol", "date", "run", *FOLDERS.get(table, [])).parquet(f"{root}/{table}")
    if run is None:
        publish(read_sessions(df.sparkSession, root, table, own), root, own, [table])


def publish(sessions: DataFrame, root: str, run: str, tables: list[str]) -> None:
    """Make a run's tables current for the sessions, all at once: one file, which a single rename puts in its place. A table in
    which the run has no row of such a session is empty for it. Of two runs that name a session, the one published last is current,
    whichever began first."""
    keys = sessions.select(*KEY).distinct().withColumns({"at": F.lit(new_run()), "run": F.lit(run)})
    rows = keys.withColumn("table", F.explode(F.array(*map(F.lit, tables))))
    rows.select(*_MARKER.fieldNames()).coalesce(1).write.mode("append").parquet(f"{root}/{MARKERS}")


def _runs(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Each session of the table with its current run and the replaced ones (old)."""
    marks = spark.read.schema(_MARKER).parquet(f"{root}/{MARKERS}").filter(F.col("table") == table)
    per = marks.groupBy(*KEY).agg(F.max_by("run", "at").alias("run"), F.collect_set("run").alias("old"))
    return per.withColumn("old", F.array_except("old", F.array("run")))


def _named(key: list, run) -> Column:
    return F.concat_ws("\0", *[F.col(k).cast("string") for k in key], run)


def superseded(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Runs of sessions (symbol, trade_date, run) that later ones have replaced: their folders are read by nothing new."""
    return _runs(spark, root, table).select(*KEY, F.explode("old").alias("run"))


def current(df: DataFrame, root: str, table: str) -> DataFrame:
    """df's rows (session, run) of each session's current run, without run.

    Up to NAMED runs and replaced sessions are named in a filter on the folders, so that no row is shuffled; more are joined."""
    runs = _runs(df.sparkSession, root, table)
    asked = runs.select("run", F.lit(False).alias("old")).distinct().unionAll(runs.select(F.explode("old").alias("run"), *KEY).select(_named(KEY, F.col("run")), F.lit(True)))
    few = asked.limit(NAMED + 1).collect()
    if len(few) > NAMED:
        return df.join(runs.select(*KEY, "run"), [*KEY, "run"], "left_semi").drop("run")
    rows = df.filter(F.col("run").isin([r["run"] for r in few if not r["old"]]))
    old = [r["run"] for r in few if r["old"]]
    return (rows.filter(~_named(KEY, F.col("run")).isin(old)) if old else rows).drop("run")


def read_sessions(spark: SparkSession, root: str, table: str, run: str | None = None) -> DataFrame:
    """All published sessions of a table, or what one run has written; filters on symbol and trade_date prune folders."""
    folders = FOLDERS.get(table, [])
    fields = [f for f in TABLES[table].fields if f.name not in (*KEY, *folders)]
    fields += [T.StructField("symbol", T.StringType()), T.StructField("date", T.LongType()), T.StructField("run", T.StringType())]
    fields += [f for f in TABLES[table].fields if f.name in folders]
    rows = spark.read.schema(T.StructType(fields)).parquet(f"{root}/{table}").withColumnRenamed("date", "trade_date")
    mine = current(rows, root, table) if run is None else rows.filter(F.col("run") == run)
    return mine.select(*TABLES[table].fieldNames())


def session_of_path(path) -> F.Column:
    """struct(symbol, trade_date) out of a path with symbol=…/date=…."""
    part = lambda k: F.regexp_extract(path, f"{k}=([^/]+)", 1)
    return F.struct(part("symbol").alias("symbol"), part("date").cast("bigint").alias("trade_date"))
