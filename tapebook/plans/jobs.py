"""Whole jobs: import sessions, diagnose what is left, answer seeks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapebook.operators import book, diagnostics, quarantine, rollups, seek, states, validate
from tapebook.operators.normalize import normalize_orders, normalize_quotes, normalize_trades
from tapebook.operators.tape import event_tape, session_event_counts
from tapebook.schemas import KEY
from tapebook.sources.scratch import written
from tapebook.sources.session_csv import first_rows, inspect, listed, missing_files, mixed_sessions, numbered, read_kind
from tapebook.sources.session_tables import TABLES, current, new_run, publish, read_sessions, write_sessions


def check_source(spark: SparkSession, source: str, raw: dict[str, DataFrame]) -> None:
    """Fail, naming the folders, where files are missing or a folder's files are of different sessions."""
    for what, rows in (("files are missing", missing_files(listed(spark, source))), ("files are of different sessions", mixed_sessions(*raw.values()))):
        bad = rows.limit(20).collect()
        if bad:
            raise ValueError(f"{what}: {bad}")


def import_sessions(spark: SparkSession, source: str, out: str, rejected_limit: int | None = None) -> None:
    """Read, type, order, replay and compare every session below source; write its seven tables and its report below out, to be seen
    all at once when the last of them is there. An import that ends before leaves what was there before as it was.

    Without a limit the first cell that cannot be typed fails the import. With one, rows with such cells are left out and written
    to out/rejected_rows (quarantine.split), and the import fails, before it writes anything else, if a folder has more of them."""
    files = written(inspect(spark, source))
    raw = {k: read_kind(spark, source, k, files) for k in ("quotes", "orders", "trades")}
    check_source(spark, source, raw)
    first = first_rows(raw["quotes"])
    typed = {"quotes": normalize_quotes, "orders": normalize_orders, "trades": normalize_trades}
    rows = {name: numbered(raw[name]) for name in typed}
    if rejected_limit is not None:
        split = {name: quarantine.split(rows[name], name) for name in typed}
        rows = {name: accepted for name, (accepted, _) in split.items()}
        reduce(DataFrame.unionAll, [rejected for _, rejected in split.values()]).write.mode("overwrite").parquet(f"{out}/rejected_rows")
        over = quarantine.rejected_by(spark.read.parquet(f"{out}/rejected_rows"), "dir").filter(F.col("rejected_rows") > rejected_limit)
        if bad := over.orderBy(F.desc("rejected_rows"), "dir").limit(20).collect():
            raise ValueError(f"over {rejected_limit} rows cannot be typed: {bad}")
    run = new_run()
    replay_sessions(spark, {name: f(rows[name]) for name, f in typed.items()}, out, run)
    import_report(spark, out, first, files, run).write.json(f"{out}/import_report/run={run}")
    publish(read_sessions(spark, out, "events", run), out, run, [*TABLES, "import_report"])


def replay_sessions(spark: SparkSession, typed: dict[str, DataFrame], out: str, run: str | None = None) -> None:
    """Order, replay and compare typed quotes, orders and trades; write the seven tables, the checkpoints' index, the books' states and
    the parts of reports below out, as those of a run that the caller publishes, or published here if none is given.

    Each table is written once and what follows reads it again, so nothing is computed twice and a lost executor costs a task."""
    own = run or new_run()
    write = lambda df, name: write_sessions(df, out, name, own)
    read = lambda name: read_sessions(spark, out, name, own)
    for name, df in typed.items():
        write(df, name)
    quotes, orders, trades = map(read, ("quotes", "orders", "trades"))
    write(event_tape(quotes, orders, trades), "events")
    events = read("events")
    legs = book.legs(events)
    life = written(book.lifecycle(legs))
    write(book.missing_order_log(legs, life), "missing_order_report")
    levels = validate.compared(quotes, events, book.top_at_quotes(book.deltas(life), quotes))
    write(validate.checkpoints(levels), "visible_orderbook_checkpoints")
    points = read("visible_orderbook_checkpoints")
    write(seek.times_of(points), "checkpoint_times")
    write(validate.validation_report(_levels_of(points)), "validation_report")
    net = written(states.net_changes(book.deltas(life)))
    write(states.spans(net), "book_spans")
    write(states.states(net, read("book_spans")), "book_states")
    write(rollups.quote_parts(quotes), "quote_parts")
    write(rollups.mismatch_parts(diagnostics.enriched(read("validation_report"), quotes)), "mismatch_parts")
    write(rollups.missing_parts(read("missing_order_report")), "missing_parts")
    write(rollups.visible_parts(points), "visible_parts")
    if run is None:
        publish(events, out, own, [*TABLES])


def _levels_of(points: DataFrame) -> DataFrame:
    """Checkpoints as compared levels."""
    names = {"visible_price_int": "expected_price_int", "visible_qty": "expected_qty", "raw_price_int": "actual_price_int", "raw_qty": "actual_qty", "raw_price_match": "price_match", "raw_qty_match": "qty_match"}
    return points.withColumnsRenamed(names)


def import_report(spark: SparkSession, out: str, first: DataFrame | None = None, files: DataFrame | None = None, run: str | None = None) -> DataFrame:
    """One row per session that is published, or that a run has written: artifacts (table, row_count), warnings, the validation and the visible summary. With what the
    source's quote files name first, and what inspect() found of all files, also those files, and a warning for each with NULs."""
    read = lambda name: read_sessions(spark, out, name, run)
    tables = ("quotes", "orders", "trades", "events", "validation_report", "missing_order_report", "visible_orderbook_checkpoints")
    keys = read("quotes").select(*KEY).distinct()
    count = lambda t: read(t).groupBy(*KEY).agg(F.count("*").alias("row_count")).select(*KEY, F.lit(t).alias("table"), "row_count")
    counts = reduce(DataFrame.unionAll, map(count, tables))
    artifacts = counts.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("table", "row_count"))).alias("artifacts"))
    said = F.concat(F.col("session_event_count").cast("string"), F.lit(" order rows became session events"))
    unknown = session_event_counts(read("orders")).select(*KEY, F.when(F.col("session_event_count") > 0, F.array(said)).alias("unknown"))
    checks = rollups.validation_summary(read("quote_parts"), read("mismatch_parts"), read("missing_parts"))
    nested = lambda df, name: df.select(*KEY, F.struct(*[c for c in df.columns if c not in KEY]).alias(name))
    rows = keys.join(artifacts, KEY, "left").join(unknown, KEY, "left")
    rows = rows.join(nested(checks, "validation"), KEY, "left").join(nested(rollups.visible_summary(read("visible_parts")), "visible"), KEY, "left")
    none = F.array().cast("array<string>")
    if files is None:
        return rows.withColumn("warnings", F.coalesce("unknown", none)).drop("unknown")
    entry = F.struct(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "encoding", "nul_count")
    per = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    where = first.select("symbol", F.col("date").cast("bigint").alias("trade_date"), "dir")
    rows = rows.join(where.join(per, "dir").drop("dir"), KEY, "left")
    nul = F.transform(F.filter("files", lambda f: f["nul_count"] > 0), lambda f: F.concat(f["file"], F.lit(": "), f["nul_count"].cast("string"), F.lit(" NUL bytes removed")))
    return rows.withColumn("warnings", F.concat(F.coalesce(nul, none), F.coalesce("unknown", none))).drop("unknown")


def read_reports(spark: SparkSession, out: str) -> DataFrame:
    """The import's reports of the published sessions."""
    return current(spark.read.json(f"{out}/import_report"), out, "import_report")


def diagnose(spark: SparkSession, out: str) -> None:
    """Groups, worst buckets and openings over all sessions below out: four tables and one JSON. What only counts is merged from the
    sessions' parts; levels are read for the worst buckets' minutes and the openings."""
    read = lambda name: read_sessions(spark, out, name)
    report, quotes = read("validation_report"), read("quotes")
    parts, missed = read("mismatch_parts"), read("missing_parts")
    to = f"{out}/diagnostics"
    groups = rollups.mismatch_groups(parts).orderBy(F.desc("mismatch_count"), "symbol", "session", "minute_bucket", "side", "level")
    groups.write.mode("overwrite").parquet(f"{to}/residual_mismatch_groups")
    missing = rollups.missing_groups(missed).orderBy(F.desc("missing_order_count"), "reason", "session", "symbol")
    missing.write.mode("overwrite").parquet(f"{to}/residual_missing_groups")
    rollups.top_buckets(parts).write.mode("overwrite").parquet(f"{to}/residual_top_time_buckets")
    diagnostics.opening_alignment(report, quotes).write.mode("overwrite").parquet(f"{to}/opening_alignment_report")
    buckets = spark.read.parquet(f"{to}/residual_top_time_buckets")
    rich = diagnostics.enriched(seek.of_sessions(report, buckets), seek.of_sessions(quotes, buckets))
    told = {
        "totals": rollups.totals(parts, missed),
        "time_window": rollups.window_shares(parts),
        "top_bucket": diagnostics.bucket_snapshots(rich, quotes, buckets),
        "opening": diagnostics.opening_snapshots(report, quotes),
    }
    lines = [df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("json")) for part, df in told.items()]
    reduce(DataFrame.unionByName, lines).write.mode("overwrite").json(f"{to}/residual_diagnostics")


def answer(spark: SparkSession, out: str, requests: DataFrame, ties: str = "last") -> DataFrame:
    """Seek requests (request_id, symbol, trade_date, ts_ms, depth) against the checkpoints below out, found by their stored index."""
    return seek.seek(requests, read_sessions(spark, out, "visible_orderbook_checkpoints"), ties, read_sessions(spark, out, "checkpoint_times"))


def books(spark: SparkSession, out: str, requests: DataFrame) -> DataFrame:
    """The rebuilt books at requests (request_id, symbol, trade_date, ts_ms, depth), from the states below out."""
    return states.books_at(requests, read_sessions(spark, out, "book_states"), read_sessions(spark, out, "book_spans"))
