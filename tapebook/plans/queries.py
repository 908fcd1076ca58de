"""Queries over the given tables: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapebook.operators import book, diagnostics, quarantine, rollups, seek, states, validate
from tapebook.operators.normalize import normalize_orders as normalize_orders_
from tapebook.operators.normalize import normalize_quotes as normalize_quotes_
from tapebook.operators.normalize import normalize_trades as normalize_trades_
from tapebook.operators.normalize import quote_levels
from tapebook.operators.tape import event_tape as event_tape_
from tapebook.operators.tape import session_event_counts
from tapebook.plans import jobs
from tapebook.plans.tapes import Tape, raw_a, requests_a, spoilt_a, tape_a, tape_b_events
from tapebook.schemas import FILES, KEY
from tapebook.sources.scratch import scratch, written
from tapebook.sources.session_csv import inspect, missing_files, mixed_sessions, raw_rows, read_csv
from tapebook.sources.session_tables import new_run, read_sessions, session_of_path, superseded, write_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class _Replayed:
    """Tape A with everything derived from it. Quotes and the report are written when first asked for and read again, as the tape
    is by its numbering, which goes over orders and trades twice, so that they are written too; the rest are plans over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tape: Tape = tape_a(spark, sf_dir)

    @cached_property
    def quotes(self) -> DataFrame:
        return written(self.tape.quotes)

    @cached_property
    def events(self) -> DataFrame:
        return event_tape_(self.quotes, written(self.tape.orders), written(self.tape.trades))

    @cached_property
    def _replay(self) -> tuple[DataFrame, DataFrame]:
        return book.replay(self.events)

    @property
    def deltas(self) -> DataFrame:
        return self._replay[0]

    @property
    def log(self) -> DataFrame:
        return self._replay[1]

    @property
    def levels(self) -> DataFrame:
        return validate.compared(self.quotes, self.events, book.top_at_quotes(self.deltas, self.quotes))

    @cached_property
    def report(self) -> DataFrame:
        """The levels that differ: a part of all, written where a query goes over them more than once."""
        return written(validate.validation_report(self.levels))

    @property
    def rich(self) -> DataFrame:
        return diagnostics.enriched(self.report, self.quotes)

    @property
    def points(self) -> DataFrame:
        return validate.checkpoints(self.levels)


@_query
def normalize_quotes(spark, d):
    return tape_a(spark, d).quotes


@_query
def normalize_orders(spark, d):
    return tape_a(spark, d).orders


@_query
def normalize_trades(spark, d):
    return tape_a(spark, d).trades


@_query
def rejected_rows(spark, d):
    """The bad cells of tape A with spoilt ones."""
    return reduce(DataFrame.unionAll, [quarantine.split(raw, kind)[1] for kind, raw in spoilt_a(spark, d).items()])


@_query
def quarantine_counts(spark, d):
    """Raw, typed and rejected rows of each kind and symbol; what is typed went through strict typing."""
    typed = {"quotes": normalize_quotes_, "orders": normalize_orders_, "trades": normalize_trades_}
    parts = []
    for kind, raw in spoilt_a(spark, d).items():
        accepted, rejected = quarantine.split(raw, kind)
        n = lambda df, c: df.groupBy("symbol").agg(F.count("*").alias(c))
        rows = n(raw.select(F.col("万得代码").alias("symbol")), "all_rows").join(n(typed[kind](accepted).select("symbol", "ts_ms", "trade_date"), "accepted_rows"), "symbol", "left")
        parts.append(rows.join(quarantine.rejected_by(rejected, "symbol"), "symbol", "left").na.fill(0).select(F.lit(kind).alias("kind"), "symbol", "all_rows", "accepted_rows", "rejected_rows"))
    return reduce(DataFrame.unionAll, parts)


@_query
def event_tape(spark, d):
    return tape_a(spark, d).events


@_query
def session_event_counts_(spark, d):
    return session_event_counts(tape_a(spark, d).orders)


QUERIES["session_event_counts"] = QUERIES.pop("session_event_counts_")
QUERIES["quote_levels"] = lambda spark, d: quote_levels(tape_a(spark, d).quotes, *KEY, "seq")


@_query
def order_legs(spark, d):
    return book.legs(tape_a(spark, d).events).select(*KEY, "event_id", "order_id", "leg_no", "kind", "side", "required", "ref_side", "reason")


@_query
def order_lifecycle(spark, d):
    life = book.lifecycle(book.legs(tape_a(spark, d).events))
    return life.select(*KEY, "order_id", "event_id", "leg_no", "kind", "gen", "book_side", "book_price", "rem_before", "removed", "rem_after", "prev_rem", "prev_side", "prev_price")


@_query
def book_deltas(spark, d):
    return _Replayed(spark, d).deltas


@_query
def book_levels_at(spark, d):
    return book.levels_at(_Replayed(spark, d).deltas, 40_000_000)


@_query
def books_at(spark, d):
    """The books at every seek request's time, from stored states."""
    at, net = scratch(spark), written(states.net_changes(_Replayed(spark, d).deltas))
    write_sessions(states.spans(net), at, "book_spans")
    write_sessions(states.states(net, read_sessions(spark, at, "book_spans")), at, "book_states")
    return jobs.books(spark, at, requests_a(spark, d))


@_query
def book_top10_at_quotes(spark, d):
    r = _Replayed(spark, d)
    return book.top_at_quotes(r.deltas, r.quotes)


@_query
def missing_order_report(spark, d):
    return _Replayed(spark, d).log


def _reasons(log: DataFrame) -> DataFrame:
    return log.groupBy("reason").agg(F.count("*").alias("missing_order_count"))


@_query
def missing_reason_counts(spark, d):
    return _reasons(_Replayed(spark, d).log)


@_query
def validation_report(spark, d):
    return validate.validation_report(_Replayed(spark, d).levels)


@_query
def validation_summary(spark, d):
    r = _Replayed(spark, d)
    return validate.validation_summary(r.quotes, validate.validation_report(r.levels), r.log)


@_query
def raw_match_rates(spark, d):
    r = _Replayed(spark, d)
    return validate.match_rates(r.quotes, validate.validation_report(r.levels))


@_query
def raw_match_by_window(spark, d):
    r = _Replayed(spark, d)
    return validate.match_rates_by_window(r.quotes, validate.validation_report(r.levels))


@_query
def mismatch_by_side(spark, d):
    return validate.mismatch_by_side(validate.validation_report(_Replayed(spark, d).levels))


@_query
def visible_checkpoints(spark, d):
    return _Replayed(spark, d).points


@_query
def visible_summary(spark, d):
    return validate.visible_summary(_Replayed(spark, d).points)


def _sought(spark, d, ties: str, shown=None) -> DataFrame:
    """Every request of tape A answered. The index of checkpoints is that of the tape's quotes: each has one."""
    r = _Replayed(spark, d)
    return seek.seek(written(requests_a(spark, d)), r.points, ties, seek.times_of(r.events.filter("event_type = 'quote'")), shown)


def _batch(spark, d, ties: str) -> DataFrame:
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    said = lambda levels: F.array_join(F.transform(levels, lambda x: F.concat_ws(":", *[text(x[k]) for k in ("level", "price_int", "qty", "raw_price_int", "raw_qty", "correction_cost")])), ",")
    return _sought(spark, d, ties, said).select("request_id", *KEY, "asked_ts", "depth", "status", "ts_ms", "checkpoint_id", "asks", "bids", "correction_cost", "inter_quote_drift_abs_qty")


@_query
def seek_batch_all(spark, d):
    return _batch(spark, d, "all")


@_query
def seek_batch_last(spark, d):
    return _batch(spark, d, "last")


@_query
def seek_depth(spark, d):
    df = _sought(spark, d, "last")
    return df.select("request_id", "depth", (F.size("asks") + F.size("bids")).cast("long").alias("n_levels"), F.size("asks").cast("long").alias("n_asks"), "correction_cost", "inter_quote_drift_abs_qty")


@_query
def seek_status(spark, d):
    return _sought(spark, d, "last").groupBy("status").agg(F.count("*").alias("n"))


@_query
def mismatch_groups(spark, d):
    r = _Replayed(spark, d)
    return diagnostics.mismatch_groups(diagnostics.enriched(validate.validation_report(r.levels), r.quotes))


@_query
def enriched_missing_orders(spark, d):
    rich = diagnostics.enriched_missing(_Replayed(spark, d).log)
    return rich.select(*KEY, "event_id", "reason", "ref_side", "order_id", "minute_bucket", "minute")


@_query
def missing_groups(spark, d):
    return diagnostics.missing_groups(diagnostics.enriched_missing(_Replayed(spark, d).log))


@_query
def window_shares(spark, d):
    return diagnostics.window_shares(_Replayed(spark, d).report)


@_query
def top_buckets(spark, d):
    return diagnostics.top_buckets(_Replayed(spark, d).rich)


@_query
def worst_quotes(spark, d):
    rich = _Replayed(spark, d).rich
    return diagnostics.worst_quotes(rich, diagnostics.top_buckets(rich))


def _flat(df: DataFrame, *names: str) -> DataFrame:
    """Snapshots as text, so that two engines' rows compare."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    side = lambda c, s: F.transform(F.col(c)[s], lambda x: F.concat_ws(":", F.lit(s), *[text(x[k]) for k in ("level", "price_int", "qty")]))
    return df.withColumns({c: F.array_join(F.concat(side(c, "ask"), side(c, "bid")), ",") for c in names})


@_query
def bucket_snapshots(spark, d):
    r = _Replayed(spark, d)
    return _flat(diagnostics.bucket_snapshots(r.rich, r.quotes, diagnostics.top_buckets(r.rich)), "quote_snapshot", "raw_book_snapshot")


@_query
def opening_alignment(spark, d):
    r = _Replayed(spark, d)
    return diagnostics.opening_alignment(r.report, r.quotes)


@_query
def opening_snapshots(spark, d):
    r = _Replayed(spark, d)
    return _flat(diagnostics.opening_snapshots(r.report, r.quotes), "opening_snapshot", "raw_book_snapshot")


@_query
def diagnostic_totals(spark, d):
    r = _Replayed(spark, d)
    return diagnostics.totals(r.report, r.log)


@_query
def order_ref_coverage(spark, d):
    tape = tape_a(spark, d)
    return diagnostics.order_ref_coverage(tape.trades, tape.orders)


@_query
def import_counts(spark, d):
    tape = tape_a(spark, d)
    parts = [t.groupBy(*KEY).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("artifact"), *KEY, "row_count") for n, t in (("quotes", tape.quotes), ("orders", tape.orders), ("trades", tape.trades))]
    return reduce(DataFrame.unionAll, parts)


@_query
def b_book_top10_at_quotes(spark, d):
    events = tape_b_events(spark, d)
    changes, _ = book.replay(events)
    return book.top_at_quotes(changes, events.filter("event_type = 'quote'"))


@_query
def b_missing_reason_counts(spark, d):
    return _reasons(book.replay(tape_b_events(spark, d))[1])


@_query
def b_order_lifecycle_totals(spark, d):
    life = book.lifecycle(book.legs(tape_b_events(spark, d)))
    return life.groupBy(*KEY, "kind").agg(F.count("*").alias("n"), F.sum("removed").alias("removed"), F.sum("rem_after").alias("rem_after"))


def _write_csv(rows: DataFrame, at: str, encoding: str = "UTF-8") -> None:
    """Raw rows (s: the folder's symbol, d: its day) as one file a folder, in the order of seq."""
    dealt = rows.repartition("s", "d").sortWithinPartitions("s", "d", "seq").drop("seq")
    dealt.write.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).partitionBy("s", "d").csv(at)


def _own(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"s": F.col("万得代码"), "d": F.trim("自然日")})


@_query
def csv_roundtrip(spark, d):
    """Raw orders written as GB18030 files, one a session, and read, numbered and typed again."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    at, (_, orders, _) = scratch(spark), raw_a(spark, d)
    _write_csv(_own(orders), at, "GB18030")
    return normalize_orders_(read_csv(spark, f"{at}/*/*/*.csv", "gb18030"))


@_query
def file_encodings(spark, d):
    """Encoding and NUL count of files: orders of one symbol in GB18030, the others' in UTF-8, a NUL in every seventh id."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    at, (_, orders, _) = scratch(spark), raw_a(spark, d)
    nul = F.when(F.trim("委托编号").cast("bigint") % 7 == 0, F.concat(F.lit("x\0"), F.col("委托编号"))).otherwise(F.col("委托编号"))
    rows, old = _own(orders).withColumn("委托编号", nul), F.col("s") == "600000.SH"
    _write_csv(rows.filter(old), f"{at}/old", "GB18030")
    _write_csv(rows.filter(~old), f"{at}/new")
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]+)/", 1)
    return inspect(spark, at).select(part("s").alias("symbol"), part("d").cast("bigint").alias("trade_date"), "encoding", "nul_count")


@_query
def missing_session_files(spark, d):
    """Folders that lack files: quotes of every session that has some, orders of those on even days, trades of two symbols."""
    at, kept = scratch(spark), {"quotes": F.lit(True), "orders": F.col("d").cast("bigint") % 2 == 0, "trades": F.col("s") != "300002.SZ"}
    for (kind, condition), rows in zip(kept.items(), raw_a(spark, d)):
        _write_csv(_own(rows).filter(condition), f"{at}/{kind}")
    names = F.create_map(*[x for k, v in FILES.items() for x in (F.lit(k), F.lit(v))])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(at).select("path")
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]+)/", 1)
    listed = files.select(F.concat_ws(" ", part("s"), part("d")).alias("dir"), names[F.regexp_extract("path", "/([a-z]+)/s=", 1)].alias("name"))
    return missing_files(listed).select("dir", F.array_join("missing", ",").alias("missing"))


@_query
def mixed_session_files(spark, d):
    """Folders whose files are of different sessions: on days that three divides two symbols' orders lie in each other's folder."""
    at, (quotes, orders, _) = scratch(spark), raw_a(spark, d)
    own, third = F.col("s"), F.col("d").cast("bigint") % 3 == 0
    moved = _own(orders).withColumn("s", F.when(third & (own == "600000.SH"), F.lit("000001.SZ")).when(third & (own == "000001.SZ"), F.lit("600000.SH")).otherwise(own))
    _write_csv(_own(quotes), f"{at}/quotes")
    _write_csv(moved, f"{at}/orders")
    folder = F.regexp_extract("path", "/s=([^/]+/d=[^/]+)/", 1)
    tables = [raw_rows(spark, f"{at}/{kind}/*/*/*.csv").withColumn("dir", folder) for kind in ("quotes", "orders")]
    said = F.array_join(F.transform("sessions", lambda s: F.concat_ws(" ", s["symbol"], s["date"])), ",")
    return mixed_sessions(*tables).select(F.regexp_replace("dir", "/d=", " ").alias("dir"), said.alias("sessions"))


def _imported(spark: SparkSession, d: str) -> str:
    """The folder of tape A's seven tables."""
    at, tape = scratch(spark), tape_a(spark, d)
    jobs.replay_sessions(spark, {"quotes": tape.quotes, "orders": tape.orders, "trades": tape.trades}, at)
    return at


@_query
def import_report(spark, d):
    """The import's report, with its lists as text and its structures flat."""
    rows = jobs.import_report(spark, _imported(spark, d))
    artifacts = F.array_join(F.transform("artifacts", lambda a: F.concat_ws(":", a["table"], a["row_count"].cast("string"))), ",")
    visible = ("checkpoint_rows", "quote_anchor_match_count", "quote_anchor_match_rate", "correction_cost", "correction_price_change_count")
    return rows.select(*KEY, artifacts.alias("artifacts"), F.array_join("warnings", ",").alias("warnings"), "validation.*", *[f"visible.{c}" for c in visible])


def _parts(spark: SparkSession, d: str, *tables: str) -> list[DataFrame]:
    """Stored parts of tape A; those of odd days are written again afterwards, so that they replace the first ones."""
    r, at = _Replayed(spark, d), scratch(spark)
    make = {
        "quote_parts": lambda: rollups.quote_parts(r.quotes),
        "mismatch_parts": lambda: rollups.mismatch_parts(r.rich),
        "missing_parts": lambda: rollups.missing_parts(r.log),
        "visible_parts": lambda: rollups.visible_parts(r.points),
    }
    for name in tables:
        rows = written(make[name]())
        write_sessions(rows, at, name)
        write_sessions(rows.filter("trade_date % 2 = 1"), at, name)
    return [read_sessions(spark, at, name) for name in tables]


@_query
def merged_mismatch_groups(spark, d):
    return rollups.mismatch_groups(*_parts(spark, d, "mismatch_parts"))


@_query
def merged_validation_summary(spark, d):
    return rollups.validation_summary(*_parts(spark, d, "quote_parts", "mismatch_parts", "missing_parts"))


@_query
def merged_match_by_window(spark, d):
    return rollups.match_rates_by_window(*_parts(spark, d, "quote_parts", "mismatch_parts"))


@_query
def merged_visible_summary(spark, d):
    return rollups.visible_summary(*_parts(spark, d, "visible_parts"))


@_query
def published_runs(spark, d):
    """Trades of all sessions, those of odd days written again with doubled quantities, and a third run that writes rows but ends
    before its marker: each session's rows and quantity as a reader finds them, and how many of its runs are replaced."""
    at, trades = scratch(spark), tape_a(spark, d).trades
    write_sessions(trades, at, "trades")
    write_sessions(trades.filter("trade_date % 2 = 1").withColumn("qty", F.col("qty") * 2), at, "trades")
    write_sessions(trades.withColumn("qty", F.lit(-1).cast("bigint")), at, "trades", new_run())
    rows = read_sessions(spark, at, "trades").groupBy(*KEY).agg(F.count("*").alias("row_count"), F.sum("qty").alias("qty"))
    old = superseded(spark, at, "trades").groupBy(*KEY).agg(F.count("*").alias("replaced_runs"))
    return rows.join(old, KEY, "left").select(*KEY, "row_count", "qty", F.coalesce("replaced_runs", F.lit(0)).cast("bigint").alias("replaced_runs"))


@_query
def diagnostics_output(spark, d):
    """What the diagnostics job writes: its four tables' counts, and its JSON's parts read again."""
    at = _imported(spark, d)
    jobs.diagnose(spark, at)
    to, none = f"{at}/diagnostics", F.lit(None)
    tables = {"residual_mismatch_groups": "mismatch_count", "residual_missing_groups": "missing_order_count", "residual_top_time_buckets": "mismatch_count", "opening_alignment_report": "raw_mismatch_count"}
    counted = [spark.read.parquet(f"{to}/{t}").agg(F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("m")).select(F.lit(t).alias("part"), none.cast("string").alias("name"), "n", "m") for t, c in tables.items()]
    fields = "symbol string, trade_date bigint, window string, minute string, mismatch_count bigint, missing_order_count bigint, worst_quote_seq bigint, opening_quote_seq bigint, raw_mismatch_count bigint"
    json = spark.read.schema("part string, json string").json(f"{to}/residual_diagnostics").select("part", F.from_json("json", fields).alias("j"))
    name = F.concat_ws(" ", "j.symbol", F.col("j.trade_date").cast("string"), "j.window", "j.minute")
    seen = F.coalesce("j.missing_order_count", "j.worst_quote_seq", "j.opening_quote_seq", F.lit(0))
    return reduce(DataFrame.unionAll, counted).unionByName(json.select("part", name.alias("name"), seen.alias("n"), F.coalesce("j.mismatch_count", "j.raw_mismatch_count").alias("m")))


@_query
def parquet_roundtrip(spark, d):
    """Trades written by session and read again."""
    at = scratch(spark)
    write_sessions(tape_a(spark, d).trades, at, "trades")
    return read_sessions(spark, at, "trades")


@_query
def path_sessions(spark, d):
    """Sessions by the folders of the written trades, and each folder's rows."""
    at = scratch(spark)
    write_sessions(tape_a(spark, d).trades, at, "trades")
    rows = spark.read.parquet(f"{at}/trades").select(session_of_path(F.col("_metadata.file_path")).alias("s"))
    return rows.groupBy("s.symbol", "s.trade_date").agg(F.count("*").alias("row_count"))
