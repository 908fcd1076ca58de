"""Raw rows that cannot be typed, told apart from those that can, with the cells that are to blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapebook.functions.cells import clean, int_problem, time_problem
from tapebook.operators.normalize import int_headers
from tapebook.schemas import COMMON_HEADERS
from tapebook.sources.scratch import written

_HEADER_OF = {v: k for k, v in COMMON_HEADERS.items()}


def problems(kind: str) -> Column:
    """The bad cells of a raw row of a kind (quotes, orders, trades): array of column (as in the typed table), cell, reason. It is empty
    if and only if strict typing does not fail on the row."""
    time = _HEADER_OF["time"]
    names = {time: "ts_ms"} | {header: name for header, name in int_headers(kind).items() if header != time}
    cells = F.array(*[F.struct(F.lit(name).alias("column"), F.col(header).alias("cell")) for header, name in names.items()])
    # one expression for all cells, not a copy for each
    reason = lambda c: F.when(c["column"] == "ts_ms", time_problem(c["cell"])).otherwise(int_problem(c["cell"]))
    told = F.transform(cells, lambda c: F.struct(c["column"].alias("column"), c["cell"].alias("cell"), reason(c).alias("reason")))
    return F.filter(told, lambda p: p["reason"].isNotNull())


def split(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of raw rows with seq. Accepted: the rows, as they were, that strict typing takes whole. Rejected: one row per
    bad cell: kind, symbol and trade_date as they stand, seq, nth (of the row's bad cells), column, cell, reason, and path and dir where
    raw has them. Every raw row is
    in exactly one of the two. The marked rows are written once and read twice: cells are looked at once, and no filter over forty
    cells' expressions reaches the optimizer, whose constraints double with each of them. No shuffle."""
    marked = written(raw.withColumn("_problems", problems(kind)))
    accepted = marked.filter(F.size("_problems") == 0).drop("_problems")
    where = [c for c in ("path", "dir") if c in raw.columns]
    names = [clean(F.col(_HEADER_OF[n])).alias(n) for n in ("symbol", "trade_date")]
    each = marked.select(F.lit(kind).alias("kind"), *where, *names, F.col("seq").cast("bigint").alias("seq"), F.posexplode("_problems").alias("nth", "p"))
    return accepted, each.withColumn("nth", F.col("nth") + 1).select("*", "p.*").drop("p")


def rejected_by(rejected: DataFrame, *by: str) -> DataFrame:
    """rejected_rows for each value of the columns: raw rows with a bad cell, however many it has."""
    return rejected.filter("nth = 1").groupBy(*by).agg(F.count("*").alias("rejected_rows"))
