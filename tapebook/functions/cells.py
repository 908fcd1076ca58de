"""Functions of raw cells and clock times."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapebook.schemas import SESSION_STARTS


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean(cell: Column) -> Column:
    """Null as empty, NUL characters dropped, Unicode white space stripped; only the ends are looked at."""
    return F.btrim(F.replace(F.coalesce(cell, F.lit("")), F.lit("\0")), F.lit(WHITE_SPACE))


def to_int(cell: Column, strict: bool = True) -> Column:
    """A bigint; blank is null; bad text fails, or is null where not strict. A cell that is a number as it stands is not cleaned."""
    text = F.nullif(clean(cell), F.lit(""))
    return F.coalesce(cell.try_cast("bigint"), text.cast("bigint") if strict else text.try_cast("bigint"))


def parse_ts_ms(cell: Column) -> Column:
    """HHMMSSmmm, leading zeros optional, to ms of the day. Blank fails."""
    text = clean(cell)
    digits = F.lpad(F.when(text == "", F.raise_error(F.lit("blank time"))).otherwise(text), 9, "0")
    part = lambda at, n: F.substring(digits, at, n).cast("bigint")
    return part(1, 2) * 3_600_000 + part(3, 2) * 60_000 + part(5, 2) * 1000 + part(7, 3)


def int_problem(cell: Column) -> Column:
    """Why to_int() would fail: out of range, or not a whole number; null if it would not."""
    text = clean(cell)
    bad = (text != "") & text.try_cast("bigint").isNull()
    return F.when(bad, F.when(text.rlike("^[+-]?[0-9]+$"), "out of range").otherwise("not a whole number"))


def time_problem(cell: Column) -> Column:
    """Why parse_ts_ms() would fail, or to_int() of the same cell; null if neither would."""
    text = clean(cell)
    digits = F.lpad(text, 9, "0")
    parts = [F.substring(digits, at, n).try_cast("bigint").isNull() for at, n in ((1, 2), (3, 2), (5, 2), (7, 3))]
    return F.when(text == "", "blank time").otherwise(F.coalesce(int_problem(cell), F.when(reduce(or_, parts), "not a clock time")))


def once(value: Column, case) -> Column:
    """case(value), with the value computed once however often the case names it."""
    return F.get(F.transform(F.array(value), case), F.lit(0))


def session_label(ts_ms: Column) -> Column:
    """The trading phase by clock time."""

    def label(ts: Column) -> Column:
        found = F
        for name, end in SESSION_STARTS:
            found = found.when(ts < end, name)
        return found.otherwise("close")

    return once(ts_ms, label)


def aggressor(cell: Column) -> Column:
    """B or S, whatever the case; else unknown."""
    side = F.upper(clean(cell))
    return F.when(side.isin("B", "S"), side).otherwise("unknown")


def or_unknown(cell: Column) -> Column:
    """Blank as unknown; case kept."""
    return F.coalesce(F.nullif(clean(cell), F.lit("")), F.lit("unknown"))


def minute_bucket(ts_ms: Column) -> Column:
    return F.floor(ts_ms / 60_000).cast("bigint")


def minute_label(bucket: Column) -> Column:
    """HH:MM."""
    return F.format_string("%02d:%02d", F.floor(bucket / 60).cast("bigint"), bucket % 60)


def within(ts_ms: Column, window: tuple[int, int]) -> Column:
    """Half-open."""
    return (ts_ms >= window[0]) & (ts_ms < window[1])
