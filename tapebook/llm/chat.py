"""Operator 5: tool-call linking for chat records.

Messages are rows (conv_id, turn, role, text).  An assistant's text may be a JSON object with tool_calls (id, name,
arguments, after: ids whose results it needs); a tool's text is a JSON object with tool_call_id and content.  Calls and
results are hash-joined by (conversation, id), ordered so that every call comes after those it needs, their arguments are
validated against the tools' schemas, and each call is serialised with its result as canonical JSON.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import columns, cut, drop_table, grown, write_table

_CALL = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_KEY = ["conv", "call_id"]


# ---------------------------------------------------------------- schemas and JSON

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value: type, enum, minimum, maximum, maxLength, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {w}" for w, bad in (("too small", value < schema.get("minimum", value)), ("too large", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [e for k, v in enumerate(value) for e in errors(v, schema["items"], f"{at}[{k}]")]
    return out


_LONE = re.compile("[\ud800-\udfff]")


def _told(text: str) -> str:
    """Half a surrogate pair, which UTF-8 cannot hold, as its escape."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are (halves of surrogate pairs as escapes)."""
    return _told(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"no JSON number: {text}")
    return value


def parsed(arguments: str):
    """The value of a JSON text. ValueError if it is none: NaN, infinite numbers and too deep nesting included."""
    try:
        value = json.loads(arguments, parse_float=_number, parse_constant=_number)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


# ---------------------------------------------------------------- linking


def _calls(messages: DataFrame) -> DataFrame:
    """One row per call. after: the different ids that it names, sorted; nulls among them say nothing."""
    said = messages.filter("role = 'assistant'").select("conv", "conv_id", "turn", F.from_json("text", _CALL)["tool_calls"].alias("c"))
    rows = said.select("conv", "conv_id", "turn", F.posexplode("c").alias("pos", "c")).filter("c.id IS NOT NULL")
    named = F.array_sort(F.array_distinct(F.filter(F.coalesce("c.after", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return rows.select("conv", F.col("c.id").alias("call_id"), "conv_id", "turn", "pos", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), named.alias("after"))


def _until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """start, and step of it again and again, each written, until no value changes."""
    spark = start.sparkSession
    state = lambda df: tuple(df.agg(F.count(value), F.sum(F.xxhash64(*_KEY, value).cast("decimal(38,0)"))).first())
    path = write_table(start, "call-order")
    now = spark.read.schema(start.schema).parquet(path)
    before = state(now)
    while now.first() is not None:
        after = write_table(step(now), "call-order")
        drop_table(spark, path)
        path, now = after, spark.read.schema(start.schema).parquet(after)
        if (new := state(now)) == before:
            break
        before = new
    return now


def _ordered(calls: DataFrame) -> DataFrame:
    """(conv, call_id, slot, level, cyclic): in the order (slot, level, turn, pos) a call comes after all that it needs.

    slot is the last place (turn, pos) among the call and all that it needs, directly or not: the place that it waits for.
    Calls without a row are of conversations where nothing waits: their slot is their own place. level is the length of the
    longest chain of needs below a call and orders the calls of one slot; a call that never gets one is on, or behind, a
    cycle. A call with one need looks past it, in every round twice as far as before, so chains cost rounds by the logarithm
    of their length; calls with several needs cost one for each such call in a row."""
    nodes = calls.select(*_KEY, F.struct("turn", "pos").alias("at"), "after")
    needed = nodes.select("conv", F.col("call_id").alias("need"), F.col("at").alias("need_at"))
    edges = cut(nodes.select(*_KEY, "at", F.explode("after").alias("need")).join(needed, ["conv", "need"]), "call-edges")
    waiting = edges.filter(F.col("need_at") >= F.col("at")).select("conv").distinct()
    edges = cut(edges.join(waiting, "conv", "left_semi"), "call-waiting")
    own = edges.groupBy(*_KEY).agg(F.first("at").alias("at"), F.max("need_at").alias("last"), F.count("*").alias("needs"), F.min("need").alias("next"))
    start = own.select(*_KEY, F.greatest("at", "last").alias("slot"), F.when(F.col("needs") == 1, F.col("next")).alias("next"))
    several = cut(edges.join(own.filter("needs > 1").select(*_KEY), _KEY, "left_semi").select(*_KEY, "need"), "call-several")

    def later(now: DataFrame) -> DataFrame:
        theirs = now.select("conv", F.col("call_id").alias("need"), F.col("slot").alias("far"), F.col("next").alias("beyond"))
        most = several.join(theirs, ["conv", "need"]).groupBy(*_KEY).agg(F.max("far").alias("more"))
        past = now.withColumn("need", F.col("next")).join(theirs, ["conv", "need"], "left").join(most, _KEY, "left")
        return past.select(*_KEY, F.greatest("slot", "far", "more").alias("slot"), F.coalesce("beyond", "next").alias("next"))

    slots = _until_stable(start, later, "slot")
    mine = slots.select(*_KEY, "slot")
    inner = edges.select(*_KEY, "need")
    per = inner.groupBy(*_KEY).agg(F.count("*").alias("needs"), F.min("need").alias("next"))
    ends = inner.select("conv", F.col("need").alias("call_id")).distinct().join(per, _KEY, "left_anti")
    none = F.lit(None).cast("bigint")
    begin = per.select(*_KEY, none.alias("level"), F.when(F.col("needs") == 1, F.col("next")).alias("next"), F.lit(1).cast("bigint").alias("away"))
    begin = begin.unionByName(ends.select(*_KEY, F.lit(0).cast("bigint").alias("level"), F.lit(None).cast("string").alias("next"), none.alias("away")))
    crowd = cut(inner.join(per.filter("needs > 1").select(*_KEY), _KEY, "left_semi"), "call-crowd")

    def settled(now: DataFrame) -> DataFrame:
        theirs = now.select("conv", F.col("call_id").alias("need"), F.col("level").alias("base"), F.col("next").alias("beyond"), F.col("away").alias("step"))
        all_there = crowd.join(theirs, ["conv", "need"]).groupBy(*_KEY).agg(F.when(F.count_if(F.col("base").isNull()) == 0, F.max("base") + 1).alias("above"))
        past = now.withColumn("need", F.col("next")).join(theirs, ["conv", "need"], "left").join(all_there, _KEY, "left")
        level = F.coalesce("level", F.col("away") + F.col("base"), "above")
        on = F.col("level").isNull() & F.col("base").isNull() & F.col("beyond").isNotNull()
        return past.select(*_KEY, level.alias("level"), F.when(on, F.col("beyond")).otherwise(F.col("next")).alias("next"), F.when(on, F.col("away") + F.col("step")).otherwise(F.col("away")).alias("away"))

    levels = _until_stable(begin, settled, "level")
    return mine.join(levels.select(*_KEY, "level", F.col("level").isNull().alias("cyclic")), _KEY, "full")


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per result without one: conv_id, call_id, turn, pos, slot, level, name, status, duplicates,
    errors, record. Calls in the order (slot, level, turn, pos) come after those that they need.

    status: linked, unanswered, early (the result stands before the call), cyclic (on or behind a cycle of needs; level is
    null), or orphan (a result without a call). Of calls or results with one id in a conversation the first counts and
    duplicates says how many more there are. errors: what the arguments' schema finds (unknown tools and text that is no JSON
    included: NaN, infinite numbers and nesting that the parser refuses are none). record: the call and its result as
    canonical JSON; arguments that are no JSON stand in it as text. Null ids, roles and texts are no calls, nulls among after
    are no needs, null conv_ids are one conversation."""
    rows = columns(messages, "conv_id", "turn", "role", "text")
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    each = _calls(rows)
    first = F.min(F.struct("turn", "pos", "name", "arguments", "after", "conv_id")).alias("c")
    calls = cut(each.groupBy(*_KEY).agg(first, (F.count("*") - 1).alias("again")).select(*_KEY, "c.*", "again"), "calls")
    said = rows.filter("role = 'tool'").select("conv", "conv_id", "turn", F.from_json("text", _RESULT).alias("r")).filter("r.tool_call_id IS NOT NULL")
    answer = F.min(F.struct("turn", F.col("r.content").alias("content"), "conv_id")).alias("r")
    results = said.groupBy("conv", F.col("r.tool_call_id").alias("call_id")).agg(answer, (F.count("*") - 1).alias("more"))
    linked = calls.join(results, _KEY, "full").join(_ordered(calls), _KEY, "left")
    status = (
        F.when(F.col("after").isNull(), "orphan")
        .when(F.coalesce("cyclic", F.lit(False)), "cyclic")
        .when(F.col("r").isNull(), "unanswered")
        .when(F.col("r.turn") <= F.col("turn"), "early")
        .otherwise("linked")
    )
    turn = F.coalesce("turn", "r.turn")
    flat = linked.select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"),
        "call_id",
        turn.alias("turn"),
        "pos",
        F.coalesce("slot", F.struct(turn.alias("turn"), "pos")).alias("slot"),
        F.when(~F.coalesce("cyclic", F.lit(False)), F.coalesce("level", F.lit(0))).alias("level"),
        "name",
        status.alias("status"),
        (F.coalesce("again", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("duplicates"),
        "arguments",
        "after",
        F.col("r.content").alias("content"),
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrong, records = [], []
            for name, arguments, status, call, after, content in zip(*(b.column(k).to_pylist() for k in ("name", "arguments", "status", "call_id", "after", "content"))):
                if status == "orphan":
                    wrong.append([])
                    records.append(canonical({"id": call, "result": content}))
                    continue
                try:
                    value = parsed(arguments) if arguments else {}
                    bad = errors(value, schemas[name]) if name in schemas else [f"$: no tool {name}"]
                except ValueError:
                    value, bad = arguments, ["$: no JSON"]
                wrong.append([_told(x) for x in bad])
                records.append(canonical({"id": call, "result": content, "name": name, "arguments": value, "after": after}))
            kept = [b.column(k) for k in range(9)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(wrong, pa.list_(pa.string())), pa.array(records, pa.string())], names=[*b.schema.names[:9], "errors", "record"])

    return flat.mapInArrow(of, grown(flat.schema.fields[:9], "errors array<string>, record string"))


# ---------------------------------------------------------------- the conversations table as tool messages

TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 5}}},
    "translate": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Tool messages made from plain ones: every assistant turn calls a tool with its whole text, every following user turn
    is the answer to it. Each call needs the one before; those of every fifth turn need the next one instead, which needs none."""
    call = F.struct(
        F.concat(F.lit("c"), F.col("turn")).alias("id"),
        F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "translate").otherwise("draw").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") % 7).alias("limit"))).alias("arguments"),
        F.when(F.col("turn") % 5 == 0, F.array(F.concat(F.lit("c"), F.col("turn") + 2))).when(F.col("turn") % 5 == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), F.col("turn") - 2))).alias("after"),
    )
    calls = conversations.filter("role = 'assistant'").select("conv_id", "turn", "role", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answer = F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    answers = conversations.filter("role = 'user'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(answer).alias("text"))
    return calls.unionByName(answers)


def report(conversations: DataFrame) -> DataFrame:
    """Per call and orphan result of the conversations as tool messages: its place, status, number of errors, and its record's SHA-256."""
    df = link(as_tool_messages(conversations), TOOLS)
    return df.select("conv_id", "call_id", "turn", F.col("slot.turn").alias("slot_turn"), "level", "name", "status", "duplicates", F.size("errors").cast("long").alias("n_errors"), F.sha2("record", 256).alias("record_sha256"))
