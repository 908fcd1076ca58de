"""Operator 4: secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is addressed by its content (SHA-256).  The ledger has one row per finding and one marker
row per (blob, rule, version) that was scanned.  A run scans each blob that the ledger lacks once, for the rule versions
it lacks only, and joins the findings back to every document that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapebook.llm.common import columns, cut, packed, unpacked


@dataclass(frozen=True)
class Rule:
    """pattern is a Java and RE2 expression; a match counts if its group `value` has min_chars characters or more. The span
    begins behind the group `lead`, if there is one: what must stand before a secret, as neither language of expressions can look
    back in the same way. Expressions go over any text in linear time: no repeated group, and no start inside what a failed
    match has run over."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    min_chars: int = 1
    lead: int | None = None


#: The base rules, in the order in which spans with equal starts are listed.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)

#: What the ledger's later rule versions add.
ADDED = (
    Rule("private_key", 2, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hosting_token", 2, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 2, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", 3, r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lead=1),
    Rule("url_password", 2, r"://[A-Za-z0-9._~-]+:([^\x20\x09-\x0D:/@]{6,})@", 1, 6),
)
RULES = (*BASE, *ADDED)

_HEADER = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_BODY = r"A-Za-z0-9+/=\s\\"
#: What redact() scans for besides (a Java expression): a private key's header with its body up to the END line; without such
#: a line, with what looks like its body. Not in RULES: the spans and the SQL of the query tell the header only. No quantifier
#: that can run far stands over a group (the engine would recurse), and none gives back what it took (possessive), but for the
#: last ones, which give back whole runs at most once.
KEY_BODY = Rule(
    "private_key",
    4,
    _HEADER + rf"[{_BODY}:,]*+(?:-[{_BODY}:,]++){{0,20}}+-----END [A-Z ]{{0,30}}PRIVATE KEY-----|"
    + _HEADER + rf"(?:(?:\s++[A-Za-z-]++:\x20[^\n]*+){{0,8}}+[{_BODY}]*[A-Za-z0-9+/=]{{16,}}(?:[\s\\][\s\\nr]*[A-Za-z0-9+/]+=*(?=[^\S\n]*+(?:\n|\z)|\\[nr]))?)?",
)

#: Findings are broadcast up to these bytes (64 for a blob and for a span).
BROADCAST_BYTES = 16_000_000

#: Characters of a block.
_BLOCK = 1024

_LEDGER = "blob binary, kind string, version int, start long, end long"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], _LEDGER)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(text: Column, rule: Rule) -> Column:
    """The rule's matches in order: the characters since the match before, of the match, and of its value. No match: null."""
    found = lambda g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))
    leads = F.array().cast("array<string>") if rule.lead is None else found(rule.lead)
    # zipped, so that each expression is gone through once a text and not once a match; behind the last match stands one piece more
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found(0).alias("whole"), found(rule.value).alias("value"), leads.alias("lead"))
    lead = lambda m: F.coalesce(F.length(m["lead"]), F.lit(0))
    each = F.transform(
        F.filter(zipped, lambda m: m["whole"].isNotNull()),
        lambda m, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.alias("nth"), (F.length(m["gap"]) + lead(m)).alias("gap"),
            (F.length(m["whole"]) - lead(m)).alias("chars"), (F.length(m["value"]) >= rule.min_chars).alias("good"),
        ),
    )
    return F.when(text.rlike(rule.pattern), each)


def scan(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: blob, kind, version, start, end (code points, end exclusive); a scanned (blob, rule) pair also has
    one row with null start and end. Only blobs and rule versions that the ledger lacks are scanned, each blob once."""
    docs = columns(documents, "text").select(_blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = docs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        done = ledger.filter("start IS NULL").groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", F.col("version").cast("string"))).alias("seen"))
        todo = blobs.join(done, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    none = F.array().cast("array<struct<kind:string,version:int,nth:int,gap:int,chars:int,good:boolean>>")
    found, marks = [], []
    for r in rules:
        new = ~F.array_contains("seen", f"{r.kind}:{r.version}")
        found.append(F.when(new, F.coalesce(_matches(F.col("text"), r), none)).otherwise(none))
        marks.append(F.when(new, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(-1).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("chars"), F.lit(True).alias("good"))))
    rows = todo.select("blob", F.inline(F.concat(F.filter(F.array(*marks), lambda m: m.isNotNull()), *found)))
    before = Window.partitionBy("blob", "kind", "version").orderBy("nth")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("chars")).over(before))
    start = F.when(F.col("nth") >= 0, F.col("end") - F.col("chars"))
    return placed.filter("good").select("blob", "kind", "version", start.alias("start"), F.when(F.col("nth") >= 0, F.col("end")).alias("end"))


def update(documents: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with what the documents add to it."""
    return ledger.unionByName(cut(scan(documents, ledger, rules), "ledger"))


def _known(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's spans by the rules, with each rule's rank."""
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
    known = ledger.filter("start IS NOT NULL").withColumn("rank", F.element_at(rank, F.concat_ws(":", "kind", F.col("version").cast("string"))))
    return known.filter("rank IS NOT NULL")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: blob, found (kind, start, end; by start, then the rules' order)."""
    each = F.struct("start", "rank", "kind", "end")
    return _known(ledger, rules).groupBy("blob").agg(F.array_sort(F.collect_list(each)).alias("found"))


def merged(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: blob, found (start, end; in order, overlapping spans as one)."""
    order = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = _known(ledger, rules).select("blob", "start", "end", F.coalesce(before <= F.col("start"), F.lit(True)).cast("int").alias("new"))
    runs = rows.withColumn("run", F.sum("new").over(order)).groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))


def joined(documents: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with found: the findings of their text, null if none (an own column found is replaced). Every document
    that holds a blob gets its findings."""
    docs = documents.drop("found")
    rows = _found(docs, findings(ledger, rules))
    return rows.select(*[(F.col("text") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns], "found")


def _found(documents: DataFrame, known: DataFrame) -> DataFrame:
    """_row, text and found of documents. Only blobs with findings are joined: broadcast up to BROADCAST_BYTES, by blob beyond;
    they are written first, so that a blob which many documents hold can be split over tasks."""
    rows = packed(documents).withColumn("_blob", _blob(F.col("text")))
    known = cut(known.withColumnRenamed("blob", "_blob"), "findings")
    size = known.agg(F.sum(F.size("found") * 64 + 64)).first()[0] or 0
    return rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "_blob", "left").drop("_blob")


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Null text is empty, empty text has no spans;
    repeated rows stay.

    A first run scans all blobs for the base rules and stores the ledger; a second one, for all rules, finds there what it need
    not scan again, scans every blob for the added rules only, and adds to the store. Findings come from the store, joined to
    every document that holds the blob."""
    return reported(documents, stored(documents))


def stored(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The written ledger of the documents' blobs, base rules first, then all."""
    ledger = empty_ledger(documents.sparkSession) if ledger is None else ledger
    for rules in (BASE, RULES):
        ledger = update(documents, ledger, rules)
    return ledger


def reported(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    df = joined(columns(documents, "doc_id", "text"), ledger).drop("text")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    found = F.coalesce("found", none)
    base = F.filter(found, lambda s: s["rank"] < len(BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter(found, lambda s: s["rank"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(found).alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every found span (overlapping ones as one) replaced by the mark, private keys with their bodies; columns
    as they were, and n_chars, if there is such a column, follows the text. Documents without findings stay as they are."""
    rules = (*RULES, KEY_BODY)
    df = _found(documents, merged(scan(documents, rules=rules), rules)).withColumnRenamed("found", "_spans")
    last = F.size("_spans")
    # characters are looked up in blocks: a place in a text is found by walking to it
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    within = lambda b, j: F.least(F.greatest(b - j * _BLOCK, F.lit(0)), F.lit(_BLOCK)).cast("int")

    def piece(blocks: Column, i: Column) -> Column:
        a = F.when(i > 0, F.get("_spans", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
        z = F.when(i < last, F.get("_spans", i)["start"]).otherwise(F.length("text").cast("long"))
        over = F.sequence(F.floor(a / _BLOCK).cast("int"), F.floor((z - 1) / _BLOCK).cast("int"))
        parts = F.transform(over, lambda j: F.substring(F.get(blocks, j), within(a, j) + 1, within(z, j) - within(a, j)))
        return F.when(z > a, F.array_join(parts, "")).otherwise("")

    new = F.transform(F.array(blocks), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: piece(b, i)), mark))
    df = df.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.get(new, F.lit(0))))
    return unpacked(df.withColumn("_new", F.col("_spans").isNotNull()), documents)


def _sql() -> str:
    """DuckDB: the same spans from the pieces between matches, document by document, without a ledger."""
    quote = lambda p: p.replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        p = quote(r.pattern)
        lengths = lambda g: f"list_transform(regexp_extract_all(text, '{p}', {g}), lambda x: length(x))"  # noqa: B023, E731
        lead = f"unnest({lengths(r.lead)})" if r.lead is not None else "0"
        parts.append(
            f"SELECT doc_id, rank, kind, gap + lead AS gap, chars - lead AS chars, good, nth FROM (SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, "
            f"unnest(list_transform(string_split_regex(text, '{p}'), lambda x: length(x))) AS gap, unnest({lengths(0)}) AS chars, {lead} AS lead, "
            f"unnest(list_transform(regexp_extract_all(text, '{p}', {r.value}), lambda x: length(x) >= {r.min_chars})) AS good, "
            f"generate_subscripts(string_split_regex(text, '{p}'), 1) AS nth FROM docs WHERE regexp_matches(text, '{p}'))"
        )
    union = "\nUNION ALL\n".join(parts)
    counts = ", ".join(f"count(s.kind) FILTER (WHERE s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({union}),
placed AS (SELECT *, sum(gap + chars) OVER (PARTITION BY doc_id, rank ORDER BY nth) AS finish FROM raw WHERE chars IS NOT NULL),
s AS (SELECT doc_id, rank, kind, CAST(finish - chars AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish FROM placed WHERE good)
SELECT d.doc_id, {counts},
sha256(coalesce(string_agg(s.kind || ':' || s.start || ':' || s.finish, ',' ORDER BY s.start, s.rank) FILTER (WHERE s.rank < {len(BASE)}), '')) AS base_sha256,
coalesce(string_agg(s.kind || ':' || s.start || ':' || s.finish, ',' ORDER BY s.start, s.rank), '') AS spans
FROM docs d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


SQL = _sql()
