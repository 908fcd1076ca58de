"""Raw session files: one folder per session with three CSV files of strings."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapebook.schemas import FILES

#: Encodings in the order in which they are tried. (What the last one decodes, the first one does as well.)
ENCODINGS = ("utf-8-sig", "gb18030", "utf-8")
_JAVA = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gb18030": "GB18030"}


def inspect(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, encoding, nul_count) of every file below root: the first encoding that decodes it whole without its NUL bytes, null
    where none fits. An empty file has no row: Spark reads none.

    Files are gone through line by line, in splits: in each of the encodings a line feed or carriage return is a character of
    its own, whatever stands before it, so a file is well formed if and only if every line is. No row is larger than a line. UTF-8 and NUL
    bytes are looked at by built-in functions; only lines of files that are not UTF-8 go to Python, many at once."""
    read = spark.read.options(recursiveFileLookup="true", pathGlobFilter=pattern)
    path = F.col("_metadata.file_path").alias("path")
    bare = F.replace(F.col("value"), F.lit("\0"), F.lit(""))
    lines = read.text(root).select(path, bare.alias("line"), (F.octet_length("value") - F.octet_length(bare)).alias("nul"))
    seen = lines.groupBy("path").agg(F.sum("nul").alias("nul_count"), F.bool_and(F.is_valid_utf8("line")).alias("utf8"))
    other = lines.join(seen.filter("NOT utf8").select("path"), "path", "left_semi").select("path", F.col("line").cast("binary"))
    national = other.mapInArrow(_well_formed(ENCODINGS[1]), "path string, fits boolean").groupBy("path").agg(F.bool_and("fits").alias("fits"))
    files = read.format("binaryFile").load(root).select(path)
    encoding = F.when(F.coalesce("utf8", F.lit(True)), ENCODINGS[0]).when(F.col("fits"), ENCODINGS[1])
    return files.join(seen, "path", "left").join(national, "path", "left").select("path", encoding.alias("encoding"), F.coalesce("nul_count", F.lit(0)).cast("long").alias("nul_count"))


def _well_formed(encoding: str):
    """For batches of (path, line): whether the lines of one file that stand together there are well formed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, lines = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
            fits = []
            for a, z in zip(starts, [*starts[1:], len(paths)]):
                try:
                    codecs.decode(b"\n".join(lines[a:z]), encoding)
                    fits.append(True)
                except UnicodeDecodeError:
                    fits.append(False)
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in starts], pa.string()), pa.array(fits, pa.bool_())], names=["path", "fits"])

    return of


def numbered(rows: DataFrame) -> DataFrame:
    """seq: each row's place in its file, from 1, over all splits of the file. A split's rows are numbered by themselves, and what the
    splits before it hold is added: no task has more than a split."""
    split = ["path", "_start"]
    counts = rows.groupBy(*split).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*split).orderBy("_at"))
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_place", place).join(bases, split)
    return placed.withColumn("seq", (F.col("_base") + F.col("_place")).cast("bigint")).select(*[c for c in rows.columns if c != "_start"], "seq")


def raw_rows(spark: SparkSession, paths: list[str] | str, encoding: str = "utf-8", **options: str) -> DataFrame:
    """Rows of files of one kind and encoding, all cells strings: blank headers dropped, missing cells empty, plus path, dir and
    _start (of the file's split).

    Files whose headers differ fail. GB18030 needs the session's legacy charset setting, which is switched on for it and stays
    so: plans are lazy and read it when they run."""
    if _JAVA[encoding] != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.options(**options).option("header", True).option("enforceSchema", False).option("encoding", _JAVA[encoding]).csv(paths)
    names = [c for c in raw.columns if not c.startswith("_c")]
    cells = [F.coalesce(F.translate(f"`{c}`", "\0", ""), F.lit("")).alias(c.lstrip("\ufeff").strip()) for c in names]
    path = F.col("_metadata.file_path")
    return raw.select(*cells, path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.col("_metadata.file_block_start").alias("_start"))


def read_csv(spark: SparkSession, paths: list[str] | str, encoding: str = "utf-8") -> DataFrame:
    """raw_rows with seq, each row's place in its file."""
    return numbered(raw_rows(spark, paths, encoding))


def read_kind(spark: SparkSession, root: str, kind: str, files: DataFrame | None = None) -> DataFrame:
    """raw_rows of all files of a kind (quotes, orders, trades) below root; files: what inspect() found there, if it is known.

    Files of one encoding are read by their name; where several encodings occur, one read each by path."""
    found = inspect(spark, root, FILES[kind]) if files is None else files.filter(F.col("path").endswith("/" + FILES[kind]))
    encodings = [r["encoding"] for r in found.select("encoding").distinct().collect()]
    if None in encodings:
        raise ValueError(f"no known encoding: {[r['path'] for r in found.filter('encoding IS NULL').limit(20).collect()]}")
    if not encodings:
        raise FileNotFoundError(f"no {FILES[kind]} below {root}")
    if len(encodings) == 1:
        return raw_rows(spark, root, encodings[0], recursiveFileLookup="true", pathGlobFilter=FILES[kind])
    paths = lambda e: [r["path"] for r in found.filter(F.col("encoding") == e).select("path").toLocalIterator()]
    return reduce(DataFrame.unionByName, [raw_rows(spark, paths(e), e) for e in encodings])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(dir, name) of the files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def missing_files(files: DataFrame) -> DataFrame:
    """files (dir, name) -> (dir, missing) of the folders that lack some of the three files; none if all are whole."""
    missing = F.array_except(F.array(*map(F.lit, FILES.values())), F.collect_set("name"))
    return files.groupBy("dir").agg(F.array_sort(missing).alias("missing")).filter(F.size("missing") > 0)


def first_rows(raw: DataFrame) -> DataFrame:
    """(dir, path, symbol, date) of raw_rows: what each file's first row names. Combined on the map side: no window, and a row
    per file and task in the shuffle."""
    rows = raw.select("dir", "path", "_start", F.monotonically_increasing_id().alias("_at"), F.struct(F.trim("万得代码").alias("symbol"), F.trim("自然日").alias("date")).alias("s"))
    return rows.groupBy("dir", "path").agg(F.min_by("s", F.struct("_start", "_at")).alias("s")).select("dir", "path", "s.*")


def mixed_sessions(*tables: DataFrame) -> DataFrame:
    """(dir, sessions) of the folders whose files' first rows name more than one (symbol, date). Tables are raw_rows."""
    each = reduce(DataFrame.unionAll, map(first_rows, tables)).groupBy("dir").agg(F.array_sort(F.collect_set(F.struct("symbol", "date"))).alias("sessions"))
    return each.filter(F.size("sessions") > 1)


def nul_counts(raw: DataFrame) -> DataFrame:
    """NUL characters per file in the data rows of a CSV read that has not dropped them (columns path and strings)."""
    cells = [F.length(f"`{c}`") - F.length(F.translate(f"`{c}`", "\0", "")) for c, t in raw.dtypes if t == "string" and c not in ("path", "dir")]
    return raw.groupBy("path").agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cells])).alias("nul_count"))
