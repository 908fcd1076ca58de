"""Connected components of an edge table: alternating large-star and small-star rounds, each one written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapebook.llm.common import drop_table, write_table


def _state(df: DataFrame) -> tuple:
    return tuple(df.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u long, v long): root is the smallest node reachable.

    Rounds go on until nothing changes (their number grows with the logarithm of a component's size); each is written
    to the shared folder and the one before it removed. Loops and repeated edges are allowed; no edges give no rows."""
    spark = edges.sparkSession
    start = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = write_table(start, "edges")
    now = spark.read.schema(start.schema).parquet(path)
    state = _state(now)
    while state[0]:
        after = write_table(_small_star(_large_star(now)), "edges")
        drop_table(spark, path)
        path, now, before = after, spark.read.schema(start.schema).parquet(after), state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
