"""Places of rows within a key, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapebook.sources.scratch import written


def numbered_by(df: DataFrame, key: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with name: each row's place (from 1) among the rows of its key, by the order; null keys are a key.

    Ranges of (key, order) are sorted in tasks of their own and written, so that a retry cannot deal them anew; what a key's
    rows in one range add is told by its first row there and their number, and summed over the few ranges that hold the key.
    Rows that tie in the order come in either order. parts: the number of ranges, else spark.sql.shuffle.partitions."""
    by = [*key, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    table = written(dealt.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    return _placed(table.withColumn("_part", F.shiftright("_id", 33)), key, name)


def _placed(table: DataFrame, key: list[str], name: str) -> DataFrame:
    runs = table.groupBy(*key, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
    # written, so that its size is known when the join is planned, and df is not dealt out again where it is small
    bases = written(bases.select(F.col("_part").alias("_of"), "_base", *[F.col(k).alias(f"_key_{k}") for k in key]))
    same = [F.col("_part") == F.col("_of"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]]
    out = table.join(bases, same).withColumn(name, F.col("_base") + F.col("_id"))
    return out.select(*[c for c in table.columns if c not in ("_id", "_part", name)], name)
