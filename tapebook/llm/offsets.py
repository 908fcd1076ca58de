"""Global offsets from partition totals: the second pass of a prefix sum over a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Partition totals are broadcast up to this many partitions (16 bytes each), and joined by shuffle beyond.
BROADCAST_PARTS = 1_000_000


def with_offset(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df (part) with base: the sum of total over all smaller parts. totals: one row (part, total) per partition, so the
    single ordered window holds as many rows as the table has partitions, not as it has rows."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("part", "base")
    small = totals.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    return df.join(F.broadcast(bases) if small else bases, "part")
