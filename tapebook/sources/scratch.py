"""Tables written in the shared folder, as cut points of a plan."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session (one JVM, as in tests) gets a temporary
    one, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = _own_folder()
    return f"{base.rstrip('/')}/tapebook-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to a scratch folder and read again: computed once, and a lost executor costs a task."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
