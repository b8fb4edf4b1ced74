"""Where a job keeps tables between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-auditlake-")
    return f"{base}/auditlake/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a parquet table there: cuts the lineage and survives the loss of executors."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges both sides, whatever Spark takes their sizes for.

    Spark sizes a table by its files and columns: what is parsed, unfolded or read from files that compress well is taken
    for far smaller than it is, and a side that is taken for small is collected by the driver to be broadcast.
    """
    return df.hint("merge")
