"""Named tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a directory of files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    """Epoch milliseconds of a zoneless timestamp, truncated; independent of the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
