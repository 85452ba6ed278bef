"""Metric sample table: long rows, partitioned so one metric reads only its own files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.operators import metrics


def write_samples(
    est: DataFrame, path: str, by: Sequence[str] = ("metric",)
) -> None:
    """Rows are brought together by the partition columns (``day`` may be one, for retention)
    and ordered by time, so a time range skips row groups.  Rebalancing lets AQE split a
    partition that is too large for one file and merge small ones, to the advisory size."""
    rows = metrics.samples(est)
    if "day" in by:
        rows = rows.withColumn("day", F.to_date("interval"))
    ordered = rows.hint("rebalance", *by).sortWithinPartitions(*by, "interval")
    ordered.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
