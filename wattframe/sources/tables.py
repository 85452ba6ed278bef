"""Event tables, batch and streaming, and per-process statistics tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe import schemas


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file stream.  The file source wants a folder, so the file is
    picked out of it by name; the schema is fixed, never inferred."""
    reader = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def heartbeat(spark: SparkSession, path: str, at: dt.datetime | None = None) -> None:
    """Tells streams reading the heartbeats of ``path`` that time has come to ``at``.

    Without a time only the (empty) folder is made, which a stream needs to start.
    """
    beat = spark.range(0 if at is None else 1).select(F.lit(at).cast("timestamp_ntz").alias("ts"))
    beat.write.mode("append").parquet(path)


def stream_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("ts timestamp_ntz").parquet(path)


def write_stats(stats: DataFrame, path: str, probe: str) -> None:
    """One statistics table per probe."""
    stats.write.mode("overwrite").parquet(f"{path}/{probe}_stats")


def read_stats(spark: SparkSession, path: str, probe: str) -> DataFrame:
    return spark.read.schema(schemas.STATS[probe]).parquet(f"{path}/{probe}_stats")
