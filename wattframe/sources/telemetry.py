"""Telemetry frames: one JSON document per host and interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe import schemas
from wattframe.functions import fixed
from wattframe.operators import views

FRAME = ("interval", "host_id")


def _process_struct():
    omit_empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return F.struct(
        "pid",
        "comm",
        omit_empty("container_id"),
        omit_empty("container_name"),
        "energy_joules",
        "power_watts",
        "carbon_grams_co2",
        "cpu_energy_joules",
        "memory_energy_joules",
        "gpu_energy_joules",
        "confidence",
        F.col("is_ai_inference").alias("is_ai_workload"),
    )


def frames(est: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Documents with every process of the frame and the frame's summary.

    An array has to fit one row, so its length needs a bound that does not depend on the
    data volume: a frame covers one host, and pids are grouped in ranges of the tracked-pid
    limit.  A host with pids beyond the first range sends its processes as several
    documents (``part`` 0, 1, ...), each with the summary of the whole frame.
    """
    part = F.floor(F.col("pid") / F.lit(fixed.MAX_TRACKED_PIDS)).alias("part")
    processes = est.groupBy(*frame, part).agg(
        F.sort_array(F.collect_list(_process_struct())).alias("process_data")
    )
    summary = views.system_summary(est, frame)
    fields = [c for c in summary.columns if c not in frame]
    whole = processes.join(summary, list(frame))
    document = F.struct(
        F.date_format("interval", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("telemetry").alias("type"),
        "process_data",
        F.struct(*fields).alias("summary"),
    )
    return whole.select(*frame, "part", F.to_json(document).alias("value"))


def write_frames(est: DataFrame, path: str, frame: Sequence[str] = FRAME) -> None:
    """JSON lines, one document per line."""
    frames(est, frame).select("value").write.mode("overwrite").text(path)


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """Documents as columns; unreadable frames and other message types are dropped."""
    doc = F.from_json(F.col(value), schemas.TELEMETRY_DOC)
    return (
        df.select(doc.alias("d"))
        .where(F.col("d.type") == "telemetry")
        .select("d.*")
        .withColumn("interval", F.col("timestamp").cast("timestamp").cast("timestamp_ntz"))
    )


def parse_stream(
    lines: DataFrame, watermark: str, value: str = "value", replayed_within: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """A feed's documents and its unreadable lines, both as streams.

    A document that is sent again while its time is inside the watermark comes out once: it is told by a
    checksum of its text, which Spark keeps that long.  ``replayed_within`` is the watermark's delay for
    that, if it is another one.  Messages of other types are no frames and not unreadable either.
    """
    doc = F.from_json(F.col(value), schemas.TELEMETRY_DOC)
    read = lines.select(doc.alias("d"), F.sha2(F.col(value), 256).alias("frame"), F.col(value).alias("value"))
    at = F.col("d.timestamp").cast("timestamp")
    frames = (
        read.where(F.col("d.type") == "telemetry")
        .select("d.*", "frame", at.alias("event_time"))
        .withWatermark("event_time", replayed_within or watermark)
        .dropDuplicatesWithinWatermark(["frame"])
        .withColumn("interval", F.col("event_time").cast("timestamp_ntz"))
        .drop("frame", "event_time")
    )
    return frames, read.where(F.col("d").isNull() | F.col("d.type").isNull()).select("value")
