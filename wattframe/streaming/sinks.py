"""Stream outputs that survive replays and restarts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"
AVAILABLE_NOW: Mapping[str, object] = {"availableNow": True}
COMPACT_EVERY = 20


def start(writer, trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Starts a query.  One that takes what is there now is awaited; any other trigger keeps it
    running, and the caller stops it."""
    query = writer.trigger(**trigger).start()
    if "availableNow" in trigger:
        query.awaitTermination()
    return query


def append_files(
    stream: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = AVAILABLE_NOW
) -> StreamingQuery:
    """Append-only parquet output (exactly once through the sink's own log)."""
    return start(
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append"),
        trigger,
    )


def for_each_batch(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    trigger: Mapping[str, object] = AVAILABLE_NOW,
) -> StreamingQuery:
    return start(
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handle),
        trigger,
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch; a replayed batch overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def changelog(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "update",
    trigger: Mapping[str, object] = AVAILABLE_NOW,
    keys: Sequence[str] = (),
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Writes only the rows a micro-batch changed; :func:`latest` reads the current ones.

    Given the keys, every ``compact_every``-th batch writes the latest row of every key and the
    folders from before the last such batch go.  A batch that may still be replayed finds all
    it reads, and the log never holds more than twice that many folders.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        log_batch(df, path, batch_id, keys, compact_every)

    return for_each_batch(stream, write, checkpoint, mode, trigger)


def log_batch(
    df: DataFrame, path: str, batch_id: int, keys: Sequence[str] = (), compact_every: int = COMPACT_EVERY
) -> None:
    """Adds a micro-batch's rows to a changelog (:func:`changelog`)."""
    if not keys or batch_id == 0 or batch_id % compact_every:
        return write_batch(df, path, batch_id)
    spark = df.sparkSession
    before = spark.read.parquet(path).where(F.col(BATCH) < batch_id)
    known = before.unionByName(df.withColumn(BATCH, F.lit(batch_id).cast("int")))
    write_batch(_newest(known, keys), path, batch_id)
    _remove_batches(spark, path, batch_id - compact_every)


def latest_before(spark: SparkSession, path: str, batch_id: int, keys: Sequence[str]) -> DataFrame | None:
    """Most recent row per key of a changelog as a micro-batch finds it, also when it is replayed."""
    if batch_id == 0:
        return None
    return _newest(spark.read.parquet(path).where(F.col(BATCH) < batch_id), keys)


def _remove_batches(spark: SparkSession, path: str, before: int) -> None:
    """Deletes the folders of the batches before the given one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < before:
            files.delete(status.getPath(), True)


def _newest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in (*keys, BATCH)]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Most recent row per key of a changelog."""
    return _newest(spark.read.parquet(path), keys)
