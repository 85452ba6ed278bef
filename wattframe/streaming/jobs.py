"""Structured Streaming jobs.  Each is a stream-to-stream function plus, where it needs a
sink of its own, a ``run_*`` that drives it into a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, LongType, StructField, StructType

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators import containers, energy, events, metrics, rollup, views
from wattframe.sources import records, samples, telemetry
from wattframe.streaming import sinks, state

WATERMARK = "10 seconds"
EVENT_TIME = "event_time"
#: Parts that the rows of one container or window are dealt over, as it may hold a third of all.
SALTS = 16
#: Groups of processes whose state is kept and whose rows are folded together.
BUCKETS = 512
#: Times in JSON to the microsecond.
EXACT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def fan_in(*probes: DataFrame) -> DataFrame:
    """The probe streams as one; a column a probe lacks is NULL there."""
    out = probes[0]
    for probe in probes[1:]:
        out = out.unionByName(probe, allowMissingColumns=True)
    return out


def with_event_time(
    stream: DataFrame, watermark: str = WATERMARK, heartbeats: DataFrame | None = None
) -> DataFrame:
    """Watermarks need a zoned timestamp; rows later than the delay are dropped downstream.

    ``heartbeats`` (:func:`wattframe.sources.tables.stream_heartbeats`) move the watermark where
    no events come, so the last windows close too.  They leave the stream right behind the
    watermark; the condition names the event time, which keeps it from being pushed below.
    """
    zoned = F.col("ts").cast("timestamp")
    if heartbeats is not None:
        stream = stream.unionByName(heartbeats.withColumn("_beat", zoned), allowMissingColumns=True)
    timed = stream.withColumn(EVENT_TIME, zoned).withWatermark(EVENT_TIME, watermark)
    if heartbeats is None:
        return timed
    return timed.where(F.col("_beat").isNull() | (F.col("_beat") != F.col(EVENT_TIME))).drop("_beat")


def pid_merge(
    vectors: DataFrame,
    window: str = "1 second",
    keys: Sequence[str] = rollup.PROCESS,
    keep_time: bool = False,
) -> DataFrame:
    """The batch merge on a stream.  Map tasks combine before the shuffle here as well.

    With ``keep_time`` closed windows (append mode) can go on into another stateful step.
    """
    merged = rollup.pid_merge_single(vectors, window=window, keys=keys, time=EVENT_TIME, keep_time=keep_time)
    return merged.withColumn("interval", F.col("interval").cast("timestamp_ntz"))


def counters(estimates: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Running totals per label set; the checkpoint is what makes them survive restarts."""
    return estimates.groupBy(*labels).agg(
        F.sum(F.col("energy_nj").cast("decimal(20,0)")).alias("_nj"),
        F.sum(metrics.milli_carbon()).alias("_mc"),
    ).select(
        *labels,
        S.joules("_nj").alias(metrics.COUNTERS[0]),
        metrics.grams(F.col("_mc")).alias(metrics.COUNTERS[1]),
    )


def exec_reset(
    cpu_events: DataFrame,
    keys: Sequence[str] = rollup.PROCESS,
    step: str = "1 second",
    expiry_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """CPU statistics since each process's last exec; a row whenever a process's change.

    Two states, both Spark's: the rows of steps that are still open, held per process and
    step until the watermark has passed, so an exec may come after rows that follow it; and
    what is known of each process, into which closed steps are folded in order.  The second is
    kept in ``buckets`` of processes, which a checkpoint fixes.  Append mode.
    """
    steps = rollup.step_segments(cpu_events, EVENT_TIME, step, keys)
    process = StructType([steps.schema[k] for k in keys])
    dealt = steps.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
        F.to_json(F.struct(*keys), EXACT).alias("series"), *[c for c in steps.columns if c not in keys],
    )
    schema = StructType([f for f in dealt.schema if f.name not in ("bucket", "had_exec")])
    folded = dealt.groupBy("bucket").transformWithStateInPandas(
        state.SinceExec(expiry_ms), schema, "Append", "ProcessingTime" if expiry_ms else "None"
    )
    return folded.withColumn("process", F.from_json("series", process, EXACT)).select(
        "process.*", *[c for c in schema.names if c != "series"]
    )


def process_stats(
    all_events: DataFrame,
    keys: Sequence[str] = rollup.PROCESS,
    step: str = "1 second",
    expiry_ms: int | None = None,
) -> DataFrame:
    """CPU, memory and GPU statistics of a process in one row, whenever one of its steps has closed.

    What takes three tables and a full outer join in a batch is one keyed state with three variables here, so
    no side waits for another.  Append mode; :func:`mem_stats`, :func:`gpu_stats` and :func:`feature_snapshot`
    read the rows (the latest per process, if they come from a changelog).
    """
    steps = rollup.step_stats(events.with_fault_classes(all_events), EVENT_TIME, step, keys)
    gone = ("step_us", "had_exec", "first_reclaim_us")
    schema = StructType([f for f in steps.schema if f.name not in gone])
    return steps.groupBy(*keys).transformWithState(
        state.ProcessStats(keys, expiry_ms), schema, "Append", "ProcessingTime" if expiry_ms else "None"
    )


def mem_stats(stats: DataFrame, keys: Sequence[str] = rollup.PROCESS) -> DataFrame:
    """The layout of :func:`wattframe.operators.rollup.mem_stats`."""
    return stats.where("has_mem").select(
        *keys, *state.MEM, (F.col("last_fault_us") * 1000).alias("last_fault_ns"),
        F.col("minor_faults").alias("estimated_rss_pages"), F.col("mem_comm").alias("comm"),
    )


def gpu_stats(stats: DataFrame, keys: Sequence[str] = rollup.PROCESS) -> DataFrame:
    """The layout of :func:`wattframe.operators.rollup.gpu_stats`; no job is ever seen to end."""
    zero = F.lit(0).cast("bigint")
    return stats.where("has_gpu").select(
        *keys, F.col("jobs").alias("total_jobs_submitted"), zero.alias("total_gpu_active_ns"),
        (F.col("last_submit_us") * 1000).alias("last_submit_ns"), zero.alias("last_complete_ns"),
        F.col("jobs").alias("active_jobs"), F.col("gpu_comm").alias("comm"),
    )


def feature_snapshot(stats: DataFrame, keys: Sequence[str] = rollup.PROCESS) -> DataFrame:
    """The layout of :func:`wattframe.operators.rollup.feature_snapshot`."""
    names = {
        "_cpu_comm": F.when(F.col("has_cpu"), F.col("cpu_comm")), "_mem_comm": F.when(F.col("has_mem"), F.col("mem_comm")),
        "estimated_rss_pages": F.col("minor_faults"), "total_jobs_submitted": F.col("jobs"),
        "total_gpu_active_ns": F.lit(0).cast("bigint"),
    }
    return rollup.snapshot_row(stats.withColumns(names), keys)


def container_asof(
    facts: DataFrame,
    history: DataFrame,
    keys: Sequence[str] = rollup.PROCESS,
    watermark: str = WATERMARK,
    heartbeats: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """:func:`wattframe.operators.containers.enrich_asof` on two streams: adds ``container_name``.

    ``facts`` (with ``ts``, ``ts_us`` and ``container_id``) wait in keyed state until the watermark has passed
    them; so an inventory snapshot may come after the facts that it names, as long as it is no later than the
    watermark allows.  Versions no fact can need any more are evicted.  A container's facts are dealt over ``salts``
    keys, each with its versions; those of host processes over ``BUCKETS`` keys that no inventory has.  Append mode.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")
    host = F.concat_ws(":", F.lit("host"), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("string"))
    entry = F.coalesce(F.nullif("container_id", F.lit("")), host)
    schema = StructType([f for f in facts.schema if f.name != EVENT_TIME])
    asked = facts.select(
        entry.alias("entry"), part.alias("salt"), F.lit(1).alias("rank"),
        "ts", F.col("ts_us").alias("at_us"), F.to_json(F.struct(*[f.name for f in schema]), EXACT).alias("row"),
        F.lit(None).cast("string").alias("value"),
    )
    every = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    known = history.select(
        F.col("short_id").alias("entry"), every.alias("salt"), F.lit(0).alias("rank"),
        F.col("snapshot_ts").alias("ts"), F.col("snapshot_us").alias("at_us"), F.lit(None).cast("string").alias("row"),
        F.col("name").alias("value"),
    )
    both = with_event_time(asked.unionByName(known), watermark, heartbeats)
    found = both.groupBy("entry", "salt").transformWithStateInPandas(
        state.AsOf(), "row string, value string", "Append", "EventTime"
    )
    return found.select(
        F.from_json("row", schema, EXACT).alias("r"), F.coalesce("value", F.lit("")).alias("container_name")
    ).select("r.*", "container_name")


def silent_counters(
    estimates: DataFrame, labels: Sequence[str], silence: dt.timedelta, window: str = "1 second"
) -> DataFrame:
    """Running totals per label set that end after a silence: state does not grow with every series ever seen.

    Estimates (with event time) are added up per window, then counted in the order of windows.  A series whose
    last window began more than ``silence`` ago gets a row that repeats its last value with ``ended`` set, and is
    forgotten; if it returns it starts from 0.  ``ts`` is a window's start, or the end of the silence.  Append mode.
    """
    windows = estimates.groupBy(F.window(EVENT_TIME, window).alias("window"), *labels).agg(
        F.sum(F.col("energy_nj").cast("decimal(20,0)")).alias("nj"), F.sum(metrics.milli_carbon()).alias("mc")
    )
    timed = windows.select(
        F.window_time("window").alias(EVENT_TIME), *labels, S.micros(F.col("window.start")).alias("at_us"), "nj", "mc"
    )
    of = timed.schema
    schema = StructType(
        [
            *[of[c] for c in labels], of["at_us"],
            *[StructField(f"{n}_total", DecimalType(38, 0)) for n in ("nj", "mc")], StructField("ended", BooleanType()),
        ]
    )
    totals = timed.groupBy(*labels).transformWithState(
        state.SilentCounter(labels, ["nj", "mc"], int(silence.total_seconds() * 1000)), schema, "Append", "EventTime"
    )
    return totals.select(
        F.timestamp_micros("at_us").cast("timestamp_ntz").alias("ts"), *labels, "nj_total", "mc_total", "ended"
    )


def enriched(vectors: DataFrame, ids: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows joined to the container and grid dimensions.

    On a stream the dimensions are those the query was started with; to see what has been
    added since, call this on each micro-batch with dimensions read there, as
    :func:`run_two_sinks` does.
    """
    known = containers.attach_container_id(vectors, ids)
    named = containers.enrich(known, inventory)
    return energy.with_intensity(named)


def scored(vectors: DataFrame, model=None) -> DataFrame:
    """Stateless scoring of a stream of vectors."""
    return energy.heuristic(vectors) if model is None else energy.model_estimates(vectors, model)


SERIES = (*rollup.PROCESS, "comm")
TOTALS = ("exact_nj", "exact_mc")


def with_counters(
    estimates: DataFrame, known: DataFrame | None, keys: Sequence[str] = SERIES, expiry_ms: int | None = None
) -> DataFrame:
    """Adds the running totals of each series' energy and carbon to a micro-batch's estimates of closed windows.

    ``known`` has the totals before it (:func:`totals`), which take part as a first row of their series; one that has
    been silent for ``expiry_ms`` of processing time starts from 0.  The totals are exact integers and stay beside
    the counters; a process that runs in one container, as they do, has one series.
    """
    rows = estimates.withColumns(
        {"exact_nj": F.col("energy_nj").cast("decimal(20,0)"), "exact_mc": metrics.milli_carbon(), "_known": F.lit(False)}
    )
    if known is not None:
        if expiry_ms is not None:
            known = known.where(F.col("seen_ms") > F.unix_millis(F.current_timestamp()) - expiry_ms)
        rows = rows.unionByName(known.drop("seen_ms").withColumn("_known", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy(F.desc("_known"), "interval").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = rows.withColumns(
        {f"{n}_total": F.coalesce(F.sum(n).over(so_far), F.lit(0)).cast("decimal(38,0)") for n in TOTALS}
    ).where("not _known")
    return counted.select(
        *estimates.columns,
        S.joules("exact_nj_total").alias(metrics.COUNTERS[0]),
        metrics.grams(F.col("exact_mc_total")).alias(metrics.COUNTERS[1]),
        *[f"{n}_total" for n in TOTALS],
    )


def totals(counted: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last totals of each series of a micro-batch, as the next one takes them."""
    return counted.groupBy(*keys).agg(
        *[F.max_by(f"{n}_total", "interval").alias(n) for n in TOTALS],
        F.unix_millis(F.current_timestamp()).alias("seen_ms"),
    )


def summaries(estimates: DataFrame, window: str = "1 second") -> DataFrame:
    """System summary of every closed window as a stream: a second aggregate behind the merge.

    ``estimates`` are those of windows closed by :func:`pid_merge` with ``keep_time`` and have their
    ``container_id``.  The rows keep their event time.  A window's state is its sums and its set of containers.
    """
    containers_seen = F.collect_set(F.nullif("container_id", F.lit("")))
    grouped = estimates.groupBy(F.window(EVENT_TIME, window).alias("interval")).agg(
        *[c.alias(n) for n, c in views.summary_columns(F.size(containers_seen).cast("bigint")).items()]
    )
    return grouped.withColumn(EVENT_TIME, F.window_time("interval")).withColumn(
        "interval", F.col("interval.start").cast("timestamp_ntz")
    )


def topk(
    estimates: DataFrame, k: int = 10, keys: Sequence[str] = rollup.PROCESS, salts: int = SALTS
) -> DataFrame:
    """The k largest consumers of each closed window (:func:`wattframe.operators.views.topk`) as a stream.

    A window closes in one micro-batch.  Its rows are dealt over ``salts`` keys, each of which passes on its k
    largest, so one task never holds a window; the k of a window are then picked from k times ``salts`` rows.
    """
    rows = estimates.select("interval", *keys, "comm", "energy_nj", "energy_joules")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    columns, order = rows.columns, ["energy_nj", *keys]
    parts = dealt.groupBy("interval", "salt").transformWithStateInPandas(
        state.Largest(columns, order, k), rows.schema, "Append", "None"
    )
    ranked = StructType([*rows.schema.fields, StructField("rank", LongType())])
    whole = parts.groupBy("interval").transformWithStateInPandas(
        state.Largest(columns, order, k, "rank"), ranked, "Append", "None"
    )
    return whole.select("interval", "rank", *keys, "comm", "energy_joules")


def history(points: DataFrame, values: Sequence[str], keys: Sequence[str] = (), n: int = fixed.HISTORY_POINTS) -> DataFrame:
    """The last ``n`` points of each series whenever it gets new ones: ``points``, an array of (interval, values).

    ``points`` have an ``interval`` and one row per key and interval, as closed windows have.  Append mode.
    """
    keyed = points.select(*(keys or [F.lit("all").alias("series")]), S.micros("interval").alias("at_us"), *values)
    named = list(keys) or ["series"]
    point = StructType([keyed.schema["at_us"], *[keyed.schema[v] for v in values]])
    schema = StructType([*[keyed.schema[c] for c in named], StructField("points", ArrayType(point))])
    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in point)
    return keyed.groupBy(*named).transformWithStateInPandas(
        state.Tail(named, ["at_us", *values], held, n), schema, "Append", "None"
    )


def tail_rows(latest: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A history's points as rows."""
    rows = latest.select(*keys, F.explode("points").alias("p"))
    at = F.timestamp_micros("p.at_us").cast("timestamp_ntz").alias("interval")
    return rows.select(*keys, at, *[F.col(f"p.{v}").alias(v) for v in values])


def gauges(
    estimates: DataFrame, window: dt.timedelta, labels: Sequence[str] = (*rollup.PROCESS, "comm")
) -> DataFrame:
    """Gauges of each closed window, and a tombstone (``stale``, no values) for every series that the window
    before had and this one has not (:func:`wattframe.operators.metrics.gauge_latest` at each cycle).

    Each row is in two sliding windows: its own and the one before, and its own and the one after.  A pair of windows
    whose later half has no row gives the tombstone, once; nothing is held beyond that.  ``estimates`` are those of
    ``window`` and keep their event time.  Append mode.
    """
    width_us = window // dt.timedelta(microseconds=1)
    sliding = F.window(EVENT_TIME, f"{2 * width_us} microseconds", f"{width_us} microseconds").alias("pair")
    point = F.struct(S.micros("interval").alias("at_us"), *metrics.GAUGES)
    pairs = estimates.groupBy(sliding, *labels).agg(F.collect_list(point).alias("points"))
    later_us = S.micros(F.col("pair.start")) + width_us
    later = pairs.withColumn("at_us", later_us).withColumn(
        "shown", F.filter("points", lambda p: p["at_us"] == F.col("at_us"))
    )
    at = F.timestamp_micros("at_us").cast("timestamp_ntz").alias("interval")
    rows = later.select(at, *labels, F.explode_outer("shown").alias("p"))
    return rows.select("interval", *labels, *[F.col(f"p.{g}").alias(g) for g in metrics.GAUGES], F.col("p").isNull().alias("stale"))


def run_summary(
    vectors: DataFrame,
    path: str,
    checkpoint: str,
    ids: Callable[[], DataFrame],
    window: str = "1 second",
    trigger: Mapping[str, object] = sinks.AVAILABLE_NOW,
) -> StreamingQuery:
    """System summary of every closed window.

    Append mode releases all processes of a window in the same micro-batch, once the
    watermark has passed its end, so the batch operator sees whole windows.  ``ids`` is
    called in every micro-batch, so processes that are new since then are known.
    """
    closed = pid_merge(vectors, window)

    def summarise(batch: DataFrame, batch_id: int) -> None:
        known = containers.attach_container_id(batch, ids())
        est = energy.heuristic(known.withColumn("container_name", F.lit("")))
        sinks.write_batch(views.system_summary(est), path, batch_id)

    return sinks.for_each_batch(closed, summarise, checkpoint, "append", trigger)


def run_decode(
    segments: DataFrame,
    vectors_path: str,
    rejects_path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = sinks.AVAILABLE_NOW,
) -> StreamingQuery:
    """Captured segments decoded as they come: vectors into one folder, what is malformed into another.

    A reject keeps its raw bytes beside what its header says.  Both folders are written per micro-batch, so a
    replayed one overwrites itself in both.
    """
    frames = records.split_frames(segments)

    def route(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("probe").isNotNull()).withColumn("raw", F.col("data"))
        decoded = records.decode_records(known, keep=["raw"]).persist()
        try:
            sinks.write_batch(decoded.where("not malformed").drop("raw"), vectors_path, batch_id)
            torn = batch.where(F.col("probe").isNull()).select(F.col("data").alias("raw"), F.lit(True).alias("malformed"))
            rejects = decoded.where("malformed").unionByName(torn, allowMissingColumns=True)
            sinks.write_batch(rejects, rejects_path, batch_id)
        finally:
            decoded.unpersist()

    return sinks.for_each_batch(frames, route, checkpoint, "append", trigger)


def run_two_sinks(
    vectors: DataFrame,
    samples_path: str,
    feed_path: str,
    checkpoint: str,
    dimensions: Callable[[], tuple[DataFrame, DataFrame]],
    window: str = "1 second",
    estimate: Callable[[DataFrame], DataFrame] = energy.heuristic,
    trigger: Mapping[str, object] = sinks.AVAILABLE_NOW,
) -> StreamingQuery:
    """The live path: vectors merged per window, estimated, counted, named by their container
    and published as metric samples and as telemetry frames.

    ``dimensions`` gives the processes' container ids and the inventory.  It is called in
    every micro-batch, so a container started since the last one is seen.  ``estimate`` turns
    merged vectors into estimates (model, heuristic or one falling back on the other).  The counters'
    totals are a log per micro-batch beside the checkpoint, so a replayed batch starts from the same ones.
    """
    merged = estimate(pid_merge(vectors, window))
    log = f"{checkpoint}/totals"

    def publish(batch: DataFrame, batch_id: int) -> None:
        ids, inventory = dimensions()
        counted = with_counters(batch, sinks.latest_before(batch.sparkSession, log, batch_id, SERIES))
        est = containers.enrich(containers.attach_container_id(counted, ids), inventory).persist()
        try:
            sinks.log_batch(totals(est), log, batch_id, SERIES)
            samples.write_samples(est, f"{samples_path}/{sinks.BATCH}={batch_id}")
            telemetry.write_frames(est, f"{feed_path}/{sinks.BATCH}={batch_id}")
        finally:
            est.unpersist()

    return sinks.for_each_batch(merged, publish, checkpoint, "append", trigger)


def partial_stream(stream: DataFrame, heartbeats: DataFrame | None = None) -> DataFrame:
    """Event stream to partial vectors with event time."""
    return events.partial_vectors(with_event_time(stream, heartbeats=heartbeats))
