"""Per-process rollups.  A process is (host, pid): pids repeat across hosts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.joins import lookup_join

PROCESS = ("host_id", "pid")
ORDER = ("ts_us", "event_id")
COUNTERS = (
    "cpu_time_ns",
    "ctx_switches",
    "major_faults",
    "minor_faults",
    "gpu_jobs_submitted",
    "gpu_active_ns",
)

_SEGMENT_SUMS = (
    "total_cpu_time_ns",
    "ctx_switches",
    "voluntary_ctx_switches",
    "involuntary_ctx_switches",
)


def _order() -> Column:
    return F.struct(*ORDER)


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def _groups(window: str | None, keys: Sequence[str], time: str) -> list[Column]:
    groups = [F.col(k) for k in keys]
    if window is not None:
        groups.insert(0, F.window(time, window)["start"].alias("interval"))
    return groups


def pid_merge(
    vectors: DataFrame,
    window: str | None = "1 second",
    keys: Sequence[str] = PROCESS,
    time: str = "ts",
) -> DataFrame:
    """Partial vectors merged per process and tumbling window: sums, the last non-empty
    command name, the latest time.

    Two aggregates: the first also groups by name, so all it keeps are numbers and it runs
    as a hash aggregate that reduces a hot process to a few rows per map task and window;
    picking the last name is left to the second, which only sees those.
    """
    groups = ["interval", *keys] if window is not None else list(keys)
    named = vectors.groupBy(*_groups(window, keys, time), "comm").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.max("ts_us").alias("_last_us"),
        F.max(S.position(ORDER)).alias("_last"),
    )
    return named.groupBy(*groups).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        _last_name(F.col("_last")),
        (F.max("_last_us") * 1000).alias("timestamp_ns"),
    )


def pid_merge_single(
    vectors: DataFrame,
    window: str = "1 second",
    keys: Sequence[str] = PROCESS,
    time: str = "ts",
    keep_time: bool = False,
) -> DataFrame:
    """:func:`pid_merge` as one aggregate, for streams: one state store, any output mode.

    With ``keep_time`` the rows keep their event time (the window's), for stateful steps that follow.
    """
    merged = vectors.groupBy(F.window(time, window).alias("interval"), *keys).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        _last_name(S.position(ORDER)),
        (F.max("ts_us") * 1000).alias("timestamp_ns"),
    )
    if keep_time:
        merged = merged.withColumn(time, F.window_time("interval"))
    return merged.withColumn("interval", F.col("interval.start"))


def _last_name(place: Column) -> Column:
    named = F.when(F.col("comm") != "", place)
    return F.coalesce(F.max_by("comm", named), F.lit("")).alias("comm")


def _first_name() -> Column:
    return F.min_by("comm", F.col("_first")).alias("comm")


def cpu_stats(switches: DataFrame, keys: Sequence[str] = PROCESS) -> DataFrame:
    """Kernel-side CPU statistics from context-switch rows (no exec reset)."""
    place = S.position(ORDER)
    named = switches.groupBy(*keys, "comm").agg(
        F.sum("delta_ns").alias("total_cpu_time_ns"),
        _count(F.lit(True)).alias("ctx_switches"),
        _count(~S.is_involuntary("prev_state")).alias("voluntary_ctx_switches"),
        _count(S.is_involuntary("prev_state")).alias("involuntary_ctx_switches"),
        F.max_by("cpu_id", place).alias("last_cpu_id"),
        F.max("ts_us").alias("_last_us"),
        F.max(place).alias("_last"),
        F.min(place).alias("_first"),
    )
    return named.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SEGMENT_SUMS],
        F.max_by("last_cpu_id", "_last").alias("last_cpu_id"),
        (F.max("_last_us") * 1000).alias("last_seen_ns"),
        _first_name(),
    )


def mem_stats(faults: DataFrame, keys: Sequence[str] = PROCESS) -> DataFrame:
    """Kernel-side memory statistics from classified memory events.

    Each minor fault stands for one new resident page.  A reclaim moves the last-fault
    time only when it is what created the process's entry.
    """
    fault = F.col("is_major") | F.col("is_minor")
    named = faults.groupBy(*keys, "comm").agg(
        _count(F.col("is_major")).alias("major_faults"),
        _count(F.col("is_minor")).alias("minor_faults"),
        _count(fault).alias("total_faults"),
        _count(F.col("is_reclaim")).alias("direct_reclaim_count"),
        F.max(F.when(fault, F.col("ts_us"))).alias("_last_fault_us"),
        F.min(F.when(F.col("is_reclaim"), F.col("ts_us"))).alias("_first_reclaim_us"),
        F.min(S.position(ORDER)).alias("_first"),
    )
    sums = ("major_faults", "minor_faults", "total_faults", "direct_reclaim_count")
    last_us = F.coalesce(F.max("_last_fault_us"), F.min("_first_reclaim_us"))
    return named.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        (last_us * 1000).alias("last_fault_ns"),
        F.sum("minor_faults").alias("estimated_rss_pages"),
        _first_name(),
    )


def gpu_stats(submits: DataFrame, keys: Sequence[str] = PROCESS) -> DataFrame:
    """Kernel-side GPU statistics.  Completions are never recorded, so no job ever ends."""
    zero = F.lit(0).cast("bigint")
    named = submits.groupBy(*keys, "comm").agg(
        _count(F.lit(True)).alias("total_jobs_submitted"),
        F.max("ts_us").alias("_last_us"),
        F.min(S.position(ORDER)).alias("_first"),
    )
    return named.groupBy(*keys).agg(
        F.sum("total_jobs_submitted").alias("total_jobs_submitted"),
        zero.alias("total_gpu_active_ns"),
        (F.max("_last_us") * 1000).alias("last_submit_ns"),
        zero.alias("last_complete_ns"),
        F.sum("total_jobs_submitted").alias("active_jobs"),
        _first_name(),
    )


def exec_segments(
    cpu_events: DataFrame,
    keys: Sequence[str] = PROCESS,
) -> DataFrame:
    """The CPU statistics of each process since its last exec, with the order bounds that
    make two such rows mergeable (``reset`` is the exec's position, NULL if there was none).

    Exec restarts the counters, so only rows from a process's last exec on count.  No order
    is needed for that: the last exec of each process is a map-side-combined maximum over the
    exec rows alone, and the rows from it on are added up.
    """
    position = _order()
    execs = (
        cpu_events.where(F.col("event_kind") == "exec").groupBy(*keys).agg(F.max(position).alias("reset"))
    )
    switch = F.col("event_kind") == "switch"
    involuntary = S.is_involuntary("prev_state")
    per_name = (
        lookup_join(cpu_events, execs, keys)
        .where(F.col("reset").isNull() | (position >= F.col("reset")))
        .groupBy(*keys, "comm")  # numbers alone are left, so it runs as a hash aggregate
        .agg(
            F.max("reset").alias("reset"),
            F.sum(F.when(switch, F.col("delta_ns")).otherwise(0)).alias("total_cpu_time_ns"),
            _count(switch).alias("ctx_switches"),
            _count(switch & ~involuntary).alias("voluntary_ctx_switches"),
            _count(switch & involuntary).alias("involuntary_ctx_switches"),
            F.min(position).alias("first_order"),
            F.max(position).alias("last_order"),
            F.max_by("cpu_id", position).alias("last_cpu_id"),
        )
    )
    return per_name.groupBy(*keys).agg(
        F.max("reset").alias("reset"),
        *[F.sum(c).alias(c) for c in _SEGMENT_SUMS],
        F.min_by("comm", "first_order").alias("comm"),
        F.max_by("last_cpu_id", "last_order").alias("last_cpu_id"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
    )


def step_segments(
    cpu_events: DataFrame,
    time: str,
    step: str = "1 second",
    keys: Sequence[str] = PROCESS,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """What each step of time adds to a process's CPU statistics, for streams: one aggregate.

    An exec may be seen after rows that follow it, so a step's rows are kept until the step
    is closed and are put in order then.  A group is the rows of one process in one step,
    which a host's clock bounds; a busy process is spread over its steps.  ``also`` are further
    aggregates of the same groups, which may then hold rows of other probes.
    """
    also = dict(also or {})
    row = F.struct("ts_us", "event_id", "event_kind", "prev_state", "delta_ns", "comm", "cpu_id")
    of_cpu = F.when(F.col("event_kind").isin("switch", "exec"), row)
    steps = cpu_events.groupBy(F.window(time, step).alias("step"), *keys).agg(
        F.sort_array(F.collect_list(of_cpu)).alias("_rows"), *[v.alias(n) for n, v in also.items()]
    )
    place = lambda r: F.struct(r["ts_us"], r["event_id"])
    is_exec = lambda r: r["event_kind"].eqNullSafe("exec")
    is_switch = lambda r: r["event_kind"].eqNullSafe("switch")
    involuntary = lambda r: F.coalesce(S.is_involuntary(r["prev_state"]), F.lit(False))
    voluntary = lambda r: F.coalesce(~S.is_involuntary(r["prev_state"]), F.lit(False))
    count = lambda test: F.size(F.filter("_kept", test)).cast("bigint")
    cpu_time = F.aggregate(
        F.filter("_kept", is_switch),
        F.lit(0).cast("bigint"),
        lambda total, r: total + F.coalesce(r["delta_ns"], F.lit(0).cast("bigint")),
    )
    last = F.get("_kept", F.size("_kept") - 1)
    return (
        steps.withColumn("_reset", F.array_max(F.transform(F.filter("_rows", is_exec), place)))
        .withColumn(
            "_kept",
            F.filter("_rows", lambda r: F.col("_reset").isNull() | (place(r) >= F.col("_reset"))),
        )
        .select(
            *keys,
            F.col("_reset").isNotNull().alias("had_exec"),
            cpu_time.alias("total_cpu_time_ns"),
            count(is_switch).alias("ctx_switches"),
            count(lambda r: is_switch(r) & voluntary(r)).alias("voluntary_ctx_switches"),
            count(lambda r: is_switch(r) & involuntary(r)).alias("involuntary_ctx_switches"),
            last["cpu_id"].cast("bigint").alias("last_cpu_id"),
            (last["ts_us"] * 1000).alias("last_seen_ns"),
            F.get("_kept", F.lit(0))["comm"].alias("comm"),
            *(("step", *also) if also else ()),
        )
    )


def step_stats(
    classified: DataFrame, time: str, step: str = "1 second", keys: Sequence[str] = PROCESS
) -> DataFrame:
    """What each step adds to a process's CPU, memory and GPU statistics: events of all probes, classified
    (:func:`wattframe.operators.events.classify_faults`), in one aggregate.  No column is NULL."""
    kind = F.col("event_kind")
    is_mem, is_gpu = kind.isin("fault_user", "fault_kernel", "reclaim"), kind == "gpu_submit"
    major, minor, reclaim = (is_mem & F.col(c) for c in ("is_major", "is_minor", "is_reclaim"))
    fault = major | minor
    place = F.struct(*ORDER)
    first = lambda test: F.min_by(F.when(test, F.col("comm")), F.when(test, place))
    steps = step_segments(
        classified, time, step, keys,
        also={
            "cpu_rows": _count(kind.isin("switch", "exec")), "mem_rows": _count(is_mem), "jobs": _count(is_gpu),
            "major_faults": _count(major), "minor_faults": _count(minor), "total_faults": _count(fault),
            "direct_reclaim_count": _count(reclaim), "last_fault_us": F.max(F.when(fault, F.col("ts_us"))),
            "first_reclaim_us": F.min(F.when(reclaim, F.col("ts_us"))), "mem_comm": first(is_mem),
            "last_submit_us": F.max(F.when(is_gpu, F.col("ts_us"))), "gpu_comm": first(is_gpu),
        },
    )
    whole = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    counts = ("jobs", "major_faults", "minor_faults", "total_faults", "direct_reclaim_count")
    return steps.select(
        *keys,
        S.micros(F.col("step.start")).alias("step_us"),
        (F.col("cpu_rows") > 0).alias("has_cpu"), (F.col("mem_rows") > 0).alias("has_mem"), (F.col("jobs") > 0).alias("has_gpu"),
        "had_exec", *[whole(c) for c in (*_SEGMENT_SUMS, "last_cpu_id", "last_seen_ns", *counts)],
        *[whole(c) for c in ("last_fault_us", "first_reclaim_us", "last_submit_us")],
        text("comm", "cpu_comm"), text("mem_comm", "mem_comm"), text("gpu_comm", "gpu_comm"),
    )


def segment_stats(segments: DataFrame, keys: Sequence[str] = PROCESS) -> DataFrame:
    """Segments in the layout of :func:`cpu_stats`."""
    return segments.select(
        *keys,
        *_SEGMENT_SUMS,
        "last_cpu_id",
        (F.col("last_order.ts_us") * 1000).alias("last_seen_ns"),
        "comm",
    )


def cpu_stats_exec_reset(
    cpu_events: DataFrame,
    keys: Sequence[str] = PROCESS,
) -> DataFrame:
    """CPU statistics that restart at each exec; a process that just did one shows zeros."""
    return segment_stats(exec_segments(cpu_events, keys), keys)


def feature_snapshot(
    cpu: DataFrame, mem: DataFrame, gpu: DataFrame, keys: Sequence[str] = PROCESS
) -> DataFrame:
    """Full outer join of the three statistics tables, one row per process.

    Each side is one row per key and already partitioned by it, so the first join moves
    nothing; its result, one row per process, moves once for the second.  Missing numbers
    are 0; the name is the CPU side's, else memory's, never the GPU's; only CPU rows carry a
    time.
    """
    c = cpu.withColumnRenamed("comm", "_cpu_comm")
    m = mem.withColumnRenamed("comm", "_mem_comm")
    joined = c.join(m, list(keys), "full").join(gpu.drop("comm"), list(keys), "full")
    return snapshot_row(joined, keys)


def snapshot_row(stats: DataFrame, keys: Sequence[str] = PROCESS) -> DataFrame:
    """Feature vectors from rows that hold all three statistics of a process; missing ones are NULL."""
    zero = F.lit(0).cast("bigint")
    value = lambda name: F.coalesce(F.col(name), zero)
    return stats.select(
        *keys,
        F.coalesce(
            F.nullif("_cpu_comm", F.lit("")), F.col("_mem_comm"), F.lit("")
        ).alias("comm"),
        value("total_cpu_time_ns").alias("cpu_time_ns"),
        value("ctx_switches").alias("ctx_switches"),
        value("voluntary_ctx_switches").alias("voluntary_ctx_switches"),
        value("involuntary_ctx_switches").alias("involuntary_ctx_switches"),
        zero.alias("cpu_freq_mhz"),
        value("last_cpu_id").alias("cpu_id"),
        value("major_faults").alias("major_faults"),
        value("minor_faults").alias("minor_faults"),
        (value("estimated_rss_pages") * fixed.PAGE_BYTES).alias("rss_bytes"),
        value("direct_reclaim_count").alias("direct_reclaim_count"),
        value("total_jobs_submitted").alias("gpu_jobs_submitted"),
        value("total_gpu_active_ns").alias("gpu_active_ns"),
        value("last_seen_ns").alias("timestamp_ns"),
    )
