"""Process telemetry as deterministic views of the ``events`` table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.timeline import with_previous
from wattframe.sources import tables
from wattframe.sources.records import EVENT_KINDS, FRAME_HEADER, LAYOUTS, PROBE_NUMBERS

# Which event type stands for which probe event, and the process names.
KINDS = {"click": "switch", "signup": "exec", "view": "fault_user"}
PROBE_TYPES = {"cpu": ("click", "signup"), "mem": ("view", "error")}
NAMES = ("python3", "torch", "node", "postgres", "ollama", "nginx", "vllm", "bash")
REGIONS = ("us", "eu", "fr", "in", "cn")
KNOWN_CONTAINERS = 15
CONTAINERS = 20
SEGMENT_FRAMES = 200


def only_probe(events: DataFrame, probe: str) -> DataFrame:
    """Events of one probe, as a condition on a stored column, so it reaches the scan."""
    kind = F.col("event_type")
    if probe in PROBE_TYPES:
        return events.where(kind.isin(*PROBE_TYPES[probe]))
    taken = [t for types in PROBE_TYPES.values() for t in types]
    return events.where(kind.isNull() | ~kind.isin(*taken))


def telemetry(events: DataFrame) -> DataFrame:
    """Events seen as probe records of processes."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    probe_kind = F.when(kind == "error", F.when(F.col("k") % 10 == 0, "reclaim").otherwise("fault_kernel"))
    for event_type, name in KINDS.items():
        probe_kind = probe_kind.when(kind == event_type, name)
    name_at = F.element_at(
        F.array(*[F.lit(n) for n in NAMES]), ((user + F.col("k") % 2) % 8 + 1).cast("int")
    )
    region = F.coalesce(
        F.get(F.array(*[F.lit(r) for r in REGIONS]), (user % 7).cast("int")), F.lit("other")
    )
    return (
        events.withColumn("k", k)
        .withColumn("event_kind", probe_kind.otherwise("gpu_submit"))
        .select(
            "event_id",
            "ts",
            S.micros("ts").alias("ts_us"),
            (user % 4).alias("host_id"),
            user.alias("pid"),
            (user % 50).alias("tgid"),
            (F.col("event_id") % 4).alias("cpu_id"),
            "k",
            "event_kind",
            F.when(F.col("event_kind").isin("switch", "exec"), "cpu")
            .when(F.col("event_kind") == "gpu_submit", "gpu")
            .otherwise("mem")
            .alias("probe"),
            F.when(F.col("k") % 10 == 9, "").otherwise(name_at).alias("comm"),
            F.when(
                F.col("event_kind") == "switch",
                F.round(F.col("value") * 100).cast("bigint") * 10000,
            )
            .otherwise(F.lit(0).cast("bigint"))
            .alias("delta_ns"),
            (F.col("k") % 2).cast("bigint").alias("prev_state"),
            F.col("k").cast("bigint").alias("error_code"),
            region.alias("region"),
        )
    )


def tele(spark: SparkSession, sf_dir: str, probe: str | None = None) -> DataFrame:
    events = tables.read_events(spark, sf_dir)
    return telemetry(events if probe is None else only_probe(events, probe))


def sched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw context switches; an outgoing pid of -1 marks a lost event."""
    rows = with_previous(
        tele(spark, sf_dir), keys=["cpu_id"], order=["ts_us", "event_id"], values={"_before": "pid"}
    )
    return rows.select(
        "event_id", "ts", "ts_us", "cpu_id", "prev_state",
        F.col("pid").alias("next_pid"),
        F.when(F.col("k") % 20 == 0, F.lit(-1).cast("bigint"))
        .otherwise(F.coalesce("_before", F.lit(0).cast("bigint")))
        .alias("prev_pid"),
    )


def _processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct processes, straight from the stored column (one narrow scan)."""
    user = F.col("user_id")
    return (
        tables.read_events(spark, sf_dir)
        .select("user_id")
        .distinct()
        .select((user % 4).alias("host_id"), user.alias("pid"))
    )


def _full_id(c):
    text = c.cast("string")
    return F.concat(F.md5(F.concat(F.lit("c"), text)), F.md5(F.concat(F.lit("d"), text)))


def _cgroup_text(pid: Column, cid: Column) -> Column:
    path = (
        F.when(pid % 6 == 0, F.concat(F.lit("/docker/"), cid))
        .when(pid % 6 == 1, F.concat(F.lit("/kubepods.slice/cri-containerd-"), cid, F.lit(".scope")))
        .when(pid % 6 == 2, F.concat(F.lit("/machine.slice/libpod-"), cid, F.lit(".scope")))
        .when(pid % 6 == 3, F.concat(F.lit("/system.slice/svc-"), cid, F.lit(".scope")))
        .when(pid % 6 == 4, F.concat(F.lit("/custom/"), cid))
        .otherwise("/")
    )
    return F.concat(F.lit("0::/\n12:devices:"), path, F.lit("\n"))


def cgroup_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cgroup texts as they were read over time: a pid that is used again may sit in another container."""
    seen = tele(spark, sf_dir).where(F.col("k") % 5 == 2)
    cid = _full_id((F.col("pid") + F.col("event_id") % 3) % CONTAINERS)
    return seen.select(
        "event_id", "ts_us", "host_id", "pid", _cgroup_text(F.col("pid"), cid).alias("cgroup_text")
    )


def cgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured cgroup text and memory limit of each process."""
    pid = F.col("pid")
    limit = (
        F.when(pid % 4 == 0, "max")
        .when(pid % 4 == 1, "9223372036854771712")
        .when(pid % 4 == 2, " 536870912 ")
        .otherwise("1048576")
    )
    return (
        _processes(spark, sf_dir)
        .withColumn("cid", _full_id(pid % CONTAINERS))
        .select(
            "host_id",
            "pid",
            _cgroup_text(pid, F.col("cid")).alias("cgroup_text"),
            limit.alias("mem_limit_text"),
        )
    )


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("pid") % CONTAINERS
    return _processes(spark, sf_dir).select(c.alias("c")).distinct().where(F.col("c") < KNOWN_CONTAINERS)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container list as JSON documents; only some containers are known."""
    c = F.col("c")
    text = c.cast("string")
    labels = F.when(
        c % 2 == 0,
        F.concat(
            F.lit('"io.kubernetes.pod.name":"pod-'), text,
            F.lit('","io.kubernetes.pod.namespace":"ns-'), (c % 4).cast("string"), F.lit('"'),
        ),
    ).otherwise("")
    doc = F.concat(
        F.lit('[{"Id":"'), _full_id(c), F.lit('","Names":["/svc-'), text,
        F.lit('"],"Image":"img-'), (c % 3).cast("string"), F.lit('","Labels":{'), labels, F.lit("}}]"),
    )
    return _containers(spark, sf_dir).select("c", doc.alias("doc"))


def inventory_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per day of every known container."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    days = tables.read_events(spark, sf_dir).select(day.alias("snapshot_ts")).distinct()
    numbered = days.withColumn(
        "c", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(KNOWN_CONTAINERS)]))
    ).join(_containers(spark, sf_dir), ["c"], "left_semi")
    return numbered.select(
        "snapshot_ts",
        S.micros("snapshot_ts").alias("snapshot_us"),
        F.left(_full_id(F.col("c")), F.lit(12)).alias("short_id"),
        F.concat(
            F.lit("svc-"), F.col("c").cast("string"), F.lit("-"),
            F.date_format("snapshot_ts", "yyyy-MM-dd"),
        ).alias("name"),
    )


def calibration(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calibration rows: the published linear relation plus a bounded disturbance.  ``keep`` names columns of
    the events to carry along."""
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    features = tables.read_events(spark, sf_dir).select(
        "event_id",
        *keep,
        (F.round(F.col("value") * 100).cast("bigint") * 10000).cast("double").alias("cpu_time_ns"),
        (k + 1).cast("double").alias("ctx_switches"),
        ((u * 37) % 3700 + 800).cast("double").alias("cpu_freq_mhz"),
        ((e * 7) % 100).cast("double").alias("major_faults"),
        ((e * 31) % 49999).cast("double").alias("minor_faults"),
        (((e * 7919) % 7993) * 1000000 + 1000000).cast("double").alias("rss_bytes"),
        (((e * 104729) % 499) * 1000000).cast("double").alias("gpu_active_ns"),
    )
    clean = S.add([F.lit(c) * F.col(f) for f, c in fixed.CALIBRATED_COEFFICIENTS.items()])
    noise = ((e * 13) % 101 - 50).cast("double") / F.lit(10.0)
    return features.withColumn("energy_joules", clean + noise)


def model_registry(spark: SparkSession, sf_dir: str, interval: str = "1 hour") -> DataFrame:
    """Whether the model service was up, per interval: down for two hours out of five."""
    start = F.window("ts", interval)["start"]
    hours = tables.read_events(spark, sf_dir).select(start.alias("interval")).distinct()
    number = F.floor(S.micros("interval") / F.lit(3_600 * S.MICROS))
    return hours.withColumn("available", number % 5 < 3)


_TYPE_NUMBERS = {kind: n for kinds in EVENT_KINDS.values() for n, kind in kinds.items()}


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layouts = {probe: layout.newbyteorder("<") for probe, layout in LAYOUTS.items()}
    widest = max(layout.itemsize for layout in layouts.values())
    for batch in stream:
        columns = {
            name: batch.column(name).to_numpy(zero_copy_only=False)
            for name in ("ts_us", "pid", "tgid", "cpu_id", "delta_ns", "prev_state", "error_code")
        }
        columns["timestamp_ns"] = columns.pop("ts_us") * 1000
        columns["comm"] = np.array(batch.column("comm").cast(pa.binary()).to_pylist(), "S16")
        kinds = batch.column("event_kind")
        columns["event_type"] = np.zeros(len(kinds), np.int64)
        for kind, number in _TYPE_NUMBERS.items():
            columns["event_type"][pc.equal(kinds, kind).to_numpy(zero_copy_only=False)] = number
        padded = np.zeros((len(kinds), widest), np.uint8)
        sizes = np.zeros(len(kinds), np.int64)
        for probe, layout in layouts.items():
            at = pc.equal(batch.column("probe"), probe).to_numpy(zero_copy_only=False)
            rows = np.zeros(at.sum(), layout)
            for name in layout.names:
                if name in columns:
                    rows[name] = columns[name][at]
            padded[at, : layout.itemsize] = rows.view(np.uint8).reshape(len(rows), layout.itemsize)
            sizes[at] = layout.itemsize
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        packed = padded[np.arange(widest) < sizes[:, None]]
        data = pa.Array.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
        )
        yield pa.RecordBatch.from_pydict(
            {
                "host_id": batch.column("host_id"),
                "event_id": batch.column("event_id"),
                "probe": batch.column("probe"),
                "data": data,
            }
        )


def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry as the binary records a probe would have written."""
    rows = tele(spark, sf_dir).select(
        "host_id", "event_id", "probe", "event_kind", "ts_us", "pid", "tgid", "cpu_id", "comm",
        "delta_ns", "prev_state", "error_code",
    )
    return rows.mapInArrow(_pack, "host_id bigint, event_id bigint, probe string, data binary")


def _segments(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        frames = []
        for probe, data in zip(batch.column("probe").to_pylist(), batch.column("data").to_pylist()):
            head = np.array([(len(data), PROBE_NUMBERS[probe])], FRAME_HEADER)
            frames.append(head.tobytes() + data)
        blocks = [b"".join(frames[i : i + SEGMENT_FRAMES]) for i in range(0, len(frames), SEGMENT_FRAMES)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["content"])


def captured_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed records, cut at lengths around every limit, as the segments a capture writes."""
    packed = packed_records(spark, sf_dir)
    kept = (F.col("event_id") % 12 * 7).cast("int")
    return packed.select("probe", F.substring("data", F.lit(1), kept).alias("data")).mapInArrow(
        _segments, "content binary"
    )
