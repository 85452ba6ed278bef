"""Event-level operators: normalise captured events, classify them, derive CPU slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import scalar as S
from wattframe.operators.timeline import HOT_ROWS, with_previous

def _long(value):
    return F.lit(value).cast("bigint")


def partial_vectors(df: DataFrame) -> DataFrame:
    """One partial feature vector per captured event, as the event-stream path counts them.

    CPU records carry their slice and count as one switch, memory records count as one
    minor fault whatever they are, GPU records count as one submitted job.
    """
    probe = F.col("probe")
    one_if = lambda name: F.when(probe == name, _long(1)).otherwise(_long(0))
    passed = [c for c in df.columns if c in _KEPT]
    return df.select(
        *passed,
        F.when(probe == "cpu", F.col("delta_ns")).otherwise(_long(0)).alias("cpu_time_ns"),
        one_if("cpu").alias("ctx_switches"),
        _long(0).alias("major_faults"),
        one_if("mem").alias("minor_faults"),
        one_if("gpu").alias("gpu_jobs_submitted"),
        _long(0).alias("gpu_active_ns"),
    )


_KEPT = (
    "event_id", "ts", "ts_us", "event_time", "host_id", "pid", "tgid", "probe", "comm", "region",
)


def with_fault_classes(df: DataFrame) -> DataFrame:
    """Adds the class of memory events to events of all probes; a reclaim is neither a major nor a minor fault."""
    kind = F.col("event_kind")
    major = S.is_major_fault("event_kind", "error_code")
    return df.withColumns(
        {
            "is_major": S.is_fault(kind) & major,
            "is_minor": S.is_fault(kind) & ~major,
            "is_reclaim": kind == "reclaim",
        }
    )


def classify_faults(df: DataFrame) -> DataFrame:
    """Memory events with their class."""
    return with_fault_classes(df.where(F.col("probe") == "mem"))


def split_pid_tgid(df: DataFrame, packed: str = "pid_tgid") -> DataFrame:
    """Low half of the packed id is the thread, high half the process."""
    return df.withColumns({"pid": S.pid_of(packed), "tgid": S.tgid_of(packed)})


def cpu_slices(
    sched: DataFrame,
    keys: Sequence[str] = ("host_id", "cpu_id"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Time on CPU from raw context switches.

    The outgoing task is charged the time since the previous switch on that CPU, but only
    if that switch is the one that brought it in; otherwise an event was lost and nothing
    is charged.
    """
    seen = with_previous(
        sched,
        keys=keys,
        order=["ts_us", "event_id"],
        values={"since_us": "ts_us", "running_pid": "next_pid"},
        hot_rows=hot_rows,
    )
    charged = (F.col("running_pid") == F.col("prev_pid")) & (F.col("since_us") > 0)
    return seen.where(charged).select(
        "event_id",
        "ts",
        "ts_us",
        *keys,
        F.col("prev_pid").alias("pid"),
        ((F.col("ts_us") - F.col("since_us")) * 1000).alias("delta_ns"),
        "prev_state",
        S.is_involuntary("prev_state").alias("involuntary"),
    )
