"""Captured binary records: to partial feature vectors, or to full events."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe import schemas
from wattframe.functions.scalar import nul_cut


def _layout(size: int, **fields: tuple[str, int]) -> np.dtype:
    names = list(fields)
    return np.dtype(
        {
            "names": names,
            "formats": [fields[n][0] for n in names],
            "offsets": [fields[n][1] for n in names],
            "itemsize": size,
        }
    )


# Record layouts (type, byte offset) and sizes, event type numbers, and the
# shortest record that still holds a probe's payload.
LAYOUTS = {
    "cpu": _layout(
        64, timestamp_ns=("u8", 0), pid=("u4", 8), tgid=("u4", 12), cpu_id=("u4", 16),
        event_type=("u4", 20), comm=("S16", 24), delta_ns=("u8", 40), prev_pid=("u4", 48),
        next_pid=("u4", 52), prev_state=("i8", 56),
    ),
    "mem": _layout(
        80, timestamp_ns=("u8", 0), pid=("u4", 8), tgid=("u4", 12), event_type=("u4", 16),
        cpu_id=("u4", 20), comm=("S16", 24), address=("u8", 40), ip=("u8", 48),
        error_code=("u8", 56), reclaim_order=("u4", 64), gfp_flags=("u8", 72),
    ),
    "gpu": _layout(
        64, timestamp_ns=("u8", 0), pid=("u4", 8), tgid=("u4", 12), event_type=("u4", 16),
        cpu_id=("u4", 20), comm=("S16", 24), job_id=("u8", 40), fence_id=("u8", 48),
        ring_id=("u4", 56), hw_job_count=("u4", 60),
    ),
}
EVENT_KINDS = {
    "cpu": {1: "switch", 2: "exec"},
    "mem": {1: "fault_user", 2: "fault_kernel", 3: "reclaim"},
    "gpu": {1: "gpu_submit"},
}
MIN_HEADER = 16
MIN_PAYLOAD = {"cpu": 56, "mem": 40, "gpu": 40}

# what all layouts share as far as partial vectors go; the slice is only read for CPU records
_HEADER = _layout(
    48, timestamp_ns=("u8", 0), pid=("u4", 8), tgid=("u4", 12), comm=("S16", 24), delta_ns=("u8", 40)
)
_FULL_RANGE = ("address", "ip", "gfp_flags", "job_id", "fence_id")  # unsigned 64 bit, kept exact as decimals


def _read(column: pa.Array, layout: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Record lengths, and the records as structured rows, zero-filled where too short."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    lengths = np.diff(offsets)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    width = layout.itemsize
    raw = np.concatenate([raw, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(raw, width)[offsets[:-1]]
    (short,) = np.nonzero(lengths < width)
    rows[short] *= np.arange(width) < lengths[short, None]
    return lengths, rows.view(layout).ravel()


def _names(raw: np.ndarray, present: np.ndarray) -> pa.Array:
    """Process names; :func:`~wattframe.functions.scalar.nul_cut` ends them at the first NUL."""
    names = pa.array(np.where(present, raw, b"").tolist(), pa.binary())
    try:
        return names.cast(pa.string())
    except pa.ArrowInvalid:  # some name is not UTF-8
        return pa.array([n.decode("utf-8", "replace") for n in names.to_pylist()], pa.string())


def _equal(column: pa.Array, value: str) -> np.ndarray:
    return pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)


Batches = Iterator[pa.RecordBatch]


def _vector_decoder(byteorder: str, strict: bool, keep: Sequence[str]) -> Callable[[Batches], Batches]:
    layout = _HEADER.newbyteorder(byteorder)

    def decode(stream: Batches) -> Batches:
        for batch in stream:
            lengths, rows = _read(batch.column("data"), layout)
            readable = lengths >= MIN_HEADER
            whole = {
                probe: _equal(batch.column("probe"), probe) & (lengths >= size)
                for probe, size in MIN_PAYLOAD.items()
            }
            payload = np.logical_or.reduce(list(whole.values()))
            number = lambda field, ok: np.where(ok, rows[field], 0).astype(np.int64)
            out = {
                **{name: batch.column(name) for name in keep},
                "probe": batch.column("probe"),
                "timestamp_ns": number("timestamp_ns", readable),
                "pid": number("pid", readable),
                "tgid": number("tgid", readable),
                "comm": _names(rows["comm"], payload),
                "cpu_time_ns": number("delta_ns", whole["cpu"]),
                "ctx_switches": whole["cpu"].astype(np.int64),
                "major_faults": np.zeros(len(rows), np.int64),
                "minor_faults": whole["mem"].astype(np.int64),
                "gpu_jobs_submitted": whole["gpu"].astype(np.int64),
                "gpu_active_ns": np.zeros(len(rows), np.int64),
                "malformed": ~payload,
            }
            decoded = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})
            yield decoded.filter(pa.array(readable)) if strict else decoded

    return decode


def _with_types(df: DataFrame, keep: Sequence[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def decode_records(
    df: DataFrame, strict: bool = False, byteorder: str = "<", keep: Sequence[str] = ()
) -> DataFrame:
    """Partial feature vectors from ``(probe, data)`` rows, a whole Arrow batch at a time.

    Records too short for their probe's payload keep the header and are marked
    ``malformed``.  Records too short for a header come out as an all-zero vector of process
    0, marked too; only ``strict`` drops them.  ``keep`` names columns to carry along.
    """
    decoded = df.select(*keep, "probe", "data").mapInArrow(
        _vector_decoder(byteorder, strict, tuple(keep)),
        _with_types(df, keep) + schemas.PARTIAL_VECTOR,
    )
    return decoded.withColumn("comm", nul_cut("comm"))


def _event_decoder(probe: str, byteorder: str, keep: Sequence[str]) -> Callable[[Batches], Batches]:
    layout = LAYOUTS[probe].newbyteorder(byteorder)

    def decode(stream: Batches) -> Batches:
        for batch in stream:
            lengths, rows = _read(batch.column("data"), layout)
            out = {name: batch.column(name) for name in keep}
            for name in layout.names:
                if name == "comm":
                    out[name] = _names(rows[name], np.ones(len(rows), bool))
                elif name in _FULL_RANGE:
                    out[name] = pa.array(rows[name].astype(np.uint64)).cast(pa.decimal128(20, 0))
                else:
                    out[name] = rows[name].astype(np.int64)
            out["malformed"] = lengths < MIN_PAYLOAD[probe]
            out["partial"] = (lengths >= MIN_PAYLOAD[probe]) & (lengths < layout.itemsize)
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    return decode


def decode_events(
    df: DataFrame, probe: str, byteorder: str = "<", keep: Sequence[str] = ()
) -> DataFrame:
    """Every field of one probe's records, with the event type as ``event_kind``.

    No record is left out: one that lacks trailing fields has zeros there and is marked
    ``partial``, one too short for its payload is marked ``malformed``.
    """
    types = {n: "decimal(20,0)" if n in _FULL_RANGE else "bigint" for n in LAYOUTS[probe].names}
    types |= {"comm": "string", "malformed": "boolean", "partial": "boolean"}
    decoded = df.where(F.col("probe") == probe).select(*keep, "data").mapInArrow(
        _event_decoder(probe, byteorder, tuple(keep)),
        _with_types(df, keep) + ", ".join(f"{n} {t}" for n, t in types.items()),
    )
    kind = F.lit(None).cast("string")
    for number, name in EVENT_KINDS[probe].items():
        kind = F.when(F.col("event_type") == number, name).otherwise(kind)
    return decoded.withColumns({"comm": nul_cut("comm"), "event_kind": kind, "probe": F.lit(probe)})


def with_time(decoded: DataFrame, boot_epoch_ns: int = 0) -> DataFrame:
    """Adds ``ts_us`` and ``ts``; record times count from boot, whose epoch time is given."""
    ns = F.col("timestamp_ns") + F.lit(int(boot_epoch_ns)).cast("bigint")
    timed = decoded.withColumn("_ns", ns).withColumn("ts_us", F.expr("_ns div 1000")).drop("_ns")
    return timed.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))


# A frame in a captured segment is its record's length (4 bytes, little-endian), the
# number of its probe (one byte) and the record.
FRAME_HEADER = np.dtype([("length", "<u4"), ("probe", "u1")])
PROBE_NUMBERS = {"cpu": 0, "mem": 1, "gpu": 2}


def split_frames(segments: DataFrame, content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """Captured segments (whole files, or blocks of them) as ``(probe, data)`` rows, in batches or on a stream.

    A frame that the segment's end cuts off, or whose probe has no number, comes out with the probe NULL and
    whatever bytes there are.  ``keep`` names columns to carry along.
    """
    names = {number: probe for probe, number in PROBE_NUMBERS.items()}
    size = FRAME_HEADER.itemsize

    def split(stream: Batches) -> Batches:
        for batch in stream:
            owner, probes, datas = [], [], []
            for i, segment in enumerate(batch.column(content).to_pylist()):
                at, end = 0, len(segment or b"")
                while at < end:
                    whole = at + size <= end
                    length, number = np.frombuffer(segment, FRAME_HEADER, 1, at)[0] if whole else (0, 255)
                    whole = whole and at + size + int(length) <= end
                    upto = at + size + int(length) if whole else end
                    probe = names.get(int(number)) if whole else None
                    owner.append(i)
                    probes.append(probe)
                    datas.append(segment[at + size : upto] if probe else segment[at:upto])
                    at = upto
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(rows) for c in keep], pa.array(probes, pa.string()), pa.array(datas, pa.binary())],
                [*keep, "probe", "data"],
            )

    return segments.select(*keep, content).mapInArrow(split, _with_types(segments, keep) + "probe string, data binary")


def stream_segments(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Captured files of a folder as a stream of segments (``path``, ``content``), each file once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select("path", "content")
