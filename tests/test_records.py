"""Record layout and decoding."""

from __future__ import annotations

import struct

import numpy as np

from wattframe.plans import fixture
from wattframe.sources.records import LAYOUTS as DTYPES
from wattframe.sources.records import decode_events, decode_records, with_time

LAYOUTS = {
    "cpu": ("<QIIII16sQIIq", 64),
    "mem": ("<QIIII16sQQQI4xQ", 80),
    "gpu": ("<QIIII16sQQII", 64),
}


def cpu(ts, pid, tgid, comm, delta, order="<"):
    return struct.pack(order + LAYOUTS["cpu"][0][1:], ts, pid, tgid, 0, 1, comm, delta, pid, 0, 0)


def test_sizes_and_offsets():
    assert {p: d.itemsize for p, d in DTYPES.items()} == {"cpu": 64, "mem": 80, "gpu": 64}
    for probe, (text, size) in LAYOUTS.items():
        assert struct.calcsize(text) == size
        values = tuple(b"abc" if c == "16s" else i + 1 for i, c in enumerate(
            text[1:].replace("4x", "").replace("16s", "s").replace("s", "S")) if c != "S")
        values = values[:5] + (b"abc",) + values[5:]
        row = np.frombuffer(struct.pack(text, *values), DTYPES[probe])[0]
        assert tuple(row.tolist()) == values


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "probe string, data binary")


def test_decode_each_probe(spark):
    mem = struct.pack(LAYOUTS["mem"][0], 7, 2, 3, 1, 0, b"mem", 1, 2, 1, 0, 0)
    gpu = struct.pack(LAYOUTS["gpu"][0], 8, 4, 5, 1, 0, b"exactly16bytes!!", 1, 2, 0, 0)
    rows = [("cpu", cpu(2**40, 2**31 + 5, 9, b"py\0junk", 2**33)), ("mem", mem), ("gpu", gpu)]
    got = {r.probe: r for r in decode_records(frame(spark, rows)).collect()}
    c = got["cpu"]
    assert (c.timestamp_ns, c.pid, c.tgid, c.comm, c.cpu_time_ns, c.ctx_switches) == (
        2**40, 2**31 + 5, 9, "py", 2**33, 1)
    m = got["mem"]
    assert (m.pid, m.comm, m.minor_faults, m.major_faults, m.cpu_time_ns) == (2, "mem", 1, 0, 0)
    g = got["gpu"]
    assert (g.pid, g.comm, g.gpu_jobs_submitted) == (4, "exactly16bytes!!", 1)
    assert not any(r.malformed for r in got.values())


def test_short_records(spark):
    full = cpu(1, 2, 3, b"x", 4)
    rows = [("cpu", full[:15]), ("cpu", full[:16]), ("cpu", full[:55]), ("cpu", full[:56]),
            ("mem", full[:39]), ("mem", full[:40]), ("gpu", full[:40]), ("other", full), ("cpu", b"")]
    loose = decode_records(frame(spark, rows)).collect()
    assert [(r.pid, r.ctx_switches, r.minor_faults, r.gpu_jobs_submitted, r.malformed) for r in loose] == [
        (0, 0, 0, 0, True), (2, 0, 0, 0, True), (2, 0, 0, 0, True), (2, 1, 0, 0, False),
        (2, 0, 0, 0, True), (2, 0, 1, 0, False), (2, 0, 0, 1, False), (2, 0, 0, 0, True), (0, 0, 0, 0, True)]
    assert loose[2].comm == "" and loose[3].cpu_time_ns == 4
    assert decode_records(frame(spark, rows), strict=True).count() == 7


def test_bad_utf8_and_big_endian(spark):
    rows = [("cpu", cpu(1, 2, 3, b"a\xff", 4))]
    assert decode_records(frame(spark, rows)).first().comm == "a�"
    rows = [("cpu", cpu(1, 2, 3, b"be", 4, order=">"))]
    got = decode_records(frame(spark, rows), byteorder=">").first()
    assert (got.timestamp_ns, got.pid, got.tgid, got.cpu_time_ns) == (1, 2, 3, 4)


def test_packed_records_have_the_right_sizes(spark, sf_dir):
    sizes = fixture.packed_records(spark, sf_dir).selectExpr("probe", "length(data) AS n").distinct().collect()
    assert {r.probe: r.n for r in sizes} == {"cpu": 64, "mem": 80, "gpu": 64}


def test_full_events(spark):
    big = 2**64 - 1
    mem = struct.pack(LAYOUTS["mem"][0], 7_001, 2, 3, 3, 5, b"m\0x", big, 1, 2**63, 4, 9)
    rows = [("mem", mem), ("mem", mem[:79]), ("cpu", cpu(1, 2, 3, b"c", 4))]
    rows += [("mem", mem[:40]), ("mem", mem[:39])]
    got = decode_events(frame(spark, rows), "mem").orderBy("malformed", "partial").collect()
    assert [(x.malformed, x.partial) for x in got] == [(False, False), (False, True), (False, True), (True, False)]
    r = got[0]
    assert (r.timestamp_ns, r.pid, r.tgid, r.cpu_id, r.comm, r.event_kind) == (7_001, 2, 3, 5, "m", "reclaim")
    assert (int(r.address), int(r.ip), int(r.gfp_flags), r.reclaim_order) == (big, 1, 9, 4)


def test_record_times_count_from_boot(spark):
    df = spark.createDataFrame([(1_999,)], "timestamp_ns bigint")
    r = with_time(df, boot_epoch_ns=5_000_000).first()
    assert r.ts_us == 5_001
