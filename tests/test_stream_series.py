"""Streams of closed windows: summaries, top consumers, history, gauges; captured files and feeds."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_streaming import add, same, split, stream
from wattframe.operators import containers, energy, metrics, views
from wattframe.plans import attribution as A
from wattframe.plans import fixture
from wattframe.sources import records, tables, telemetry
from wattframe.streaming import jobs, sinks

LAST = dt.datetime(2100, 1, 1)
HOUR = dt.timedelta(hours=1)
VALUES = ["total_energy_joules", "total_power_watts", "total_carbon_grams_co2"]


def closed(spark, folder, beat):
    tables.heartbeat(spark, f"{folder}/beats", beat)
    vectors = jobs.partial_stream(stream(spark, folder), tables.stream_heartbeats(spark, f"{folder}/beats"))
    return energy.heuristic(jobs.pid_merge(vectors, "1 hour", keep_time=True))


def over_restarts(spark, sf_dir, folder, run, parts=3):
    """``run`` once per part of the events, then with a last heartbeat."""
    for i, part in enumerate(split(spark, sf_dir, folder, parts)):
        add(part, folder, i)
        run(None)
    return run(LAST)


def test_summaries_and_history_over_restarts_equal_the_batch(spark, sf_dir, folder):
    def run(beat):
        located = containers.attach_container_id(closed(spark, folder, beat), A.process_containers(spark, sf_dir))
        whole = jobs.summaries(located, "1 hour")
        sinks.changelog(jobs.history(whole, VALUES), f"{folder}/tail", f"{folder}/check", "append", keys=["series"])
        return sinks.latest(spark, f"{folder}/tail", ["series"])

    got = over_restarts(spark, sf_dir, folder, run)
    want = views.history_tail(views.system_summary(A.estimates(spark, sf_dir)))
    same(views.history_tail(jobs.tail_rows(got, VALUES)), want)
    assert [len(r.points) for r in got.collect()] == [14]


@pytest.mark.parametrize("salts", [1, 5])
def test_top_consumers_over_restarts_equal_the_batch(spark, sf_dir, folder, salts):
    def run(beat):
        top = jobs.topk(closed(spark, folder, beat), k=2, salts=salts)
        sinks.append_files(top, f"{folder}/out", f"{folder}/check")
        return spark.read.schema(top.schema).parquet(f"{folder}/out")

    got = over_restarts(spark, sf_dir, folder, run)
    same(got, views.topk(energy.heuristic(A.vectors(spark, sf_dir)), k=2))


def test_gauges_are_those_of_each_cycle_and_stale_ones_say_so(spark, sf_dir, folder):
    def run(beat):
        shown = jobs.gauges(closed(spark, folder, beat), HOUR)
        sinks.append_files(shown, f"{folder}/out", f"{folder}/check")
        return spark.read.schema(shown.schema).parquet(f"{folder}/out")

    got = over_restarts(spark, sf_dir, folder, run).persist()
    est = energy.heuristic(A.vectors(spark, sf_dir)).withColumns({"container_id": F.lit(""), "container_name": F.lit("")})
    labels = ["host_id", "pid", "comm"]
    cycles = sorted(r[0] for r in est.select("interval").distinct().collect())
    for now in (cycles[0], cycles[len(cycles) // 2], cycles[-1]):
        latest = metrics.gauge_latest(est.where(F.col("interval") <= F.lit(now)), labels)
        same(got.where((F.col("interval") == F.lit(now)) & ~F.col("stale")).drop("stale"), latest.drop(metrics.AI_GAUGE))
    rows = {(r.host_id, r.pid, r.comm, r.interval): r.stale for r in got.collect()}
    live = {k for k, stale in rows.items() if not stale}
    assert {k for k, stale in rows.items() if stale} == {(h, p, c, t + HOUR) for h, p, c, t in live} - live
    assert all(r.energy_joules is None for r in got.where("stale").collect())


# --- captured files ----------------------------------------------------------------


def frame(probe, data):
    return np.array([(len(data), records.PROBE_NUMBERS[probe])], records.FRAME_HEADER).tobytes() + data


def test_frames_of_a_segment(spark):
    segments = [
        ("a", frame("cpu", b"x" * 64) + frame("mem", b"") + frame("gpu", b"z")),
        ("b", frame("cpu", b"x" * 64)[:-1]),
        ("c", frame("cpu", b"q") + b"\x01\x02"),
        ("d", np.array([(1, 9)], records.FRAME_HEADER).tobytes() + b"?" + frame("mem", b"m")),
        ("e", b""), ("f", None),
    ]
    df = spark.createDataFrame(segments, "name string, content binary")
    got = [(r.name, r.probe, bytes(r.data)) for r in records.split_frames(df.repartition(1), keep=["name"]).collect()]
    assert sorted(got, key=repr) == sorted([
        ("a", "cpu", b"x" * 64), ("a", "mem", b""), ("a", "gpu", b"z"), ("b", None, frame("cpu", b"x" * 64)[:-1]),
        ("c", "cpu", b"q"), ("c", None, b"\x01\x02"), ("d", None, b"\x01\x00\x00\x00\x09?"), ("d", "mem", b"m"),
    ], key=repr)


def test_captured_files_are_decoded_once_whatever_restarts(spark, sf_dir, folder):
    import os

    packed = fixture.packed_records(spark, sf_dir).select("probe", "data").limit(300).collect()
    os.makedirs(f"{folder}/captured")
    for i in range(3):
        with open(f"{folder}/captured/part{i}.rec", "wb") as out:
            out.write(b"".join(frame(r.probe, bytes(r.data)) for r in packed[100 * i : 100 * i + 100]) + b"\x00" * i)
        segments = records.stream_segments(spark, f"{folder}/captured", files_per_trigger=1)
        jobs.run_decode(segments, f"{folder}/vectors", f"{folder}/rejects", f"{folder}/check")
    got = spark.read.parquet(f"{folder}/vectors").drop(sinks.BATCH)
    want = records.decode_records(spark.createDataFrame([(r.probe, r.data) for r in packed], "probe string, data binary"))
    same(got, want)
    rejects = spark.read.parquet(f"{folder}/rejects").collect()
    assert sorted(bytes(r.raw) for r in rejects) == [b"\x00", b"\x00\x00"] and all(r.probe is None for r in rejects)


# --- feeds -------------------------------------------------------------------------


def test_frames_that_are_sent_again_come_out_once(spark, sf_dir, folder):
    lines = [r.value for r in telemetry.frames(A.estimates(spark, sf_dir)).select("value").limit(12).collect()]
    greeting, cut_off = '{"type":"connected","message":"x"}', lines[0][:50]

    def run(values):
        spark.createDataFrame([(v,) for v in values], "value string").write.mode("append").text(f"{folder}/feed")
        feed = spark.readStream.schema("value string").text(f"{folder}/feed")
        frames, unreadable = telemetry.parse_stream(feed, "10 seconds", replayed_within="60 days")
        sinks.append_files(frames, f"{folder}/frames", f"{folder}/check")
        sinks.append_files(unreadable, f"{folder}/bad", f"{folder}/check-bad")
        return spark.read.schema(frames.schema).parquet(f"{folder}/frames"), spark.read.schema("value string").parquet(f"{folder}/bad")

    run([*lines[:8], lines[0], greeting, cut_off])
    frames, bad = run([*lines[4:], lines[9], greeting, "", "no json"])
    want = telemetry.parse(spark.createDataFrame([(v,) for v in lines], "value string"))
    same(frames.select(*want.columns), want)
    assert sorted(r.value for r in bad.collect()) == sorted([cut_off, "", "no json"])
