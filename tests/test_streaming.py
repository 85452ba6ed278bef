"""Streams over several micro-batches, restarts and late rows, against the batch operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattframe.operators import energy, events, metrics, rollup, views
from wattframe.plans import fixture
from wattframe.sources import samples, tables, telemetry
from wattframe.streaming import jobs, sinks


def split(spark, sf_dir, folder, parts=5):
    """The event table as one file per stretch of time, written in order."""
    rows = tables.read_events(spark, sf_dir)
    bounds = rows.approxQuantile("event_id", [i / parts for i in range(parts + 1)], 0.0)
    paths = []
    for i in range(parts):
        upper = F.col("event_id") < bounds[i + 1] if i + 1 < parts else F.lit(True)
        lower = F.col("event_id") >= bounds[i] if i else F.lit(True)
        paths.append(rows.where(lower & upper))
    return paths


def add(df, folder, i):
    staged = f"{folder}/staged{i}"
    df.coalesce(1).write.parquet(staged)
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/in", exist_ok=True)
    (part,) = glob.glob(f"{staged}/part-*.parquet")
    shutil.copy(part, f"{folder}/in/events{i}.parquet")


def stream(spark, folder, probe=None):
    source = tables.stream_events(spark, f"{folder}/in", files_per_trigger=1)
    return fixture.telemetry(source if probe is None else fixture.only_probe(source, probe))


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    rows = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert rows(a) == rows(b)


@pytest.fixture()
def feed(spark, sf_dir, folder):
    for i, part in enumerate(split(spark, sf_dir, folder)):
        add(part, folder, i)
    return folder


def test_merge_over_batches_equals_batch(spark, sf_dir, feed):
    merged = jobs.pid_merge(jobs.partial_stream(stream(spark, feed)), "1 hour")
    sinks.changelog(merged, f"{feed}/out", f"{feed}/check")
    want = rollup.pid_merge(events.partial_vectors(fixture.tele(spark, sf_dir)), "1 hour")
    same(sinks.latest(spark, f"{feed}/out", ["interval", "host_id", "pid"]), want)


def test_counters_survive_a_restart(spark, sf_dir, folder):
    parts = split(spark, sf_dir, folder, 2)
    labels = ["host_id", "pid", "comm"]

    def run():
        est = jobs.scored(events.partial_vectors(stream(spark, folder)))
        sinks.changelog(jobs.counters(est, labels), f"{folder}/out", f"{folder}/check")
        return sinks.latest(spark, f"{folder}/out", labels)

    add(parts[0], folder, 0)
    first = {tuple(r)[:3]: r[metrics.COUNTERS[0]] for r in run().collect()}
    add(parts[1], folder, 1)
    second = run()
    after = {tuple(r)[:3]: r[metrics.COUNTERS[0]] for r in second.collect()}
    assert all(after[k] >= v for k, v in first.items())
    est = energy.heuristic(events.partial_vectors(fixture.tele(spark, sf_dir)))
    same(second, jobs.counters(est, labels))


def run_exec_reset(spark, folder, beat=None):
    tables.heartbeat(spark, f"{folder}/beats", beat)
    timed = jobs.with_event_time(
        stream(spark, folder, "cpu"), heartbeats=tables.stream_heartbeats(spark, f"{folder}/beats")
    )
    out = jobs.exec_reset(timed)
    sinks.changelog(out, f"{folder}/out", f"{folder}/check", "append", keys=rollup.PROCESS, compact_every=3)
    return sinks.latest(spark, f"{folder}/out", rollup.PROCESS)


def test_exec_reset_over_batches_equals_batch(spark, sf_dir, feed):
    run_exec_reset(spark, feed)
    got = run_exec_reset(spark, feed, dt.datetime(2100, 1, 1))
    same(got, rollup.cpu_stats_exec_reset(fixture.tele(spark, sf_dir, "cpu")))


def test_an_exec_that_comes_batches_later_still_resets(spark, folder):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    row = lambda i, s, kind, v=1.0: (i, at(s), 9, kind, v, '{"k": 1}')
    batches = [
        [row(1, 1, "click"), row(2, 8, "click"), row(3, 8, "click")],
        [row(4, 5, "click"), row(5, 9, "click")],
        [row(6, 3, "signup")],  # the exec, two micro-batches and a restart after rows that follow it
        [row(7, 40, "click")],
    ]
    for i, rows in enumerate(batches):
        add(spark.createDataFrame(rows, schema), folder, i)
        run_exec_reset(spark, folder)
    got = run_exec_reset(spark, folder, dt.datetime(2024, 1, 2))
    everything = spark.createDataFrame([r for rows in batches for r in rows], schema)
    want = rollup.cpu_stats_exec_reset(fixture.telemetry(fixture.only_probe(everything, "cpu")))
    assert [r.ctx_switches for r in want.collect()] == [5]
    same(got, want)


def test_steps_count_like_the_batch_operator(spark, sf_dir):
    """One step as long as all of time is the whole statistics; NULLs included."""
    cpu = fixture.tele(spark, sf_dir, "cpu").withColumn(
        "prev_state", F.when(F.col("event_id") % 5 != 0, F.col("prev_state"))
    ).withColumn("delta_ns", F.when(F.col("event_id") % 7 != 0, F.col("delta_ns")))
    steps = rollup.step_segments(cpu.withColumn("at", F.col("ts").cast("timestamp")), "at", "36500 days")
    # a process of execs alone adds up nothing there and zeros here
    same(steps.drop("had_exec"), rollup.cpu_stats_exec_reset(cpu))


def test_changelog_stays_bounded(spark, folder):
    import os

    def rows(i):
        return spark.createDataFrame([(i % 4, i)], "k bigint, v bigint").coalesce(1)

    for i in range(12):
        staged = f"{folder}/in"
        rows(i).write.mode("append").parquet(staged)
        values = spark.readStream.schema("k bigint, v bigint").parquet(staged)
        sinks.changelog(values, f"{folder}/out", f"{folder}/check", "append", keys=["k"], compact_every=3)
        held = [f for f in os.listdir(f"{folder}/out") if f.startswith("batch_id=")]
        assert len(held) <= 6
    got = {r.k: r.v for r in sinks.latest(spark, f"{folder}/out", ["k"]).collect()}
    assert got == {0: 8, 1: 9, 2: 10, 3: 11}


def test_late_rows_are_dropped_after_the_watermark(spark, folder):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    row = lambda i, ts: (i, ts, 1, "click", 1.0, '{"k": 1}')
    for i, rows in enumerate([[row(1, at(0)), row(2, at(10))], [row(3, at(10, 1))], [row(4, at(0, 1)), row(5, at(10, 2))]]):
        add(spark.createDataFrame(rows, schema), folder, i)
    merged = jobs.pid_merge(jobs.partial_stream(stream(spark, folder)), "1 minute")
    sinks.changelog(merged, f"{folder}/out", f"{folder}/check")
    got = {r.interval.minute: r.ctx_switches for r in sinks.latest(spark, f"{folder}/out", ["interval", "host_id", "pid"]).collect()}
    assert got == {0: 1, 10: 3}


def test_fan_in_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "event_id bigint, delta_ns bigint")
    b = spark.createDataFrame([(3, 4)], "event_id bigint, error_code bigint")
    got = sorted(tuple(r) for r in jobs.fan_in(a, b).collect())
    assert got == [(1, 2, None), (3, None, 4)]


def test_summary_of_all_windows_after_a_heartbeat(spark, sf_dir, feed):
    ids = spark.createDataFrame([], "host_id bigint, pid bigint, container_id string")
    for beat in (None, dt.datetime(2100, 1, 1)):
        tables.heartbeat(spark, f"{feed}/beats", beat)
        beats = tables.stream_heartbeats(spark, f"{feed}/beats")
        jobs.run_summary(
            jobs.partial_stream(stream(spark, feed), beats), f"{feed}/out", f"{feed}/check", lambda: ids, "1 hour"
        )
    got = spark.read.parquet(f"{feed}/out").drop(sinks.BATCH)
    est = energy.heuristic(
        rollup.pid_merge(events.partial_vectors(fixture.tele(spark, sf_dir)), "1 hour")
    ).withColumn("container_id", F.lit(""))
    same(got, views.system_summary(est))


def test_two_sinks_hold_the_same_processes(spark, feed):
    nothing = (
        spark.createDataFrame([], "host_id bigint, pid bigint, container_id string"),
        spark.createDataFrame(
            [], "full_id string, short_id string, name string, image_name string, pod_name string, pod_namespace string"
        ),
    )
    jobs.run_two_sinks(
        jobs.partial_stream(stream(spark, feed)), f"{feed}/samples", f"{feed}/frames", f"{feed}/check",
        lambda: nothing, "1 hour",
    )
    series = samples.read_samples(spark, f"{feed}/samples").where("metric = 'energy_joules'")
    frames = telemetry.parse(spark.read.text(f"{feed}/frames"))
    processes = frames.select("interval", F.explode("process_data").alias("p")).select("interval", "p.pid", "p.energy_joules")
    same(series.select("interval", "pid", F.col("value").alias("energy_joules")), processes)


def test_a_new_container_shows_up_in_the_next_batch(spark, folder):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    pid = fixture.telemetry(spark.createDataFrame([(1, at(0), 9, "click", 1.0, '{"k": 1}')], schema)).first()
    known = {"ids": [], "inventory": []}

    def dimensions():
        return (
            spark.createDataFrame(known["ids"], "host_id bigint, pid bigint, container_id string"),
            spark.createDataFrame(
                known["inventory"],
                "full_id string, short_id string, name string, image_name string, pod_name string, pod_namespace string",
            ),
        )

    for i in range(3):  # batch i closes the window of batch i - 1
        add(spark.createDataFrame([(i, at(5 * i), 9, "click", 1.0, '{"k": 1}')], schema), folder, i)
        jobs.run_two_sinks(
            jobs.partial_stream(stream(spark, folder)), f"{folder}/samples", f"{folder}/frames", f"{folder}/check",
            dimensions, "1 minute",
        )
        if i == 1:  # started after the first window was published
            known["ids"] = [(pid.host_id, pid.pid, "abcdefabcdef")]
            known["inventory"] = [("abcdefabcdef00", "abcdefabcdef", "web", "img", "", "")]
    series = samples.read_samples(spark, f"{folder}/samples")
    names = {r.interval.minute: r.container_name for r in series.where("metric = 'energy_joules'").collect()}
    assert names == {0: "host", 5: "web"}
    totals = [r.value for r in series.where("metric = 'energy_joules_total'").orderBy("interval").collect()]
    assert len(totals) == 2 and totals[1] == 2 * totals[0]


def test_frames_split_by_pid_range_and_keep_everyone(spark):
    rows = [(0, p, "x") for p in (1, 2, 20_000, 40_000)]
    est = energy.heuristic(
        spark.createDataFrame(rows, "host_id bigint, pid bigint, comm string").withColumns(
            {c: F.lit(1).cast("bigint") for c in rollup.COUNTERS})
    ).withColumns({"interval": F.expr("timestamp_ntz'2024-01-01'"), "container_id": F.lit(""), "container_name": F.lit("")})
    docs = telemetry.frames(est)
    assert {r.part for r in docs.collect()} == {0, 1, 2}
    assert "container_id" not in docs.first().value
    parsed = telemetry.parse(docs)
    assert [r[0] for r in parsed.select("summary.tracked_processes").distinct().collect()] == [4]
    assert sorted(r[0] for r in parsed.select(F.explode("process_data.pid")).collect()) == [1, 2, 20_000, 40_000]


def test_bad_frames_are_dropped(spark):
    lines = ['{"type":"telemetry","process_data":[],"summary":{"tracked_processes":0}}', '{"type":"connected"}', "{bad", ""]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert telemetry.parse(df).count() == 1


def test_model_scoring_on_a_stream(spark, sf_dir, feed):
    from wattframe.plans import attribution as A

    zero = F.lit(0).cast("bigint")
    features = lambda df: df.withColumns({"cpu_freq_mhz": zero, "rss_bytes": zero})
    columns = ["event_id", "energy_joules", "confidence", "model_version"]
    scored = jobs.scored(features(jobs.partial_stream(stream(spark, feed))), A.REFERENCE_MODEL)
    sinks.append_files(scored.select(columns), f"{feed}/out", f"{feed}/check")
    batch = features(events.partial_vectors(fixture.tele(spark, sf_dir)))
    same(spark.read.parquet(f"{feed}/out"), jobs.scored(batch, A.REFERENCE_MODEL).select(columns))
