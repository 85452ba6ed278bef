"""Keyed state of streams: versions, statistics of three probes, counters that end."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_streaming import add, same, split, stream
from wattframe.functions import scalar as S
from wattframe.operators import containers, events, metrics, rollup
from wattframe.plans import attribution as A
from wattframe.plans import fixture
from wattframe.sources import tables
from wattframe.streaming import jobs, sinks

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LAST = dt.datetime(2100, 1, 1)


# --- container of a pid, in batches ------------------------------------------------


def lifetimes(seed=1):
    draw = random.Random(seed)
    execs, captures, facts = [], [], []
    for i in range(900):
        row = (i, draw.randrange(400), draw.choice([0, 0, 0, 1]), draw.choice([7, 7, 8, None]))
        kind = draw.random()
        if kind < 0.1:
            execs.append(row)
        elif kind < 0.25:
            captures.append((*row, "/" if draw.random() < 0.2 else f"0::/docker/{draw.choice('abc') * 64}"))
        else:
            facts.append(row)
    return execs, captures, facts


def container_at(execs, captures, fact):
    _, at, host, pid = fact
    mine = lambda rows: [r for r in rows if r[2] == host and r[3] == pid]
    begin = max((r[1] for r in mine(execs) if r[1] <= at), default=-1)
    end = min((r[1] for r in mine(execs) if r[1] > at), default=10**9)
    life = sorted(r for r in mine(captures) if begin <= r[1] < end)
    life.sort(key=lambda r: (r[1], r[0]))
    before = [r for r in life if r[1] <= at]
    if before:
        found = before[-1]
    elif life:
        found = [r for r in life if r[1] == life[0][1]][-1]
    else:
        return ""
    return "" if found[4] == "/" else found[4][-12:]


@pytest.mark.parametrize("hot_rows", [2_000_000, 20])
def test_container_of_a_pid_as_of_each_time(spark, hot_rows):
    execs, captures, facts = lifetimes()
    schema = "event_id bigint, ts_us bigint, host_id bigint, pid bigint"
    versions = containers.pid_versions(
        spark.createDataFrame(captures, f"{schema}, cgroup_text string"), spark.createDataFrame(execs, schema), hot_rows=hot_rows
    )
    got = containers.attach_container_id_asof(spark.createDataFrame(facts, schema), versions, hot_rows=hot_rows)
    assert {r.event_id: r.container_id for r in got.collect()} == {f[0]: container_at(execs, captures, f) for f in facts}
    assert len({r.container_id for r in got.collect()}) == 4


def test_a_pid_used_again_leaves_its_old_container(spark):
    schema = "event_id bigint, ts_us bigint, host_id bigint, pid bigint"
    captures = [(1, 10, 0, 5, "0::/docker/" + "a" * 64), (3, 40, 0, 5, "0::/docker/" + "b" * 64)]
    versions = containers.pid_versions(
        spark.createDataFrame(captures, f"{schema}, cgroup_text string"), spark.createDataFrame([(2, 30, 0, 5), (4, 60, 0, 5)], schema)
    )
    facts = spark.createDataFrame([(i, t, 0, 5) for i, t in enumerate([0, 10, 29, 30, 39, 40, 59, 60, 99])], schema)
    got = containers.attach_container_id_asof(facts, versions).orderBy("event_id").collect()
    assert [r.container_id[:1] for r in got] == ["a", "a", "a", "b", "b", "b", "b", "", ""]
    none = containers.pid_versions(facts.withColumn("cgroup_text", F.lit("/")).limit(0), facts.limit(0))
    assert {r.container_id for r in containers.attach_container_id_asof(facts, none).collect()} == {""}


# --- as-of on streams --------------------------------------------------------------


def run_asof(spark, sf_dir, folder, history_schema, beat=None, salts=3):
    tables.heartbeat(spark, f"{folder}/beats", beat)
    rows = stream(spark, folder).select("event_id", "ts", "ts_us", "host_id", "pid")
    facts = containers.attach_container_id(rows, A.process_containers(spark, sf_dir))
    history = spark.readStream.schema(history_schema).parquet(f"{folder}/history")
    named = jobs.container_asof(
        facts, history, heartbeats=tables.stream_heartbeats(spark, f"{folder}/beats"), salts=salts
    )
    sinks.append_files(named, f"{folder}/out", f"{folder}/check")
    return spark.read.schema(named.schema).parquet(f"{folder}/out")


def test_asof_over_batches_and_restarts_equals_batch(spark, sf_dir, folder):
    history = fixture.inventory_history(spark, sf_dir).persist()
    bounds = sorted(r[0] for r in history.select("snapshot_ts").distinct().collect())
    parts = split(spark, sf_dir, folder, 3)
    for i, part in enumerate(parts):
        add(part, folder, i)
        last = part.agg(F.max("ts")).first()[0]
        # the part's snapshots come in the same run, after events that they name
        before = part.agg(F.min("ts")).first()[0]
        lower = F.lit(True) if i == 0 else F.col("snapshot_ts") > F.lit(before)
        upper = F.col("snapshot_ts") <= F.lit(last) if i + 1 < len(parts) else F.lit(True)
        history.where(lower & upper).coalesce(1).write.mode("append").parquet(f"{folder}/history")
        run_asof(spark, sf_dir, folder, history.schema)
    got = run_asof(spark, sf_dir, folder, history.schema, LAST)
    assert bounds
    want = containers.enrich_asof(
        fixture.tele(spark, sf_dir).select("event_id", "ts", "ts_us", "host_id", "pid"), history,
        ids=A.process_containers(spark, sf_dir),
    )
    same(got, want.select(*got.columns))


def test_facts_wait_for_versions_that_come_later(spark, folder):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    facts_schema = "event_id bigint, ts timestamp_ntz, ts_us bigint, host_id bigint, pid bigint, container_id string"
    history_schema = "short_id string, snapshot_ts timestamp_ntz, snapshot_us bigint, name string"
    us = lambda s: int(at(s).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)

    def run(facts, history, beat=None):
        rows = [(i, at(s), us(s), 0, p, c) for i, s, p, c in facts]
        spark.createDataFrame(rows, facts_schema).write.mode("append").parquet(f"{folder}/facts")
        rows = [(c, at(s), us(s), n) for c, s, n in history]
        spark.createDataFrame(rows, history_schema).write.mode("append").parquet(f"{folder}/history")
        tables.heartbeat(spark, f"{folder}/beats", beat)
        named = jobs.container_asof(
            spark.readStream.schema(facts_schema).parquet(f"{folder}/facts"),
            spark.readStream.schema(history_schema).parquet(f"{folder}/history"),
            heartbeats=tables.stream_heartbeats(spark, f"{folder}/beats"), salts=2,
        )
        sinks.append_files(named, f"{folder}/out", f"{folder}/check")
        return {r.event_id: r.container_name for r in spark.read.schema(named.schema).parquet(f"{folder}/out").collect()}

    assert run([(1, 5, 1, "c"), (2, 9, 1, "c"), (3, 5, 2, "")], [("c", 8, "second")]) == {}
    assert run([(4, 12, 1, "c")], [("c", 4, "first")]) == {}  # the version of event 1 comes a run after it
    got = run([(5, 40, 1, "c"), (6, 40, 3, "unknown")], [])
    assert got == {1: "first", 2: "second", 3: "", 4: "second"}
    # the version that still holds has been kept
    assert run([], [], at(59) + dt.timedelta(minutes=1)) == got | {5: "second", 6: ""}


# --- statistics of three probes in one state ---------------------------------------


def run_stats(spark, folder, beat=None):
    tables.heartbeat(spark, f"{folder}/beats", beat)
    timed = jobs.with_event_time(stream(spark, folder), heartbeats=tables.stream_heartbeats(spark, f"{folder}/beats"))
    sinks.changelog(
        jobs.process_stats(timed), f"{folder}/out", f"{folder}/check", "append", keys=rollup.PROCESS, compact_every=3
    )
    return sinks.latest(spark, f"{folder}/out", rollup.PROCESS)


def test_stats_over_batches_and_restarts_equal_the_batch(spark, sf_dir, folder):
    for i, part in enumerate(split(spark, sf_dir, folder, 3)):
        add(part, folder, i)
        if i < 2:  # a restart after each part
            run_stats(spark, folder)
    stats = run_stats(spark, folder, LAST)
    faults = events.classify_faults(fixture.tele(spark, sf_dir, "mem"))
    same(jobs.mem_stats(stats), rollup.mem_stats(faults))
    same(jobs.gpu_stats(stats), rollup.gpu_stats(fixture.tele(spark, sf_dir, "gpu")))
    same(jobs.feature_snapshot(stats), A.snapshot(spark, sf_dir))


def test_a_reclaim_that_comes_first_makes_the_entry(spark, folder):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    row = lambda i, s, pid, kind, k: (i, at(s), pid, kind, 1.0, f'{{"k": {k}}}')
    batches = [
        [row(1, 1, 1, "error", 10), row(2, 2, 2, "view", 2), row(3, 3, 3, "error", 10)],
        [row(4, 20, 1, "error", 20), row(5, 20, 2, "error", 10), row(6, 20, 4, "purchase", 9), row(7, 20, 3, "view", 3)],
        [row(8, 40, 4, "purchase", 1), row(9, 41, 3, "error", 30), row(10, 42, 5, "signup", 1)],
    ]
    for i, rows in enumerate(batches):
        add(spark.createDataFrame(rows, EVENTS), folder, i)
        run_stats(spark, folder)
    stats = run_stats(spark, folder, dt.datetime(2024, 1, 2))
    everything = fixture.telemetry(spark.createDataFrame([r for rows in batches for r in rows], EVENTS))
    faults = rollup.mem_stats(events.classify_faults(everything))
    same(jobs.mem_stats(stats), faults)
    second = lambda s: int(at(s).replace(tzinfo=dt.timezone.utc).timestamp()) * 10**9
    assert {r.pid: r.last_fault_ns for r in faults.collect()} == {1: second(1), 2: second(2), 3: second(20)}
    submits = everything.where("event_kind = 'gpu_submit'")
    same(jobs.gpu_stats(stats), rollup.gpu_stats(submits))
    cpu = rollup.cpu_stats_exec_reset(everything.where("probe = 'cpu'"))
    same(jobs.feature_snapshot(stats), rollup.feature_snapshot(cpu, faults, rollup.gpu_stats(submits)))


# --- counters that end -------------------------------------------------------------

HOUR = dt.timedelta(hours=1)


def run_counters(spark, folder, beat=None):
    tables.heartbeat(spark, f"{folder}/beats", beat)
    est = jobs.scored(jobs.partial_stream(stream(spark, folder), tables.stream_heartbeats(spark, f"{folder}/beats")))
    counted = jobs.silent_counters(est, ["host_id", "pid"], 3 * HOUR, "1 hour")
    sinks.append_files(counted, f"{folder}/out", f"{folder}/check")
    states = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "held")
    held = states.load(f"{folder}/check").count()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out"), held


@pytest.mark.parametrize("at_once", [True, False])
def test_silent_series_end_and_start_again(spark, folder, at_once):
    at = lambda h: dt.datetime(2024, 1, 1) + h * HOUR
    row = lambda i, h, pid: (i, at(h), pid, "click", 1.0 + i, '{"k": 1}')
    batches = [
        [row(1, 0, 1), row(2, 1, 1), row(3, 1, 2)],
        [row(4, 3, 2)],
        [row(5, 9, 3), row(6, 6, 2)],  # 2 is back within the silence, 1 is not seen any more
        [row(7, 20, 1), row(8, 21, 1)],  # 1 returns
    ]
    if at_once:
        batches = [[r for rows in batches for r in rows]]
    sizes = []
    for i, rows in enumerate(batches):
        add(spark.createDataFrame(rows, EVENTS), folder, i)
        out, held = run_counters(spark, folder)
        sizes.append(held)
    out, held = run_counters(spark, folder, at(48))
    assert held == 0  # state shrinks to nothing once all are silent
    nj = {i: 5 * round((1.0 + i) * 100) * 10_000 for i in range(1, 9)}
    got = sorted((r.pid, r.ts, int(r.nj_total), r.ended) for r in out.collect())
    assert got == sorted([
        (1, at(0), nj[1], False), (1, at(1), nj[1] + nj[2], False), (1, at(4), nj[1] + nj[2], True),
        (1, at(20), nj[7], False), (1, at(21), nj[7] + nj[8], False), (1, at(24), nj[7] + nj[8], True),
        (2, at(1), nj[3], False), (2, at(3), nj[3] + nj[4], False), (2, at(6), nj[3] + nj[4] + nj[6], False),
        (2, at(9), nj[3] + nj[4] + nj[6], True), (3, at(9), nj[5], False), (3, at(12), nj[5], True),
    ])
    # a rate over the rows takes the return as a restart from 0
    samples = metrics.ended_as_zero(out, "nj_total").withColumn("ts_us", S.micros("ts"))
    rated = metrics.counter_rate(samples, "nj_total", ["host_id", "pid"], ["ts_us"], 24 * metrics.HOUR)
    increases = {(r.pid, r.ts): int(r.increase) for r in rated.collect()}
    assert increases[1, at(20)] == nj[7] and increases[1, at(4)] == 0 and increases[1, at(21)] == nj[8]
