"""Streams whose state is not one Python call per process."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from test_stream_series import HOUR, closed
from test_streaming import add, same, split, stream
from wattframe.operators import energy, rollup
from wattframe.plans import attribution as A
from wattframe.plans import fixture
from wattframe.sources import tables
from wattframe.streaming import jobs, sinks, state


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_gauges_take_no_python_per_series(spark, sf_dir, folder):
    add(split(spark, sf_dir, folder, 1)[0], folder, 0)
    assert "TransformWithState" not in analysed(jobs.gauges(closed(spark, folder, None), HOUR))


def test_facts_without_a_container_share_keys(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    at = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame(
        [(at, 0, p % 3, p, "") for p in range(60)],
        "ts timestamp_ntz, ts_us bigint, host_id bigint, pid bigint, container_id string",
    )
    history = spark.createDataFrame([], "short_id string, snapshot_ts timestamp_ntz, snapshot_us bigint, name string")
    taken = []
    monkeypatch.setattr(jobs, "with_event_time", lambda rows, *_: taken.append(rows) or rows)
    try:
        jobs.container_asof(facts, history, salts=4)
    except Exception:  # a batch has no keyed state; what it is grouped by is what counts here
        pass
    assert taken[0].select("entry").distinct().count() == 2


def run_exec(spark, folder, beat=None):
    tables.heartbeat(spark, f"{folder}/beats", beat)
    timed = jobs.with_event_time(
        stream(spark, folder, "cpu"), heartbeats=tables.stream_heartbeats(spark, f"{folder}/beats")
    )
    sinks.changelog(
        jobs.exec_reset(timed, buckets=2), f"{folder}/out", f"{folder}/check", "append", keys=rollup.PROCESS
    )
    return sinks.latest(spark, f"{folder}/out", rollup.PROCESS)


def test_processes_of_one_bucket_reset_on_their_own(spark, sf_dir, folder):
    events = tables.read_events(spark, sf_dir).withColumn(
        "user_id", F.when(F.col("event_id") % 11 != 0, F.col("user_id"))  # some have no process
    )
    half = events.agg(F.percentile("event_id", 0.5)).first()[0]
    for i, part in enumerate([events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half)]):
        add(part, folder, i)
        run_exec(spark, folder)
    got = run_exec(spark, folder, dt.datetime(2100, 1, 1))
    cpu = fixture.telemetry(fixture.only_probe(events, "cpu")).withColumn("at", F.col("ts").cast("timestamp"))
    # one step as long as all of time is the whole statistics
    same(got, rollup.step_segments(cpu, "at", "36500 days").drop("had_exec"))


class Held:
    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = [tuple(r) for r in rows]


def fold(calls, expiry_ms=None):
    held, out = Held(), []
    since = state.SinceExec(expiry_ms)
    since.init(SimpleNamespace(getListState=lambda *_, **__: held))
    for now, steps in calls:
        rows = [
            {"series": s, "had_exec": e, **dict.fromkeys(state.SUMS, n), "last_cpu_id": n, "last_seen_ns": t, "comm": f"{s}{t}"}
            for s, t, e, n in steps
        ]
        frames = [pd.DataFrame(rows[i : i + 3]) for i in range(0, len(rows), 3)]
        (got,) = since.handleInputRows((0,), iter(frames), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now))
        out.append({r.series: (r.ctx_switches, r.last_cpu_id, r.comm) for r in got.itertuples()})
    return out, held.rows


def test_steps_fold_by_hand():
    draw = random.Random(5)
    calls, known, want = [], {}, []
    for call in range(6):
        steps = [(draw.choice("abc"), 100 * call + i, draw.random() < 0.2, draw.randrange(9)) for i in range(20)]
        for s, t, execs, n in steps:
            total, _, name = known.get(s, (0, 0, f"{s}{t}"))
            known[s] = (n, n, f"{s}{t}") if execs else (total + n, n, name)
        want.append({s: known[s] for s in {s for s, *_ in steps}})
        draw.shuffle(steps)
        calls.append((0, steps))
    assert fold(calls)[0] == want


def test_a_silent_process_starts_anew_and_the_others_do_not():
    calls = [(0, [("a", 1, False, 5), ("b", 1, False, 5)]), (60, [("a", 2, False, 1)]), (120, [("a", 3, False, 1), ("b", 3, False, 1)])]
    out, held = fold(calls, expiry_ms=100)
    assert [c["a"][0] for c in out] == [5, 6, 7] and out[-1]["b"][0] == 1
    assert len(held) == 2
    assert fold(calls)[0][-1]["b"][0] == 6


def test_counters_go_on_from_the_totals_before_a_batch(spark, sf_dir, folder):
    est = energy.heuristic(A.vectors(spark, sf_dir)).withColumn("pid", F.when(F.col("pid") % 4 != 1, F.col("pid")))
    est = est.groupBy("interval", "host_id", "pid", "comm").agg(
        F.sum("energy_nj").alias("energy_nj"), F.first("intensity").alias("intensity")
    ).persist()
    bounds = [est.agg(F.percentile_approx("interval", q)).first()[0] for q in (0.3, 0.6)]
    cuts = [F.col("interval") < bounds[0], (F.col("interval") >= bounds[0]) & (F.col("interval") < bounds[1]), F.col("interval") >= bounds[1]]
    log = f"{folder}/totals"
    for i, cut in [*enumerate(cuts), (1, cuts[1]), (2, cuts[2])]:  # the last two are replayed
        counted = jobs.with_counters(est.where(cut), sinks.latest_before(spark, log, i, jobs.SERIES))
        counted.write.mode("overwrite").parquet(f"{folder}/out/batch_id={i}")
        sinks.log_batch(jobs.totals(counted), log, i, jobs.SERIES, compact_every=2)
    got = spark.read.parquet(f"{folder}/out").drop("batch_id")
    whole = jobs.with_counters(est, None)
    same(got, whole)
    last = whole.groupBy(*jobs.SERIES).agg(F.max_by("exact_nj_total", "interval").alias("nj"))
    same(last, est.groupBy(*jobs.SERIES).agg(F.sum(F.col("energy_nj").cast("decimal(28,0)")).cast("decimal(38,0)").alias("nj")))


def test_silent_counters_of_a_batch_start_from_zero(spark):
    est = spark.sql(
        "select timestamp_ntz'2024-01-01' as interval, 0L as host_id, p as pid, 'x' as comm, 10L as energy_nj, 1.0D as intensity "
        "from values (1L), (2L) as t(p)"
    )
    known = spark.sql(
        "select 0L as host_id, p as pid, 'x' as comm, cast(5 as decimal(38,0)) as exact_nj, cast(5 as decimal(38,0)) as exact_mc, "
        "unix_millis(current_timestamp()) - ago as seen_ms from values (1L, 1000L), (2L, 900000L) as t(p, ago)"
    )
    seen = lambda expiry: {
        r.pid: int(r.exact_nj_total) for r in jobs.with_counters(est, known, expiry_ms=expiry).collect()
    }
    assert seen(600_000) == {1: 15, 2: 10}
    assert seen(None) == {1: 15, 2: 15}
