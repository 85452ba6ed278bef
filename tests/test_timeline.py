"""Ordered operators against brute force, with one key holding most rows."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from wattframe.operators import containers, events, metrics, rollup
from wattframe.operators.joins import asof_lookup, lookup_join
from wattframe.operators.timeline import (
    STRETCH,
    hot_keys,
    running_since,
    running_totals,
    sliding_sum,
    with_previous,
    with_stretch,
)

# rows above which a key is cut into stretches
HOT = (1, 7, 50, 150, 10**6)


def make_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.6 else rng.randint(1, 4)
        rows.append((key, rng.randint(0, 2000), i, rng.randint(0, 50), rng.random() < 0.1))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, ts_us bigint, event_id bigint, v bigint, reset boolean").repartition(4)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("hot", HOT)
@pytest.mark.parametrize("seed", [1, 2])
def test_with_previous(spark, seed, hot):
    rows = make_rows(seed)
    want = {}
    for history in by_key(rows).values():
        for before, row in zip([None, *history], history):
            want[row[2]] = (before and before[1], before and before[3])
    got = with_previous(frame(spark, rows), ["k"], ["ts_us", "event_id"], {"pt": "ts_us", "pv": "v"}, hot_rows=hot)
    assert {r.event_id: (r.pt, r.pv) for r in got.collect()} == want


@pytest.mark.parametrize("hot", HOT)
def test_running_since(spark, hot):
    rows = make_rows(3)
    want = {}
    for history in by_key(rows).values():
        total = 0
        for row in history:
            total = row[3] if row[4] else total + row[3]
            want[row[2]] = total
    got = running_since(
        frame(spark, rows), ["k"], ["ts_us", "event_id"], F.col("v"), F.col("reset"), "total", hot_rows=hot,
    )
    assert {r.event_id: r.total for r in got.collect()} == want


@pytest.mark.parametrize("hot", HOT)
def test_running_since_with_the_value_before(spark, hot):
    rows = make_rows(7)
    want = {}
    for history in by_key(rows).values():
        total = None
        for row in history:
            before = total
            total = row[3] if row[4] else (total or 0) + row[3]
            want[row[2]] = (total, before)
    got = running_since(
        frame(spark, rows), ["k"], ["ts_us", "event_id"], F.col("v"), F.col("reset"), "total",
        hot_rows=hot, previous="before",
    )
    assert {r.event_id: (r.total, r.before) for r in got.collect()} == want


@pytest.mark.parametrize("hot", HOT)
def test_running_totals(spark, hot):
    rows = make_rows(4)
    want = {}
    for key, history in by_key(rows).items():
        total = 0
        for row in history:
            total += row[3]
            want[key, row[1]] = total
    got = running_totals(frame(spark, rows), ["k"], "ts_us", {"total": F.col("v")}, "ts_us", hot_rows=hot)
    assert {(r.k, r.ts_us): r.total for r in got.collect()} == want


@pytest.mark.parametrize("window", [1, 7, 300, 5000])
@pytest.mark.parametrize("bucket", [1, 300, 10**6])
def test_sliding_sum(spark, window, bucket):
    rows = make_rows(5, 200)
    want = {
        r[2]: sum(o[3] for o in rows if o[0] == r[0] and r[1] - window < o[1] <= r[1]) for r in rows
    }
    got = sliding_sum(frame(spark, rows), ["k"], window, {"total": F.col("v")}, bucket_us=bucket)
    assert {r.event_id: r.total for r in got.collect()} == want


@pytest.mark.parametrize("hot", HOT)
def test_asof(spark, hot):
    rows = make_rows(6)
    rng = random.Random(7)
    history = sorted({(rng.randint(0, 3), rng.randint(0, 2500)) for _ in range(40)})
    marks = spark.createDataFrame([(k, t, f"{k}@{t}") for k, t in history], "k bigint, at bigint, name string")
    want = {}
    for r in rows:
        times = [t for k, t in history if k == r[0]]
        i = bisect.bisect_right(times, r[1])
        want[r[2]] = f"{r[0]}@{times[i - 1]}" if i else None
    got = asof_lookup(
        frame(spark, rows), marks, F.col("k"), F.col("k"), {"name": F.col("name")}, ["event_id"],
        history_time="at", hot_rows=hot,
    )
    assert {r.event_id: r.name for r in got.collect()} == want


@pytest.mark.parametrize("hot", HOT)
def test_exec_reset(spark, hot):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        pid = 0 if rng.random() < 0.5 else rng.randint(1, 8)
        kind = "exec" if rng.random() < 0.05 else "switch"
        rows.append((0, pid, rng.randint(0, 3000), i, kind, rng.randint(1, 9), rng.randint(0, 1), rng.randint(0, 3), f"c{i}"))
    df = spark.createDataFrame(
        rows, "host_id bigint, pid bigint, ts_us bigint, event_id bigint, event_kind string, delta_ns bigint, "
        "prev_state bigint, cpu_id bigint, comm string").repartition(4)
    want = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        _, pid, ts, _, kind, delta, state, cpu, comm = row
        if kind == "exec" or pid not in want:
            want[pid] = [0, 0, 0, 0, cpu, ts * 1000, comm]
        now = want[pid]
        if kind == "switch":
            now[0] += delta
            now[1] += 1
            now[2] += state != 0
            now[3] += state == 0
        now[4], now[5] = cpu, ts * 1000
    got = rollup.cpu_stats_exec_reset(df)
    assert {r.pid: list(r)[2:] for r in got.collect()} == want


def test_cpu_slices_guard(spark):
    rows = [
        (0, 0, 100, 1, 0, 5, 0),   # first switch on the CPU: nothing to charge
        (0, 0, 150, 2, 5, 6, 1),   # 5 ran 50
        (0, 0, 170, 3, 9, 7, 0),   # 9 was never switched in: event lost
        (0, 0, 200, 4, 7, 5, 0),   # 7 ran 30
        (0, 1, 210, 5, 5, 1, 0),   # another CPU
    ]
    df = spark.createDataFrame(
        rows, "host_id bigint, cpu_id bigint, ts_us bigint, event_id bigint, prev_pid bigint, next_pid bigint, prev_state bigint"
    ).withColumn("ts", F.timestamp_micros("ts_us"))
    for hot in (1, 2, 10**6):
        got = events.cpu_slices(df, hot_rows=hot).orderBy("event_id").collect()
        assert [(r.pid, r.delta_ns, r.involuntary) for r in got] == [(5, 50_000, False), (7, 30_000, True)]


def test_counter_rate_restarts(spark):
    rows = [(0, 0, 1, 10), (0, 1_000_000, 2, 25), (0, 2_000_000, 3, 5), (0, 2_500_000, 4, 7),
            (0, 3_000_000, 5, 7), (0, 90_000_000, 6, 13)]
    df = spark.createDataFrame(rows, "k bigint, ts_us bigint, event_id bigint, c bigint")
    got = metrics.counter_rate(df, "c", ["k"], ["ts_us", "event_id"], window_us=metrics.MINUTE)
    seen = [(r.ts.second + 60 * r.ts.minute, r.c, r.increase, r.rate_per_second) for r in got.orderBy("ts").collect()]
    assert seen == [(0, 10, 0, 0.0), (1, 25, 15, 0.25), (2, 7, 7, 22 / 60), (3, 7, 0, 22 / 60), (90, 13, 6, 0.1)]


def test_lookup_join_matches_plain_join(spark):
    rows = [(0 if i % 3 else i, i) for i in range(300)]
    fact = spark.createDataFrame(rows, "k bigint, i bigint")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 200)], "k bigint, name string")
    got = sorted((r.i, r.name) for r in lookup_join(fact, dim, ["k"]).collect())
    assert got == [(i, f"d{k}" if k < 200 else None) for k, i in sorted(rows, key=lambda r: r[1])]


def test_a_hot_lookup_key_is_split(spark):
    """Even below an aggregate that could reuse the join's partitioning."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        fact = spark.range(0, 40_000, 1, 8).select(F.when(i % 3 == 0, 7).otherwise(i).alias("k"), F.xxhash64(i).alias("i"))
        dim = spark.range(0, 1000).select(i.alias("k"), F.lit("d").alias("name"))
        counted = lookup_join(fact, dim, ["k"]).groupBy("k", "name").agg(F.count("i").alias("n"), F.max("i"))
        rows = {r.k: (r.name, r.n) for r in counted.collect()}  # the largest i keeps i in the shuffle
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows[7] == ("d", 13_335) and rows[1] == ("d", 1) and rows[1001] == (None, 1)
    assert sum(n for _, n in rows.values()) == 40_000


def test_asof_for_host_processes(spark):
    vectors = spark.createDataFrame([(0, 1, 5, 1, ""), (0, 2, 5, 2, "c")], "host_id bigint, pid bigint, ts_us bigint, event_id bigint, container_id string")
    history = spark.createDataFrame([("c", 5, "web"), ("", 1, "never")], "short_id string, snapshot_us bigint, name string")
    got = {r.pid: r.container_name for r in containers.enrich_asof(vectors, history).collect()}
    assert got == {1: "", 2: "web"}


def test_only_hot_keys_are_cut(spark):
    burst = [(0, 50_000 + i, i, 1, False) for i in range(900)]  # 0.9 of 100 milliseconds
    rest = [(0, 1000 * i, 1000 + i, 1, False) for i in range(100)] + [(1, 5000, 2000, 1, False)]
    df = frame(spark, burst + rest)
    hot = hot_keys(df, ["k"], "ts_us", 100)
    assert [r.k for r in hot.collect()] == [0]
    sizes = with_stretch(df, ["k"], "ts_us", hot).groupBy("k", STRETCH).count().collect()
    assert sum(r["count"] for r in sizes) == 1001
    assert max(r["count"] for r in sizes) <= 101
    assert [r[STRETCH] for r in sizes if r.k == 1] == [0]
    assert with_stretch(df, ["k"], "ts_us", hot, only_hot=True).where("k <> 0").count() == 0


def test_bursts_and_null_keys_are_cut_by_rows(spark):
    """Nine tenths of a key's rows within a thousandth of a thousandth of its time."""
    burst = [(0, 5 * 10**11 + i, i, 1, False) for i in range(18_000)]
    rest = [(0, i * 5 * 10**8, 20_000 + i, 1, False) for i in range(2_000)]
    nulls = [(None, 1000 * i, 30_000 + i, 1, False) for i in range(5_000)]
    df = frame(spark, burst + rest + nulls + [(1, 7, 50_000, 1, False)])
    hot = hot_keys(df, ["k"], "ts_us", 1000)
    assert {r.k for r in hot.collect()} == {0, None}
    sizes = with_stretch(df, ["k"], "ts_us", hot).groupBy("k", STRETCH).count().collect()
    assert sum(r["count"] for r in sizes) == 25_001
    assert max(r["count"] for r in sizes) <= 2000
    assert sum(r.k is None for r in sizes) >= 5
    got = with_previous(df, ["k"], ["ts_us", "event_id"], {"pt": "ts_us"}, hot_rows=1000)
    assert got.where("pt is null").count() == 3
    assert got.where("k is null and ts_us - pt = 1000").count() == 4_999


def test_hot_keys_are_bounded_by_the_share_of_all_rows(spark, monkeypatch):
    from wattframe.operators import timeline

    monkeypatch.setattr(timeline, "MOST_HOT", 4)
    df = frame(spark, [(i % 10, i, i, 1, False) for i in range(1000)] + [(0, i, i, 1, False) for i in range(2000)])
    assert [r.k for r in hot_keys(df, ["k"], "ts_us", 5).collect()] == [0]
