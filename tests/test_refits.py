"""Refits from sums, versions as of a time, and the histogram's counters and rates, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.operators import metrics, refits

DAY = [dt.datetime(2024, 1, d) for d in range(1, 8)]
FEATURES = ("a", "b", "c")
SCHEMA = "model string, interval timestamp_ntz, a double, b bigint, c bigint, energy_joules double"


def rows(seed=3):
    draw = random.Random(seed)
    out = []
    for model in ("x", "y", None):
        for day in (DAY[0], DAY[1], DAY[3], DAY[4]):
            for _ in range(draw.choice([3, 12, 40])):
                a, b = draw.randrange(10**9), draw.randrange(50)
                c = 7 if model == "y" else draw.randrange(10**6)
                out.append((model, day, float(a), b, c, 3e-9 * a + 0.5 * b - 2e-6 * c + 4 + draw.gauss(0, 0.1)))
        out.append((model, DAY[1], None, 1, 1, 5.0))
        out.append((model, DAY[1], 1.0, 1, 1, float("nan")))
    return out


def least_squares(part):
    x = np.array([r[2:5] for r in part], float)
    y = np.array([r[5] for r in part])
    used = [i for i in range(3) if x[:, i].std() > 0]
    if len(part) <= len(used) + 1:
        return None
    mean, scale = x.mean(0), np.array([x[:, i].std(ddof=1) if i in used else 1.0 for i in range(3)])
    z = ((x - mean) / scale)[:, used]
    found = np.linalg.lstsq(np.column_stack([z, np.ones(len(y))]), y, rcond=None)[0]
    coefficients = np.zeros(3)
    coefficients[used] = found[:-1]
    return mean, scale, coefficients, found[-1], len(part)


def good(part):
    return [r for r in part if None not in r[2:] and not np.isnan(r[5])]


def test_refits_are_fits_on_all_rows_so_far(spark):
    data = rows()
    table = spark.createDataFrame(data, SCHEMA).repartition(5)
    states = refits.gram_state(table, ["model", "interval"], FEATURES)
    got = {(r.model, r.interval): r for r in refits.refits(states, ["model"], features=FEATURES).collect()}
    seen = 0
    for model in ("x", "y", None):
        for day in (DAY[0], DAY[1], DAY[3], DAY[4]):
            want = least_squares(good([r for r in data if r[0] == model and r[1] <= day]))
            if want is None:
                assert (model, day) not in got
                continue
            mean, scale, coefficients, intercept, n = want
            version, seen = got[model, day], seen + 1
            assert version.n == n and np.allclose(version.means, mean) and np.allclose(version.scales, scale)
            assert np.allclose(version.coefficients, coefficients, rtol=1e-6, atol=1e-8)
            assert version.intercept == pytest.approx(intercept)
    assert len(got) == seen > 6


def test_states_merge_in_any_order_to_the_same_numbers(spark):
    table = spark.createDataFrame(rows(), SCHEMA)
    whole = refits.gram_state(table, ["model"], FEATURES)
    by_day = refits.merge(refits.gram_state(table.repartition(7), ["model", "interval"], FEATURES).drop("interval"), ["model"])
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, by_day.collect()), key=repr)


def test_a_vector_takes_the_version_from_before_its_interval(spark):
    versions = spark.createDataFrame(
        [("x", DAY[1], 9, [0.0] * 3, [1.0] * 3, [1.0, 0.0, 0.0], 1.0), ("x", DAY[4], 9, [1.0] * 3, [2.0] * 3, [0.0, 2.0, 0.0], -9.0)],
        "model string, interval timestamp_ntz, n bigint, means array<double>, scales array<double>, coefficients array<double>, intercept double",
    )
    vectors = spark.createDataFrame(
        [(i, m, DAY[d], 4.0, 5, 6) for i, (m, d) in enumerate([("x", 0), ("x", 1), ("x", 2), ("x", 4), ("x", 5), ("y", 5), (None, 5)])],
        "event_id bigint, model string, interval timestamp_ntz, a double, b bigint, c bigint",
    )
    got = refits.predict_asof(vectors, versions, ["model"], features=FEATURES).orderBy("event_id").collect()
    assert [(r.model_interval, r.predicted_joules) for r in got] == [
        (None, None), (None, None), (DAY[1], 5.0), (DAY[1], 5.0), (DAY[4], 0.0), (None, None), (None, None)
    ]


# --- histogram ---------------------------------------------------------------------


def observations(seed=5):
    draw = random.Random(seed)
    hours = sorted(draw.sample(range(100), 40))
    return [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), host, draw.choice([0.05, 0.3, 0.85, 0.9, 0.95, 0.999]))
            for h in hours for host in (1, None) for _ in range(draw.choice([0, 1, 4, 30]))]


@pytest.mark.parametrize("hot_rows", [2_000_000, 8])
def test_histogram_counters_and_rates(spark, hot_rows):
    data = observations()
    df = spark.createDataFrame(data, "interval timestamp_ntz, host_id bigint, confidence double")
    day = F.to_date("interval").cast("string")
    counters = metrics.histogram_counters(df, by=["host_id"], life=day, hot_rows=hot_rows).persist()
    bounds = [*fixed.CONFIDENCE_BOUNDS, float("inf")]
    shown = {}
    for host in (1, None):
        for at in sorted({t for t, h, _ in data if h == host}):
            seen = [v for t, h, v in data if h == host and t <= at and t.date() == at.date()]
            shown[host, at] = ([sum(v <= b for v in seen) for b in bounds], sum(round(v * 1e9) for v in seen))
    got = {(r.host_id, r.interval): ([b.cumulative for b in r.buckets], int(r.total_nano)) for r in counters.collect()}
    assert got == shown
    series = metrics.histogram_series(counters, ["host_id"]).collect()
    assert len(series) == len(shown) * (len(bounds) + 2)
    assert {s.metric.rsplit("_", 1)[1] for s in series} == {"bucket", "sum", "count"}

    window = dt.timedelta(hours=9)
    rates = metrics.histogram_rate(counters, 9 * metrics.HOUR, ["host_id"], hot_rows).collect()
    grown = {}
    for host in (1, None):
        before = None
        for at in sorted(t for h, t in shown if h == host):
            counts, total = shown[host, at]
            if before is None:
                grown[host, at] = ([0] * len(bounds), 0)
            elif any(x < y for x, y in zip((*counts, total), (*before[0], before[1]))):
                grown[host, at] = (counts, total)
            else:
                grown[host, at] = ([x - y for x, y in zip(counts, before[0])], total - before[1])
            before = counts, total
    assert len(rates) == len(shown)
    for r in rates:
        inside = [g for (h, t), g in grown.items() if h == r.host_id and r.interval - window < t <= r.interval]
        counts = [sum(g[0][i] for g in inside) for i in range(len(bounds))]
        assert [b.cumulative for b in r.buckets] == [max(counts[: i + 1]) for i in range(len(counts))]
        assert r.sum_per_second == pytest.approx(sum(g[1] for g in inside) / 1e9 / window.total_seconds())
        assert r.count_per_second == pytest.approx(counts[-1] / window.total_seconds())


def test_a_lost_sample_leaves_no_falling_bucket(spark):
    def row(hour, counts):
        buckets = [(b, c) for b, c in zip([0.5, 0.9, float("inf")], counts)]
        return (dt.datetime(2024, 1, 1, hour), buckets, counts[-1], hour * 10**9 + 1)

    schema = "interval timestamp_ntz, buckets array<struct<le:double,cumulative:bigint>>, observations bigint, total_nano decimal(38,0)"
    from decimal import Decimal

    rows = [(*row(h, c)[:3], Decimal(row(h, c)[3])) for h, c in [(1, [1, 1, 1]), (2, [5, 3, 6]), (3, [2, 2, 2])]]
    got = metrics.histogram_rate(spark.createDataFrame(rows, schema), metrics.HOUR).orderBy("interval").collect()
    assert [[b.cumulative for b in r.buckets] for r in got] == [[0, 0, 0], [4, 4, 5], [2, 2, 2]]
