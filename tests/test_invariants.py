"""Relations that hold on any data, checked on the fixture's estimates."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattframe.operators import metrics, views
from wattframe.plans import attribution as A


@pytest.fixture(scope="module")
def est(spark, sf_dir):
    from wattframe.session import configure

    return A.stored_estimates(configure(spark), sf_dir)


def total(df, column="energy_joules"):
    return df.agg(F.sum(column)).first()[0]


def test_every_breakdown_adds_up_to_the_total(est):
    whole = views.totals(est).first().energy_joules
    assert total(views.ai_split(est)) == pytest.approx(whole)
    assert total(views.by_component(est)) == pytest.approx(whole)
    for keys in (["container_id"], ["container_name"], ["comm"], ["host_id", "pid"]):
        assert total(views.by(est, keys)) == pytest.approx(whole)
    assert total(views.system_summary(est), "total_energy_joules") == pytest.approx(whole)


def test_counters_never_fall_and_end_at_the_total(est):
    samples = metrics.counters(est)
    series = Window.partitionBy(*metrics.LABELS).orderBy("interval")
    for counter in metrics.COUNTERS:
        step = F.col(counter) - F.lag(counter, 1, 0.0).over(series)
        assert samples.select(step.alias("step")).where("step < 0").count() == 0
    last = samples.groupBy(*metrics.LABELS).agg(
        F.max_by(metrics.COUNTERS[0], "interval").alias("energy_joules")
    )
    assert total(last) == pytest.approx(views.totals(est).first().energy_joules)


def test_counters_do_not_depend_on_how_hot_keys_are_cut(est):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(metrics.counters(est, hot_rows=3)) == rows(metrics.counters(est))


def test_carbon_follows_energy(est):
    r = views.totals(est).first()
    assert r.carbon_grams_co2 == pytest.approx(r.energy_joules / 3.6e6 * 475.0)


def test_topk_is_at_most_k_and_ordered(est):
    top = views.topk(est, k=3)
    assert top.groupBy("interval").count().where("count > 3").count() == 0
    series = Window.partitionBy("interval").orderBy("rank")
    rise = F.col("energy_joules") > F.lag("energy_joules").over(series)
    assert top.select(rise.alias("rise")).where("rise").count() == 0


def test_samples_have_every_series_of_every_process(est):
    counts = {r.metric: r["count"] for r in metrics.samples(est).groupBy("metric").count().collect()}
    n = est.count()
    assert all(counts[g] == n for g in (*metrics.GAUGES, *metrics.COUNTERS, metrics.AI_GAUGE))
    intervals = est.select("interval").distinct().count()
    assert counts[metrics.PROCESS_GAUGE] == intervals
    assert counts[f"{metrics.HISTOGRAM}_bucket"] == 10 * intervals


def test_sample_table_by_metric_and_day(spark, est, folder):
    from wattframe.sources import samples

    samples.write_samples(est, f"{folder}/samples", by=("metric", "day"))
    table = samples.read_samples(spark, f"{folder}/samples")
    assert table.count() == metrics.samples(est).count()
    assert table.where(F.col("day") != F.to_date("interval")).count() == 0
