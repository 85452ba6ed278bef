"""Physical plans: what reaches the scan, what is shuffled, what never happens."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from wattframe.operators import events, rollup
from wattframe.plans import fixture

QUERIES = entry.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairs_and_no_global_windows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", text)
    assert "BatchEvalPython" not in text


def test_probe_filter_reaches_the_scan(spark, sf_dir):
    text = plan(fixture.tele(spark, sf_dir, "cpu"))
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type, \[click,signup\]\)", text)


def test_narrow_scan(spark, sf_dir):
    text = plan(QUERIES["gpu_stats"](spark, sf_dir))
    assert "value" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)


def test_first_merge_stage_is_a_hash_aggregate(spark, sf_dir):
    text = plan(rollup.pid_merge(events.partial_vectors(fixture.tele(spark, sf_dir)), "1 hour"))
    below_first_shuffle = text[text.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in below_first_shuffle and "SortAggregate" not in below_first_shuffle


def test_snapshot_joins_shuffle_nothing_but_the_first_result(spark, sf_dir):
    """A full join has no known partitioning, so its rows (one per process) move once more;
    the rollups themselves are joined where they are."""
    sides = [
        rollup.cpu_stats_exec_reset(fixture.tele(spark, sf_dir, "cpu")),
        rollup.mem_stats(events.classify_faults(fixture.tele(spark, sf_dir, "mem"))),
        rollup.gpu_stats(fixture.tele(spark, sf_dir, "gpu")),
    ]
    shuffles = lambda df: plan(df).count("Exchange hashpartitioning")
    joined = rollup.feature_snapshot(*sides)
    text = plan(joined)
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 2
    assert shuffles(joined) == sum(shuffles(side) for side in sides) + 1


def test_topk_keeps_k_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["topk_energy"](spark, sf_dir))
    assert "WindowGroupLimit" in text


def test_limits_do_not_sort_everything(spark, sf_dir):
    for name in ("top5_processes", "history_tail", "prediction_sample"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_ordered_operators_without_hot_keys_are_one_window(spark, sf_dir):
    """Nothing is hot at this size, which one narrow pass has told before the plan is made."""
    text = plan(QUERIES["counter_rate"](spark, sf_dir))
    # the counter and what it restarts from are two window nodes on one shuffle of raw rows, the third is
    # the sliding one; nothing is planned for hot keys and nothing is stored on the way
    assert text.count("Window [") <= 3 and "_stretch" not in text and "SortMergeJoin" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(host_id#\d+L, pid#\d+L, \d+\)", text)) <= 2


#: Scans of the events that stay in the plan: the facts, and dimensions that derive from events too.
SCANS = {"cpu_slices": 1, "counter_rate": 1, "container_asof": 4, "pid_container_asof": 2}


@pytest.mark.parametrize("name", SCANS)
def test_ordered_operators_plan_their_source_once(spark, sf_dir, name):
    assert plan(QUERIES[name](spark, sf_dir)).count("FileScan parquet") <= SCANS[name]


def test_a_hot_key_is_counted_once_and_cut_from_a_small_table(spark, folder):
    """Rows read: one narrow pass to count, one to cut, then the plan's own."""
    from wattframe.operators import timeline

    rows = spark.range(4000).selectExpr("id AS event_id", "id AS ts_us", "IF(id % 3 = 0, id, 0) AS k")
    rows.write.parquet(f"{folder}/rows")
    read = spark.read.parquet(f"{folder}/rows")
    hot = timeline.known_hot(read, ["k"], "ts_us", 500)
    assert [r.k for r in hot.collect()] == [0] and plan(hot).count("FileScan parquet") == 1
    assert timeline.known_hot(read, ["k"], "ts_us", 5000) is None
    text = plan(timeline.with_previous(read, ["k"], ["ts_us", "event_id"], {"before": "event_id"}, hot_rows=500))
    # the rows twice (all of them, and the hot key's for what is carried on) and the small table beside each
    assert text.count("FileScan parquet") <= 4


def test_no_event_sized_table_is_written(spark, sf_dir, monkeypatch):
    from wattframe.plans import catalog

    def refuse(*args):
        raise AssertionError("stored a table")

    monkeypatch.setattr(catalog, "stored", refuse, raising=False)
    monkeypatch.setattr("wattframe.session.stored", refuse)
    for name in ("container_asof", "counter_rate", "counter_rate_6h"):
        assert QUERIES[name](spark, sf_dir).columns


def test_metric_read_touches_its_own_files(spark, sf_dir):
    text = plan(QUERIES["metric_sample_table"](spark, sf_dir))
    assert re.search(r"PartitionFilters: \[[^\]]*metric[^\]]*energy_joules", text)
