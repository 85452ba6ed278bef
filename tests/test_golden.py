"""Hand-computed values for the formulas."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators import containers, energy, events, metrics, rollup, views

VECTOR = """host_id bigint, pid bigint, comm string, cpu_time_ns bigint, ctx_switches bigint,
    major_faults bigint, minor_faults bigint, gpu_jobs_submitted bigint, gpu_active_ns bigint,
    timestamp_ns bigint"""


def vector(pid=1, comm="bash", cpu=0, major=0, minor=0, jobs=0, host=0):
    return (host, pid, comm, cpu, 0, major, minor, jobs, 0, 0)


def test_heuristic_units(spark):
    rows = [
        vector(1, cpu=10**9),
        vector(2, major=400_000, minor=600_000),
        vector(3, jobs=10_000),
        vector(4, cpu=720_000 * 10**9),
    ]
    est = energy.heuristic(spark.createDataFrame(rows, VECTOR)).orderBy("pid").collect()
    assert [r.energy_joules for r in est] == [5.0, 0.5, 1.0, 3.6e6]
    assert est[0].cpu_energy_joules == 5.0 and est[1].memory_energy_joules == 0.5
    assert est[2].gpu_energy_joules == 1.0
    assert est[3].carbon_grams_co2 == 475.0
    assert all(r.confidence == 0.3 and r.power_watts == r.energy_joules for r in est)


def test_power_uses_the_window(spark):
    df = spark.createDataFrame([vector(cpu=10**9)], VECTOR)
    assert energy.heuristic(df, window_seconds=10.0).first().power_watts == 0.5


def test_parts_add_up(spark):
    rows = [vector(i, cpu=i * 7, major=i, minor=3 * i, jobs=i % 5) for i in range(50)]
    est = energy.heuristic(spark.createDataFrame(rows, VECTOR))
    assert est.where("energy_nj <> cpu_nj + memory_nj + gpu_nj").count() == 0


def test_ai_names_are_exact(spark):
    names = ["python", "Python", "python3.11", "ollama", "", "vllm "]
    df = spark.createDataFrame([(n,) for n in names], "comm string")
    assert [r[0] for r in df.select(S.is_ai("comm")).collect()] == [True, False, False, True, False, False]


def test_fault_classes(spark):
    rows = [("mem", "fault_user", 0), ("mem", "fault_user", 1), ("mem", "fault_user", 6),
            ("mem", "fault_kernel", 0), ("mem", "reclaim", 1), ("cpu", "switch", 1)]
    df = spark.createDataFrame(rows, "probe string, event_kind string, error_code bigint")
    got = [(r.is_major, r.is_minor, r.is_reclaim) for r in events.classify_faults(df).collect()]
    assert got == [(False, True, False), (True, False, False), (False, True, False),
                   (True, False, False), (False, False, True)]


def test_reclaim_only_sets_the_last_fault_time_of_a_new_process(spark):
    rows = [
        (0, 1, 10, 1, "reclaim"), (0, 1, 20, 2, "reclaim"),  # only reclaims: the first one
        (0, 2, 10, 3, "reclaim"), (0, 2, 20, 4, "fault_kernel"), (0, 2, 30, 5, "reclaim"),
        (0, 3, 10, 6, "fault_user"), (0, 3, 40, 7, "reclaim"),
    ]
    df = spark.createDataFrame(rows, "host_id bigint, pid bigint, ts_us bigint, event_id bigint, event_kind string")
    df = df.withColumns({"probe": F.lit("mem"), "error_code": F.lit(0).cast("bigint"), "comm": F.lit("x")})
    got = {r.pid: r.last_fault_ns for r in rollup.mem_stats(events.classify_faults(df)).collect()}
    assert got == {1: 10_000, 2: 20_000, 3: 10_000}


def test_merge_keeps_the_last_name_that_is_not_empty(spark):
    rows = [(0, 1, 1, 1, "a"), (0, 1, 2, 2, "b"), (0, 1, 2, 1, "c"), (0, 1, 3, 3, ""), (0, 2, 1, 4, "")]
    df = spark.createDataFrame(rows, "host_id bigint, pid bigint, ts_us bigint, event_id bigint, comm string")
    zero = F.lit(0).cast("bigint")
    df = df.withColumns({c: zero for c in rollup.COUNTERS}).withColumn("ts", F.timestamp_micros("ts_us"))
    for merged in (rollup.pid_merge(df, None), rollup.pid_merge(df, "1 second"), rollup.pid_merge_single(df)):
        got = {r.pid: (r.comm, r.timestamp_ns) for r in merged.collect()}
        assert got == {1: ("b", 3000), 2: ("", 1000)}


def test_snapshot_name_and_zeros(spark):
    stats = "host_id bigint, pid bigint, {} comm string"
    cpu = spark.createDataFrame(
        [(0, 1, 5, 1, 1, 0, 2, 9, "cpu"), (0, 4, 5, 1, 1, 0, 2, 9, "")],
        stats.format("total_cpu_time_ns bigint, ctx_switches bigint, voluntary_ctx_switches bigint, "
                     "involuntary_ctx_switches bigint, last_cpu_id bigint, last_seen_ns bigint,"),
    )
    mem = spark.createDataFrame(
        [(0, 1, 1, 2, 3, 0, 7, 2, "mem"), (0, 2, 1, 2, 3, 0, 7, 2, "mem"), (0, 4, 0, 0, 0, 1, 7, 0, "mem4")],
        stats.format("major_faults bigint, minor_faults bigint, total_faults bigint, direct_reclaim_count bigint, "
                     "last_fault_ns bigint, estimated_rss_pages bigint,"),
    )
    gpu = spark.createDataFrame(
        [(0, 3, 4, 0, 8, 0, 4, "gpu")],
        stats.format("total_jobs_submitted bigint, total_gpu_active_ns bigint, last_submit_ns bigint, "
                     "last_complete_ns bigint, active_jobs bigint,"),
    )
    got = {r.pid: r for r in rollup.feature_snapshot(cpu, mem, gpu).collect()}
    assert {p: r.comm for p, r in got.items()} == {1: "cpu", 2: "mem", 3: "", 4: "mem4"}
    assert got[2].rss_bytes == 8192 and got[2].timestamp_ns == 0 and got[2].cpu_time_ns == 0
    assert got[3].gpu_jobs_submitted == 4
    assert not any(v is None for r in got.values() for v in r)


def test_container_id_patterns(spark):
    h64 = "ab" * 32
    texts = {
        f"12:memory:/docker/{h64}": "abababababab",
        f"0::/kubepods.slice/cri-containerd-{h64}.scope": "abababababab",
        f"0::/machine.slice/libpod-{h64}.scope": "abababababab",
        f"0::/system.slice/foo-{'0123456789abcd'}.scope": "0123456789ab",
        f"0::/odd/{h64}/x": "abababababab",
        "0::/": "",
        "": "",
        "garbage": "",
        "0::/user.slice/user-1000.slice": "",
        "0::/docker/short": "",
        f"0::/\n1:name=systemd:/docker/{'c' * 12}\n2:cpu:/docker/{'d' * 12}": "c" * 12,
        f"0::/libpod-{'e' * 12}.scope/docker/{'f' * 12}": "f" * 12,  # pattern order, not position
        f"  1:cpu:/docker/{'a' * 12}:x  ": "a" * 12,
        f"0::/docker/{'A' * 64}": "",
    }
    df = spark.createDataFrame(list(texts.items()), "t string, want string")
    bad = df.where(S.container_id("t") != F.col("want")).collect()
    assert not bad


def test_memory_limit_text(spark):
    rows = [("max",), (" max\n",), ("9223372036854771712",), ("1024\n",), ("12x",), ("",),
            ("-1",), ("+5",), ("18446744073709551615",), ("18446744073709551616",)]
    df = spark.createDataFrame([(0, i, t[0]) for i, t in enumerate(rows)], "host_id bigint, pid bigint, mem_limit_text string")
    got = [(r.limit_bytes, r.parse_error) for r in containers.memory_limits(df).orderBy("pid").collect()]
    assert got == [(0, False), (0, False), (0, False), (1024, False), (12, False), (None, True), (None, True), (None, True),
                   (2**64 - 1, False), (None, True)]


def test_inventory_rows(spark):
    doc = (
        '[{"Id":"%s","Names":["/a/b","/c"],"Image":"i","Labels":{"io.kubernetes.pod.name":"p"}},'
        '{"Id":"%s","Names":[],"Image":"j","Labels":null}]' % ("1" * 64, "2" * 64)
    )
    rows = containers.parse_inventory(spark.createDataFrame([(doc,)], "doc string")).orderBy("full_id").collect()
    assert [(r.short_id, r.name, r.pod_name, r.pod_namespace) for r in rows] == [
        ("1" * 12, "a/b", "p", ""), ("2" * 12, "", "", "")]


def test_enrich_ignores_unnamed_and_breaks_ties(spark):
    inventory = spark.createDataFrame(
        [("a" * 64, "a" * 12, "late", "", "", ""), ("a" * 12 + "0" * 52, "a" * 12, "first", "", "", ""),
         ("b" * 64, "b" * 12, "", "", "", "")],
        "full_id string, short_id string, name string, image_name string, pod_name string, pod_namespace string",
    )
    vectors = spark.createDataFrame(
        [(0, 1, 0, "a" * 12), (0, 2, 0, "b" * 12), (0, 3, 0, "")],
        "host_id bigint, pid bigint, timestamp_ns bigint, container_id string",
    )
    got = {r.pid: (r.container_id, r.container_name) for r in containers.enrich(vectors, inventory).collect()}
    assert got == {1: ("a" * 12, "first"), 2: ("b" * 12, ""), 3: ("", "")}


def test_label_defaults(spark):
    df = spark.createDataFrame([("", ""), ("c1", ""), ("c1", "web")], "container_id string, container_name string")
    got = [(r.container_id, r.container_name) for r in metrics.labelled(df).collect()]
    assert got == [("host", "host"), ("c1", "c1"), ("c1", "web")]


@pytest.mark.parametrize(
    "values, want",
    [([0.85] * 4, 0.85), ([0.3] * 3, 0.25), ([0.05, 0.05], 0.05), ([1.5] * 3, 0.99), ([0.3, 0.85], 0.3)],
)
def test_histogram_quantile(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "confidence double")
    got = metrics.histogram(df).select(metrics.histogram_quantile(0.5)).first()[0]
    assert got == pytest.approx(want)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(101)], "confidence double")
    buckets = metrics.histogram(df).first().buckets
    counts = [b.cumulative for b in buckets]
    assert counts == sorted(counts) and counts[-1] == 101 and counts[0] == 11


def test_bands(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (49.9,), (50.0,)], "v double")
    got = [r[0] for r in df.select(S.band("v", "energy")).collect()]
    assert got == ["green", "#EAB839", "#EAB839", "red"]


def test_nul_cut(spark):
    df = spark.createDataFrame([("ab\0cd",), ("abc",), ("\0x",)], "s string")
    assert [r[0] for r in df.select(S.nul_cut("s")).collect()] == ["ab", "abc", ""]


def test_empty_input(spark):
    empty = spark.createDataFrame([], VECTOR)
    est = energy.heuristic(empty).withColumns(
        {"interval": F.lit(None).cast("timestamp_ntz"), "container_id": F.lit(""), "container_name": F.lit("")}
    )
    assert est.count() == 0
    assert views.system_summary(est).count() == 0
    assert metrics.samples(est).count() == 0
    assert views.topk(est).count() == 0


def test_region_default(spark):
    df = spark.createDataFrame([(0, 1, "fr"), (0, 2, "mars"), (0, 3, None)], "host_id bigint, pid bigint, region string")
    for table in (None, energy.regions(spark)):
        got = {r.pid: r.intensity for r in energy.with_intensity(df, table).collect()}
        assert got == {1: 50.0, 2: fixed.DEFAULT_INTENSITY, 3: fixed.DEFAULT_INTENSITY}


def test_unreadable_inventory_is_reported(spark):
    df = spark.createDataFrame([(1, '[{"Id":"a"}]'), (2, '[{"Id":"b"'), (3, "")], "n int, doc string")
    assert sorted(r.n for r in containers.unreadable_inventories(df).collect()) == [2, 3]
