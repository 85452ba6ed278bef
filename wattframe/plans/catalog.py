"""The registered queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators import containers, energy, events, metrics, model, refits, rollup, views
from wattframe.plans import attribution as A
from wattframe.plans import fixture
from wattframe.session import configure, shared_dir, stored
from wattframe.sources import calibration, records, samples, tables, telemetry
from wattframe.streaming import jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


VECTOR = [
    "interval", "host_id", "pid", "comm", "cpu_time_ns", "ctx_switches", "major_faults",
    "minor_faults", "gpu_jobs_submitted", "gpu_active_ns", "timestamp_ns",
]
ESTIMATE = [
    "energy_joules", "cpu_energy_joules", "memory_energy_joules", "gpu_energy_joules",
    "power_watts", "carbon_grams_co2", "confidence", "is_ai_inference",
]


# --- events ------------------------------------------------------------------------


@query
def partial_vectors(spark, sf_dir):
    return events.partial_vectors(fixture.tele(spark, sf_dir)).drop("ts_us", "region")


@query
def fault_classes(spark, sf_dir):
    mem = events.classify_faults(fixture.tele(spark, sf_dir, "mem"))
    return mem.select("event_id", "host_id", "pid", "event_kind", "is_major", "is_minor", "is_reclaim")


@query
def pid_tgid_split(spark, sf_dir):
    packed = fixture.tele(spark, sf_dir).select(
        "event_id", (F.shiftleft("tgid", 32) + F.col("pid")).alias("pid_tgid")
    )
    return events.split_pid_tgid(packed)


@query
def ai_flag(spark, sf_dir):
    return fixture.tele(spark, sf_dir).select(
        "event_id", "comm", S.is_ai("comm").alias("is_ai_inference")
    )


@query
def cpu_slices(spark, sf_dir):
    return events.cpu_slices(fixture.sched(spark, sf_dir), keys=["cpu_id"]).drop("ts_us")


@query
def decode_records(spark, sf_dir):
    return records.decode_records(fixture.packed_records(spark, sf_dir))


@query
def malformed_records(spark, sf_dir):
    """Records cut at lengths around every limit: what each decoder makes of them."""
    packed = fixture.packed_records(spark, sf_dir)
    cut = packed.withColumn("kept", (F.col("event_id") % 12 * 7).cast("int")).withColumn(
        "data", F.substring("data", F.lit(1), F.col("kept"))
    )
    kept = F.length("data").alias("n_bytes")
    as_vectors = records.decode_records(cut.select(kept, "probe", "data"), keep=["n_bytes"])
    fields = [
        records.decode_events(cut.select(kept, "probe", "data"), probe, keep=["n_bytes"]).select(
            "probe", "n_bytes", "malformed", "partial"
        )
        for probe in ("cpu", "mem", "gpu")
    ]
    full = fields[0].unionByName(fields[1]).unionByName(fields[2])
    counted = full.groupBy("probe", "n_bytes", "malformed", "partial").agg(
        F.count(F.lit(1)).alias("records")
    )
    vectors = as_vectors.groupBy("probe", "n_bytes", "malformed").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("pid") > 0).alias("with_header")
    )
    return counted.join(vectors, ["probe", "n_bytes", "malformed"])


@query
def records_to_energy(spark, sf_dir):
    """Binary records all the way to joules and grams per process and hour."""
    packed = fixture.packed_records(spark, sf_dir)
    decoded = records.with_time(records.decode_records(packed, keep=["host_id", "event_id"]))
    vectors = rollup.pid_merge(decoded, window=A.INTERVAL)
    return energy.heuristic(vectors).select("interval", "host_id", "pid", "comm", *ESTIMATE)


@query
def snapshot_from_records(spark, sf_dir):
    """Statistics of the three probes from their full records, joined per process."""
    packed = fixture.packed_records(spark, sf_dir)
    cpu, mem, gpu = [
        records.with_time(records.decode_events(packed, probe, keep=["host_id", "event_id"])).where(
            "not malformed"
        )
        for probe in ("cpu", "mem", "gpu")
    ]
    return rollup.feature_snapshot(
        rollup.cpu_stats_exec_reset(cpu),
        rollup.mem_stats(events.classify_faults(mem)),
        rollup.gpu_stats(gpu),
    )


# --- rollups -----------------------------------------------------------------------


@query
def pid_batch_merge(spark, sf_dir):
    return A.vectors(spark, sf_dir).select(*VECTOR)


@query
def cpu_stats(spark, sf_dir):
    cpu = fixture.tele(spark, sf_dir, "cpu")
    return rollup.cpu_stats(cpu.where(F.col("event_kind") == "switch"))


@query
def cpu_stats_exec_reset(spark, sf_dir):
    return rollup.cpu_stats_exec_reset(fixture.tele(spark, sf_dir, "cpu"))


@query
def mem_stats(spark, sf_dir):
    return rollup.mem_stats(events.classify_faults(fixture.tele(spark, sf_dir, "mem")))


@query
def gpu_stats(spark, sf_dir):
    return rollup.gpu_stats(fixture.tele(spark, sf_dir, "gpu"))


@query
def feature_snapshot(spark, sf_dir):
    return A.snapshot(spark, sf_dir)


@query
def snapshot_tables(spark, sf_dir):
    """The same join from statistics tables that were written out and read back."""
    path = shared_dir(spark, "snapshot")
    rollups = {
        "cpu": rollup.cpu_stats_exec_reset(fixture.tele(spark, sf_dir, "cpu")),
        "mem": rollup.mem_stats(events.classify_faults(fixture.tele(spark, sf_dir, "mem"))),
        "gpu": rollup.gpu_stats(fixture.tele(spark, sf_dir, "gpu")),
    }
    for probe, stats in rollups.items():
        tables.write_stats(stats, path, probe)
    return rollup.feature_snapshot(*[tables.read_stats(spark, path, p) for p in rollups])


# --- containers --------------------------------------------------------------------


@query
def cgroup_container_id(spark, sf_dir):
    return A.process_containers(spark, sf_dir)


@query
def mem_limit(spark, sf_dir):
    return containers.memory_limits(fixture.cgroup(spark, sf_dir))


@query
def container_inventory(spark, sf_dir):
    rows = A.known_inventory(spark, sf_dir)
    return rows.withColumn("label_count", F.size("labels").cast("bigint")).drop("labels")


@query
def container_enrich(spark, sf_dir):
    return A.attributed(spark, sf_dir).select(
        "interval", "host_id", "pid", "container_id", "container_name", "image_name",
        "pod_name", "pod_namespace",
    )


@query
def container_asof(spark, sf_dir):
    named = containers.enrich_asof(
        fixture.tele(spark, sf_dir).select("event_id", "ts", "ts_us", "host_id", "pid"),
        fixture.inventory_history(spark, sf_dir),
        ids=A.process_containers(spark, sf_dir),
    )
    return named.select("event_id", "ts", "host_id", "pid", "container_id", "container_name")


@query
def pid_container_asof(spark, sf_dir):
    """Container id and name of every event, the pid's process and the inventory taken as of its time."""
    rows = fixture.tele(spark, sf_dir)
    cpu = fixture.tele(spark, sf_dir, "cpu")
    versions = stored(
        containers.pid_versions(
            fixture.cgroup_captures(spark, sf_dir), cpu.where(F.col("event_kind") == "exec")
        ),
        "pid-versions",
    )
    located = containers.attach_container_id_asof(rows.select("event_id", "ts", "ts_us", "host_id", "pid"), versions)
    named = containers.enrich_asof(
        stored(located, "located"), stored(fixture.inventory_history(spark, sf_dir), "inventory")
    )
    return named.select("event_id", "ts", "host_id", "pid", "container_id", "container_name")


# --- energy ------------------------------------------------------------------------


@query
def heuristic_energy(spark, sf_dir):
    """Joules and grams of CO2 per process and hour."""
    return energy.heuristic(A.vectors(spark, sf_dir)).select(
        "interval", "host_id", "pid", "comm", *ESTIMATE
    )


@query
def fallback_estimates(spark, sf_dir):
    return A.fallback(spark, sf_dir).select(
        "interval", "host_id", "pid", "comm", *ESTIMATE, "model_version"
    )


@query
def calibrated_energy(spark, sf_dir):
    rows = energy.calibrated_energy(fixture.calibration(spark, sf_dir))
    return rows.select("event_id", "estimated_joules")


@query
def carbon_by_region(spark, sf_dir):
    vectors = A.vectors(spark, sf_dir, keys=("host_id", "pid", "region"))
    located = energy.with_intensity(vectors)
    return views.carbon_by_region(energy.heuristic(located, intensity=F.col("intensity")))


# --- dashboard ---------------------------------------------------------------------


@query
def system_summary(spark, sf_dir):
    return views.system_summary(A.located_estimates(spark, sf_dir))


@query
def threshold_bands(spark, sf_dir):
    return views.bands(views.system_summary(A.located_estimates(spark, sf_dir)))


@query
def energy_totals(spark, sf_dir):
    return views.totals(energy.heuristic(A.vectors(spark, sf_dir)))


@query
def energy_by_component(spark, sf_dir):
    return views.by_component(energy.heuristic(A.vectors(spark, sf_dir)))


@query
def energy_by_container(spark, sf_dir):
    return views.by(A.estimates(spark, sf_dir), ["interval", "container_id"])


@query
def energy_by_container_name(spark, sf_dir):
    return views.by(A.estimates(spark, sf_dir), ["interval", "container_name"])


@query
def gpu_energy_by_comm(spark, sf_dir):
    est = energy.heuristic(A.vectors(spark, sf_dir))
    return est.groupBy("interval", "comm").agg(
        S.joules(metrics.total_nj("gpu_nj")).alias("gpu_energy_joules")
    )


@query
def ai_vs_general(spark, sf_dir):
    return views.ai_split(energy.heuristic(A.vectors(spark, sf_dir)))


@query
def series_reducers(spark, sf_dir):
    series = views.by_component(energy.heuristic(A.vectors(spark, sf_dir)))
    return views.reduce_series(series, "energy_joules", ["component"])


@query
def topk_energy(spark, sf_dir):
    return views.topk(energy.heuristic(A.vectors(spark, sf_dir)))


@query
def top5_processes(spark, sf_dir):
    now = A.latest_interval(spark, sf_dir)
    return views.top_processes(A.latest_estimates(spark, sf_dir), now=now)


@query
def history_tail(spark, sf_dir):
    since = A.latest_interval(spark, sf_dir, fixed.HISTORY_POINTS)
    recent = A.located_estimates(spark, sf_dir, since)
    return views.history_tail(views.system_summary(recent))


@query
def lookback_15m(spark, sf_dir):
    recent = views.lookback(fixture.tele(spark, sf_dir), "15 minutes")
    return recent.select("event_id", "ts", "host_id", "pid", "probe")


# --- metric series -----------------------------------------------------------------


@query
def metric_samples(spark, sf_dir):
    return metrics.samples(A.stored_estimates(spark, sf_dir))


def _sample_table(spark, sf_dir):
    path = shared_dir(spark, "samples")
    samples.write_samples(A.stored_estimates(spark, sf_dir), path)
    return samples.read_samples(spark, path)


@query
def metric_sample_table(spark, sf_dir):
    """Samples written to the partitioned table, one metric read back from its own files."""
    energy_series = _sample_table(spark, sf_dir).where(F.col("metric") == "energy_joules")
    return energy_series.groupBy("interval").agg(
        F.count(F.lit(1)).alias("series"), F.max("value").alias("largest")
    )


@query
def ai_vs_general_series(spark, sf_dir):
    """The AI split from the exported energy and flag series."""
    table = _sample_table(spark, sf_dir)
    return views.ai_split_series(
        table.where(F.col("metric") == "energy_joules"),
        table.where(F.col("metric") == metrics.AI_GAUGE),
    )


@query
def gauge_latest(spark, sf_dir):
    now = A.latest_interval(spark, sf_dir)
    return metrics.gauge_latest(A.latest_estimates(spark, sf_dir), now=now)


@query
def counter_cumulative(spark, sf_dir):
    return metrics.counters(A.stored_estimates(spark, sf_dir))


@query
def carbon_counter_rate(spark, sf_dir):
    """Rate of every series' carbon counter over six hours."""
    return metrics.carbon_rate(A.stored_estimates(spark, sf_dir), 6 * metrics.HOUR)


@query
def carbon_per_min(spark, sf_dir):
    vectors = events.partial_vectors(fixture.tele(spark, sf_dir))
    parts = energy.heuristic_columns()
    nj = parts["cpu_nj"] + parts["memory_nj"] + parts["gpu_nj"]
    rate = metrics.rate_over_events(vectors, {"nj": nj})
    return rate.select(
        "ts", S.carbon_grams(S.joules("nj"), fixed.DEFAULT_INTENSITY).alias("carbon_grams_per_min")
    )


@query
def faults_per_min(spark, sf_dir):
    mem = events.classify_faults(fixture.tele(spark, sf_dir, "mem"))
    return metrics.rate_over_events(
        mem,
        {
            "major_per_min": F.col("is_major").cast("bigint"),
            "minor_per_min": F.col("is_minor").cast("bigint"),
            "reclaim_per_min": F.col("is_reclaim").cast("bigint"),
        },
    )


def _rate(spark, sf_dir, window_us):
    return metrics.increase_rate(
        A.counter_samples(spark, sf_dir), "counter_ns", "counter_before_ns", rollup.PROCESS, rollup.ORDER, window_us
    )


@query
def counter_rate(spark, sf_dir):
    return _rate(spark, sf_dir, 5 * metrics.MINUTE)


@query
def counter_rate_6h(spark, sf_dir):
    return _rate(spark, sf_dir, 6 * metrics.HOUR)


@query
def confidence_histogram(spark, sf_dir):
    return metrics.bucket_series(metrics.histogram(A.fallback(spark, sf_dir)))


@query
def confidence_median(spark, sf_dir):
    day = F.window("interval", "1 day")["start"]
    hist = metrics.histogram(A.fallback(spark, sf_dir).withColumn("day", day), by=["day"])
    median = F.round(metrics.histogram_quantile(0.5), 9)
    return hist.select("day", "observations", median.alias("median_confidence"))


@query
def confidence_panel(spark, sf_dir):
    """Median confidence over the last six hours, at each interval."""
    panel = metrics.quantile_over_window(A.fallback(spark, sf_dir), 0.5, 6 * metrics.HOUR)
    return panel.select("interval", "observations", F.round("quantile", 9).alias("median_confidence"))


def _histogram(spark, sf_dir):
    """The confidence histogram of an exporter that is restarted every midnight."""
    day = F.date_trunc("day", F.col("interval").cast("timestamp")).cast("string")
    return metrics.histogram_counters(A.fallback(spark, sf_dir), life=day)


@query
def histogram_counters(spark, sf_dir):
    return metrics.histogram_series(_histogram(spark, sf_dir))


@query
def confidence_rate_panel(spark, sf_dir):
    """Median and mean confidence from the rates of the histogram's counters over six hours."""
    rates = metrics.histogram_rate(stored(_histogram(spark, sf_dir), "histogram"), 6 * metrics.HOUR)
    mean = F.when(F.col("observations") > 0, F.col("sum_per_second") / F.col("count_per_second"))
    return rates.select(
        "interval", "observations", F.round(metrics.histogram_quantile(0.5), 9).alias("median_confidence"),
        F.round(mean, 9).alias("mean_confidence"), F.round("count_per_second", 9).alias("count_per_second"),
    )


# --- telemetry frames --------------------------------------------------------------


@query
def telemetry_json(spark, sf_dir):
    """The frames, looked at through JSON paths into their text."""
    docs = telemetry.frames(A.stored_estimates(spark, sf_dir))
    at = lambda path: F.get_json_object("value", path)
    return docs.select(
        "interval",
        "host_id",
        "part",
        at("$.type").alias("type"),
        at("$.timestamp").alias("timestamp"),
        F.json_array_length(at("$.process_data")).cast("bigint").alias("processes"),
        at("$.process_data[0].pid").cast("bigint").alias("first_pid"),
        at("$.process_data[0].container_id").isNull().alias("first_on_host"),
        at("$.summary.ai_workload_count").cast("bigint").alias("ai_workload_count"),
        at("$.summary.container_count").cast("bigint").alias("container_count"),
        at("$.summary.total_energy_joules").cast("double").alias("total_energy_joules"),
    )


@query
def telemetry_parse(spark, sf_dir):
    """Frames written as JSON lines between greetings and cut-off frames, and read back."""
    path = shared_dir(spark, "feed")
    docs = telemetry.frames(A.stored_estimates(spark, sf_dir)).select("value")
    greeting = F.to_json(
        F.struct(F.lit("connected").alias("type"), F.length("value").alias("message"))
    )
    cut_off = F.expr("left(value, length(value) div 2)")
    lines = docs.select(F.explode(F.array("value", greeting, cut_off)).alias("value"))
    lines.write.mode("overwrite").text(path)
    frames = telemetry.parse(spark.read.text(path))
    rows = frames.select("interval", F.col("summary.*"), F.explode("process_data").alias("p"))
    return rows.select(
        "interval",
        "tracked_processes",
        "total_energy_joules",
        "p.pid",
        "p.comm",
        F.coalesce("p.container_id", F.lit("")).alias("container_id"),
        F.coalesce("p.container_name", F.lit("")).alias("container_name"),
        "p.energy_joules",
        "p.is_ai_workload",
    )


# --- model -------------------------------------------------------------------------


@query
def calibration_csv_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "calibration")
    calibration.write_calibration(fixture.calibration(spark, sf_dir), path)
    back = calibration.read_calibration(spark, path)
    return back.withColumn("event_id", F.col("event_id").cast("bigint"))


@query
def standardize(spark, sf_dir):
    scaled = model.standardize(fixture.calibration(spark, sf_dir))
    return scaled.select(
        "event_id", *[F.round(f"scaled_{f}", 5).alias(f"scaled_{f}") for f in fixed.FEATURES]
    )


@query
def ols_single(spark, sf_dir):
    fit = model.single_feature_ols(fixture.calibration(spark, sf_dir), "gpu_active_ns")
    return fit.select(
        F.round(F.col("slope") * F.lit(1e9), 4).alias("slope_nj"),
        F.round("intercept", 4).alias("intercept"),
        F.round("r2_score", 6).alias("r2_score"),
        "n",
    )


@query
def model_metrics(spark, sf_dir):
    scored = energy.calibrated_energy(fixture.calibration(spark, sf_dir))
    quality = model.quality(scored, fixed.TARGET, "estimated_joules")
    return quality.select(
        "n",
        F.round("r2_score", 6).alias("r2_score"),
        F.round("mae_joules", 6).alias("mae_joules"),
        "min_joules",
        "max_joules",
    )


@query
def feature_ranges(spark, sf_dir):
    return model.feature_ranges(fixture.calibration(spark, sf_dir))


def _fit(spark, sf_dir):
    data = fixture.calibration(spark, sf_dir)
    return data, model.train(data)


@query
def train_model(spark, sf_dir):
    _, fitted = _fit(spark, sf_dir)
    linear = model.LinearEnergyModel.from_pipeline(fitted)
    return model.coefficients(spark, linear).select(
        "feature", F.round("coefficient", 6).alias("coefficient")
    )


def _daily_fits(spark, sf_dir):
    """Calibration rows with their day, and a model version per day."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    rows = fixture.calibration(spark, sf_dir, keep=("ts",)).withColumns({"interval": day, "model": F.lit("energy")})
    states = stored(refits.gram_state(rows, ["model", "interval"]), "gram")
    return rows, stored(refits.refits(states, ["model"]), "versions")


@query
def incremental_ols(spark, sf_dir):
    """The coefficients of a model that is refitted every day on all days so far."""
    _, versions = _daily_fits(spark, sf_dir)
    names = F.array(*[F.lit(f) for f in fixed.FEATURES])
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("coefficient"))).alias("p")
    return versions.select("interval", "n", pairs).select(
        "interval", "n", F.col("p.feature").alias("feature"), F.round("p.coefficient", 5).alias("coefficient")
    )


@query
def versioned_predictions(spark, sf_dir):
    """Each calibration row predicted by the version that was current on its day."""
    rows, versions = _daily_fits(spark, sf_dir)
    scored = refits.predict_asof(rows, versions, ["model"])
    return scored.select("event_id", "model_interval", F.round("predicted_joules", 3).alias("predicted_joules"))


@query
def feature_importance(spark, sf_dir):
    _, fitted = _fit(spark, sf_dir)
    shares = model.importance(spark, model.LinearEnergyModel.from_pipeline(fitted))
    return shares.select("feature", F.round("importance", 8).alias("importance"))


@query
def predict_energy(spark, sf_dir):
    scored = model.predict(*_fit(spark, sf_dir))
    return scored.select(
        "event_id", "energy_joules", F.round("predicted_joules", 4).alias("predicted_joules")
    )


@query
def prediction_sample(spark, sf_dir):
    scored = model.predict(*_fit(spark, sf_dir))
    error = F.abs(F.col("energy_joules") - F.col("predicted_joules"))
    return (
        scored.orderBy("event_id")
        .limit(5)
        .select(
            "event_id",
            F.col("energy_joules").alias("actual"),
            F.round("predicted_joules", 4).alias("predicted"),
            F.round(error, 4).alias("error"),
        )
    )


@query
def model_roundtrip(spark, sf_dir):
    data, fitted = _fit(spark, sf_dir)
    path = shared_dir(spark, "model")
    calibration.save_model(fitted, path)
    scored = model.predict(data, calibration.load_model(path))
    return scored.select("event_id", F.round("predicted_joules", 4).alias("predicted_joules"))


@query
def energy_breakdown(spark, sf_dir):
    data = fixture.calibration(spark, sf_dir).withColumnRenamed("energy_joules", "measured_joules")
    return A.REFERENCE_MODEL.breakdown(data).select(
        "event_id", "energy_joules", "cpu_energy_joules", "memory_energy_joules", "gpu_energy_joules"
    )


@query
def model_estimates(spark, sf_dir):
    est = energy.model_estimates(A.snapshot(spark, sf_dir), A.REFERENCE_MODEL)
    return est.select("host_id", "pid", "comm", *ESTIMATE, "model_version")


# --- streams -----------------------------------------------------------------------


def _events(spark, sf_dir, probe=None):
    stream = tables.stream_events(spark, sf_dir)
    return fixture.telemetry(stream if probe is None else fixture.only_probe(stream, probe))


def _vectors(spark, sf_dir, heartbeats=None):
    return jobs.partial_stream(_events(spark, sf_dir), heartbeats)


def _to_the_end(spark, sf_dir, path, run, after=dt.timedelta(days=1)):
    """Runs a stream over the events, then once more with a heartbeat of a later day, which
    closes the windows that were still open.  ``run`` takes the stream of heartbeats."""
    beats = f"{path}/heartbeats"
    tables.heartbeat(spark, beats)
    run(tables.stream_heartbeats(spark, beats))
    last = tables.read_events(spark, sf_dir).agg(F.max("ts")).first()[0]
    if last is not None:
        tables.heartbeat(spark, beats, last + after)
        run(tables.stream_heartbeats(spark, beats))


@query
def stream_fanin(spark, sf_dir):
    """Three probe streams, each reading its own event types, as one."""
    path = shared_dir(spark, "fanin")
    probes = [events.partial_vectors(_events(spark, sf_dir, p)) for p in ("cpu", "mem", "gpu")]
    sinks.append_files(jobs.fan_in(*probes), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").drop("ts_us", "region")


@query
def stream_pid_merge(spark, sf_dir):
    path = shared_dir(spark, "merge")
    merged = jobs.pid_merge(_vectors(spark, sf_dir), A.INTERVAL)
    sinks.changelog(merged, f"{path}/out", f"{path}/checkpoint", keys=["interval", "host_id", "pid"])
    return sinks.latest(spark, f"{path}/out", ["interval", "host_id", "pid"]).select(*VECTOR)


@query
def stream_counters(spark, sf_dir):
    path = shared_dir(spark, "counters")
    labels = ["host_id", "pid", "comm"]
    est = jobs.scored(events.partial_vectors(_events(spark, sf_dir)))
    sinks.changelog(jobs.counters(est, labels), f"{path}/out", f"{path}/checkpoint", keys=labels)
    return sinks.latest(spark, f"{path}/out", labels)


@query
def stream_exec_reset(spark, sf_dir):
    path = shared_dir(spark, "exec")

    def run(heartbeats):
        timed = jobs.with_event_time(_events(spark, sf_dir, "cpu"), heartbeats=heartbeats)
        sinks.changelog(
            jobs.exec_reset(timed), f"{path}/out", f"{path}/checkpoint", "append", keys=rollup.PROCESS
        )

    _to_the_end(spark, sf_dir, path, run)
    return sinks.latest(spark, f"{path}/out", rollup.PROCESS)


def _process_stats(spark, sf_dir):
    """The latest statistics of every process, from the keyed state."""
    path = shared_dir(spark, "process-stats")

    def run(heartbeats):
        timed = jobs.with_event_time(_events(spark, sf_dir), heartbeats=heartbeats)
        sinks.changelog(
            jobs.process_stats(timed), f"{path}/out", f"{path}/checkpoint", "append", keys=rollup.PROCESS
        )

    _to_the_end(spark, sf_dir, path, run)
    return sinks.latest(spark, f"{path}/out", rollup.PROCESS)


@query
def stream_mem_stats(spark, sf_dir):
    return jobs.mem_stats(_process_stats(spark, sf_dir))


@query
def stream_gpu_stats(spark, sf_dir):
    return jobs.gpu_stats(_process_stats(spark, sf_dir))


@query
def stream_feature_snapshot(spark, sf_dir):
    return jobs.feature_snapshot(_process_stats(spark, sf_dir))


@query
def stream_container_asof(spark, sf_dir):
    """Events named by the inventory as of their time, both read as streams."""
    path = shared_dir(spark, "asof")
    fixture.inventory_history(spark, sf_dir).write.parquet(f"{path}/history")
    schema = spark.read.parquet(f"{path}/history").schema

    def run(heartbeats):
        rows = _events(spark, sf_dir).select("event_id", "ts", "ts_us", "host_id", "pid")
        facts = containers.attach_container_id(rows, A.process_containers(spark, sf_dir))
        history = spark.readStream.schema(schema).parquet(f"{path}/history")
        named = jobs.container_asof(facts, history, heartbeats=heartbeats)
        sinks.append_files(named, f"{path}/out", f"{path}/checkpoint")

    _to_the_end(spark, sf_dir, path, run)
    return spark.read.parquet(f"{path}/out").drop("ts_us")


#: Silence after which a counter of the fixture's hourly windows ends.
SILENCE = dt.timedelta(hours=20)


def _silent_counters(spark, sf_dir):
    path = shared_dir(spark, "silent")

    def run(heartbeats):
        est = jobs.scored(_vectors(spark, sf_dir, heartbeats))
        counted = jobs.silent_counters(est, ["host_id", "pid"], SILENCE, A.INTERVAL)
        sinks.append_files(counted, f"{path}/out", f"{path}/checkpoint")

    _to_the_end(spark, sf_dir, path, run, after=dt.timedelta(days=3))
    return spark.read.parquet(f"{path}/out")


@query
def stream_counters_expiry(spark, sf_dir):
    """Counters that end when their series is silent, and start from 0 when it returns."""
    return _silent_counters(spark, sf_dir).select(
        "ts", "host_id", "pid", S.joules("nj_total").alias(metrics.COUNTERS[0]),
        metrics.grams(F.col("mc_total")).alias(metrics.COUNTERS[1]), "ended",
    )


@query
def stream_enriched(spark, sf_dir):
    path = shared_dir(spark, "enriched")
    enriched = jobs.enriched(
        _vectors(spark, sf_dir), A.process_containers(spark, sf_dir), A.known_inventory(spark, sf_dir)
    ).select("event_id", "host_id", "pid", "container_id", "container_name", "pod_name", "intensity")
    sinks.append_files(enriched, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query
def stream_energy(spark, sf_dir):
    path = shared_dir(spark, "energy")
    scored = jobs.scored(_vectors(spark, sf_dir)).select("event_id", "host_id", "pid", "comm", *ESTIMATE)
    sinks.append_files(scored, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query
def stream_summary(spark, sf_dir):
    path = shared_dir(spark, "summary")

    def run(heartbeats):
        jobs.run_summary(
            _vectors(spark, sf_dir, heartbeats), f"{path}/out", f"{path}/checkpoint",
            lambda: A.process_containers(spark, sf_dir), A.INTERVAL,
        )

    _to_the_end(spark, sf_dir, path, run)
    return spark.read.parquet(f"{path}/out").drop(sinks.BATCH)


@query
def stream_decode(spark, sf_dir):
    """Captured segments decoded on a stream: vectors and rejects, read back from their two folders."""
    path = shared_dir(spark, "decode")
    fixture.captured_segments(spark, sf_dir).write.parquet(f"{path}/segments")
    segments = spark.readStream.schema("content binary").option("maxFilesPerTrigger", 4).parquet(f"{path}/segments")
    jobs.run_decode(segments, f"{path}/vectors", f"{path}/rejects", f"{path}/checkpoint")
    rejects = spark.read.parquet(f"{path}/rejects").withColumn("raw_bytes", F.octet_length("raw"))
    vectors = spark.read.parquet(f"{path}/vectors").withColumn("raw_bytes", F.lit(None).cast("int"))
    return vectors.unionByName(rejects.drop("raw")).drop(sinks.BATCH)


@query
def stream_telemetry_parse(spark, sf_dir):
    """A feed with greetings, cut-off frames and frames that are sent three times, read as a stream."""
    path = shared_dir(spark, "feed-stream")
    docs = telemetry.frames(A.stored_estimates(spark, sf_dir)).select("value")
    greeting = F.to_json(F.struct(F.lit("connected").alias("type"), F.length("value").alias("message")))
    cut_off = F.expr("left(value, length(value) div 2)")
    lines = docs.select(F.explode(F.array("value", greeting, "value", cut_off)).alias("value"))
    lines.write.text(f"{path}/feed")
    docs.write.mode("append").text(f"{path}/feed")
    feed = spark.readStream.schema("value string").text(f"{path}/feed")
    frames, unreadable = telemetry.parse_stream(feed, jobs.WATERMARK, replayed_within="60 days")
    sinks.append_files(frames, f"{path}/frames", f"{path}/checkpoint")
    sinks.append_files(unreadable, f"{path}/rejects", f"{path}/rejects-checkpoint")
    rows = spark.read.parquet(f"{path}/frames").select("interval", F.col("summary.*"), F.explode("process_data").alias("p"))
    read = rows.groupBy("interval", "tracked_processes").agg(
        F.count(F.lit(1)).alias("processes"), F.sum(F.round(F.col("p.energy_joules") * 1e9).cast("bigint")).alias("nj")
    ).withColumn("unreadable", F.lit(None).cast("bigint"))
    rejects = spark.read.schema("value string").parquet(f"{path}/rejects")
    return read.unionByName(rejects.agg(F.count(F.lit(1)).alias("unreadable")), allowMissingColumns=True)


def _closed(spark, sf_dir, heartbeats, keys=rollup.PROCESS):
    """Estimates of closed windows that can go on into another stateful step."""
    merged = jobs.pid_merge(_vectors(spark, sf_dir, heartbeats), A.INTERVAL, keys, keep_time=True)
    return energy.heuristic(merged)


def _appended(spark, sf_dir, name, stream):
    """What ``stream`` (of the heartbeats) has appended to files."""
    path = shared_dir(spark, name)

    def run(heartbeats):
        sinks.append_files(stream(heartbeats), f"{path}/out", f"{path}/checkpoint")

    _to_the_end(spark, sf_dir, path, run)
    return spark.read.parquet(f"{path}/out")


def _summaries(spark, sf_dir, heartbeats):
    located = containers.attach_container_id(
        _closed(spark, sf_dir, heartbeats), A.process_containers(spark, sf_dir)
    )
    return jobs.summaries(located, A.INTERVAL)


@query
def stream_summary_chained(spark, sf_dir):
    """The system summary as one plan, windows merged and then summed up, with an exactly-once sink."""
    out = _appended(spark, sf_dir, "summaries", lambda beats: _summaries(spark, sf_dir, beats))
    return out.drop(jobs.EVENT_TIME)


@query
def stream_topk(spark, sf_dir):
    return _appended(spark, sf_dir, "topk", lambda beats: jobs.topk(_closed(spark, sf_dir, beats)))


@query
def stream_history(spark, sf_dir):
    """The chart's last points, kept in state as summaries come in."""
    path = shared_dir(spark, "history")
    values = ["total_energy_joules", "total_power_watts", "total_carbon_grams_co2"]

    def run(heartbeats):
        tail = jobs.history(_summaries(spark, sf_dir, heartbeats), values)
        sinks.changelog(tail, f"{path}/out", f"{path}/checkpoint", "append", keys=["series"])

    _to_the_end(spark, sf_dir, path, run)
    return views.history_tail(jobs.tail_rows(sinks.latest(spark, f"{path}/out", ["series"]), values))


@query
def stream_gauges(spark, sf_dir):
    """Gauges of every cycle, with tombstones for series that were not seen again."""
    hour = dt.timedelta(hours=1)
    return _appended(
        spark, sf_dir, "gauges", lambda beats: jobs.gauges(_closed(spark, sf_dir, beats), hour)
    )


def _published(spark, sf_dir):
    """What the live path has written of the whole event table, container names included."""
    path = shared_dir(spark, "sinks")

    def run(heartbeats):
        jobs.run_two_sinks(
            _vectors(spark, sf_dir, heartbeats), f"{path}/samples", f"{path}/feed", f"{path}/checkpoint",
            lambda: (A.process_containers(spark, sf_dir), A.known_inventory(spark, sf_dir)), A.INTERVAL,
        )

    _to_the_end(spark, sf_dir, path, run)
    return samples.read_samples(spark, f"{path}/samples"), telemetry.parse(spark.read.text(f"{path}/feed"))


@query
def stream_samples(spark, sf_dir):
    """Every series of the live path."""
    series, _ = _published(spark, sf_dir)
    return series.select("interval", *metrics.LABELS, "le", "metric", "value")


@query
def stream_two_sinks(spark, sf_dir):
    """Rows each sink holds per interval."""
    series, feed = _published(spark, sf_dir)
    metric_rows = (
        series
        .groupBy("interval", "metric").agg(F.count(F.lit(1)).alias("entries"))
    )
    feed_rows = feed.groupBy("interval").agg(
        F.sum(F.size("process_data")).alias("entries")
    ).select("interval", F.lit("feed").alias("metric"), "entries")
    return metric_rows.unionByName(feed_rows)
