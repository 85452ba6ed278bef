"""From events to estimates: the chain the views and metrics start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.operators import containers, energy, events, rollup
from wattframe.operators.model import LinearEnergyModel
from wattframe.operators.timeline import running_since
from wattframe.plans import fixture
from wattframe.session import stored
from wattframe.sources import tables

INTERVAL = "1 hour"

# A model on the published coefficients, standardised over the middle and
# spread of the calibration ranges.
REFERENCE_MODEL = LinearEnergyModel(
    features=fixed.FEATURES,
    means=(5.0e8, 5000.0, 2650.0, 50.0, 25000.0, 4.0e9, 2.5e8),
    scales=(2.9e8, 2900.0, 1068.0, 29.0, 14400.0, 2.3e9, 1.44e8),
    coefficients=(1.45, 0.029, 0.2136, 0.0145, 0.0072, 0.0023, 43.2),
    intercept=78.0,
)


def vectors(
    spark: SparkSession, sf_dir: str, keys=rollup.PROCESS, since: Column | None = None
) -> DataFrame:
    """Feature vectors per process and interval, of events from ``since`` on if given."""
    rows = tables.read_events(spark, sf_dir)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    partial = events.partial_vectors(fixture.telemetry(rows))
    return rollup.pid_merge(partial, window=INTERVAL, keys=keys)


def process_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_ids(fixture.cgroup(spark, sf_dir))


def known_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.parse_inventory(fixture.inventory(spark, sf_dir))


def located(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """Vectors with their container's id alone, for views that show no names."""
    return containers.attach_container_id(
        vectors(spark, sf_dir, since=since), process_containers(spark, sf_dir)
    )


def located_estimates(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    return energy.heuristic(located(spark, sf_dir, since))


def attributed(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """Vectors with container id and name."""
    return containers.enrich(located(spark, sf_dir, since), known_inventory(spark, sf_dir))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.heuristic(attributed(spark, sf_dir))


def latest_interval(spark: SparkSession, sf_dir: str, n: int = 1) -> Column:
    """Start of the n-th last interval that has events, from the events' times alone."""
    start = F.window("ts", INTERVAL)["start"].alias("start")
    starts = tables.read_events(spark, sf_dir).select(start)
    if n == 1:
        return starts.agg(F.max("start")).scalar()
    return starts.distinct().orderBy(F.desc("start")).limit(n).agg(F.min("start")).scalar()


def latest_estimates(spark: SparkSession, sf_dir: str, intervals: int = 1) -> DataFrame:
    """Estimates of the last intervals; the scan skips everything before them."""
    since = latest_interval(spark, sf_dir, intervals)
    return energy.heuristic(attributed(spark, sf_dir, since=since))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model estimates where the model was up, heuristic ones elsewhere."""
    zero = F.lit(0).cast("bigint")
    full = vectors(spark, sf_dir).withColumns({"cpu_freq_mhz": zero, "rss_bytes": zero})
    return energy.estimate(
        full, REFERENCE_MODEL, fixture.model_registry(spark, sf_dir, INTERVAL)
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-process feature vectors from the three statistics tables."""
    return rollup.feature_snapshot(
        rollup.cpu_stats_exec_reset(fixture.tele(spark, sf_dir, "cpu")),
        rollup.mem_stats(events.classify_faults(fixture.tele(spark, sf_dir, "mem"))),
        rollup.gpu_stats(fixture.tele(spark, sf_dir, "gpu")),
    )


def stored_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates as a table, for queries that need them more than once."""
    return stored(estimates(spark, sf_dir), "estimates")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CPU time counter of each process at and before each CPU event; exec sets it back to 0."""
    cpu = fixture.tele(spark, sf_dir, "cpu").select(
        "event_id", "ts_us", "host_id", "pid", "event_kind", "delta_ns"
    )
    counted = running_since(
        cpu,
        rollup.PROCESS,
        rollup.ORDER,
        value=F.col("delta_ns"),
        reset=F.col("event_kind") == "exec",
        name="counter_ns",
        previous="counter_before_ns",
    )
    return counted.select("event_id", "ts_us", "host_id", "pid", "counter_ns", "counter_before_ns")
