"""Metric series: gauges, counters, rates, confidence histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.timeline import (
    HOT_ROWS,
    running_totals,
    sliding_sum,
    with_previous,
)

MINUTE = 60 * S.MICROS
HOUR = 60 * MINUTE
LABELS = ("host_id", "pid", "comm", "container_id", "container_name")
GAUGES = (
    "energy_joules",
    "power_watts",
    "carbon_grams_co2",
    "cpu_energy_joules",
    "memory_energy_joules",
    "gpu_energy_joules",
)
COUNTERS = ("energy_joules_total", "carbon_grams_co2_total")
AI_GAUGE = "ai_workload_detected"
PROCESS_GAUGE = "tracked_processes"
HISTOGRAM = "estimation_confidence"


def milli_carbon() -> Column:
    """Nanojoules times milligrams per kWh, an exact integer sums can use."""
    return F.col("energy_nj").cast("decimal(20,0)") * F.round(
        F.col("intensity") * F.lit(1000.0)
    ).cast("decimal(9,0)")


def grams(milli: Column) -> Column:
    return milli.cast("double") / F.lit(1000.0) / F.lit(fixed.NJ_PER_JOULE) / F.lit(
        fixed.JOULES_PER_KWH
    )


def total_nj(column: str) -> Column:
    """Sum wide enough for a whole fleet's history."""
    return F.sum(F.col(column).cast("decimal(20,0)"))


def labelled(est: DataFrame) -> DataFrame:
    """Series labels: no container means the host, no name means the (defaulted) id."""
    cid = S.nonempty("container_id", fixed.HOST_CONTAINER)
    return est.withColumns(
        {"container_name": S.nonempty("container_name", cid), "container_id": cid}
    )


def gauge_latest(
    est: DataFrame, labels: Sequence[str] = LABELS, now: Column | None = None
) -> DataFrame:
    """Gauges show the current interval only; for equal labels the last estimate counts.

    ``now`` is the current interval if it is known from something cheaper than the
    estimates; a condition on the interval reaches below their aggregation.
    """
    now = est.agg(F.max("interval")).scalar() if now is None else now
    current = labelled(est).where(F.col("interval") == now)
    return current.groupBy("interval", *labels).agg(
        *[F.max_by(g, F.struct("timestamp_ns", "energy_nj")).alias(g) for g in GAUGES],
        F.max_by(
            F.col("is_ai_inference").cast("double"), F.struct("timestamp_ns", "energy_nj")
        ).alias(AI_GAUGE),
    )


def exact_counters(
    est: DataFrame, labels: Sequence[str] = LABELS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Cumulative energy (``nj_total``) and carbon (``mc_total``) per label set at each interval
    as exact integers, which differences and rates can be taken of (``est`` is read more than
    once)."""
    cumulative = running_totals(
        labelled(est).withColumn("_at", S.micros("interval")),
        keys=labels,
        at="interval",
        sums={
            "nj_total": F.col("energy_nj").cast("decimal(20,0)"),
            "mc_total": milli_carbon(),
        },
        time="_at",
        hot_rows=hot_rows,
    )
    return cumulative.select("interval", *labels, "nj_total", "mc_total")


def counters(
    est: DataFrame, labels: Sequence[str] = LABELS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """:func:`exact_counters` in joules and grams."""
    return exact_counters(est, labels, hot_rows).select(
        "interval",
        *labels,
        S.joules("nj_total").alias(COUNTERS[0]),
        grams(F.col("mc_total")).alias(COUNTERS[1]),
    )


def carbon_rate(
    est: DataFrame, window_us: int = 5 * MINUTE, labels: Sequence[str] = LABELS
) -> DataFrame:
    """Grams of CO2 per second of each series over the look-back window, from the exact counter."""
    exported = exact_counters(est, labels).withColumn("ts_us", S.micros("interval"))
    rated = counter_rate(exported, "mc_total", labels, ["ts_us"], window_us)
    return rated.select("ts", *labels, grams(F.col("rate_per_second")).alias("carbon_grams_per_second"))


def histogram_aggregates(value: str = "confidence", bounds: Sequence[float] = fixed.CONFIDENCE_BOUNDS):
    """Cumulative bucket counts, count and sum as one row's columns (one pass)."""
    return [
        F.array(
            *[
                F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("cumulative"))
                for b in bounds
            ],
            F.struct(
                F.lit(float("inf")).alias("le"), F.count(value).alias("cumulative")
            ),
        ).alias("buckets"),
        F.count(value).alias("observations"),
        F.sum(value).alias("total"),
    ]


def histogram(
    df: DataFrame,
    value: str = "confidence",
    bounds: Sequence[float] = fixed.CONFIDENCE_BOUNDS,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group with the cumulative buckets as an array."""
    return df.groupBy(*by).agg(*histogram_aggregates(value, bounds))


def le_label(le: Column) -> Column:
    return F.when(le == float("inf"), F.lit("+Inf")).otherwise(le.cast("string"))


def bucket_series(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histogram rows as series: one per bucket bound."""
    return hist.select(*by, F.explode("buckets").alias("b"), "observations", "total").select(
        *by, le_label(F.col("b.le")).alias("le"), F.col("b.cumulative").alias("cumulative"),
        "observations", F.round("total", 6).alias("total"),
    )


def histogram_quantile(q: float, buckets: str = "buckets") -> Column:
    """Linear interpolation inside the first bucket whose cumulative count reaches the rank.

    The first bucket starts at 0; a rank in the open-ended bucket gives the highest finite
    bound; NULL when there are no observations.
    """
    b = F.col(buckets)
    rank = F.element_at(b, -1)["cumulative"].cast("double") * F.lit(float(q))
    index = F.size(F.filter(b, lambda x: x["cumulative"].cast("double") < rank))
    hit = F.get(b, index)
    below = F.get(b, index - 1)
    low = F.coalesce(below["le"], F.lit(0.0))
    under = F.coalesce(below["cumulative"], F.lit(0)).cast("double")
    inside = hit["cumulative"].cast("double") - under
    finite_top = F.element_at(b, -2)["le"]
    return (
        F.when(rank == 0, F.lit(None).cast("double"))
        .when(hit["le"] == float("inf"), finite_top)
        .otherwise(low + (hit["le"] - low) * ((rank - under) / inside))
    )


def quantile_over_window(est: DataFrame, q: float, window_us: int = 5 * MINUTE) -> DataFrame:
    """Quantile of the observations inside the look-back window, at each interval.

    What a dashboard reads off the rate of a histogram's cumulative buckets: the increase of each
    bucket inside the window (the rate's division by its length cancels out), interpolated.
    There is one row per interval and bucket bound left when the window looks back.
    """
    per_interval = histogram(est, by=["interval"]).select(
        S.micros("interval").alias("step_us"), F.explode("buckets").alias("b")
    )
    slid = sliding_sum(
        per_interval.select("step_us", F.col("b.le").alias("le"), F.col("b.cumulative").alias("increase")),
        keys=["le"],
        window_us=window_us,
        sums={"cumulative": F.col("increase")},
        time="step_us",
    )
    at = F.timestamp_micros("step_us").cast("timestamp_ntz").alias("interval")
    buckets = F.sort_array(F.collect_list(F.struct("le", "cumulative"))).alias("buckets")
    return slid.groupBy("step_us").agg(buckets).select(
        at,
        F.element_at("buckets", -1)["cumulative"].alias("observations"),
        histogram_quantile(q).alias("quantile"),
    )


def _one_series(time: str) -> Column:
    """A key that all rows share, so that a series without labels is cut in time like any other hot key."""
    return F.when(F.col(time).isNotNull(), F.lit(""))


def histogram_counters(
    df: DataFrame,
    value: str = "confidence",
    bounds: Sequence[float] = fixed.CONFIDENCE_BOUNDS,
    by: Sequence[str] = (),
    life: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The histogram as an exporter shows it: at each interval, what has been counted since the exporter's start.

    ``buckets`` (cumulative over the bounds), ``observations`` and ``total_nano`` (the sum, in exact billionths) all
    grow together, from one aggregate per interval and one running sum over those rows.  ``life`` names the
    exporter's life that an interval falls into (one and the same, if not given); counters start again with it.
    """
    at_most = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    nano = F.round(F.col(value) * F.lit(1e9)).cast("decimal(19,0)")
    per_interval = df.groupBy("interval", *by).agg(
        *at_most, F.count(value).alias("observations"), F.sum(nano).alias("total_nano")
    )
    names = [*[f"b{i}" for i in range(len(bounds))], "observations", "total_nano"]
    steps = per_interval.withColumns(
        {"_life": _one_series("interval") if life is None else life, "_at": S.micros("interval")}
    )
    grown = running_totals(steps, [*by, "_life"], "interval", {n: F.col(n) for n in names}, "_at", hot_rows)
    bucket = lambda le, n: F.struct(F.lit(float(le)).alias("le"), F.col(n).alias("cumulative"))
    buckets = F.array(*[bucket(b, f"b{i}") for i, b in enumerate(bounds)], bucket("inf", "observations"))
    return grown.select("interval", *by, buckets.alias("buckets"), "observations", "total_nano")


def histogram_series(counters: DataFrame, by: Sequence[str] = (), name: str = HISTOGRAM) -> DataFrame:
    """Those counters as samples: ``_bucket`` per bound, ``_sum`` and ``_count``."""
    sample = lambda metric, le, value: F.struct(
        F.lit(f"{name}_{metric}").alias("metric"), le.alias("le"), value.cast("double").alias("value")
    )
    none = F.lit("")
    rows = F.concat(
        F.transform("buckets", lambda b: sample("bucket", le_label(b["le"]), b["cumulative"])),
        F.array(
            sample("sum", none, F.col("total_nano").cast("double") / F.lit(1e9)),
            sample("count", none, F.col("observations")),
        ),
    )
    return counters.select("interval", *by, F.explode(rows).alias("s")).select("interval", *by, "s.*")


def histogram_rate(
    counters: DataFrame, window_us: int = 5 * MINUTE, by: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per-second rates of all of a histogram's counters over the look-back window, at each sample.

    A histogram restarts as a whole: if its count, its sum or any bucket drops, every counter is taken to have
    started from 0.  The first sample of a series shows no increase.  Buckets are made monotonic again, as their
    rates may not be if samples were lost in between.
    """
    samples = counters.withColumn("ts_us", S.micros("interval")).withColumn("_series", _one_series("ts_us"))
    before = {"_buckets": "buckets", "_observations": "observations", "_total": "total_nano"}
    seen = with_previous(samples, [*by, "_series"], ["ts_us"], before, hot_rows=hot_rows)
    dropped = F.exists(
        F.zip_with("buckets", "_buckets", lambda now, then: now["cumulative"] < then["cumulative"]), lambda d: d
    )
    restart = (F.col("observations") < F.col("_observations")) | (F.col("total_nano") < F.col("_total")) | dropped
    bounds = F.transform("buckets", lambda b: b["le"])
    values = F.concat(
        F.transform("buckets", lambda b: b["cumulative"].cast("decimal(38,0)")),
        F.array(F.col("total_nano").cast("decimal(38,0)")),
    )
    earlier = F.concat(
        F.transform("_buckets", lambda b: b["cumulative"].cast("decimal(38,0)")), F.array(F.col("_total").cast("decimal(38,0)"))
    )
    zero = F.lit(0).cast("decimal(38,0)")
    increase = F.when(F.col("_observations").isNull(), F.transform(values, lambda v: zero)).when(restart, values)
    increase = increase.otherwise(F.zip_with(values, earlier, lambda now, then: (now - then).cast("decimal(38,0)")))
    # a place per counter; the bounds and the last place are those of the row
    long = seen.select(*by, "ts_us", bounds.alias("_bounds"), F.posexplode(increase).alias("_place", "_in"))
    slid = sliding_sum(long, [*by, "_place"], window_us, {"_sum": F.col("_in")})
    rows = slid.groupBy(*by, "ts_us").agg(
        F.first("_bounds").alias("_bounds"), F.sort_array(F.collect_list(F.struct("_place", "_sum"))).alias("_all")
    )
    counts = F.transform(F.slice("_all", F.lit(1), F.size("_all") - 1), lambda x: x["_sum"])
    rising = F.transform(counts, lambda x, i: F.array_max(F.slice(F.col("_counts"), F.lit(1), i + 1)))
    seconds = F.lit(float(window_us / S.MICROS))
    whole = rows.withColumn("_counts", counts).withColumn(
        "buckets",
        F.zip_with("_bounds", rising, lambda le, c: F.struct(le.alias("le"), c.cast("bigint").alias("cumulative"))),
    )
    observed = F.element_at("buckets", -1)["cumulative"]
    return whole.select(
        F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("interval"), *by, "buckets",
        observed.alias("observations"),
        (observed.cast("double") / seconds).alias("count_per_second"),
        (F.element_at("_all", -1)["_sum"].cast("double") / F.lit(1e9) / seconds).alias("sum_per_second"),
    )


def rate_over_events(
    df: DataFrame,
    values: dict[str, Column],
    window_us: int = MINUTE,
    step_us: int = S.MICROS,
    keys: Sequence[str] = (),
    time: str = "ts_us",
) -> DataFrame:
    """Sum over the look-back window at each step that has events.

    Events are first added up per step (map-side combined), so what is ordered and windowed
    is at most one row per step and key, however many events fall into it.
    """
    steps = df.groupBy(*keys, S.bucket_start(time, step_us).alias("step_us")).agg(
        *[F.sum(v).alias(n) for n, v in values.items()]
    )
    renamed = steps.select(*keys, "step_us", *[F.col(n).alias(f"_step_{n}") for n in values])
    slid = sliding_sum(
        renamed,
        keys=keys,
        window_us=window_us,
        sums={n: F.col(f"_step_{n}") for n in values},
        time="step_us",
        bucket_us=HOUR,
    )
    return slid.select(*keys, F.timestamp_micros("step_us").cast("timestamp_ntz").alias("ts"), *values)


def counter_rate(
    samples: DataFrame,
    value: str,
    keys: Sequence[str],
    order: Sequence[str],
    window_us: int = 5 * MINUTE,
    step_us: int = S.MICROS,
    time: str = "ts_us",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per-second rate of a counter over the look-back window, at each step with samples.

    A drop is a restart from 0; the first sample of a series shows no increase.  Increases
    are attributed to the sample that shows them, without extrapolation to the edges of the
    window, and added up per step before the window looks back over them.
    """
    seen = with_previous(
        samples, keys=keys, order=order, values={"_before": value}, time=time, hot_rows=hot_rows
    )
    return increase_rate(seen, value, "_before", keys, order, window_us, step_us, time)


def ended_as_zero(samples: DataFrame, value: str, ended: str = "ended") -> DataFrame:
    """Samples of counters that end (:func:`wattframe.streaming.jobs.silent_counters`) for :func:`counter_rate`:
    the row that ends a series counts as 0, so that the series which returns is a restart however high it is."""
    zero = F.lit(0).cast(samples.schema[value].dataType)
    return samples.withColumn(value, F.when(F.col(ended), zero).otherwise(F.col(value)))


def increase_rate(
    seen: DataFrame,
    value: str,
    previous: str,
    keys: Sequence[str],
    order: Sequence[str],
    window_us: int = 5 * MINUTE,
    step_us: int = S.MICROS,
    time: str = "ts_us",
) -> DataFrame:
    """:func:`counter_rate` of samples that carry the previous one's value."""
    now, before = F.col(value), F.col(previous)
    increase = (
        F.when(before.isNull(), F.lit(0).cast("bigint")).when(now < before, now).otherwise(now - before)
    )
    steps = seen.groupBy(*keys, S.bucket_start(time, step_us).alias("step_us")).agg(
        F.max_by(now, S.position(order)).alias(value), F.sum(increase).alias("increase")
    )
    slid = sliding_sum(
        steps, keys=keys, window_us=window_us, sums={"_in_window": F.col("increase")},
        time="step_us",
    )
    seconds = F.lit(float(window_us / S.MICROS))
    return slid.select(
        *keys,
        F.timestamp_micros("step_us").cast("timestamp_ntz").alias("ts"),
        value,
        "increase",
        (F.col("_in_window").cast("double") / seconds).alias("rate_per_second"),
    )


def samples(est: DataFrame) -> DataFrame:
    """Every series of every interval as long rows: gauges, counters, AI flag, process
    count and the cumulative confidence histogram.

    Per-process gauges and the flag come from one narrow pass (unpivot); counters and the
    per-interval series each need one aggregate.  Counters the estimates bring along, as those
    of a stream do, are taken as they are.
    """
    base = labelled(est)
    labels = ["interval", *LABELS]
    counted = set(COUNTERS) <= set(est.columns)
    series = base.withColumn(AI_GAUGE, F.col("is_ai_inference").cast("double")).unpivot(
        labels, [*GAUGES, AI_GAUGE, *(COUNTERS if counted else ())], "metric", "value"
    )
    if not counted:
        series = series.unionByName(counters(est).unpivot(labels, list(COUNTERS), "metric", "value"))

    def system_wide(df: DataFrame) -> DataFrame:
        blank = {c: F.lit("") for c in ("comm", "container_id", "container_name")}
        return df.withColumns(
            {"host_id": F.lit(-1).cast("bigint"), "pid": F.lit(-1).cast("bigint"), **blank}
        )

    per_interval = histogram(est, by=["interval"])
    count = system_wide(
        per_interval.select(
            "interval", F.lit(PROCESS_GAUGE).alias("metric"),
            F.col("observations").cast("double").alias("value"),
        )
    )
    hist = system_wide(
        per_interval.select("interval", F.explode("buckets").alias("b")).select(
            "interval",
            F.lit(f"{HISTOGRAM}_bucket").alias("metric"),
            F.col("b.cumulative").cast("double").alias("value"),
            le_label(F.col("b.le")).alias("le"),
        )
    )
    out = series.unionByName(count).withColumn("le", F.lit(""))
    return out.unionByName(hist).select(*labels, "le", "metric", "value")
