"""Dashboard views over estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.metrics import grams, labelled, milli_carbon, total_nj

PROCESS_NAME = ("host_id", "pid", "comm")


def by(
    est: DataFrame,
    keys: Sequence[str],
    column: str = "energy_nj",
    name: str = "energy_joules",
) -> DataFrame:
    """Summed energy by any set of labels."""
    return labelled(est).groupBy(*keys).agg(S.joules(total_nj(column)).alias(name))


def system_summary(
    est: DataFrame,
    interval: Sequence[str] = ("interval",),
    window_seconds: float = fixed.WINDOW_SECONDS,
) -> DataFrame:
    """Totals, counts and mean confidence per interval."""
    held = F.count_distinct(F.nullif("container_id", F.lit("")))
    columns = summary_columns(held, window_seconds)
    return est.groupBy(*interval).agg(*[c.alias(n) for n, c in columns.items()])


def summary_columns(containers: Column, window_seconds: float = fixed.WINDOW_SECONDS) -> dict[str, Column]:
    """The summary's aggregates; how containers are counted differs between batches and streams."""
    energy = S.joules(total_nj("energy_nj"))
    return {
        "total_energy_joules": energy,
        "total_power_watts": energy / F.lit(float(window_seconds)),
        "total_carbon_grams_co2": grams(F.sum(milli_carbon())),
        "tracked_processes": F.count(F.lit(1)),
        "ai_workload_count": F.count_if("is_ai_inference"),
        "container_count": containers,
        "avg_confidence": F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 9),
    }


def totals(est: DataFrame, window_seconds: float = fixed.WINDOW_SECONDS) -> DataFrame:
    """Energy, power and carbon over everything."""
    energy = S.joules(total_nj("energy_nj"))
    return est.agg(
        energy.alias("energy_joules"),
        (energy / F.lit(float(window_seconds))).alias("power_watts"),
        grams(F.sum(milli_carbon())).alias("carbon_grams_co2"),
    )


def by_component(est: DataFrame, interval: Sequence[str] = ("interval",)) -> DataFrame:
    """CPU, memory and GPU energy per interval as three series."""
    wide = est.groupBy(*interval).agg(
        *[S.joules(total_nj(f"{part}_nj")).alias(part) for part in fixed.COMPONENTS]
    )
    return wide.unpivot(list(interval), list(fixed.COMPONENTS), "component", "energy_joules")


def reduce_series(series: DataFrame, value: str, keys: Sequence[str], time: str = "interval") -> DataFrame:
    """Mean, maximum and last non-null value of each series."""
    v = F.col(value)
    return series.groupBy(*keys).agg(
        F.round(F.avg(v), 6).alias("mean_value"),
        F.max(v).alias("max_value"),
        F.max_by(v, F.when(v.isNotNull(), F.col(time))).alias("last_value"),
    )


def ai_split(est: DataFrame) -> DataFrame:
    """Energy of AI and of general processes, from estimates that carry the flag."""
    return est.groupBy(F.col("is_ai_inference").alias("is_ai_workload")).agg(
        S.joules(total_nj("energy_nj")).alias("energy_joules"),
        F.count(F.lit(1)).alias("estimates"),
    )


def ai_split_series(
    energy: DataFrame, flags: DataFrame, on: Sequence[str] = ("interval", *PROCESS_NAME)
) -> DataFrame:
    """The same from two sample series, energy and flag, matched on the process.

    Many energy series may meet one flag.  Energy is summed per process name first, so both
    sides have one row per key when they meet, and neither can be skewed.
    """
    nj = energy.groupBy(*on).agg(
        F.sum(S.to_nanojoules("value").cast("decimal(20,0)")).alias("_nj")
    )
    flag = flags.groupBy(*on).agg(F.max("value").alias("_flag"))
    return (
        nj.join(flag, list(on))
        .groupBy((F.col("_flag") == 1.0).alias("is_ai_workload"))
        .agg(S.joules(F.sum("_nj")).alias("energy_joules"))
    )


def topk(est: DataFrame, k: int = 10, interval: Sequence[str] = ("interval",)) -> DataFrame:
    """The k largest consumers of each interval (each task keeps k before the shuffle)."""
    rank = F.row_number().over(
        Window.partitionBy(*interval).orderBy(F.desc("energy_nj"), "host_id", "pid")
    )
    return (
        est.withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= k)
        .select(*interval, "rank", "host_id", "pid", "comm", "energy_joules")
    )


def top_processes(est: DataFrame, n: int = 5, now: Column | None = None) -> DataFrame:
    """Process table of the latest interval, as displayed."""
    now = est.agg(F.max("interval")).scalar() if now is None else now
    current = est.where(F.col("interval") == now)
    return (
        current.orderBy(F.desc("energy_nj"), "host_id", "pid")
        .limit(n)
        .select(
            "host_id",
            "pid",
            "comm",
            S.fixed3("energy_nj").alias("energy_joules"),
            S.fixed3("energy_nj").alias("power_watts"),
            S.nonempty("container_name", fixed.SYSTEM_WORKLOAD).alias("container"),
            F.when(F.col("is_ai_inference"), F.lit(fixed.AI_BADGE))
            .otherwise(F.lit(fixed.STANDARD_BADGE))
            .alias("ai_task"),
        )
    )


def history_tail(summary: DataFrame, n: int = fixed.HISTORY_POINTS) -> DataFrame:
    """The last n points of the energy, power and carbon chart (carbon in milligrams)."""
    return (
        summary.orderBy(F.desc("interval"))
        .limit(n)
        .select(
            "interval",
            S.clock("interval").alias("time"),
            F.col("total_energy_joules").alias("energy"),
            F.col("total_power_watts").alias("power"),
            S.milligrams("total_carbon_grams_co2").alias("carbon_mg"),
        )
    )


def bands(summary: DataFrame) -> DataFrame:
    """Threshold colour of each headline number."""
    panels = {
        "energy": "total_energy_joules",
        "power": "total_power_watts",
        "carbon": "total_carbon_grams_co2",
        "processes": "tracked_processes",
        "confidence": "avg_confidence",
    }
    return summary.select(
        "interval", *[S.band(c, panel).alias(f"{panel}_band") for panel, c in panels.items()]
    )


def lookback(df: DataFrame, window: str = "15 minutes", time: str = "ts") -> DataFrame:
    """Rows no older than the window before the latest one.

    The bound is worked out inside the subquery, so the condition is a plain comparison
    that the scan can use to skip row groups.
    """
    bound = df.agg(F.max(time) - F.expr(f"INTERVAL {window}")).scalar()
    return df.where(F.col(time) >= bound)


def carbon_by_region(est: DataFrame) -> DataFrame:
    """Energy and carbon of each region at its own grid intensity."""
    return est.groupBy("region", "intensity").agg(
        S.joules(total_nj("energy_nj")).alias("energy_joules"),
        grams(F.sum(milli_carbon())).alias("carbon_grams_co2"),
    )
