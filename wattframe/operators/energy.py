"""Energy and carbon estimation.

Energies are kept as whole nanojoules (``*_nj``) next to their joule columns.  Sums over
estimates use the integers, so totals are exact and do not depend on the order in which
partitions arrive, also when a lost executor makes Spark recompute some of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.joins import lookup_join
from wattframe.operators.model import LinearEnergyModel

PARTS = ("cpu", "memory", "gpu")


def _as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def heuristic_columns() -> dict[str, Column]:
    """Component energies in nanojoules from fixed coefficients."""
    return {
        "cpu_nj": F.col("cpu_time_ns") * fixed.NJ_PER_CPU_NS,
        "memory_nj": (F.col("major_faults") + F.col("minor_faults")) * fixed.NJ_PER_FAULT,
        "gpu_nj": F.col("gpu_jobs_submitted") * fixed.NJ_PER_GPU_JOB,
    }


def _finish(df: DataFrame, intensity: Column | float, window_seconds: float) -> DataFrame:
    """Power, carbon and the AI flag from an estimated energy."""
    return df.withColumns(
        {
            "power_watts": F.col("energy_joules") / F.lit(float(window_seconds)),
            "intensity": _as_column(intensity),
            "is_ai_inference": S.is_ai("comm"),
        }
    ).withColumn("carbon_grams_co2", S.carbon_grams("energy_joules", F.col("intensity")))


def heuristic(
    vectors: DataFrame,
    intensity: Column | float = fixed.DEFAULT_INTENSITY,
    window_seconds: float = fixed.WINDOW_SECONDS,
) -> DataFrame:
    """Estimates from fixed per-unit energies: CPU time, faults, GPU jobs."""
    estimated = (
        vectors.withColumns(heuristic_columns())
        .withColumn("energy_nj", F.col("cpu_nj") + F.col("memory_nj") + F.col("gpu_nj"))
        .withColumns(
            {
                "energy_joules": S.joules("energy_nj"),
                "cpu_energy_joules": S.joules("cpu_nj"),
                "memory_energy_joules": S.joules("memory_nj"),
                "gpu_energy_joules": S.joules("gpu_nj"),
                "confidence": F.lit(fixed.HEURISTIC_CONFIDENCE),
                "model_version": F.lit(fixed.HEURISTIC_VERSION),
            }
        )
    )
    return _finish(estimated, intensity, window_seconds)


def model_estimates(
    vectors: DataFrame,
    model: LinearEnergyModel,
    intensity: Column | float = fixed.DEFAULT_INTENSITY,
    window_seconds: float = fixed.WINDOW_SECONDS,
) -> DataFrame:
    """Estimates from a linear model, with the same columns as :func:`heuristic`."""
    scored = model.breakdown(vectors)
    estimated = scored.withColumns(
        {
            "energy_nj": S.to_nanojoules("energy_joules"),
            "cpu_nj": S.to_nanojoules("cpu_energy_joules"),
            "memory_nj": S.to_nanojoules("memory_energy_joules"),
            "gpu_nj": S.to_nanojoules("gpu_energy_joules"),
            "confidence": F.lit(fixed.MODEL_CONFIDENCE),
            "model_version": F.lit(model.version),
        }
    )
    return _finish(estimated, intensity, window_seconds)


_ESTIMATED = (
    "energy_nj", "cpu_nj", "memory_nj", "gpu_nj",
    "energy_joules", "cpu_energy_joules", "memory_energy_joules", "gpu_energy_joules",
    "power_watts", "confidence", "intensity", "carbon_grams_co2", "is_ai_inference",
    "model_version",
)


def estimate(
    vectors: DataFrame,
    model: LinearEnergyModel | None = None,
    availability: DataFrame | None = None,
    on: str = "interval",
    intensity: Column | float = fixed.DEFAULT_INTENSITY,
    window_seconds: float = fixed.WINDOW_SECONDS,
) -> DataFrame:
    """Model estimate where the model was available and the features are finite, else the
    heuristic for the same vector.  ``availability`` has one row per ``on`` value."""
    if model is None:
        return heuristic(vectors, intensity, window_seconds)
    usable = F.lit(True)
    if availability is not None:
        known = availability.select(on, F.col("available").alias("_available"))
        vectors = lookup_join(vectors, known, [on])
        usable = F.coalesce("_available", F.lit(False))
    for feature in model.features:
        usable = usable & S.is_finite(feature)
    plain = vectors.columns
    by_rule = heuristic(vectors.withColumn("_usable", usable), intensity, window_seconds)
    both = by_rule.withColumn("_rule", F.struct(*_ESTIMATED)).drop(*_ESTIMATED)
    both = model_estimates(both, model, intensity, window_seconds)
    choose = lambda n: F.when(F.col("_usable"), F.col(n)).otherwise(F.col(f"_rule.{n}"))
    return both.select(
        *[c for c in plain if c != "_available"], *[choose(n).alias(n) for n in _ESTIMATED]
    )


def calibrated_energy(df: DataFrame) -> DataFrame:
    """Energy from the published calibration coefficients, never below zero."""
    total = S.add(
        [F.lit(c) * F.col(f) for f, c in fixed.CALIBRATED_COEFFICIENTS.items()]
    )
    return df.withColumn("estimated_joules", F.greatest(total, F.lit(0.0)))


def regions(spark) -> DataFrame:
    """Grid intensity of the regions that have one; a fixed handful of rows."""
    return spark.createDataFrame(list(fixed.REGION_INTENSITY.items()), "region string, grams_per_kwh double")


def with_intensity(
    df: DataFrame, region_table: DataFrame | None = None, default: float = fixed.DEFAULT_INTENSITY,
) -> DataFrame:
    """Adds ``intensity`` by region, the default where the region has no entry.

    The built-in table has a handful of rows, so it is broadcast; any other table goes
    through :func:`lookup_join`, which lets Spark check its size.
    """
    if region_table is None:
        joined = df.join(F.broadcast(regions(df.sparkSession)), ["region"], "left")
    else:
        joined = lookup_join(df, region_table, ["region"])
    return joined.withColumn(
        "intensity", F.coalesce("grams_per_kwh", F.lit(float(default)))
    ).drop("grams_per_kwh")
