"""Linear models refitted as calibration rows come in, and looked up as of a vector's time.

What a fit needs of its rows are sums: of the features, of their products and of their products with the
target.  They are kept per interval as exact integers, so states of intervals, hosts or late files merge in any
order to the same numbers, and a refit adds the newest interval's row to what is known instead of reading the
calibration again.  Solving is a 7 by 7 system per version, from one small row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.timeline import null_safe_join, running_totals

#: Parts of a joule that targets are rounded to.
NANO = 1_000_000_000
VERSION = """
    n bigint, means array<double>, scales array<double>, coefficients array<double>, intercept double
"""


def _pairs(features: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(features)) for j in range(i, len(features))]


def _sums(features: Sequence[str], target: str) -> dict[str, Column]:
    """The entries of the state by name.  Features are whole numbers, the target counts in nanojoules."""
    whole = lambda c: c.cast("decimal(19,0)")
    x = [whole(F.round(f)) for f in features]
    y = whole(F.round(F.col(target) * F.lit(float(NANO))))
    return {
        "n": F.lit(1).cast("decimal(19,0)"),
        "y": y,
        **{f"x{i}": v for i, v in enumerate(x)},
        **{f"y{i}": v * y for i, v in enumerate(x)},
        **{f"x{i}x{j}": x[i] * x[j] for i, j in _pairs(features)},
    }


def gram_state(
    rows: DataFrame, by: Sequence[str], features: Sequence[str] = fixed.FEATURES, target: str = fixed.TARGET
) -> DataFrame:
    """The sums per group.  Rows with a missing number do not count."""
    complete = F.lit(True)
    for c in (*features, target):
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    sums = _sums(features, target)
    return rows.where(complete).groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in sums.items()])


def merge(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of the same group added up."""
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in states.columns if c not in by])


def solve(states: DataFrame, features: Sequence[str] = fixed.FEATURES) -> DataFrame:
    """Least squares on standardised features, one version per state: ``n``, ``means``, ``scales``,
    ``coefficients`` (in the order of the features) and ``intercept``.

    A feature that never varies has coefficient 0.  A state with too few rows for its features gives none.
    """
    names = list(_sums(features, fixed.TARGET))
    keys = [c for c in states.columns if c not in names]
    size = len(features)

    def fitted(row: dict) -> dict | None:
        s = {k: int(row[k]) for k in names}
        n, y = s["n"], s["y"]
        centred = np.zeros((size, size + 1))
        for i in range(size):
            for j in range(size):
                a, b = min(i, j), max(i, j)
                # whole numbers up to the division, which rounds once
                centred[i, j] = (n * s[f"x{a}x{b}"] - s[f"x{i}"] * s[f"x{j}"]) / max(n * (n - 1), 1)
            centred[i, size] = (n * s[f"y{i}"] - s[f"x{i}"] * y) / max(n * (n - 1), 1) / NANO
        used = [i for i in range(size) if centred[i, i] > 0]
        if n <= len(used) + 1:
            return None
        scale = [sqrt(centred[i, i]) if i in used else 1.0 for i in range(size)]
        coefficients = np.zeros(size)
        if used:
            d = np.array([scale[i] for i in used])
            try:
                coefficients[used] = np.linalg.solve(centred[np.ix_(used, used)] / np.outer(d, d), centred[used, size] / d)
            except np.linalg.LinAlgError:
                return None
        means = [s[f"x{i}"] / n for i in range(size)]
        return {"n": n, "means": means, "scales": scale, "coefficients": coefficients.tolist(), "intercept": y / n / NANO}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.float64())
        for batch in batches:
            found = [fitted(row) for row in batch.to_pylist()]
            kept = batch.select(keys).filter(pa.array([f is not None for f in found]))
            rows = [f for f in found if f is not None]
            added = [
                pa.array([f["n"] for f in rows], pa.int64()),
                *[pa.array([f[c] for f in rows], numbers) for c in ("means", "scales", "coefficients")],
                pa.array([f["intercept"] for f in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *added], [*keys, "n", "means", "scales", "coefficients", "intercept"]
            )

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in states.select(*keys).schema)
    return states.mapInArrow(run, own + VERSION)


def refits(
    states: DataFrame, keys: Sequence[str], at: str = "interval", features: Sequence[str] = fixed.FEATURES
) -> DataFrame:
    """A version per key and interval, fitted on all rows up to the interval's end."""
    sums = [c for c in states.columns if c not in (*keys, at)]
    timed = states.withColumn("_at_us", S.micros(at))
    grown = running_totals(timed, keys, at, {c: F.col(c) for c in sums}, "_at_us")
    return solve(grown.select(*keys, at, *sums), features)


def predict_asof(
    vectors: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str = "interval",
    features: Sequence[str] = fixed.FEATURES,
) -> DataFrame:
    """Adds ``model_interval`` and ``predicted_joules`` of the latest version from before each vector's interval.

    A version only knows rows up to its interval's end, so it serves the intervals after it.  Vectors before
    the first version have NULL in both.  Which version an interval takes is settled on the intervals, a few
    rows per key; vectors then meet their version in an equi-join.
    """
    steps = vectors.select(*keys, at).distinct().unionByName(versions.select(*keys, at)).distinct()
    own = versions.select(*keys, at, F.struct(F.col(at).alias("model_interval"), "means", "scales", "coefficients", "intercept").alias("_v"))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    served = null_safe_join(steps, own, [*keys, at], "left").withColumn(
        "_version", F.last("_v", ignorenulls=True).over(before)
    )
    found = null_safe_join(vectors, served.select(*keys, at, "_version"), [*keys, at], "left")
    v = F.col("_version")
    terms = [
        v["coefficients"][i] * ((F.col(f).cast("double") - v["means"][i]) / v["scales"][i]) for i, f in enumerate(features)
    ]
    predicted = F.greatest(S.add(terms) + v["intercept"], F.lit(0.0))
    return found.withColumns(
        {"model_interval": v["model_interval"], "predicted_joules": F.when(v.isNotNull(), predicted)}
    ).drop("_version")
