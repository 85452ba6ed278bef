"""Fitting, scoring, calibration files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.operators import energy, model
from wattframe.plans import attribution as A
from wattframe.plans import fixture
from wattframe.sources import calibration


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return fixture.calibration(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def fitted(data):
    return model.train(data)


def test_fit_matches_least_squares(data, fitted):
    pdf = data.orderBy("event_id").toPandas()
    x = pdf[list(fixed.FEATURES)].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    design = np.column_stack([np.ones(len(z)), z])
    solved = np.linalg.lstsq(design, pdf["energy_joules"].to_numpy(), rcond=None)[0]
    predicted = np.maximum(design @ solved, 0.0)
    got = model.predict(data, fitted).orderBy("event_id").toPandas()["predicted_joules"].to_numpy()
    assert np.allclose(got, predicted, atol=1e-8)
    importance = {r.feature: r.importance for r in model.importance(data.sparkSession, model.LinearEnergyModel.from_pipeline(fitted)).collect()}
    size = np.abs(solved[1:])
    for f, want in zip(fixed.FEATURES, size / size.sum()):
        assert importance[f] == pytest.approx(want, rel=1e-9)


def test_column_scoring_equals_the_pipeline(data, fitted):
    linear = model.LinearEnergyModel.from_pipeline(fitted)
    by_ml = model.predict(data, fitted).select("event_id", "predicted_joules")
    by_columns = linear.predict(data.drop("energy_joules")).select("event_id", "energy_joules")
    worst = by_ml.join(by_columns, "event_id").agg(
        F.max(F.abs(F.col("predicted_joules") - F.col("energy_joules")))).first()[0]
    assert worst < 1e-9


def test_breakdown_adds_up_and_clamps(data):
    rows = A.REFERENCE_MODEL.breakdown(data.drop("energy_joules"))
    parts = F.col("cpu_energy_joules") + F.col("memory_energy_joules") + F.col("gpu_energy_joules")
    assert rows.where(F.abs(parts - F.col("energy_joules")) > 1e-9).count() == 0
    assert rows.where("energy_joules < 0").count() == 0


def test_breakdown_without_contributions(spark):
    flat = model.LinearEnergyModel(fixed.FEATURES, (0.0,) * 7, (1.0,) * 7, (0.0,) * 7, 3.0)
    df = spark.createDataFrame([tuple([1.0] * 7)], ", ".join(f"{f} double" for f in fixed.FEATURES))
    r = flat.breakdown(df).first()
    assert (r.energy_joules, r.cpu_energy_joules, r.memory_energy_joules, r.gpu_energy_joules) == (3.0, 3.0, 0.0, 0.0)
    negative = model.LinearEnergyModel(fixed.FEATURES, (0.0,) * 7, (1.0,) * 7, (-1.0,) * 7, 0.0)
    assert negative.breakdown(df).first().energy_joules == 0.0


def test_constant_feature_gets_no_weight(data):
    flat = data.withColumn("gpu_active_ns", F.lit(5.0))
    fitted = model.train(flat)
    linear = model.LinearEnergyModel.from_pipeline(fitted)
    assert linear.features == fixed.FEATURES
    assert linear.coefficients[-1] == 0.0
    assert model.predict(flat, fitted).where("predicted_joules IS NULL").count() == 0


def test_collinear_features_still_fit(data):
    twin = data.withColumn("minor_faults", F.col("major_faults") * 2)
    quality = model.quality(model.predict(twin, model.train(twin)), "energy_joules", "predicted_joules").first()
    assert quality.r2_score > 0.99


def test_quality(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, p double")
    r = model.quality(df, "y", "p").first()
    assert r.r2_score == pytest.approx(0.75) and r.mae_joules == pytest.approx(1 / 3)
    assert (r.min_joules, r.max_joules, r.n) == (1.0, 3.0, 3)


def test_standardize_constant_column(spark, data):
    flat = model.standardize(data.withColumn("rss_bytes", F.lit(4.0)))
    r = flat.agg(F.max(F.abs("scaled_rss_bytes")), F.avg("scaled_cpu_time_ns"), F.stddev_pop("scaled_cpu_time_ns")).first()
    assert r[0] == 0.0 and r[1] == pytest.approx(0, abs=1e-9) and r[2] == pytest.approx(1)


def test_missing_columns(spark, data, folder):
    short = data.drop("rss_bytes", "energy_joules")
    assert calibration.missing_columns(short) == ["energy_joules", "rss_bytes"]
    with pytest.raises(ValueError, match="rss_bytes"):
        calibration.write_calibration(short, f"{folder}/out")
    short.write.option("header", True).csv(f"{folder}/short")
    with pytest.raises(ValueError, match="energy_joules"):
        calibration.read_calibration(spark, f"{folder}/short")


def test_fallback_rules(spark):
    features = ", ".join(f"{f} double" for f in fixed.FEATURES)
    rows = [(0, 1, "bash", 1, 0, 1e9, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (0, 2, "bash", 2, 0, 1e9, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (0, 3, "bash", 3, 0, 1e9, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (0, 4, "bash", 1, 0, 1e9, 1.0, float("nan"), 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(
        rows, f"host_id bigint, pid bigint, comm string, interval bigint, gpu_jobs_submitted bigint, {features}"
    ).withColumns({c: F.col(c).cast("bigint") for c in ("cpu_time_ns", "major_faults", "minor_faults")})
    up = spark.createDataFrame([(1, True), (2, False)], "interval bigint, available boolean")
    got = {r.pid: (r.confidence, r.model_version) for r in energy.estimate(df, A.REFERENCE_MODEL, up).collect()}
    assert got == {1: (0.85, "1.0.0-synthetic"), 2: (0.3, "heuristic"), 3: (0.3, "heuristic"), 4: (0.3, "heuristic")}
    assert {r.confidence for r in energy.estimate(df).collect()} == {0.3}


def test_constant_target(spark):
    df = spark.createDataFrame([(5.0, 5.0, 4.0), (5.0, 5.0, 6.0)], "a double, met double, missed double")
    assert model.quality(df, "a", "met").first().r2_score == 1.0
    assert model.quality(df, "a", "missed").first().r2_score == 0.0


def test_constant_features_leave_the_mean(data):
    flat = data.withColumns({f: F.lit(3.0) for f in fixed.FEATURES})
    fitted = model.fit(flat)
    assert fitted.intercept == pytest.approx(data.agg(F.avg(fixed.TARGET)).first()[0])
    assert set(fitted.coefficients) == {0.0}
    assert fitted.predict(flat).select("energy_joules").distinct().count() == 1
