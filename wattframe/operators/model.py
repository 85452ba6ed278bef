"""Linear energy model: fitted with Spark ML, scored with plain column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import fixed
from wattframe.functions import scalar as S


@dataclass(frozen=True)
class LinearEnergyModel:
    """Standardised linear model: ``intercept + sum(coef * (x - mean) / scale)``."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    version: str = fixed.MODEL_VERSION

    @classmethod
    def from_pipeline(cls, fitted: PipelineModel, version: str = fixed.MODEL_VERSION):
        assembler, scaler, regression = fitted.stages
        used = list(assembler.getInputCols())
        scale = [s if s > 0 else 1.0 for s in scaler.std.toArray().tolist()]
        mean = scaler.mean.toArray().tolist()
        coef = regression.coefficients.toArray().tolist()
        at = {f: (mean[i], scale[i], coef[i]) for i, f in enumerate(used)}
        # features that were constant in training were left out: they contribute nothing
        rows = [at.get(f, (0.0, 1.0, 0.0)) for f in fixed.FEATURES]
        return cls(
            fixed.FEATURES,
            *(tuple(float(r[k]) for r in rows) for k in range(3)),
            float(regression.intercept),
            version,
        )

    def _contributions(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f"_part_{f}": F.lit(c) * ((F.col(f).cast("double") - F.lit(m)) / F.lit(s))
                for f, m, s, c in zip(self.features, self.means, self.scales, self.coefficients)
            }
        )

    def _total(self):
        linear = S.add([F.col(f"_part_{f}") for f in self.features]) + F.lit(self.intercept)
        return F.greatest(linear, F.lit(0.0))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``energy_joules``, never below zero."""
        scored = self._contributions(df).withColumn("energy_joules", self._total())
        return scored.drop(*[f"_part_{f}" for f in self.features])

    def breakdown(self, df: DataFrame) -> DataFrame:
        """Adds the total and its split over CPU, memory and GPU by the size of each
        group's contribution; all of it goes to the CPU when nothing contributes."""
        groups = {
            part: S.add([F.col(f"_part_{f}") for f in names])
            for part, names in fixed.COMPONENTS.items()
        }
        staged = self._contributions(df).withColumns(
            {"energy_joules": self._total(), **{f"_abs_{p}": F.abs(g) for p, g in groups.items()}}
        )
        staged = staged.withColumn("_abs", S.add([F.col(f"_abs_{p}") for p in groups]))
        share = lambda p: F.col("energy_joules") * (F.col(f"_abs_{p}") / F.col("_abs"))
        fallback = {"cpu": F.col("energy_joules"), "memory": F.lit(0.0), "gpu": F.lit(0.0)}
        split = staged.withColumns(
            {
                f"{p}_energy_joules": F.when(F.col("_abs") > 0, share(p)).otherwise(fallback[p])
                for p in groups
            }
        )
        return split.drop(
            "_abs", *[f"_abs_{p}" for p in groups], *[f"_part_{f}" for f in self.features]
        )


def varying_features(df: DataFrame) -> list[str]:
    """Features that are not constant; a constant one has coefficient 0 by definition."""
    bounds = df.agg(
        *[F.min(f).alias(f"min_{f}") for f in fixed.FEATURES],
        *[F.max(f).alias(f"max_{f}") for f in fixed.FEATURES],
    ).first()
    return [f for f in fixed.FEATURES if bounds[f"min_{f}"] != bounds[f"max_{f}"]]


def fit(df: DataFrame) -> LinearEnergyModel:
    """Ordinary least squares as a linear model; the mean alone if no feature varies."""
    if varying_features(df):
        return LinearEnergyModel.from_pipeline(train(df))
    mean = df.agg(F.coalesce(F.avg(fixed.TARGET), F.lit(0.0))).first()[0]
    none = tuple(0.0 for _ in fixed.FEATURES)
    return LinearEnergyModel(
        fixed.FEATURES, none, tuple(1.0 for _ in fixed.FEATURES), none, float(mean)
    )


def train(df: DataFrame) -> PipelineModel:
    """Ordinary least squares on standardised features (normal equations, tree-aggregated)."""
    assembler = VectorAssembler(inputCols=varying_features(df), outputCol="raw_features")
    scaler = StandardScaler(
        inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True
    )
    regression = LinearRegression(
        featuresCol="scaled_features",
        labelCol=fixed.TARGET,
        predictionCol="prediction",
        solver="normal",
        regParam=0.0,
        standardization=False,
    )
    return Pipeline(stages=[assembler, scaler, regression]).fit(df)


def predict(df: DataFrame, fitted: PipelineModel) -> DataFrame:
    """Pipeline prediction, never below zero, as ``predicted_joules``."""
    scored = fitted.transform(df)
    return scored.withColumn(
        "predicted_joules", F.greatest("prediction", F.lit(0.0))
    ).drop("prediction", "raw_features", "scaled_features")


def quality(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """In-sample R², mean absolute error and the range of the target, in one pass."""
    a, p = F.col(actual), F.col(predicted)
    n = F.count(a).cast("double")
    total = F.var_pop(a) * n
    missed = F.sum((a - p) * (a - p))
    # a constant target leaves nothing to explain: 1 if it is met, 0 if not
    explained = F.when(total > 0, F.lit(1.0) - missed / F.nullif(total, F.lit(0.0))).otherwise(
        F.when(missed == 0, 1.0).when(missed > 0, 0.0)
    )
    return scored.agg(
        F.count(a).alias("n"),
        explained.alias("r2_score"),
        F.avg(F.abs(a - p)).alias("mae_joules"),
        F.min(a).alias("min_joules"),
        F.max(a).alias("max_joules"),
    )


def feature_ranges(df: DataFrame) -> DataFrame:
    """Minimum and maximum of each feature, one row per feature."""
    wide = df.agg(
        *[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in fixed.FEATURES]
    )
    return wide.unpivot([], list(fixed.FEATURES), "feature", "bounds").select(
        "feature", F.col("bounds.lo").alias("min_value"), F.col("bounds.hi").alias("max_value")
    )


def standardize(df: DataFrame, features=fixed.FEATURES) -> DataFrame:
    """``(x - mean) / population deviation`` per feature, scale 1 where there is none."""
    moments = df.agg(
        F.struct(
            *[F.avg(f).alias(f"mean_{f}") for f in features],
            *[F.stddev_pop(f).alias(f"dev_{f}") for f in features],
        ).alias("moments")
    ).scalar()
    staged = df.withColumn("_m", moments)
    dev = lambda f: F.coalesce(F.nullif(F.col(f"_m.dev_{f}"), F.lit(0.0)), F.lit(1.0))
    return staged.withColumns(
        {f"scaled_{f}": (F.col(f) - F.col(f"_m.mean_{f}")) / dev(f) for f in features}
    ).drop("_m")


def single_feature_ols(df: DataFrame, feature: str, target: str = fixed.TARGET) -> DataFrame:
    """Least squares on one feature, as one aggregate."""
    return df.agg(
        F.regr_slope(target, feature).alias("slope"),
        F.regr_intercept(target, feature).alias("intercept"),
        F.regr_r2(target, feature).alias("r2_score"),
        F.regr_count(target, feature).alias("n"),
    )


def coefficients(spark, model: LinearEnergyModel) -> DataFrame:
    """Intercept and coefficients (per standard deviation); eight rows of the fitted model."""
    rows = [("intercept", model.intercept), *zip(model.features, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def importance(spark, model: LinearEnergyModel) -> DataFrame:
    """Share of each coefficient's size, largest first."""
    total = sum(abs(c) for c in model.coefficients)
    rows = [
        (f, abs(c) / total if total > 0 else abs(c))
        for f, c in zip(model.features, model.coefficients)
    ]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
