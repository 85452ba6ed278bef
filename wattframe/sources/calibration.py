"""Calibration tables as CSV, and fitted models on disk."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from wattframe.functions import fixed


def missing_columns(df: DataFrame) -> list[str]:
    """Required calibration columns the table lacks."""
    return sorted({*fixed.FEATURES, fixed.TARGET} - set(df.columns))


def check(df: DataFrame) -> DataFrame:
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"calibration data lacks columns: {', '.join(missing)}")
    return df


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Reads calibration CSV; the header line decides which columns exist.

    The header is looked at first (columns only), so a missing column is an error rather
    than a column of NULLs; the data is then read with fixed types, not inferred ones.
    """
    header = spark.read.option("header", True).csv(path)
    check(header)
    numeric = (*fixed.FEATURES, fixed.TARGET)
    return header.withColumns({name: header[name].cast("double") for name in numeric})


def write_calibration(df: DataFrame, path: str) -> None:
    check(df).write.mode("overwrite").option("header", True).csv(path)


def save_model(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
