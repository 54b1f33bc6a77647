"""Prediction files with a binary label, a risk score and optional subgroup columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from staywise.functions.columns import ref


def read_predictions(spark: SparkSession, path: str, numeric: Sequence[str] = ()) -> DataFrame:
    """Parquet or CSV with header, chosen by suffix.

    CSV is read in one pass: every column is text, and those named in ``numeric`` (label and score) become doubles,
    null where the text is no number.
    """
    lowered = str(path).rstrip("/").lower()
    if lowered.endswith(".parquet"):
        return spark.read.parquet(str(path))
    if lowered.endswith(".csv"):
        frame = spark.read.csv(str(path), header=True)
        return frame.select(*[ref(c).try_cast("double").alias(c) if c in numeric else ref(c) for c in frame.columns])
    raise ValueError(f"unsupported prediction file {path}; expected .csv or .parquet")
