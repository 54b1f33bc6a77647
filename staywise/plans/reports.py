"""Reports as frames, written by Spark. No report carries row-level predictions."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.functions.columns import ref
from staywise.functions.scale import materialize
from staywise.functions.vocab import STAY
from staywise.operators.evaluation import (
    bins_of_counts,
    clipped_counts,
    decision_curve,
    expected_calibration_error,
    metrics_of_counts,
    score_cube,
    subgroup_metrics,
    subgroup_metrics_of,
)
from staywise.operators.models import calibration_verdict
from staywise.plans.baseline import RunReport


def nan_to_null(frame: DataFrame) -> DataFrame:
    """JSON has no NaN: floating columns carry null instead."""
    return frame.select(
        *[
            F.nanvl(ref(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else ref(f.name)
            for f in frame.schema
        ]
    )


def write_cohort(cohort: DataFrame, path: str) -> None:
    """CSV with header, ordered by stay; range-partitioned, so the order costs no single task."""
    cohort.orderBy(STAY).write.mode("overwrite").csv(str(path), header=True)


def write_json(frame: DataFrame, path: str) -> None:
    """One JSON object per row; null fields stay visible."""
    nan_to_null(frame).write.mode("overwrite").option("ignoreNullFields", "false").json(str(path))


def evaluation_report(
    predictions: DataFrame, label: str, score: str, subgroups: Sequence[str] = (), n_bins: int = 10
) -> dict[str, DataFrame]:
    """Overall metrics, calibration bins with their error, and subgroup metrics, all from one count table.

    The predictions are read once: counts per distinct score, overall and per subgroup value, are written down, and
    every section is worked out from them.
    """
    cube = materialize(score_cube(predictions, label, score, list(subgroups)))
    overall = cube.where(F.col("subgroup_col").isNull()).select("score", "n", "pos")
    bins = materialize(bins_of_counts(overall.where((F.col("n") > 0) & F.col("score").between(0.0, 1.0)), n_bins))
    no_groups = subgroup_metrics(predictions, label, score, [])
    return {
        "overall": metrics_of_counts(clipped_counts(overall)),
        "calibration_error": expected_calibration_error(bins),
        "calibration_bins": bins.orderBy("bin"),
        "subgroups": (subgroup_metrics_of(cube) if subgroups else no_groups).orderBy("subgroup_col", "subgroup_value"),
    }


def long_report(sections: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """All sections as typed rows (section, key, metric, value); ``keys`` names the columns that tell rows apart."""
    frames = []
    for name, frame in sections.items():
        own = list(keys.get(name, ()))
        numbers = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType) and f.name not in own]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), ref(c).cast("double").alias("value")) for c in numbers])
        key = F.concat_ws("=", *[ref(c).cast("string") for c in own]) if own else F.lit("")
        frames.append(nan_to_null(frame).select(F.lit(name).alias("section"), key.alias("key"), F.inline(cells)))
    return reduce(DataFrame.unionByName, frames)


def decision_report(
    predictions: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None
) -> dict[str, DataFrame]:
    return {"decision_curve": decision_curve(predictions, label, score, thresholds).orderBy("threshold")}


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """Each section as JSON lines under ``path/<section>``."""
    for name, frame in sections.items():
        write_json(frame, f"{str(path).rstrip('/')}/{name}")


def _plain(value: Any) -> Any:
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def run_payload(report: RunReport, data_root: str, code_version: str | None = None) -> dict[str, Any]:
    """The run as one nested record of aggregates; only the last part of the data root is kept."""
    models = {
        name: {
            "metrics": result.metrics,
            "calibration": calibration_verdict(result.metrics),
            # At most ten rows.
            "calibration_table": [r.asDict() for r in result.reliability.orderBy("bin").collect()],
        }
        for name, result in report.models.items()
    }
    return _plain(
        {
            "kind": report.kind,
            "config": {"data_root_basename": str(data_root).rstrip("/").rsplit("/", 1)[-1], **report.config},
            "cohort_waterfall": report.waterfall,
            "n_features": len(report.features),
            "feature_names": list(report.features),
            "split": report.split,
            "models": models,
            "chosen_model": report.chosen,
            "training": report.training,
            "warnings": list(report.warnings),
            "generated_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "code_version": code_version,
        }
    )


def write_run(spark, report: RunReport, path: str, data_root: str, code_version: str | None = None) -> None:
    """The payload as one JSON line, written through Spark so that any Hadoop path works."""
    line = json.dumps(run_payload(report, data_root, code_version), allow_nan=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(str(path))
