"""Discrimination, calibration and decision curves from (label, score) rows.

Everything order-related works on counts per distinct score: rows with the same score are combined map-side,
so heavy ties cost nothing and no task ever sorts raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.columns import ref, require_columns
from staywise.functions.scale import materialize, running_counts
from staywise.functions.vocab import DECILE_EDGES

CLIP = 1e-15
LOGIT_CLIP = 1e-7
SINGLE_CLASS = "AUROC is undefined: only one class among these rows"


def _finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def _binary(label: Column) -> Column:
    """The label as 0/1; any other value fails the job when it is read."""
    return F.when(label.isin(0.0, 1.0), label.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("labels must be binary 0/1, found "), label.cast("string")))
    )


def _or_fail(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def clean_scores(
    frame: DataFrame, label: str, score: str, by: Sequence[str] = (), clip: float | None = CLIP
) -> DataFrame:
    """(by..., score, y): rows with a finite label and score, the score optionally clipped to (0, 1).

    With groups, the other rows stay with a null y, so that a group made of nothing else is still seen.
    """
    require_columns(frame, [label, score, *by], "evaluation")
    y, p = ref(label).cast("double"), ref(score).cast("double")
    usable = _finite(y) & _finite(p)
    if clip is not None:
        used = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    else:
        used = p + F.lit(0.0)  # one zero, not two
    if by:
        used = F.when(usable, used).otherwise(F.lit(0.5))
    else:
        frame = frame.where(usable)
    return frame.select(*[ref(c) for c in by], used.alias("score"), F.when(usable, _binary(y)).alias("y"))


def score_counts(
    frame: DataFrame, label: str, score: str, by: Sequence[str] = (), clip: float | None = CLIP
) -> DataFrame:
    """(by..., score, n, pos): rows and positives per distinct clean score."""
    return (
        clean_scores(frame, label, score, by, clip)
        .groupBy(*by, "score")
        .agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("pos"))
    )


def _rank_area(n: Column, pos: Column, rank_sum: Column) -> Column:
    """Mann-Whitney AUROC from the positives' rank sum; null when a class is missing."""
    pairs = pos.cast("double") * (n - pos).cast("double")
    return F.when(pairs > 0, (rank_sum - pos * (pos + 1) / F.lit(2.0)) / pairs)


def binary_metrics(
    frame: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """n, prevalence, auroc, brier, log_loss on clipped scores; one row, or one per group.

    AUROC uses average ranks for ties and is null when a group has one class. No finite row at all fails.
    """
    return metrics_of_counts(score_counts(frame, label, score, by), by, buckets)


def metrics_of_counts(counts: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """The binary metrics of rows (by..., score, n, pos) whose scores are clipped and distinct within a group."""
    ranked = running_counts(counts, "score", ["n"], list(by), buckets)
    p, n, pos = F.col("score"), F.col("n"), F.col("pos")
    neg = n - pos
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.sum(pos).alias("pos"),
        F.sum(pos * (F.col("below_n") + (n + 1) / F.lit(2.0))).alias("rank_sum"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("squared"),
        F.sum(-(pos * F.log(p) + neg * F.log(1 - p))).alias("log_sum"),
    )
    total = _or_fail(F.col("n") > 0, F.col("n"), "no finite labels and scores" + (" in a group" if by else ""))
    return sums.select(
        *by,
        total.alias("n"),
        (F.col("pos") / F.col("n")).alias("prevalence"),
        _rank_area(F.col("n"), F.col("pos"), F.col("rank_sum")).alias("auroc"),
        (F.col("squared") / F.col("n")).alias("brier"),
        (F.col("log_sum") / F.col("n")).alias("log_loss"),
    )


def auroc(frame: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    return binary_metrics(frame, label, score, by, buckets).select(*by, "auroc")


def score_cube(frame: DataFrame, label: str, score: str, subgroups: Sequence[str] = ()) -> DataFrame:
    """(subgroup_col, subgroup_value, score, n, pos): counts per distinct score, overall and per subgroup value.

    One scan and one aggregation by grouping sets; the overall rows have a null subgroup_col. Scores are not clipped;
    a missing subgroup value is the group "Unknown". Rows without a finite label and score count as n = 0, so that a
    group made of nothing else is still seen.
    """
    require_columns(frame, [label, score, *subgroups], "evaluation")
    y, p = ref(label).cast("double"), ref(score).cast("double")
    usable = _finite(y) & _finite(p)
    names = [f"g{i}" for i in range(len(subgroups))]
    rows = frame.select(
        F.when(usable, p + F.lit(0.0)).otherwise(F.lit(0.5)).alias("score"),
        F.when(usable, _binary(y)).alias("y"),
        *[F.coalesce(ref(c).cast("string"), F.lit("Unknown")).alias(g) for c, g in zip(subgroups, names, strict=True)],
    )
    counted = [F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("pos")]
    if not names:
        cube = rows.groupBy("score").agg(*counted)
        return cube.select(F.lit(None).cast("string").alias("subgroup_col"), F.lit(None).cast("string").alias("subgroup_value"), "score", "n", "pos")
    sets = [["score"], *[["score", g] for g in names]]
    cube = rows.groupingSets([[F.col(c) for c in one] for one in sets], F.col("score"), *[F.col(g) for g in names]).agg(
        *counted, *[F.grouping(g).alias(f"_{g}") for g in names]
    )
    column, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, g in zip(subgroups, names, strict=True):
        column = F.when(F.col(f"_{g}") == 0, c).otherwise(column)
        value = F.when(F.col(f"_{g}") == 0, F.col(g)).otherwise(value)
    return cube.select(column.alias("subgroup_col"), value.alias("subgroup_value"), "score", "n", "pos")


def clipped_counts(counts: DataFrame, by: Sequence[str] = (), clip: float = CLIP) -> DataFrame:
    """Rows (by..., score, n, pos) with the scores clipped to (0, 1)."""
    inside = F.least(F.greatest("score", F.lit(clip)), F.lit(1.0 - clip))
    return counts.groupBy(*by, inside.alias("score")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def subgroup_metrics(
    frame: DataFrame, label: str, score: str, subgroups: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Metrics per value of every subgroup column; a missing value is the group "Unknown".

    One pass for all columns. A subgroup with one class keeps its row, with a null AUROC and a warning. A
    subgroup without a single finite row fails the job.
    """
    require_columns(frame, [label, score, *subgroups], "subgroup metrics")
    if not subgroups:
        return frame.sparkSession.createDataFrame(
            [],
            "subgroup_col string, subgroup_value string, n bigint, prevalence double, auroc double, "
            "brier double, log_loss double, warning string",
        )
    return subgroup_metrics_of(score_cube(frame, label, score, subgroups), buckets)


def subgroup_metrics_of(cube: DataFrame, buckets: int | None = None) -> DataFrame:
    """The subgroup metrics of a score cube."""
    by = ["subgroup_col", "subgroup_value"]
    counts = clipped_counts(cube.where(F.col("subgroup_col").isNotNull()), by)
    return metrics_of_counts(counts, by, buckets).withColumn("warning", F.when(F.col("auroc").isNull(), SINGLE_CLASS))


def calibration_bins(
    frame: DataFrame, label: str, score: str, n_bins: int = 10, buckets: int | None = None
) -> DataFrame:
    """Equal-frequency calibration table: row i of n in score order falls into bin floor(i * bins / n).

    Rows with equal scores are interchangeable; where a bin edge cuts through them their positives are spread
    evenly over the run. Only counts per distinct score are ordered.
    """
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    require_columns(frame, [label, score], "calibration table")
    usable = frame.where(ref(label).isNotNull() & ref(score).cast("double").between(0.0, 1.0))
    return bins_of_counts(materialize(score_counts(usable, label, score, clip=None)), n_bins, buckets)


def bins_of_counts(counts: DataFrame, n_bins: int = 10, buckets: int | None = None) -> DataFrame:
    """The equal-frequency table of rows (score, n, pos) with distinct scores in [0, 1]."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    total = counts.agg(F.sum("n").alias("t")).first().t
    if not total:
        raise ValueError("no valid rows for a calibration table")
    bins = min(total, n_bins)
    runs = running_counts(counts, "score", ["n"], [], buckets).select(
        "*", F.lit(total).cast("bigint").alias("t"), F.lit(bins).cast("bigint").alias("k")
    )
    # A run of equal scores covers rows [below_n, below_n + n); one output row per bin it touches.
    pieces = runs.withColumn(
        "bin",
        F.explode(F.expr("sequence((below_n * k) div t, ((below_n + n - 1) * k) div t)")),
    ).select(
        "bin",
        "score",
        "n",
        "pos",
        F.expr("greatest(0, (bin * t + k - 1) div k - below_n)").alias("start"),
        F.expr("least(n, ((bin + 1) * t + k - 1) div k - below_n)").alias("stop"),
    )
    share = pieces.select(
        "bin",
        "score",
        (F.col("stop") - F.col("start")).alias("rows"),
        # Decimals: the product of two counts may leave 64 bits.
        F.expr("(CAST(stop AS DECIMAL(20,0)) * CAST(pos AS DECIMAL(18,0))) div n - (CAST(start AS DECIMAL(20,0)) * CAST(pos AS DECIMAL(18,0))) div n").alias("events"),
    )
    return share.groupBy("bin").agg(
        F.sum("rows").alias("n"),
        (F.sum(F.col("score") * F.col("rows")) / F.sum("rows")).alias("mean_predicted_risk"),
        (F.sum("events") / F.sum("rows")).alias("observed_event_rate"),
        F.min("score").alias("min_predicted_risk"),
        F.max("score").alias("max_predicted_risk"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """One row: row-weighted mean gap between predicted and observed risk; NaN when the bins hold no rows."""
    require_columns(bins, ["n", "mean_predicted_risk", "observed_event_rate"], "calibration error")
    gap = F.abs(F.col("mean_predicted_risk") - F.col("observed_event_rate")) * F.col("n")
    return bins.agg(F.sum(gap).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).select(
        F.coalesce(F.try_divide("g", "t"), F.lit(float("nan"))).alias("expected_calibration_error")
    )


def reliability_deciles(frame: DataFrame, label: str, score: str) -> DataFrame:
    """Fixed-width bins 0..9 of the score that hold rows: bin, mean_pred, mean_actual, count."""
    require_columns(frame, [label, score], "reliability table")
    p = ref(score).cast("double")
    # Compared with the edge values themselves: floor(10 p) lands in the wrong bin at 0.3, 0.6 and 0.7.
    bin_of = sum((p >= F.lit(edge)).cast("int") for edge in DECILE_EDGES)
    return (
        frame.select(bin_of.alias("bin"), p.alias("p"), ref(label).cast("double").alias("y"))
        .groupBy("bin")
        .agg(F.avg("p").alias("mean_pred"), F.avg("y").alias("mean_actual"), F.count(F.lit(1)).alias("count"))
    )


def calibration_line(counts: DataFrame) -> tuple[float, float]:
    """Intercept and slope of the outcome on logit(score), unpenalised; NaN with a single class.

    ``counts`` come from score_counts, so the fit sees each distinct score at most twice, with weights.
    """
    p = F.least(F.greatest(F.col("score"), F.lit(LOGIT_CLIP)), F.lit(1.0 - LOGIT_CLIP))
    weighted = (
        counts.select(
            array_to_vector(F.array(F.log(p / (1 - p)))).alias("features"),
            F.inline(
                F.array(
                    F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")),
                    F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("pos")).cast("double").alias("w")),
                )
            ),
        )
        .where("w > 0")
        .persist()
    )
    try:
        if weighted.select("y").distinct().count() < 2:
            return math.nan, math.nan
        fit = LogisticRegression(
            featuresCol="features", labelCol="y", weightCol="w", regParam=0.0, standardization=False,
            maxIter=1000, tol=1e-12,
        ).fit(weighted)
        return float(fit.intercept), float(fit.coefficients[0])
    finally:
        weighted.unpersist()


def ranking_metrics(frame: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """One row: auroc, auprc (average precision), brier_score on raw scores, prevalence.

    AUROC and average precision are NaN with a single class.
    """
    return _ranking(score_counts(frame, label, score, clip=None), buckets)


def _ranking(counts: DataFrame, buckets: int | None) -> DataFrame:
    # In descending order the running counts are those at higher scores: precision needs no totals.
    descending = counts.select(F.negative("score").alias("order"), "score", "n", "pos")
    ranked = running_counts(descending, "order", ["n", "pos"], [], buckets)
    p, n, pos = F.col("score"), F.col("n"), F.col("pos")
    sums = ranked.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.coalesce(F.sum(pos), F.lit(0)).alias("pos"),
        F.sum(pos * (F.col("below_n") + (n - 1) / F.lit(2.0))).alias("higher"),
        F.sum(pos * (F.col("below_pos") + pos) / (F.col("below_n") + n)).alias("precision_sum"),
        F.sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p).alias("squared"),
    )
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    nan = F.lit(float("nan"))
    rank_sum = n * pos - F.col("higher")
    return sums.select(
        F.coalesce(_rank_area(n, pos, rank_sum), nan).alias("auroc"),
        F.when((pos > 0) & (pos < n), F.col("precision_sum") / pos).otherwise(nan).alias("auprc"),
        (F.col("squared") / _or_fail(n > 0, n, "no finite labels and scores")).alias("brier_score"),
        (pos / n).alias("prevalence"),
    )


def model_metrics(frame: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """One row with the six holdout metrics: ranking metrics plus calibration_intercept and calibration_slope."""
    counts = materialize(score_counts(frame, label, score, clip=None))
    intercept, slope = calibration_line(counts)
    return _ranking(counts, buckets).select(
        "*",
        F.lit(intercept).alias("calibration_intercept"),
        F.lit(slope).alias("calibration_slope"),
    )


def default_thresholds() -> list[float]:
    """0.05, 0.10, ... 0.50."""
    return [round(step * 0.05, 3) for step in range(1, 11)]


def decision_curve(
    frame: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Net benefit of acting on the model, on everyone and on no one, per threshold; one scan for all of them.

    A NaN score counts as a row but never as positive.
    """
    thresholds = [float(t) for t in (default_thresholds() if thresholds is None else thresholds)]
    if any(not 0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie strictly between 0 and 1")
    require_columns(frame, [label, score], "decision curve")
    clean = (
        frame.select(ref(label).cast("bigint").cast("double").alias("y"), ref(score).cast("double").alias("p"))
        .where(F.col("y").isNotNull() & F.col("p").isNotNull())
        .select(_binary(F.col("y")).alias("y"), F.when(~F.isnan("p"), F.col("p")).alias("p"))
    )
    counted = clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("y").alias("pos"),
        *[F.count_if((F.col("p") >= t) & (F.col("y") == 1)).alias(f"tp_{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((F.col("p") >= t) & (F.col("y") == 0)).alias(f"fp_{i}") for i, t in enumerate(thresholds)],
    )
    points = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"tp_{i}").alias("true_positives"),
                F.col(f"fp_{i}").alias("false_positives"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    odds = F.col("threshold") / (1 - F.col("threshold"))
    n = F.col("n")
    return (
        counted.select(
            _or_fail(F.col("rows") > 0, F.col("rows"), "no valid rows for a decision curve").alias("n"),
            (F.col("pos") / F.col("rows")).alias("prevalence"),
            F.inline(points),
        )
        .select(
            "threshold",
            "n",
            "prevalence",
            "true_positives",
            "false_positives",
            (F.col("true_positives") / n - F.col("false_positives") / n * odds).alias("net_benefit_model"),
            (F.col("prevalence") - (1 - F.col("prevalence")) * odds).alias("net_benefit_treat_all"),
            F.lit(0.0).alias("net_benefit_treat_none"),
        )
    )
