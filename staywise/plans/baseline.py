"""The two baseline jobs: flat features with two classifiers, and hourly sequences with a selected linear model."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.columns import require_same_key_type
from staywise.functions.scale import materialize
from staywise.functions.vocab import PATIENT, STAY
from staywise.operators.cohort import CohortSpec, cohort_with_waterfall
from staywise.operators.evaluation import auroc
from staywise.operators.labels import drop_short_stays, outcome_labels, require_two_classes
from staywise.operators.models import (
    LABEL,
    SCORE,
    ModelResult,
    better_model,
    check_training_data,
    evaluate,
    fit_boosted_trees,
    fit_logistic,
    fit_stopped_trees,
    predict,
    principal_stages,
)
from staywise.operators.sequences import SequenceFrame, build_sequences
from staywise.operators.splits import group_train_test_split, split_summary, three_way_split
from staywise.operators.windows import admission_anchors
from staywise.plans.matrix import feature_matrix, model_frame
from staywise.sources.catalog import TableCatalog


@dataclass(frozen=True)
class RunReport:
    """What a run produced. Scalars and small frames, plus the fitted models with their predictions."""

    kind: str
    config: dict[str, Any]
    waterfall: dict[str, Any]
    features: tuple[str, ...]
    split: dict[str, dict[str, float]]
    models: dict[str, ModelResult]
    warnings: tuple[str, ...] = field(default=())
    training: dict[str, Any] = field(default_factory=dict)
    chosen: str | None = None


@dataclass(frozen=True)
class RunConfig:
    """What both jobs are asked for; the report repeats it."""

    cohort_spec: CohortSpec = field(default_factory=CohortSpec)
    window_hours: float = 24.0
    seed: int = 42
    outcome: str = "mortality"
    include_hospice: bool = False
    los_threshold_hours: float = 168.0
    censoring_guard: bool = False


@dataclass(frozen=True)
class FlatConfig(RunConfig):
    test_size: float = 0.2
    feature_set: str = "basic"
    stratify: bool = False
    trees: int = 200


@dataclass(frozen=True)
class SequenceConfig(RunConfig):
    window_hours: int = 24
    censoring_guard: bool = True
    include_mask: bool = False
    use_pos_weight: bool = False
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0)
    trees: int = 40
    patience: int = 3
    max_iter: int = 1000


def labelled_cohort(catalog: TableCatalog, config: RunConfig) -> tuple[DataFrame, dict[str, Any]]:
    """Checkpointed (patient, stay, age, outcome) and the waterfall; fails on an empty or one-class result."""
    labels = outcome_labels(catalog, config.outcome, config.include_hospice, config.los_threshold_hours)
    cohort, waterfall = cohort_with_waterfall(catalog, config.cohort_spec)
    steps = waterfall.first().asDict()
    if steps["final"] == 0:
        raise ValueError(f"the cohort is empty after its filters: {steps}")
    require_same_key_type(cohort, labels, STAY, "cohort and labels")
    labelled = cohort.join(labels, STAY)
    if config.censoring_guard:
        labelled = drop_short_stays(labelled, catalog, config.window_hours)
    labelled = materialize(labelled)
    found = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("bigint")).alias("pos")).first()
    if found.n == 0:
        raise ValueError("no cohort stay has a label" + (" and covers the window" if config.censoring_guard else ""))
    require_two_classes(found.pos, found.n)
    return labelled, steps


def cohort_anchors(catalog: TableCatalog, labelled: DataFrame) -> DataFrame:
    return admission_anchors(catalog).join(labelled.select(STAY).distinct(), STAY, "left_semi")


def _sides(frame: DataFrame) -> dict[str, dict[str, float]]:
    return {
        r.split: {"n": r.n, "n_patients": r.n_groups, "prevalence": r.prevalence}
        for r in split_summary(frame, PATIENT, LABEL).collect()  # one row per side
    }


def run_baseline(catalog: TableCatalog, spec: CohortSpec | None = None, **options) -> RunReport:
    """Cohort, labels, windowed features, patient-disjoint split, boosted trees and logistic regression.

    ``options`` are the fields of FlatConfig. The model frame is checkpointed once: the many passes of the fits never
    go back to the event tables.
    """
    config = FlatConfig(spec or CohortSpec(), **options)
    labelled, steps = labelled_cohort(catalog, config)
    matrix = feature_matrix(catalog, labelled, cohort_anchors(catalog, labelled), config.window_hours, config.feature_set)
    if not matrix.features:
        raise ValueError(f"no usable feature table: {list(matrix.warnings)}")
    full = materialize(model_frame(matrix, labelled))
    full = group_train_test_split(full, PATIENT, config.test_size, config.seed, LABEL, config.stratify)
    check_training_data(full, "split")
    train, test = full.where("split = 'train'"), full.where("split = 'test'")
    trees = fit_boosted_trees(train, matrix.features, seed=config.seed, trees=config.trees)
    boosted = evaluate("boosted_trees", trees, test)
    linear = evaluate("logistic", fit_logistic(train, matrix.features), test)
    chosen = better_model(boosted, linear)
    return RunReport(
        "baseline", asdict(config), steps, matrix.features, _sides(full), {m.name: m for m in (boosted, linear)},
        matrix.warnings, chosen=chosen.name,
    )


def flatten_sequences(sequences: SequenceFrame, include_mask: bool = False) -> DataFrame:
    """(stay, x): the hourly channels of a stay as one vector, hour by hour. Its length is fixed."""
    nested = sequences.per_stay()
    hour = lambda own, mask: F.concat(own.cast("array<double>"), mask.cast("array<double>"))
    rows = F.zip_with("features", "mask", hour) if include_mask else F.transform("features", lambda own: own.cast("array<double>"))
    return nested.select(STAY, array_to_vector(F.flatten(rows)).alias("x"))


def run_sequence_baseline(catalog: TableCatalog, spec: CohortSpec | None = None, **options) -> RunReport:
    """Hourly sequences, 70/15/15 split by patient, model choice on validation AUROC, metrics on the test side.

    ``options`` are the fields of SequenceConfig. Candidates differ in the inverse penalty strength and are tried in
    order; the first of equals stays, and ``patience`` candidates without a strict improvement end the search. Boosted
    trees are one more candidate (none with ``trees=0``): they grow until the loss on the validation side rises.
    """
    config = SequenceConfig(spec or CohortSpec(), **options)
    labelled, steps = labelled_cohort(catalog, config)
    sequences = build_sequences(catalog, labelled, cohort_anchors(catalog, labelled), config.window_hours)
    flat = flatten_sequences(sequences, config.include_mask)
    full = materialize(labelled.select(STAY, PATIENT, LABEL).join(flat, STAY))
    full = three_way_split(full, PATIENT, config.seed)
    check_training_data(full, "split")
    train, validation, test = (full.where(F.col("split") == s) for s in ("train", "validation", "test"))

    best = best_area = best_penalty = None
    tried = stale = 0
    stages = principal_stages(train, "x")
    for penalty in config.penalties:
        candidate = fit_logistic(
            train, "x", penalty=penalty, reweight=config.use_pos_weight, tol=1e-6, max_iter=config.max_iter, stages=stages
        )
        row = auroc(predict(candidate, validation), LABEL, SCORE).first()
        area = 0.5 if row.auroc is None else row.auroc  # one class in the validation fold: no preference
        tried += 1
        if best is None or area > best_area:
            best, best_area, best_penalty, stale = candidate, area, penalty, 0
        else:
            stale += 1
            if stale >= config.patience:
                break
    name, areas = "sequence_logistic", {"logistic": best_area}
    if config.trees:
        both = full.where(F.col("split") != "test").withColumn("_validation", F.col("split") == "validation")
        grown = fit_stopped_trees(both, "x", "_validation", trees=config.trees, seed=config.seed, is_unbalance=config.use_pos_weight)
        row = auroc(predict(grown, validation), LABEL, SCORE).first()
        areas["boosted_trees"] = 0.5 if row.auroc is None else row.auroc
        tried += 1
        if areas["boosted_trees"] > best_area:
            name, best, best_area, best_penalty = "sequence_boosted_trees", grown, areas["boosted_trees"], None
    result = evaluate(name, best, test)
    training = {
        "candidates_tried": tried, "best_penalty": best_penalty, "best_validation_auroc": best_area, "validation_auroc": areas,
    }
    return RunReport(
        "sequence-baseline", asdict(config), steps, sequences.channels, _sides(full), {result.name: result}, (), training,
        result.name,
    )
