"""Flat feature matrices and the model frame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from staywise.functions.columns import KeyTypeMismatch, require_same_key_type
from staywise.functions.vocab import PATIENT, STAY
from staywise.operators.sequences import rich_sources
from staywise.operators.windows import (
    STATS,
    ChannelSource,
    channel_matrix,
    channel_rows,
    require_parseable,
    value_column,
)
from staywise.sources.catalog import TableCatalog

BASIC_SOURCES = (ChannelSource("vitals", "vitals"), ChannelSource("labs", "labs"))
FEATURE_SETS = ("basic", "rich")


@dataclass(frozen=True)
class FeatureMatrix:
    """``frame`` has one row per cohort stay; None when no table could be used."""

    frame: DataFrame | None
    features: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())


def _feature_names(sources: list[ChannelSource]) -> tuple[str, ...]:
    names = []
    for source in sources:
        for channel in source.channels:
            names += [channel] if source.indicator else [f"{channel}_{s}" for s in STATS]
    return tuple(names)


def _assemble(
    catalog: TableCatalog,
    sources: list[ChannelSource],
    cohort: DataFrame,
    anchors: DataFrame,
    window_hours: float,
    warn_on_bad_table: bool,
    salting: bool | None,
) -> FeatureMatrix:
    used, rows, warnings = [], [], []
    for source in sources:
        if source.table not in catalog:
            warnings.append(f"table {source.table} not found, its features are skipped")
            continue
        try:
            rows.append(channel_rows(catalog, source, anchors, first=sum(len(s.channels) for s in used)))
        except KeyTypeMismatch:
            raise
        except ValueError as problem:
            if not warn_on_bad_table:
                raise
            warnings.append(f"table {source.table} skipped: {problem}")
            continue
        if source.categories is None:
            frame = catalog[source.table]
            require_parseable(frame, value_column(frame, source.table), source.table, 0.5)
        used.append(source)
    if not used:
        return FeatureMatrix(None, (), tuple(warnings))
    require_same_key_type(cohort, anchors, STAY, "cohort and anchors")
    together = reduce(DataFrame.unionByName, rows)
    frame = channel_matrix(together, used, anchors, window_hours, cohort, salting)
    return FeatureMatrix(frame, _feature_names(used), tuple(warnings))


def basic_matrix(
    catalog: TableCatalog, cohort: DataFrame, anchors: DataFrame, window_hours: float, salting: bool | None = None
) -> FeatureMatrix:
    """Vitals and labs, each as one channel with four statistics. A missing table is a warning, bad data fails."""
    return _assemble(catalog, list(BASIC_SOURCES), cohort, anchors, window_hours, False, salting)


def rich_matrix(
    catalog: TableCatalog, cohort: DataFrame, anchors: DataFrame, window_hours: float, salting: bool | None = None
) -> FeatureMatrix:
    """Per-category vitals, labs and assessments plus device flags. A table that does not fit is a warning."""
    return _assemble(catalog, rich_sources(), cohort, anchors, window_hours, True, salting)


def feature_matrix(
    catalog: TableCatalog,
    cohort: DataFrame,
    anchors: DataFrame,
    window_hours: float,
    feature_set: str = "basic",
    salting: bool | None = None,
) -> FeatureMatrix:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {FEATURE_SETS}, got {feature_set!r}")
    build = rich_matrix if feature_set == "rich" else basic_matrix
    return build(catalog, cohort, anchors, window_hours, salting)


def model_frame(matrix: FeatureMatrix, labelled_cohort: DataFrame) -> DataFrame:
    """(stay, patient, outcome, features...), one row per labelled stay."""
    clash = {PATIENT, "outcome"} & set(matrix.features)
    if clash:
        raise ValueError(f"feature names collide with reserved columns: {sorted(clash)}")
    keys = labelled_cohort.select(STAY, PATIENT, "outcome")
    return keys.join(matrix.frame, STAY).select(STAY, PATIENT, "outcome", *matrix.features)
