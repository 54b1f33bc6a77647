"""Leakage-safe aggregation of measurements in a half-open window after an anchor instant."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.columns import (
    as_double,
    first_present,
    hours_interval,
    needs_parsing,
    ref,
    require_columns,
    require_same_key_type,
    require_same_time_type,
    require_time_column,
    safe_name,
)
from staywise.functions.scale import skew_safe_join
from staywise.functions.vocab import ANCHOR, STAY, TIME_COLUMNS, VALUE_COLUMNS
from staywise.sources.catalog import TableCatalog

STATS = ("mean", "min", "max", "n")


def admission_anchors(catalog: TableCatalog) -> DataFrame:
    """(stay, anchor_dttm): earliest admission per stay."""
    stays = catalog["hospitalization"]
    require_columns(stays, [STAY, "admission_dttm"], "hospitalization")
    return stays.groupBy(STAY).agg(F.min("admission_dttm").alias(ANCHOR))


def require_anchors(anchors: DataFrame) -> None:
    require_columns(anchors, [STAY, ANCHOR], "anchors")
    require_time_column(anchors, ANCHOR, "anchors")


def value_column(frame: DataFrame, table: str) -> str:
    found = first_present(frame.columns, VALUE_COLUMNS)
    if found is None or STAY not in frame.columns:
        raise ValueError(f"{table} needs {STAY} and one of {list(VALUE_COLUMNS)}; observed {sorted(frame.columns)}")
    return found


def time_column(frame: DataFrame, table: str, candidates: Sequence[str] = TIME_COLUMNS) -> str:
    found = first_present(frame.columns, candidates)
    if found is None:
        raise ValueError(f"{table} has no timestamp column among {list(candidates)}; observed {sorted(frame.columns)}")
    return found


def parse_quality(frame: DataFrame, column: str) -> DataFrame:
    """One row: n_rows, n_non_null, n_numeric, n_unparseable, unparseable_fraction (null without values)."""
    counted = frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(ref(column)).alias("n_non_null"),
        F.count(as_double(frame, column)).alias("n_numeric"),
    )
    failed = F.col("n_non_null") - F.col("n_numeric")
    return counted.select(
        "*",
        failed.alias("n_unparseable"),
        F.try_divide(failed, F.col("n_non_null")).alias("unparseable_fraction"),
    )


def require_parseable(frame: DataFrame, column: str, table: str, max_fraction: float) -> None:
    """Fail when too large a share of the text values is no number. Numeric columns need no scan."""
    if not needs_parsing(frame, column):
        return
    found = parse_quality(frame, column).first()
    if found.unparseable_fraction is not None and found.unparseable_fraction > max_fraction:
        raise ValueError(
            f"{table}.{column}: {found.n_unparseable} of {found.n_non_null} values are unparseable as numbers, "
            f"share {found.unparseable_fraction:.3f} exceeds {max_fraction}"
        )


def _stat_columns(prefix: str = "") -> list:
    """The four statistics. n counts rows, also those whose value is null."""
    aggregates = (F.avg("value"), F.min("value"), F.max("value"), F.count(F.lit(1)))
    return [a.alias(f"{prefix}{name}") for a, name in zip(aggregates, STATS, strict=True)]


def _onto_cohort(stats: DataFrame, cohort: DataFrame, counts: Sequence[str], what: str) -> DataFrame:
    """Every cohort stay appears; without data the statistics are null and the counts 0."""
    require_columns(cohort, [STAY], "cohort")
    require_same_key_type(cohort, stats, STAY, what)
    return cohort.select(STAY).join(stats, STAY, "left").fillna(0, list(counts))


def whole_stay_stats(
    catalog: TableCatalog,
    table: str,
    prefix: str,
    cohort: DataFrame | None = None,
    max_unparseable_fraction: float = 0.5,
) -> DataFrame:
    """Per stay ``{prefix}_mean/min/max/n`` over all rows of a table."""
    frame = catalog[table]
    column = value_column(frame, table)
    require_parseable(frame, column, table, max_unparseable_fraction)
    stats = (
        frame.select(STAY, as_double(frame, column).alias("value"))
        .groupBy(STAY)
        .agg(*_stat_columns(f"{prefix}_"))
    )
    return stats if cohort is None else _onto_cohort(stats, cohort, [f"{prefix}_n"], table)


@dataclass(frozen=True)
class ChannelSource:
    """Where a block of channels comes from.

    ``categories=None`` makes the whole table one channel called ``name``; otherwise ``name`` is a template such
    as ``vitals_{category}``. ``indicator`` sources only say whether rows exist.
    """

    table: str
    name: str
    category_column: str | None = None
    categories: tuple[str, ...] | None = None
    indicator: bool = False

    def __post_init__(self) -> None:
        if self.categories is not None and self.name.count("{category}") != 1:
            raise ValueError(f"channel name template needs one {{category}}: {self.name!r}")

    @property
    def channels(self) -> list[str]:
        if self.categories is None:
            return [self.name]
        return [self.name.replace("{category}", safe_name(c)) for c in self.categories]


def require_distinct(names: Sequence[str]) -> None:
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"feature names collide after clean-up: {repeated}")


def channel_codes(sources: Sequence[ChannelSource]) -> dict[str, int]:
    """Channel names numbered in order; names must be distinct."""
    names = [c for s in sources for c in s.channels]
    require_distinct(names)
    return {name: code for code, name in enumerate(names)}


def channel_rows(catalog: TableCatalog, source: ChannelSource, anchors: DataFrame, first: int = 0) -> DataFrame:
    """Pruned rows (stay, ts, channel, value) of one source, checked against the anchors.

    ``channel`` is a number counted from ``first``: integer keys are cheap to shuffle, group and compare. The
    category filter is a plain IN list on the source column, so it reaches the parquet scan.
    """
    frame = catalog[source.table]
    needed = [STAY] + ([source.category_column] if source.category_column else [])
    require_columns(frame, needed, source.table)
    value = None if source.indicator else value_column(frame, source.table)
    moment = time_column(frame, source.table)
    require_time_column(frame, moment, source.table)
    require_anchors(anchors)
    require_same_time_type(frame, moment, anchors, ANCHOR, source.table)
    require_same_key_type(anchors, frame, STAY, f"anchors and {source.table}")

    rows = frame.where(ref(STAY).isNotNull() & ref(moment).isNotNull())
    if source.categories is None:
        channel = F.lit(first)
    else:
        category = ref(source.category_column)
        rows = rows.where(category.isin(list(source.categories)))
        channel = F.when(category == source.categories[0], first)
        for code, value_of in enumerate(source.categories[1:], first + 1):
            channel = channel.when(category == value_of, code)
    return rows.select(
        STAY,
        ref(moment).alias("ts"),
        channel.alias("channel"),
        (F.lit(None).cast("double") if value is None else as_double(frame, value)).alias("value"),
    )


def in_window(rows: DataFrame, anchors: DataFrame, hours: float, salting: bool | None = None) -> DataFrame:
    """Rows with anchor <= ts < anchor + hours. Anchors hold one row per stay."""
    starts = anchors.select(STAY, ANCHOR).where(ref(ANCHOR).isNotNull())
    inside = (F.col("ts") >= F.col(ANCHOR)) & (F.col("ts") < F.col(ANCHOR) + hours_interval(hours))
    return skew_safe_join(rows, starts, STAY, salting=salting).where(inside)


def anchors_of(anchors: DataFrame, cohort: DataFrame, what: str) -> DataFrame:
    """Anchors of the cohort only, so that events of other stays end at the join."""
    require_columns(cohort, [STAY], "cohort")
    require_same_key_type(cohort, anchors, STAY, what)
    return anchors.join(cohort.select(STAY).distinct(), STAY, "left_semi")


def windowed_stats(
    catalog: TableCatalog,
    table: str,
    prefix: str,
    anchors: DataFrame,
    window_hours: float,
    cohort: DataFrame | None = None,
    max_unparseable_fraction: float = 0.5,
    salting: bool | None = None,
) -> DataFrame:
    """Per stay ``{prefix}_mean/min/max/n`` over the rows inside the window."""
    rows = channel_rows(catalog, ChannelSource(table, prefix), anchors)
    frame = catalog[table]
    require_parseable(frame, value_column(frame, table), table, max_unparseable_fraction)
    wanted = anchors if cohort is None else anchors_of(anchors, cohort, table)
    stats = in_window(rows, wanted, window_hours, salting).groupBy(STAY).agg(*_stat_columns(f"{prefix}_"))
    return stats if cohort is None else _onto_cohort(stats, cohort, [f"{prefix}_n"], table)


def channel_matrix(
    rows: DataFrame,
    sources: Sequence[ChannelSource],
    anchors: DataFrame,
    window_hours: float,
    base: DataFrame,
    salting: bool | None = None,
) -> DataFrame:
    """One row per base stay with four statistics per numeric channel and a 0/1 flag per indicator channel.

    ``rows`` is the union over all sources, numbered as in channel_codes, so every table is read once and one join and one pivot serve
    all blocks. The pivot aggregates per (stay, channel) first and combines map-side.
    """
    codes = channel_codes(sources)
    wide = (
        in_window(rows, anchors_of(anchors, base, "cohort"), window_hours, salting)
        .groupBy(STAY)
        .pivot("channel", list(codes.values()))
        .agg(*_stat_columns())
    )
    numeric = [c for s in sources if not s.indicator for c in s.channels]
    flags = [c for s in sources if s.indicator for c in s.channels]
    picked = [STAY]
    for source in sources:
        for channel in source.channels:
            if source.indicator:
                seen = F.coalesce(ref(f"{codes[channel]}_n"), F.lit(0)) > 0
                picked.append(seen.cast("tinyint").alias(channel))
            else:
                picked += [ref(f"{codes[channel]}_{s}").alias(f"{channel}_{s}") for s in STATS]
    joined = base.select(STAY).join(wide, STAY, "left").select(*picked)
    return joined.fillna(0, [f"{c}_n" for c in numeric] + flags)


def _one_source(
    catalog: TableCatalog,
    source: ChannelSource,
    anchors: DataFrame,
    window_hours: float,
    cohort: DataFrame | None,
    salting: bool | None,
) -> DataFrame:
    """Matrix of a single source over the cohort, or over every anchored stay."""
    if cohort is None:
        base = anchors.select(STAY).distinct()
    else:
        require_columns(cohort, [STAY], "cohort")
        require_same_key_type(cohort, anchors, STAY, source.table)
        base = cohort
    if not source.categories:
        return base.select(STAY)
    return channel_matrix(channel_rows(catalog, source, anchors), [source], anchors, window_hours, base, salting)


def category_stats(
    catalog: TableCatalog,
    table: str,
    category_column: str,
    categories: Sequence[str],
    name_template: str,
    anchors: DataFrame,
    window_hours: float,
    cohort: DataFrame | None = None,
    salting: bool | None = None,
) -> DataFrame:
    """Wide windowed statistics, four columns per requested category whether or not it occurs."""
    source = ChannelSource(table, name_template, category_column, tuple(categories))
    return _one_source(catalog, source, anchors, window_hours, cohort, salting)


def device_flags(
    catalog: TableCatalog,
    devices: Sequence[str],
    anchors: DataFrame,
    window_hours: float,
    cohort: DataFrame | None = None,
    prefix: str = "resp",
    salting: bool | None = None,
) -> DataFrame:
    """``{prefix}_{device}`` = 1 when the device has any row inside the window, else 0; never null."""
    source = ChannelSource("respiratory_support", f"{prefix}_{{category}}", "device_category", tuple(devices), indicator=True)
    return _one_source(catalog, source, anchors, window_hours, cohort, salting)
