"""Hourly sequences per stay: means and flags per hour, dense grid, forward fill, observation mask."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.columns import ref, require_columns, require_same_key_type
from staywise.functions.vocab import (
    ANCHOR,
    ASSESSMENT_CATEGORIES,
    LAB_CATEGORIES,
    RESPIRATORY_DEVICES,
    STAY,
    VITAL_CATEGORIES,
)
from staywise.operators.windows import (
    ChannelSource,
    channel_codes,
    channel_rows,
    in_window,
    require_anchors,
)
from staywise.sources.catalog import TableCatalog

HOUR = "hour"


def rich_sources(
    vitals: Sequence[str] = VITAL_CATEGORIES,
    labs: Sequence[str] = LAB_CATEGORIES,
    assessments: Sequence[str] = ASSESSMENT_CATEGORIES,
    devices: Sequence[str] = RESPIRATORY_DEVICES,
) -> list[ChannelSource]:
    """Channel blocks in their fixed order: vitals, labs, assessments, device indicators."""
    return [
        ChannelSource("vitals", "vitals_{category}", "vital_category", tuple(vitals)),
        ChannelSource("labs", "labs_{category}", "lab_category", tuple(labs)),
        ChannelSource("patient_assessments", "assess_{category}", "assessment_category", tuple(assessments)),
        ChannelSource("respiratory_support", "resp_{category}", "device_category", tuple(devices), indicator=True),
    ]


def _hourly(rows: DataFrame, anchors: DataFrame, window_hours: int, salting: bool | None) -> DataFrame:
    """In-window rows with their whole-hour offset from the anchor."""
    offset = F.expr(f"timestampdiff(SECOND, `{ANCHOR}`, ts) div 3600").cast("int")
    return in_window(rows, anchors, window_hours, salting).withColumn(HOUR, offset)


def _category_rows(catalog: TableCatalog, source: ChannelSource, anchors: DataFrame, cohort: DataFrame | None):
    if cohort is not None:
        anchors = anchors.join(cohort.select(STAY), STAY, "left_semi")
    return channel_rows(catalog, source, anchors), anchors


def _category_of(source: ChannelSource):
    """The category a channel number stands for."""
    return F.element_at(F.array(*[F.lit(c) for c in source.categories]), F.col("channel") + 1).alias("category")


def hourly_means(
    catalog: TableCatalog,
    table: str,
    category_column: str,
    categories: Sequence[str],
    anchors: DataFrame,
    window_hours: int,
    cohort: DataFrame | None = None,
    salting: bool | None = None,
) -> DataFrame:
    """Long form (stay, hour, category, value, observed): mean per cell that has at least one row.

    ``observed`` is 1 even when all values of the cell are null.
    """
    source = ChannelSource(table, "{category}", category_column, tuple(categories))
    rows, starts = _category_rows(catalog, source, anchors, cohort)
    return (
        _hourly(rows, starts, window_hours, salting)
        .groupBy(STAY, HOUR, "channel")
        .agg(F.avg("value").alias("value"), F.lit(1).cast("tinyint").alias("observed"))
        .select(STAY, HOUR, _category_of(source), "value", "observed")
    )


def hourly_indicator(
    catalog: TableCatalog,
    table: str,
    category_column: str,
    categories: Sequence[str],
    anchors: DataFrame,
    window_hours: int,
    cohort: DataFrame | None = None,
    salting: bool | None = None,
) -> DataFrame:
    """Long form (stay, hour, category, value): 1.0 per cell with any row."""
    source = ChannelSource(table, "{category}", category_column, tuple(categories), indicator=True)
    rows, starts = _category_rows(catalog, source, anchors, cohort)
    return (
        _hourly(rows, starts, window_hours, salting)
        .groupBy(STAY, HOUR, "channel")
        .agg(F.lit(1.0).alias("value"))
        .select(STAY, HOUR, _category_of(source), "value")
    )


@dataclass(frozen=True)
class SequenceFrame:
    """Dense hourly channels.

    ``packed`` has one row per stay: one array of ``window_hours`` doubles per channel, filled, and an array
    ``mask_<channel>`` (0/1, observed in that very hour) per numeric channel.
    """

    packed: DataFrame
    channels: tuple[str, ...]
    numeric_channels: tuple[str, ...]
    window_hours: int

    @property
    def _hours(self):
        return F.sequence(F.lit(0), F.lit(self.window_hours - 1))

    @property
    def grid(self) -> DataFrame:
        """One row per (stay, hour) with a column per channel and per mask, unrolled from the arrays in place."""
        names = [*self.channels, *[f"mask_{c}" for c in self.numeric_channels]]
        return self.packed.select(STAY, F.inline(F.arrays_zip(self._hours.alias(HOUR), *[ref(n) for n in names]))).toDF(STAY, HOUR, *names)

    def arrays(self) -> DataFrame:
        """(stay, hour, features array<float>, mask array<tinyint>)."""
        return self.grid.select(
            STAY,
            HOUR,
            F.array(*[ref(c) for c in self.channels]).cast("array<float>").alias("features"),
            F.array(*[ref(f"mask_{c}") for c in self.numeric_channels]).cast("array<tinyint>").alias("mask"),
        )

    def _by_hour(self, names: Sequence[str], kind: str):
        """The arrays of a stay turned round: for each hour one array over the channels."""
        held = F.array(F.array(*[ref(n) for n in names]).cast(f"array<array<{kind}>>"))
        turned = lambda every: F.transform(self._hours, lambda h: F.transform(every, lambda own: F.get(own, h)))
        return F.get(F.transform(held, turned), F.lit(0))

    def per_stay(self) -> DataFrame:
        """One row per stay with hour-major nested arrays. A stay holds exactly ``window_hours`` entries."""
        masks = [f"mask_{c}" for c in self.numeric_channels]
        return self.packed.select(
            STAY, self._by_hour(self.channels, "float").alias("features"), self._by_hour(masks, "tinyint").alias("mask")
        )


def _runs(entries, window_hours: int, before, value, after):
    """A dense array made of runs: ``before`` until the first entry, then from each entry's hour to the next one's
    its ``value`` followed by ``after`` in every further hour. Entries rise by hour; linear in the window."""

    def fill(known):
        stop = lambda i: F.coalesce(F.get(known, i + 1).getField(HOUR), F.lit(window_hours))
        run = lambda x, i: F.concat(F.array(value(x)), F.array_repeat(after(x), stop(i) - x.getField(HOUR) - 1))
        first = F.coalesce(F.get(known, F.lit(0)).getField(HOUR), F.lit(window_hours))
        return F.concat(F.array_repeat(before, first), F.flatten(F.transform(known, run)))

    # As the only element of an array the entries are made once, however often they are named.
    return F.get(F.transform(F.array(entries), fill), F.lit(0))


def build_sequences(
    catalog: TableCatalog,
    cohort: DataFrame,
    anchors: DataFrame,
    window_hours: int = 24,
    sources: Sequence[ChannelSource] | None = None,
    validate: bool = True,
    salting: bool | None = None,
) -> SequenceFrame:
    """Hourly grid over [anchor, anchor + window_hours) for every cohort stay that has an anchor.

    Numeric channels carry the last hourly mean forward, never backward; hours before the first value are
    0.0. Indicator channels are 1.0 only in hours with a row. A missing table leaves its channels at 0.
    All tables are read once and share one join and one aggregation; only the (stay, hour) cells move on.
    """
    if window_hours <= 0 or window_hours != int(window_hours):
        raise ValueError(f"window_hours must be a positive whole number, got {window_hours}")
    require_columns(cohort, [STAY], "cohort")
    require_anchors(anchors)
    require_same_key_type(cohort, anchors, STAY, "cohort and anchors")
    sources = list(rich_sources() if sources is None else sources)
    numeric = [c for s in sources if not s.indicator for c in s.channels]
    flags = [c for s in sources if s.indicator for c in s.channels]
    codes = channel_codes(sources)

    starts = anchors.where(ref(ANCHOR).isNotNull()).join(cohort.select(STAY).distinct(), STAY, "left_semi")
    if validate and starts.isEmpty():
        raise ValueError("no cohort stay has an anchor: the cohort is empty or does not match the anchors")

    present = [s for s in sources if s.categories and s.table in catalog]
    stays = starts.select(STAY)
    if present:
        rows = reduce(DataFrame.unionByName, [channel_rows(catalog, s, starts, codes[s.channels[0]]) for s in present])
        is_channel = {name: F.col("channel") == code for name, code in codes.items()}
        cells = (
            _hourly(rows, starts, window_hours, salting)
            .groupBy(STAY, HOUR)
            .agg(
                *[F.avg(F.when(is_channel[c], F.col("value"))).alias(f"v_{c}") for c in numeric],
                *[F.max(F.when(is_channel[c], 1)).alias(f"s_{c}") for c in numeric + flags],
            )
        )
        # At most window_hours cells per stay, in order. From here on a stay is one row: nothing is sorted, spread
        # or grouped again.
        order = F.struct(F.col(HOUR).cast("int").alias(HOUR), *[c for c in cells.columns if c not in (STAY, HOUR)])
        ordered = cells.groupBy(STAY).agg(F.array_sort(F.collect_list(order)).alias("cells"))
        stays = stays.join(ordered, STAY, "left")
    else:
        fields = [(HOUR, "int"), *[(f"v_{c}", "double") for c in numeric], *[(f"s_{c}", "int") for c in numeric + flags]]
        kind = ", ".join(f"`{name}`: {type_}" for name, type_ in fields)
        stays = stays.select(STAY, F.lit(None).cast(f"array<struct<{kind}>>").alias("cells"))
    hours = int(window_hours)
    cells = F.coalesce("cells", F.array().cast(stays.schema["cells"].dataType))

    def carried(channel: str):
        """The last known hourly mean; hours before the first are 0."""
        name, zero = f"v_{channel}", F.lit(0.0)
        known = F.filter(cells, lambda c: c.getField(name).isNotNull() & ~F.isnan(c.getField(name)))
        return _runs(known, hours, zero, lambda c: c.getField(name), lambda c: c.getField(name))

    def seen(channel: str, kind: str):
        """1 in the hours that have a row."""
        zero, one = F.lit(0).cast(kind), F.lit(1).cast(kind)
        return _runs(F.filter(cells, lambda c: c.getField(f"s_{channel}") == 1), hours, zero, lambda c: one, lambda c: zero)

    packed = stays.select(
        STAY,
        *[carried(c).alias(c) for c in numeric],
        *[seen(c, "double").alias(c) for c in flags],
        *[seen(c, "tinyint").alias(f"mask_{c}") for c in numeric],
    )
    return SequenceFrame(packed, tuple(numeric + flags), tuple(numeric), hours)
