import pytest

from staywise.functions.columns import KeyTypeMismatch
from staywise.operators.sequences import build_sequences, hourly_indicator, hourly_means, rich_sources

from helpers import at, rows_by

VITALS = "hospitalization_id int, recorded_dttm timestamp, vital_category string, vital_value double"
LABS = "hospitalization_id int, lab_collect_dttm timestamp, lab_category string, lab_value_numeric double"
DEVICES = "hospitalization_id int, recorded_dttm timestamp, device_category string"


def cohort_of(spark, *stays):
    return spark.createDataFrame([(s,) for s in stays], "hospitalization_id int")


def anchors_of(spark, *stays):
    return spark.createDataFrame([(s, at(0)) for s in stays], "hospitalization_id int, anchor_dttm timestamp")


def build(tables, spark, stays=(1,), hours=24, **given):
    return build_sequences(tables(**given), cohort_of(spark, *stays), anchors_of(spark, *stays), hours)


def series(built, stay, channel):
    cells = rows_by(built.grid.where(f"hospitalization_id = {stay}"), "hour")
    return [cells[h][channel] for h in sorted(cells)]


def test_shapes_and_forward_fill(tables, spark):
    built = build(
        tables, spark, (1, 2),
        vitals=(VITALS, [(1, at(1), "heart_rate", 80.0), (1, at(5), "heart_rate", 90.0), (2, at(0), "sbp", 120.0)]),
        labs=(LABS, [(1, at(3), "sodium", 140.0)]),
    )
    assert len(built.channels) == 26 and len(built.numeric_channels) == 21
    assert built.channels[:21] == built.numeric_channels
    assert built.channels[0] == "vitals_heart_rate" and built.channels[-1] == "resp_cpap"
    assert series(built, 1, "vitals_heart_rate") == [0.0] + [80.0] * 4 + [90.0] * 19
    assert series(built, 1, "mask_vitals_heart_rate") == [int(h in (1, 5)) for h in range(24)]
    assert series(built, 1, "labs_sodium") == [0.0] * 3 + [140.0] * 21
    assert series(built, 2, "vitals_sbp") == [120.0] * 24
    nested = rows_by(built.per_stay(), "hospitalization_id")
    assert len(nested[1]["features"]) == 24 and len(nested[1]["features"][0]) == 26
    assert len(nested[1]["mask"][0]) == 21
    assert nested[1]["features"][4][0] == 80.0 and nested[1]["mask"][5][0] == 1
    kinds = {f.name: f.dataType.simpleString() for f in built.per_stay().schema}
    assert kinds["features"] == "array<array<float>>" and kinds["mask"] == "array<array<tinyint>>"


def test_window_end_is_excluded(tables, spark):
    built = build(tables, spark, vitals=(VITALS, [(1, at(0), "sbp", 80.0), (1, at(24), "sbp", 9999.0)]))
    assert series(built, 1, "vitals_sbp") == [80.0] * 24
    assert series(built, 1, "mask_vitals_sbp") == [1] + [0] * 23


def test_leading_gap_is_zero_and_hours_are_averaged(tables, spark):
    built = build(tables, spark, vitals=(VITALS, [(1, at(10), "sbp", 80.0), (1, at(10.5), "sbp", 90.0)]))
    assert series(built, 1, "vitals_sbp") == [0.0] * 10 + [85.0] * 14


def test_flags_are_not_carried(tables, spark):
    built = build(tables, spark, respiratory_support=(DEVICES, [(1, at(2), "IMV"), (1, at(5), "IMV")]))
    assert series(built, 1, "resp_imv") == [float(h in (2, 5)) for h in range(24)]
    assert "mask_resp_imv" not in built.grid.columns
    assert series(built, 1, "vitals_sbp") == [0.0] * 24  # missing table


def test_null_and_nan_rows_set_the_mask_but_not_the_value(tables, spark):
    rows = [(1, at(0), "sbp", 100.0), (1, at(2), "sbp", None), (1, at(4), "sbp", float("nan")), (1, at(6), "sbp", 50.0)]
    built = build(tables, spark, hours=8, vitals=(VITALS, rows))
    assert series(built, 1, "vitals_sbp") == [100.0] * 6 + [50.0] * 2
    assert series(built, 1, "mask_vitals_sbp") == [1, 0, 1, 0, 1, 0, 1, 0]


def test_no_tables_at_all(tables, spark):
    built = build(tables, spark, hours=3, other=("a int", []))
    assert built.grid.count() == 3 and series(built, 1, "resp_imv") == [0.0] * 3


def test_guards(tables, spark):
    catalog = tables(vitals=(VITALS, []))
    with pytest.raises(ValueError, match="window_hours"):
        build_sequences(catalog, cohort_of(spark, 1), anchors_of(spark, 1), 0)
    with pytest.raises(ValueError, match="empty"):
        build_sequences(catalog, cohort_of(spark, 1).limit(0), anchors_of(spark, 1))
    with pytest.raises(ValueError, match="does not match"):
        build_sequences(catalog, cohort_of(spark, 1), anchors_of(spark, 2))
    with pytest.raises(KeyTypeMismatch):
        build_sequences(catalog, spark.createDataFrame([("1",)], "hospitalization_id string"), anchors_of(spark, 1))
    with pytest.raises(ValueError, match="missing columns"):
        build_sequences(catalog, spark.createDataFrame([(1,)], "x int"), anchors_of(spark, 1))


def test_long_forms(tables, spark):
    catalog = tables(
        vitals=(VITALS, [(1, at(0), "sbp", 1.0), (1, at(0.5), "sbp", 3.0), (1, at(1), "sbp", None), (2, at(0), "sbp", 9.0)]),
        respiratory_support=(DEVICES, [(1, at(2), "High Flow NC"), (1, at(2.2), "High Flow NC"), (1, at(3), "Other")]),
    )
    means = hourly_means(catalog, "vitals", "vital_category", ["sbp"], anchors_of(spark, 1, 2), 24, cohort_of(spark, 1))
    assert sorted(tuple(r) for r in means.collect()) == [(1, 0, "sbp", 2.0, 1), (1, 1, "sbp", None, 1)]
    flags = hourly_indicator(catalog, "respiratory_support", "device_category", ["High Flow NC"], anchors_of(spark, 1), 24)
    assert [tuple(r) for r in flags.collect()] == [(1, 2, "High Flow NC", 1.0)]


def test_salted_grid_equals_plain(tables, spark):
    rows = [(1 + i % 3 * (i % 2), at(i % 24), ("sbp", "map")[i % 2], float(i)) for i in range(300)]
    catalog = tables(vitals=(VITALS, rows))
    sources = rich_sources(("sbp", "map"), (), (), ())
    grids = [
        build_sequences(catalog, cohort_of(spark, 1, 2, 3), anchors_of(spark, 1, 2, 3), 24, sources, salting=s).grid
        for s in (False, True)
    ]
    assert grids[0].exceptAll(grids[1]).count() == 0 and grids[0].count() == 72
