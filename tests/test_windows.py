
import pytest
from pyspark.sql import functions as F

from staywise.functions.columns import KeyTypeMismatch, safe_name
from staywise.functions.scale import skew_safe_join
from staywise.operators.windows import (
    admission_anchors,
    category_stats,
    device_flags,
    parse_quality,
    whole_stay_stats,
    windowed_stats,
)
from staywise.plans.matrix import basic_matrix, rich_matrix
from staywise.sources.catalog import TableCatalog

from helpers import at, rows_by

VITALS = "hospitalization_id int, recorded_dttm timestamp, vital_value double"
CATEGORY = "hospitalization_id int, recorded_dttm timestamp, vital_category string, vital_value double"


def anchor_frame(spark, *stays, start=at(0), kind="timestamp"):
    return spark.createDataFrame([(s, start) for s in stays], f"hospitalization_id int, anchor_dttm {kind}")


def test_whole_stay(tables):
    catalog = tables(vitals=("hospitalization_id int, value int", [(1, 10), (1, 20), (2, 30)]))
    found = rows_by(whole_stay_stats(catalog, "vitals", "v"), "hospitalization_id")
    assert found[1] == {"hospitalization_id": 1, "v_mean": 15.0, "v_min": 10.0, "v_max": 20.0, "v_n": 2}
    assert found[2]["v_n"] == 1 and found[2]["v_mean"] == 30.0


def test_numeric_column_beats_text(tables):
    catalog = tables(
        labs=(
            "hospitalization_id int, lab_value string, lab_value_numeric double",
            [(1, "<5", 12.3), (1, "15 mg/dL", 15.1), (2, "5", 5.0)],
        )
    )
    found = rows_by(whole_stay_stats(catalog, "labs", "labs"), "hospitalization_id")
    assert found[1]["labs_mean"] == pytest.approx(13.7) and found[2]["labs_mean"] == 5.0


def test_unparseable_share(tables):
    bad = tables(vitals=("hospitalization_id int, value string", [(1, v) for v in ("120/80", "130/85", "118/78", "125/82")]))
    with pytest.raises(ValueError, match="unparseable"):
        whole_stay_stats(bad, "vitals", "v")
    half = tables(vitals=("hospitalization_id int, value string", [(1, "1"), (1, "<5")]))
    assert whole_stay_stats(half, "vitals", "v").first().v_n == 2  # exactly half is still allowed


@pytest.mark.parametrize(
    ("text", "number"),
    [("12d", None), ("<5", None), ("15 mg/dL", None), ("", None), ("1e3", 1000.0), (" 12 ", 12.0), (".5", 0.5), ("5.", 5.0), ("-3", -3.0)],
)
def test_number_parsing(tables, text, number):
    frame = tables(t=("x string", [(text,)]))["t"]
    assert parse_quality(frame, "x").first().n_numeric == (number is not None)
    from staywise.functions.columns import as_double

    assert frame.select(as_double(frame, "x")).first()[0] == number


def test_n_counts_rows_not_values(tables):
    catalog = tables(vitals=("hospitalization_id int, numeric_value double", [(1, 10.0), (1, 20.0), (1, None), (1, None)]))
    row = whole_stay_stats(catalog, "vitals", "v").first()
    assert row.v_n == 4 and row.v_mean == 15.0


def test_all_null_column_does_not_fail(tables):
    catalog = tables(vitals=("hospitalization_id int, value void", [(1, None), (1, None)]))
    row = whole_stay_stats(catalog, "vitals", "v").first()
    assert row.v_n == 2 and row.v_mean is None


def test_cohort_rows_always_appear(tables, spark):
    catalog = tables(vitals=("hospitalization_id int, value int", [(1, 10), (2, 20)]))
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "hospitalization_id int")
    found = rows_by(whole_stay_stats(catalog, "vitals", "v", cohort), "hospitalization_id")
    assert found[3] == {"hospitalization_id": 3, "v_mean": None, "v_min": None, "v_max": None, "v_n": 0}
    texts = spark.createDataFrame([("1",)], "hospitalization_id string")
    with pytest.raises(KeyTypeMismatch, match="hospitalization_id"):
        whole_stay_stats(catalog, "vitals", "v", texts)


@pytest.mark.parametrize("salting", [False, True])
@pytest.mark.parametrize(
    ("start", "rows", "expected"),
    [
        (at(0), [(1, 10.0), (12, 20.0), (23, 30.0), (25, 999.0)], (20.0, 10.0, 30.0, 3)),
        (at(0), [(0, 10.0), (24, 99.0)], (10.0, 10.0, 10.0, 1)),
        (at(12), [(11, 99.0), (14, 42.0)], (42.0, 42.0, 42.0, 1)),
    ],
)
def test_window_is_half_open(tables, spark, start, rows, expected, salting):
    catalog = tables(vitals=(VITALS, [(1, at(h), v) for h, v in rows]))
    row = windowed_stats(catalog, "vitals", "v", anchor_frame(spark, 1, start=start), 24, salting=salting).first()
    assert tuple(row)[1:] == expected


def test_fractional_window(tables, spark):
    catalog = tables(vitals=(VITALS, [(1, at(0), 1.0), (1, at(1.4), 2.0), (1, at(1.5), 3.0)]))
    assert windowed_stats(catalog, "vitals", "v", anchor_frame(spark, 1), 1.5).first().v_n == 2


def test_window_onto_cohort(tables, spark):
    catalog = tables(vitals=(VITALS, [(1, at(1), 10.0), (2, at(99), 20.0), (3, at(2), 30.0)]))
    cohort = spark.createDataFrame([(1,), (2,)], "hospitalization_id int")
    found = rows_by(windowed_stats(catalog, "vitals", "v", anchor_frame(spark, 1, 2, 3), 24, cohort), "hospitalization_id")
    assert set(found) == {1, 2}
    assert found[1]["v_n"] == 1 and found[1]["v_mean"] == 10.0
    assert found[2]["v_n"] == 0 and found[2]["v_mean"] is None


def test_window_type_guards(tables, spark):
    catalog = tables(vitals=(VITALS, []), plain=("hospitalization_id int, value double", []))
    with pytest.raises(ValueError, match="time zone"):
        windowed_stats(catalog, "vitals", "v", anchor_frame(spark, 1, kind="timestamp_ntz"), 24)
    with pytest.raises(ValueError, match="no timestamp column"):
        windowed_stats(catalog, "plain", "v", anchor_frame(spark, 1), 24)
    text = tables(vitals=("hospitalization_id int, recorded_dttm string, value double", []))
    with pytest.raises(ValueError, match="must be a timestamp"):
        windowed_stats(text, "vitals", "v", anchor_frame(spark, 1), 24)
    with pytest.raises(ValueError, match="anchor_dttm"):
        windowed_stats(catalog, "vitals", "v", spark.createDataFrame([(1,)], "hospitalization_id int"), 24)
    with pytest.raises(KeyTypeMismatch):
        other = spark.createDataFrame([("1", at(0))], "hospitalization_id string, anchor_dttm timestamp")
        windowed_stats(catalog, "vitals", "v", other, 24)


def test_anchors_are_unique(tables):
    catalog = tables(
        hospitalization=("hospitalization_id int, admission_dttm timestamp", [(1, at(5)), (1, at(3)), (2, at(1))])
    )
    anchors = admission_anchors(catalog)
    assert anchors.columns == ["hospitalization_id", "anchor_dttm"]
    assert rows_by(anchors, "hospitalization_id")[1]["anchor_dttm"] == at(3)
    with pytest.raises(ValueError, match="admission_dttm"):
        admission_anchors(tables(hospitalization=("hospitalization_id int", [(1,)])))


def test_category_stats(tables, spark):
    rows = [(1, at(1), "heart_rate", 80.0), (1, at(2), "heart_rate", 90.0), (1, at(1), "sbp", 120.0),
            (1, at(2), "sbp", 130.0), (1, at(3), "spo2", 98.0), (1, at(3), "SPO2", 1.0), (1, at(30), "sbp", 1.0)]
    catalog = tables(vitals=(CATEGORY, rows))
    wide = category_stats(
        catalog, "vitals", "vital_category", ["heart_rate", "sbp", "spo2", "lactate"], "vitals_{category}",
        anchor_frame(spark, 1, 2), 24,
    )
    assert len(wide.columns) == 1 + 4 * 4
    row = rows_by(wide, "hospitalization_id")[1]
    assert [row[f"vitals_{c}_mean"] for c in ("heart_rate", "sbp", "spo2", "lactate")] == [85.0, 125.0, 98.0, None]
    assert [row[f"vitals_{c}_n"] for c in ("heart_rate", "sbp", "spo2", "lactate")] == [2, 2, 1, 0]
    assert rows_by(wide, "hospitalization_id")[2]["vitals_sbp_n"] == 0
    with pytest.raises(ValueError, match="collide"):
        category_stats(catalog, "vitals", "vital_category", ["a b", "a-b"], "{category}", anchor_frame(spark, 1), 24)


def test_safe_names():
    assert [safe_name(x) for x in ("High Flow NC", "Nasal-Cannula", "a/B")] == ["high_flow_nc", "nasal_cannula", "a_b"]


def test_device_flags(tables, spark):
    schema = "hospitalization_id int, recorded_dttm timestamp, device_category string"
    catalog = tables(respiratory_support=(schema, [(1, at(1), "IMV"), (1, at(2), "Nasal Cannula"), (2, at(3), "Nasal Cannula"), (3, at(48), "IMV")]))
    flags = device_flags(catalog, ["IMV", "Nasal Cannula", "CPAP"], anchor_frame(spark, 1, 2, 3), 24)
    found = {r[0]: tuple(r)[1:] for r in flags.collect()}
    assert flags.columns[1:] == ["resp_imv", "resp_nasal_cannula", "resp_cpap"]
    assert found == {1: (1, 1, 0), 2: (0, 1, 0), 3: (0, 0, 0)}


def test_hot_stay_is_sliced_without_changing_results(spark):
    """One stay holds a third of the rows, half of them exact copies."""
    rows = spark.range(0, 60000, 1, 8).selectExpr(
        "IF(id < 20000, 7, id % 500) AS hospitalization_id",
        "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, IF(id < 10000, 60, id % 200000)) AS ts",
        "CAST(IF(id < 10000, 5, id % 97) AS double) AS value",
    )
    anchors = spark.range(600).selectExpr("id AS hospitalization_id", "timestamp'2024-01-01' AS anchor_dttm")
    plain = skew_safe_join(rows, anchors, "hospitalization_id", salting=False)
    salted = skew_safe_join(rows, anchors, "hospitalization_id", salting=True, hot_share=0.01)
    assert salted.columns == plain.columns
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0
    left = skew_safe_join(rows, anchors.where("hospitalization_id > 250"), "hospitalization_id", "left", True, 0.01)
    assert left.count() == 60000
    assert left.where("anchor_dttm is null and hospitalization_id = 7").count() == plain.where("hospitalization_id = 7").count()


def test_hot_stay_is_spread_over_partitions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(0, 30000, 1, 8).selectExpr("IF(id < 10000, 7, id) AS hospitalization_id", "id AS value")
        anchors = spark.range(30000).selectExpr("id AS hospitalization_id", "1 AS x")
        joined = skew_safe_join(rows, anchors, "hospitalization_id", salting=True, hot_share=0.01)
        sizes = joined.where("hospitalization_id = 7").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 10000
        assert max(r["count"] for r in sizes) < 4000
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_events_are_read_once_and_a_hot_stay_is_split_at_run_time(spark, tmp_path):
    """No counting pass: one scan of the events in the plan, and the partition of the hot stay read in parts."""
    adaptive = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.shuffle.partitions": "16",
    }
    spark.range(0, 60_000, 1, 8).selectExpr(
        "CAST(IF(id < 20000, 7, id % 500) AS int) AS hospitalization_id", "timestamp'2024-01-01 01:00:00' AS recorded_dttm", "rand(1) AS vital_value",
        "uuid() AS other",
    ).write.parquet(str(tmp_path / "vitals.parquet"))
    catalog = TableCatalog.discover(spark, str(tmp_path))
    anchors = spark.range(600).selectExpr("CAST(id AS int) AS hospitalization_id", "timestamp'2024-01-01' AS anchor_dttm")
    for key, value in adaptive.items():
        spark.conf.set(key, value)
    try:
        stats = windowed_stats(catalog, "vitals", "vitals", anchors, 24)
        found = {r.hospitalization_id: r for r in stats.collect()}
        plan = stats._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in adaptive:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "skew=true" in final
    assert found[7].vitals_n == 20_000 + 80 and sum(r.vitals_n for r in found.values()) == 60_000


def matrix_tables(tables, **extra):
    return tables(vitals=(CATEGORY, [(1, at(1), "sbp", 120.0)]), **extra)


def test_basic_matrix_and_missing_table(tables, spark):
    labs = ("hospitalization_id int, lab_result_dttm timestamp, value double", [(1, at(2), 4.0)])
    anchors, cohort = anchor_frame(spark, 1, 2), spark.createDataFrame([(1,), (2,)], "hospitalization_id int")
    both = basic_matrix(matrix_tables(tables, labs=labs), cohort, anchors, 24)
    assert len(both.features) == 8 and both.warnings == ()
    assert both.frame.count() == 2
    alone = basic_matrix(matrix_tables(tables), cohort, anchors, 24)
    assert alone.features == ("vitals_mean", "vitals_min", "vitals_max", "vitals_n") and "labs" in alone.warnings[0]
    none = basic_matrix(tables(other=("a int", [])), cohort, anchors, 24)
    assert none.frame is None and len(none.warnings) == 2
    broken = tables(vitals=("hospitalization_id int, recorded_dttm timestamp", []))
    with pytest.raises(ValueError):
        basic_matrix(broken, cohort, anchors, 24)


def test_rich_matrix_warns_on_unfit_table_but_not_on_key_types(tables, spark):
    anchors, cohort = anchor_frame(spark, 1), spark.createDataFrame([(1,)], "hospitalization_id int")
    devices = ("hospitalization_id int, recorded_dttm timestamp, device_category string", [(1, at(1), "IMV")])
    assess = ("hospitalization_id int, recorded_dttm timestamp, assessment_category string, numerical_value double", [(1, at(1), "RASS", -2.0)])
    labs = ("hospitalization_id int, lab_collect_dttm timestamp, lab_category string, lab_value_numeric double", [(1, at(1), "sodium", 140.0)])
    whole = rich_matrix(
        matrix_tables(tables, labs=labs, patient_assessments=assess, respiratory_support=devices), cohort, anchors, 24
    )
    assert len(whole.features) == 89 and whole.warnings == ()
    row = whole.frame.first()
    assert row.labs_sodium_mean == 140.0 and row.assess_rass_mean == -2.0 and row.resp_imv == 1 and row.resp_cpap == 0
    unfit = matrix_tables(tables, labs=("hospitalization_id int, lab_category string", []))
    partial = rich_matrix(unfit, cohort, anchors, 24)
    assert len(partial.features) == 28 and len(partial.warnings) == 3
    with pytest.raises(KeyTypeMismatch):
        rich_matrix(
            matrix_tables(tables, labs=("hospitalization_id string, lab_collect_dttm timestamp, lab_category string, lab_value_numeric double", [])),
            cohort, anchors, 24,
        )


def test_plan_prunes_columns_and_pushes_filters(spark, tmp_path):
    wide = spark.createDataFrame(
        [(1, at(1), "sbp", 120.0, "site", "x")],
        "hospitalization_id int, recorded_dttm timestamp, vital_category string, vital_value double, meas_site_name string, other string",
    )
    wide.write.parquet(str(tmp_path / "vitals.parquet"))
    catalog = TableCatalog.discover(spark, str(tmp_path))
    frame = category_stats(catalog, "vitals", "vital_category", ["sbp"], "vitals_{category}", anchor_frame(spark, 1), 24)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "meas_site_name" not in scan and "other" not in scan
    pushed = scan.split("PushedFilters")[1]
    assert "EqualTo(vita" in pushed and "IsNotNull(recorded_dttm)" in pushed
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_categories_leaves_the_base(tables, spark):
    catalog = tables(vitals=(CATEGORY, [(1, at(1), "sbp", 120.0)]))
    empty = category_stats(catalog, "vitals", "vital_category", [], "vitals_{category}", anchor_frame(spark, 1, 2), 24)
    assert empty.columns == ["hospitalization_id"] and empty.count() == 2
