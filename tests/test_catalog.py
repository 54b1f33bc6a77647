import pytest

from staywise.functions.vocab import OPTIONAL_CONTRACTS
from staywise.operators.contracts import check_contracts, contract_report
from staywise.operators.qc import missingness, null_counts, qc_report
from staywise.sources.catalog import TableCatalog, table_key
from staywise.sources.predictions import read_predictions

from helpers import rows_by


@pytest.mark.parametrize(
    ("file", "key"),
    [
        ("clif2_patient.parquet", "patient"),
        ("mimic_clif_hospitalization.parquet", "hospitalization"),
        ("rush_clif_adt.parquet", "adt"),
        ("HOSPITALIZATION.parquet", "hospitalization"),
        ("clif_vitals.parq", "vitals"),
        ("/some/dir/clif_labs.parquet/", "labs"),
    ],
)
def test_table_key(file, key):
    assert table_key(file) == key


def test_discovery_reads_lazily_and_ignores_case(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "clif_vitals.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "Labs.parquet"))
    catalog = TableCatalog.discover(spark, str(tmp_path))
    assert list(catalog) == ["labs", "vitals"]
    assert catalog["VITALS"].count() == 5
    assert catalog.read("vitals", 2).count() == 2
    assert "Labs" in catalog and "adt" not in catalog
    with pytest.raises(KeyError, match="labs, vitals"):
        catalog["adt"]
    inventory = rows_by(catalog.inventory(), "table")
    assert inventory["labs"]["n_columns"] == 1 and inventory["labs"]["path"].endswith("Labs.parquet")


def test_discovery_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="does not exist"):
        TableCatalog.discover(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError, match="no parquet"):
        TableCatalog.discover(spark, str(tmp_path))
    spark.range(1).write.parquet(str(tmp_path / "patient.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "clif_patient.parquet"))
    with pytest.raises(ValueError, match="Duplicate table name"):
        TableCatalog.discover(spark, str(tmp_path))


def test_contracts(tables):
    catalog = tables(
        patient=("patient_id string", [("1",)]),
        hospitalization=("patient_id string, hospitalization_id string", [("1", "2")]),
        adt=("hospitalization_id string, location_category string", [("2", "ICU")]),
    )
    assert all(c.ok for c in check_contracts(catalog))
    assert all(c.ok for c in check_contracts(catalog, {}))  # nothing given means the core set
    report = rows_by(contract_report(catalog, {"adt": {"z", "hospitalization_id"}, **OPTIONAL_CONTRACTS}), "table")
    assert report["adt"]["missing_columns"] == "z" and not report["adt"]["ok"]
    assert report["adt"]["required_columns"] == "hospitalization_id,z"
    assert report["vitals"]["present"] is False
    assert report["vitals"]["missing_columns"] == "hospitalization_id"
    assert report["vitals"]["n_observed_columns"] == 0


def test_qc_counts_nulls_not_nan(tables):
    catalog = tables(
        patient=("patient_id int, x string, y double, z void", [(1, None, float("nan"), None), (2, "ok", 1.0, None)]),
        empty=("a int", []),
    )
    report = rows_by(qc_report(catalog), "table")
    assert report["patient"]["n_rows"] == 2 and report["empty"]["n_rows"] == 0
    assert report["patient"]["missing_first_columns"] == {"patient_id": 0, "x": 1, "y": 0, "z": 2}
    assert report["patient"]["missing_truncated"] is False
    short = rows_by(qc_report(catalog, max_columns=1), "table")["patient"]
    assert short["missing_truncated"] is True and short["missing_inspected"] == 1
    assert short["missing_first_columns"] == {"patient_id": 0}
    shown = rows_by(missingness(qc_report(catalog)), "column")
    assert {k: v["pct_null"] for k, v in shown.items()} == {"x": 50.0, "z": 100.0}
    assert null_counts(qc_report(catalog)).count() == 5


def test_prediction_reader(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.5), (0, 0.25)], "y int, p double")
    frame.coalesce(1).write.csv(str(tmp_path / "p.csv"), header=True)
    frame.write.parquet(str(tmp_path / "p.parquet"))
    for name in ("p.csv", "p.parquet"):
        read = read_predictions(spark, str(tmp_path / name))
        assert read.agg({"p": "sum"}).first()[0] == 0.75
    with pytest.raises(ValueError, match="unsupported"):
        read_predictions(spark, "p.xlsx")


def test_files_written_by_other_tools(spark, tmp_path):
    """Null-typed columns, zoned and zone-less timestamps as other parquet writers produce them."""
    from datetime import UTC, datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(
        pa.table(
            {
                "hospitalization_id": ["a", "b"],
                "lab_collect_dttm": pa.array([datetime(2024, 1, 1, tzinfo=UTC)] * 2, pa.timestamp("us", "UTC")),
                "birth_date": pa.array([datetime(2024, 1, 1)] * 2, pa.timestamp("us")),
                "lab_order_name": pa.nulls(2),
                "lab_value_numeric": [1.0, None],
            }
        ),
        tmp_path / "clif_labs.parquet",
    )
    catalog = TableCatalog.discover(spark, str(tmp_path))
    types = {f.name: f.dataType.simpleString() for f in catalog["labs"].schema}
    assert types["lab_collect_dttm"] == "timestamp" and types["birth_date"] == "timestamp_ntz"
    report = qc_report(catalog).first()
    assert report.missing_first_columns["lab_order_name"] == 2 and report.missing_first_columns["lab_value_numeric"] == 1
