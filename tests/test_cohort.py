import pytest

from staywise.functions.columns import KeyTypeMismatch
from staywise.operators.cohort import CohortSpec, adult_icu_cohort, cohort_with_waterfall, waterfall_steps

STAYS = "patient_id int, hospitalization_id int"
MOVES = "hospitalization_id int, location_category string"


def ids(frame):
    return sorted(r.hospitalization_id for r in frame.collect())


def test_age_and_location_filters(tables):
    catalog = tables(
        patient=("patient_id int, age int", [(1, 17), (2, 55)]),
        hospitalization=(STAYS, [(1, 10), (2, 20)]),
        adt=(MOVES, [(10, "ICU"), (20, "Medical ICU")]),
    )
    cohort = adult_icu_cohort(catalog)
    assert ids(cohort) == [20] and cohort.columns == ["patient_id", "hospitalization_id", "age"]


def test_repeated_patients_do_not_multiply_stays(tables):
    catalog = tables(
        patient=("patient_id int, age int", [(1, 55), (1, 56), (2, 60)]),
        hospitalization=(STAYS, [(1, 10), (2, 20)]),
    )
    cohort = adult_icu_cohort(catalog, CohortSpec(require_icu_location=False))
    assert sorted(cohort.collect()) == [(1, 10, 55), (2, 20, 60)]


def test_waterfall(tables):
    catalog = tables(
        patient=("patient_id int", [(1,), (2,), (3,), (4,)]),
        hospitalization=(STAYS + ", age_at_admission int", [(1, 1, 10), (2, 2, 25), (3, 3, 50), (4, 4, 80)]),
        adt=(MOVES, [(1, "Floor"), (2, "ICU"), (3, "ICU"), (3, "ICU"), (4, "Ward")]),
    )
    cohort, waterfall = cohort_with_waterfall(catalog)
    assert ids(cohort) == [2, 3] and "age_at_admission" in cohort.columns
    row = waterfall.first().asDict()
    assert list(row.values()) == [4, 3, 2, 2, "age_at_admission", "location_category", True]
    steps = [r.n for r in waterfall_steps(waterfall).orderBy("step_no").collect()]
    assert steps == [4, 3, 2, 2]


def test_skipped_filters_are_labelled(tables):
    catalog = tables(
        patient=("patient_id int", [(1,), (2,)]), hospitalization=(STAYS, [(1, 10), (2, 20), (2, None)])
    )
    cohort, waterfall = cohort_with_waterfall(catalog)
    row = waterfall.first()
    # The null stay id counts as one value.
    assert (row.total_hospitalizations, row.after_age_filter, row.after_icu_filter, row.final) == (3, 3, 3, 3)
    assert row.age_col_used is None and row.icu_location_col_used is None and row.icu_filter_applied is False
    shown = [r.step for r in waterfall_steps(waterfall).orderBy("step_no").collect()]
    assert "SKIPPED" in shown[1] and "SKIPPED" in shown[2]
    off = [r.step for r in waterfall_steps(waterfall, CohortSpec(require_icu_location=False)).orderBy("step_no").collect()]
    assert "disabled" in off[2]
    assert cohort.columns == ["patient_id", "hospitalization_id"]


def test_null_age_is_dropped_and_stay_copy_wins(tables):
    catalog = tables(
        patient=("patient_id int, age int", [(1, 99), (2, 99)]),
        hospitalization=(STAYS + ", age int", [(1, 10, None), (2, 20, 30)]),
    )
    assert sorted(adult_icu_cohort(catalog).collect()) == [(2, 20, 30)]


def test_mismatched_key_types_are_refused(tables):
    catalog = tables(
        patient=("patient_id string, age int", [("1", 50)]), hospitalization=(STAYS, [(1, 10)])
    )
    with pytest.raises(KeyTypeMismatch, match="patient_id"):
        adult_icu_cohort(catalog)


def test_hot_patient_and_hot_stay(spark):
    """One patient owns a third of the stays and has many rows; one stay has a third of the moves."""
    from staywise.sources.catalog import TableCatalog

    stays = spark.range(3000).selectExpr("if(id < 1000, 0, id) AS patient_id", "id AS hospitalization_id")
    patients = spark.range(6000).selectExpr("if(id < 3000, 0, id - 3000) AS patient_id", "20 + id % 50 AS age")
    moves = spark.range(3000).selectExpr(
        "if(id < 1000, 5, id) AS hospitalization_id", "if(id % 2 = 0, 'ICU', 'Ward') AS location_category"
    )
    catalog = TableCatalog(spark, frames={"patient": patients, "hospitalization": stays, "adt": moves})
    cohort, waterfall = cohort_with_waterfall(catalog)
    expected = {5} | {i for i in range(1000, 3000) if i % 2 == 0}
    assert set(ids(cohort)) == expected
    assert waterfall.first().final == len(expected)
