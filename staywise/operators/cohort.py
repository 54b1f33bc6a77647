"""Adult ICU cohort and its filter waterfall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.columns import first_present, ref, require_columns, require_same_key_type
from staywise.functions.scale import skew_safe_join
from staywise.functions.vocab import AGE_COLUMNS, LOCATION_COLUMNS, PATIENT, STAY
from staywise.sources.catalog import TableCatalog


@dataclass(frozen=True)
class CohortSpec:
    min_age: int = 18
    require_icu_location: bool = True


@dataclass(frozen=True)
class _Steps:
    """Unmaterialised pieces shared by the cohort and the waterfall."""

    pairs: DataFrame  # (patient, stay), `_age` = smallest qualifying age or null, `_adult`
    icu: DataFrame | None  # distinct stays with an ICU location; None when the filter does not apply
    age_column: str | None
    location_column: str | None


def _resolve(catalog: TableCatalog, spec: CohortSpec) -> _Steps:
    stays, patients = catalog["hospitalization"], catalog["patient"]
    require_columns(stays, [STAY, PATIENT], "hospitalization")
    require_columns(patients, [PATIENT], "patient")
    require_same_key_type(stays, patients, PATIENT, "hospitalization and patient")

    age = first_present([*stays.columns, *patients.columns], AGE_COLUMNS)
    keys = [PATIENT, STAY]
    if age is None:
        pairs = stays.select(*keys).distinct().withColumn("_adult", F.lit(True))
    else:
        smallest = F.min(F.when(ref(age) >= spec.min_age, ref(age))).alias("_age")
        if age in stays.columns:
            # The stay's own copy wins, and a patient join could only repeat rows: not needed at all.
            pairs = stays.groupBy(*keys).agg(smallest)
        else:
            # One row per patient before the join, so repeated patient rows never multiply stays.
            ages = patients.groupBy(PATIENT).agg(smallest)
            pairs = (
                skew_safe_join(stays.select(*keys), ages, PATIENT, "left").groupBy(*keys).agg(F.min("_age").alias("_age"))
            )
        pairs = pairs.withColumn("_adult", F.col("_age").isNotNull())

    icu = location = None
    if spec.require_icu_location and "adt" in catalog:
        moves = catalog["adt"]
        location = first_present(moves.columns, LOCATION_COLUMNS)
        if location is not None:
            require_columns(moves, [STAY], "adt")
            require_same_key_type(stays, moves, STAY, "hospitalization and adt")
            # Distinct first: it combines map-side, so a stay with countless moves ships one row per task.
            icu = moves.where(F.lower(ref(location).cast("string")).contains("icu")).select(STAY).distinct()
    return _Steps(pairs, icu, age, location)


def _cohort(steps: _Steps) -> DataFrame:
    kept = steps.pairs.where("_adult")
    if steps.icu is not None:
        kept = kept.join(steps.icu, STAY, "left_semi")
    columns = [F.col(PATIENT), F.col(STAY)]
    if steps.age_column is not None:
        columns.append(F.col("_age").alias(steps.age_column))
    return kept.select(*columns)


def _waterfall(steps: _Steps) -> DataFrame:
    pairs = steps.pairs
    if steps.icu is None:
        pairs = pairs.withColumn("_icu", F.lit(True))
    else:
        flags = steps.icu.withColumn("_icu", F.lit(True))
        pairs = pairs.join(flags, STAY, "left").withColumn("_icu", F.coalesce("_icu", F.lit(False)))
    # A null stay id forms one group, so it counts as one value like everywhere in the counts below.
    per_stay = pairs.groupBy(STAY).agg(
        F.count_if("_adult").alias("_adult_pairs"), F.bool_or("_icu").alias("_icu")
    )
    adult = F.col("_adult_pairs") > 0
    return per_stay.agg(
        F.count(F.lit(1)).alias("total_hospitalizations"),
        F.count_if(adult).alias("after_age_filter"),
        F.count_if(adult & F.col("_icu")).alias("after_icu_filter"),
        F.coalesce(F.sum(F.when(F.col("_icu"), F.col("_adult_pairs"))), F.lit(0)).alias("final"),
    ).select(
        "*",
        F.lit(steps.age_column).cast("string").alias("age_col_used"),
        F.lit(steps.location_column).cast("string").alias("icu_location_col_used"),
        F.lit(steps.icu is not None).alias("icu_filter_applied"),
    )


def adult_icu_cohort(catalog: TableCatalog, spec: CohortSpec | None = None) -> DataFrame:
    """(patient_id, hospitalization_id[, age]) of the stays that pass the filters, one row per pair.

    A filter whose column does not exist is skipped. Unordered: sort at the sink.
    """
    return _cohort(_resolve(catalog, spec or CohortSpec()))


def cohort_with_waterfall(
    catalog: TableCatalog, spec: CohortSpec | None = None
) -> tuple[DataFrame, DataFrame]:
    """The cohort and a one-row frame of distinct-stay counts after each filter, both lazy."""
    steps = _resolve(catalog, spec or CohortSpec())
    return _cohort(steps), _waterfall(steps)


def waterfall_steps(waterfall: DataFrame, spec: CohortSpec | None = None) -> DataFrame:
    """Four labelled rows for display; the label tells when a filter did not run."""
    spec = spec or CohortSpec()
    age = F.when(F.col("age_col_used").isNull(), "Age filter SKIPPED: no age column").otherwise(
        f"Age at least {spec.min_age}"
    )
    icu = F.when(
        F.col("icu_filter_applied"), F.concat(F.lit("ICU location in "), F.col("icu_location_col_used"))
    ).otherwise(
        "ICU filter SKIPPED: no location column" if spec.require_icu_location else "ICU filter disabled"
    )
    labelled = [
        (F.lit("All hospitalizations"), "total_hospitalizations"),
        (age, "after_age_filter"),
        (icu, "after_icu_filter"),
        (F.lit("Final cohort"), "final"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step_no"), text.alias("step"), F.col(count).alias("n"))
            for i, (text, count) in enumerate(labelled)
        ]
    )
    return waterfall.select(F.inline(rows))
