"""Fixed values. Column names, prefixes and vocabularies of the hospital table layout, in natural order.

They have to equal the values users already rely on, so they are listed plainly and nothing else lives here.
"""

STAY = "hospitalization_id"
PATIENT = "patient_id"
ANCHOR = "anchor_dttm"

# File-name prefixes dropped when a table key is derived from a path; the first match wins.
TABLE_PREFIXES = ("clif_", "clif2_", "mimic_clif_", "rush_clif_")
TABLE_SUFFIXES = (".parquet", ".parq")

# Contracts: columns a table must have.
CORE_CONTRACTS = {
    "patient": {"patient_id"},
    "hospitalization": {"hospitalization_id", "patient_id"},
    "adt": {"hospitalization_id"},
}
OPTIONAL_CONTRACTS = {
    "vitals": {"hospitalization_id"},
    "labs": {"hospitalization_id"},
    "medication_admin_continuous": {"hospitalization_id"},
    "medication_admin_intermittent": {"hospitalization_id"},
    "respiratory_support": {"hospitalization_id"},
}

# Ordered column candidates: the first one present is used.
AGE_COLUMNS = ("age_at_admission", "admission_age", "age", "anchor_age")
LOCATION_COLUMNS = ("location_category", "location_type", "care_unit", "unit_type", "department")
VALUE_COLUMNS = (
    "vital_value",
    "lab_value_numeric",
    "numerical_value",
    "value",
    "numeric_value",
    "measurement_value",
    "lab_value",
)
# Collection and order time come before result time: a sample drawn inside the window counts
# even when its result arrives later.
TIME_COLUMNS = (
    "recorded_dttm",
    "lab_collect_dttm",
    "lab_order_dttm",
    "lab_result_dttm",
    "obs_dttm",
    "measurement_dttm",
    "admin_dttm",
)
DISCHARGE_COLUMNS = ("discharge_category", "discharge_disposition", "discharge_to")
LABEL_COLUMNS = ("outcome", "mortality", "long_los")

# Discharge vocabularies, compared after lower-casing and stripping white space.
DEATH_DISCHARGES = ("dead/expired", "death", "deceased", "died", "expired", "expired in hospital")
HOSPICE_DISCHARGES = ("discharged to hospice", "hospice")
DEATH_DISPOSITIONS = ("dead", "death", "deceased", "died", "expired")

# Category vocabularies of the per-category feature set, in channel order.
VITAL_CATEGORIES = ("heart_rate", "sbp", "dbp", "map", "respiratory_rate", "spo2", "temp_c")
LAB_CATEGORIES = (
    "sodium",
    "potassium",
    "chloride",
    "bicarbonate",
    "bun",
    "creatinine",
    "glucose_serum",
    "calcium_total",
    "magnesium",
    "lactate",
    "hemoglobin",
    "wbc",
)
ASSESSMENT_CATEGORIES = ("gcs_total", "RASS")
RESPIRATORY_DEVICES = ("IMV", "NIPPV", "High Flow NC", "Nasal Cannula", "CPAP")

# Inner edges of ten equal-width reliability bins as IEEE doubles (multiples of 0.1 accumulated from 0 to 1).
DECILE_EDGES = (
    0.1,
    0.2,
    0.30000000000000004,
    0.4,
    0.5,
    0.6000000000000001,
    0.7000000000000001,
    0.8,
    0.9,
)
