"""DuckDB statements that compute the registered queries from the same parquet views."""

from __future__ import annotations

from staywise.functions.vocab import (
    ASSESSMENT_CATEGORIES,
    DECILE_EDGES,
    LAB_CATEGORIES,
    RESPIRATORY_DEVICES,
    VITAL_CATEGORIES,
)
from staywise.functions.columns import safe_name
from staywise.operators.splits import DEFAULT_SEED

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# The hospital tables as derived from events and customer.
_BASE = """
ev AS (
  SELECT *, CAST(user_id AS VARCHAR) || '-' ||
    CAST(date_diff('day', TIMESTAMP '2024-01-01 00:00:00', ts) // 7 AS VARCHAR) AS hospitalization_id
  FROM events),
hosp0 AS (
  SELECT CAST(user_id AS VARCHAR) AS patient_id, hospitalization_id, min(ts) AS admission_dttm,
    max(ts) AS discharge_dttm, arg_max(event_type, ts) AS last_type
  FROM ev GROUP BY ALL),
hosp AS (
  SELECT patient_id, hospitalization_id, admission_dttm, discharge_dttm,
    CASE last_type WHEN 'error' THEN 'Expired' WHEN 'signup' THEN 'Hospice' WHEN 'view' THEN NULL ELSE 'Home' END
      AS discharge_category
  FROM hosp0),
patient AS (
  SELECT CAST(c_custkey AS VARCHAR) AS patient_id, 10 + (c_custkey * 7) % 80 AS age,
    nullif(c_mktsegment, 'MACHINERY') AS sex_category
  FROM customer),
adt AS (
  SELECT hospitalization_id, CASE event_type WHEN 'purchase' THEN 'Medical ICU' ELSE 'Ward' END AS location_category
  FROM ev),
vitals AS (
  SELECT hospitalization_id, ts,
    CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'sbp' WHEN 'purchase' THEN 'map'
      WHEN 'error' THEN 'spo2' WHEN 'signup' THEN 'temp_c' END AS category, value
  FROM ev),
labs AS (
  SELECT hospitalization_id, ts,
    CASE event_type WHEN 'purchase' THEN 'sodium' WHEN 'error' THEN 'lactate' ELSE 'creatinine' END AS category,
    CASE WHEN value < 20 THEN '<20' ELSE CAST(value AS VARCHAR) END AS lab_value,
    CASE WHEN value >= 20 THEN value END AS value
  FROM ev),
assess AS (
  SELECT hospitalization_id, ts, CASE event_type WHEN 'signup' THEN 'gcs_total' ELSE 'RASS' END AS category,
    value % 15 AS value
  FROM ev WHERE event_type IN ('signup', 'error')),
resp AS (
  SELECT hospitalization_id, ts,
    CASE event_type WHEN 'click' THEN 'High Flow NC' WHEN 'view' THEN 'IMV' WHEN 'error' THEN 'CPAP'
      WHEN 'signup' THEN 'NIPPV' ELSE 'Nasal Cannula' END AS category
  FROM ev),
anchors AS (SELECT hospitalization_id, min(admission_dttm) AS anchor FROM hosp GROUP BY 1),
icu AS (SELECT DISTINCT hospitalization_id FROM adt WHERE location_category ILIKE '%icu%'),
adult AS (SELECT h.patient_id, h.hospitalization_id, p.age FROM hosp h JOIN patient p USING (patient_id) WHERE p.age >= 18),
cohort AS (SELECT * FROM adult WHERE hospitalization_id IN (SELECT hospitalization_id FROM icu)),
mortality AS (
  SELECT hospitalization_id, CAST(discharge_category = 'Expired' AS BIGINT) AS mortality
  FROM hosp WHERE discharge_category IS NOT NULL),
labelled AS (SELECT c.*, m.mortality AS outcome FROM cohort c JOIN mortality m USING (hospitalization_id))
"""


def _with(sql: str, extra: str = "", recursive: bool = False) -> str:
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {_BASE.strip()}{', ' + extra if extra else ''}\n{sql}"


def _in_window(table: str, hours: float) -> str:
    micros = round(hours * 3600 * 1_000_000)
    return (
        f"SELECT t.*, (epoch_us(t.ts) - epoch_us(a.anchor)) // 3600000000 AS hour FROM {table} t "
        f"JOIN anchors a USING (hospitalization_id) "
        f"WHERE t.ts >= a.anchor AND t.ts < a.anchor + to_microseconds(CAST({micros} AS BIGINT))"
    )


def _four(prefix: str, condition: str = "") -> str:
    keep = f" FILTER (WHERE {condition})" if condition else ""
    return (
        f"round(avg(value){keep}, 6) AS {prefix}_mean, round(min(value){keep}, 6) AS {prefix}_min, "
        f"round(max(value){keep}, 6) AS {prefix}_max, count(*){keep} AS {prefix}_n"
    )


def _onto(base: str, parts: list[tuple[str, list[str], list[str]]]) -> str:
    """Left-join aggregated parts onto a base; (cte, plain columns, zero-filled columns) each."""
    columns = ["b.hospitalization_id"]
    joins = ""
    for name, plain, zeroed in parts:
        columns += [f"{name}.{c}" for c in plain]
        columns += [f"CAST(coalesce({name}.{c}, 0) AS BIGINT) AS {c}" for c in zeroed]
        joins += f" LEFT JOIN {name} ON {name}.hospitalization_id = b.hospitalization_id"
    return f"SELECT {', '.join(columns)} FROM {base} b{joins}"


def _windowed(table: str, hours: float) -> str:
    return _with(
        _onto("cohort", [("s", [f"{table}_{k}" for k in ("mean", "min", "max")], [f"{table}_n"])]),
        f"w AS ({_in_window(table, hours)}), s AS (SELECT hospitalization_id, {_four(table)} FROM w GROUP BY 1)",
    )


def _category_part(cte: str, table: str, template: str, categories, hours: float):
    names = [template.format(safe_name(c)) for c in categories]
    stats = ", ".join(_four(n, f"category = '{c}'") for n, c in zip(names, categories))
    body = f"{cte} AS (SELECT hospitalization_id, {stats} FROM ({_in_window(table, hours)}) GROUP BY 1)"
    plain = [f"{n}_{k}" for n in names for k in ("mean", "min", "max")]
    return body, (cte, plain, [f"{n}_n" for n in names])


def _device_part(cte: str, devices, hours: float):
    names = [f"resp_{safe_name(d)}" for d in devices]
    flags = ", ".join(f"max(CAST(category = '{d}' AS BIGINT)) AS {n}" for n, d in zip(names, devices))
    body = f"{cte} AS (SELECT hospitalization_id, {flags} FROM ({_in_window('resp', hours)}) GROUP BY 1)"
    return body, (cte, [], names)


def _matrix_rich() -> str:
    parts = [
        _category_part("pv", "vitals", "vitals_{}", VITAL_CATEGORIES, 24),
        _category_part("pl", "labs", "labs_{}", LAB_CATEGORIES, 24),
        _category_part("pa", "assess", "assess_{}", ASSESSMENT_CATEGORIES, 24),
        _device_part("pr", RESPIRATORY_DEVICES, 24),
    ]
    return _with(_onto("cohort", [p for _, p in parts]), ", ".join(b for b, _ in parts))


_BASIC_CTES = (
    f"wv AS ({_in_window('vitals', 24)}), sv AS (SELECT hospitalization_id, {_four('vitals')} FROM wv GROUP BY 1), "
    f"wl AS ({_in_window('labs', 24)}), sl AS (SELECT hospitalization_id, {_four('labs')} FROM wl GROUP BY 1)"
)
_BASIC_PARTS = [
    ("sv", ["vitals_mean", "vitals_min", "vitals_max"], ["vitals_n"]),
    ("sl", ["labs_mean", "labs_min", "labs_max"], ["labs_n"]),
]
_BASIC_FEATURES = [c for _, plain, zeroed in _BASIC_PARTS for c in (*plain, *zeroed)]
_FRAME_CTES = (
    f"{_BASIC_CTES}, matrix AS ({_onto('cohort', _BASIC_PARTS)}), "
    f"frame AS (SELECT l.hospitalization_id, l.patient_id, l.outcome, {', '.join('m.' + c for c in _BASIC_FEATURES)} "
    f"FROM labelled l JOIN matrix m USING (hospitalization_id))"
)


def _grid(vitals, labs, assessments, devices) -> tuple[str, list[tuple[str, str]], list[tuple[str, str]]]:
    """CTEs ending in ``grid`` (stay, hour, v_<channel>, s_<channel>), plus numeric and flag channel names."""
    numeric, flags, reads = [], [], []
    for table, template, categories in (
        ("vitals", "vitals_{}", vitals), ("labs", "labs_{}", labs), ("assess", "assess_{}", assessments)
    ):
        numeric += [(template.format(safe_name(c)), f"{table}/{c}") for c in categories]
        reads.append(f"SELECT hospitalization_id, hour, '{table}/' || category AS ch, value FROM ({_in_window(table, 24)})")
    flags += [(f"resp_{safe_name(d)}", f"resp/{d}") for d in devices]
    reads.append(f"SELECT hospitalization_id, hour, 'resp/' || category AS ch, NULL AS value FROM ({_in_window('resp', 24)})")
    cells = ", ".join(
        [f"avg(value) FILTER (WHERE ch = '{k}') AS v_{n}" for n, k in numeric]
        + [f"CAST(count(*) FILTER (WHERE ch = '{k}') > 0 AS BIGINT) AS s_{n}" for n, k in numeric + flags]
    )
    ctes = (
        f"hourly AS ({' UNION ALL '.join(reads)}), "
        f"cells AS (SELECT hospitalization_id, hour, {cells} FROM hourly GROUP BY 1, 2), "
        "hours AS (SELECT c.hospitalization_id, CAST(h.hour AS BIGINT) AS hour FROM cohort c "
        "JOIN anchors USING (hospitalization_id), (SELECT unnest(range(24)) AS hour) h), "
        "grid AS (SELECT * FROM hours LEFT JOIN cells USING (hospitalization_id, hour))"
    )
    return ctes, numeric, flags


def _filled(name: str) -> str:
    return (
        f"coalesce(last_value(v_{name} IGNORE NULLS) OVER (PARTITION BY hospitalization_id ORDER BY hour "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)"
    )


_EVENT_GRID, _EVENT_NUMERIC, _EVENT_FLAGS = _grid(
    ("heart_rate", "sbp", "map", "spo2", "temp_c"), ("sodium", "lactate", "creatinine"), ("gcs_total", "RASS"),
    RESPIRATORY_DEVICES,
)
_RICH_GRID, _RICH_NUMERIC, _RICH_FLAGS = _grid(
    VITAL_CATEGORIES, LAB_CATEGORIES, ASSESSMENT_CATEGORIES, RESPIRATORY_DEVICES
)


def _sequence_long() -> str:
    values = [f"CAST({_filled(n)} AS FLOAT)" for n, _ in _RICH_NUMERIC]
    values += [f"CAST(coalesce(s_{n}, 0) AS FLOAT)" for n, _ in _RICH_FLAGS]
    return _with(
        "SELECT hospitalization_id, hour, CAST(p AS BIGINT) AS position, round(CAST(xs[p + 1] AS DOUBLE), 6) AS value "
        f"FROM (SELECT *, unnest(range({len(values)})) AS p FROM arrays)",
        f"{_RICH_GRID}, arrays AS (SELECT hospitalization_id, hour, [{', '.join(values)}] AS xs FROM grid)",
    )


def _sequence_per_stay() -> str:
    values = [f"CAST({_filled(n)} AS FLOAT)" for n, _ in _EVENT_NUMERIC]
    values += [f"CAST(coalesce(s_{n}, 0) AS FLOAT)" for n, _ in _EVENT_FLAGS]
    seen = " + ".join(f"coalesce(s_{n}, 0)" for n, _ in _EVENT_NUMERIC)
    total = " + ".join(f"CAST({v} AS DOUBLE)" for v in values)
    return _with(
        f"SELECT hospitalization_id, count(*) AS n_hours, CAST({len(values)} AS BIGINT) AS n_channels, "
        f"CAST({len(_EVENT_NUMERIC)} AS BIGINT) AS n_masks, CAST(sum(seen) AS BIGINT) AS n_observed, "
        "round(sum(total), 2) AS feature_total FROM per_hour GROUP BY 1",
        f"{_EVENT_GRID}, per_hour AS (SELECT hospitalization_id, hour, {seen} AS seen, {total} AS total FROM grid)",
    )


def _fraction(text: str, seed: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {text}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def _split_case(text: str, seed: str) -> str:
    share = _fraction(text, seed)
    return f"CASE WHEN {share} < 0.7::DOUBLE THEN 'train' WHEN {share} < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END"


def _held(groups: str, seed: str, share: str) -> str:
    """Groups whose hash rank lies in the first ceil(share * groups)."""
    return (
        f"SELECT g FROM (SELECT g, row_number() OVER (ORDER BY sha256({seed} || ':' || g)) AS r, count(*) OVER () AS n "
        f"FROM {groups}) WHERE r <= ceil({share} * n)"
    )


_EVENT_PREDICTIONS = (
    "pred AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label, value / 500 AS score, "
    "CAST(nullif(user_id % 4, 3) AS VARCHAR) AS subgroup FROM events)"
)
_TIED_PREDICTIONS = (
    "pred AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 5 + l_tax * 3 AS score FROM lineitem)"
)


def _metrics(source: str, key: str = "") -> str:
    """n, prevalence, AUROC from average ranks, Brier, log loss on clipped scores."""
    part = f"PARTITION BY {key}" if key else ""
    keys = f"{key}, " if key else ""
    return (
        f"clipped AS (SELECT {keys}label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM {source}), "
        f"ranked AS (SELECT *, rank() OVER ({part} ORDER BY p) + "
        f"(count(*) OVER (PARTITION BY {keys}p) - 1) / 2.0 AS rk FROM clipped), "
        f"sums AS (SELECT {keys}count(*) AS n, sum(label)::DOUBLE AS pos, sum(rk) FILTER (WHERE label = 1) AS rank_sum, "
        f"avg((p - label) * (p - label)) AS brier, -avg(label * ln(p) + (1 - label) * ln(1 - p)) AS log_loss "
        f"FROM ranked GROUP BY ALL)"
    )


_METRIC_COLUMNS = (
    "n, round(pos / n, 6) AS prevalence, "
    "round(CASE WHEN pos > 0 AND pos < n THEN (rank_sum - pos * (pos + 1) / 2) / (pos * (n - pos)) END, 6) AS auroc, "
    "round(brier, 6) AS brier, round(log_loss, 6) AS log_loss"
)


def _calibration(predictions: str, bins: int) -> str:
    """Row-level: the i-th of m positives in a run of c equal scores stands at place ceil(i * c / m) of the run."""
    return (
        f"{predictions}, placed AS (SELECT label, score, count(*) OVER () AS t, "
        "row_number() OVER (ORDER BY score, label DESC) - 1 AS idx, "
        "rank() OVER (ORDER BY score) - 1 AS below, count(*) OVER (PARTITION BY score) AS c, "
        "sum(label) OVER (PARTITION BY score) AS m, "
        "row_number() OVER (PARTITION BY score, label ORDER BY label) AS i FROM pred WHERE score BETWEEN 0 AND 1), "
        f"by_row AS (SELECT CAST((idx * least({bins}, t)) // t AS BIGINT) AS bin, score FROM placed), "
        f"by_event AS (SELECT CAST(((below + (i * c + m - 1) // m - 1) * least({bins}, t)) // t AS BIGINT) AS bin "
        "FROM placed WHERE label = 1), "
        "ev_n AS (SELECT bin, count(*) AS events FROM by_event GROUP BY 1), "
        "bins AS (SELECT r.bin, count(*) AS n, avg(score) AS mean_predicted_risk, "
        "coalesce(any_value(e.events), 0) / count(*) AS observed_event_rate, min(score) AS min_predicted_risk, "
        "max(score) AS max_predicted_risk FROM by_row r LEFT JOIN ev_n e USING (bin) GROUP BY 1)"
    )


_BIN_COLUMNS = (
    "SELECT bin, n, round(mean_predicted_risk, 6) AS mean_predicted_risk, round(observed_event_rate, 6) AS "
    "observed_event_rate, round(min_predicted_risk, 6) AS min_predicted_risk, round(max_predicted_risk, 6) AS "
    "max_predicted_risk FROM bins"
)


def _curve(predictions: str, thresholds: str) -> str:
    return (
        f"WITH {predictions}, t AS (SELECT unnest({thresholds})::DOUBLE AS threshold), "
        "c AS (SELECT threshold, count(*) AS n, avg(label) AS prevalence, "
        "count(*) FILTER (WHERE score >= threshold AND label = 1) AS true_positives, "
        "count(*) FILTER (WHERE score >= threshold AND label = 0) AS false_positives FROM pred, t GROUP BY 1) "
        "SELECT round(threshold, 6) AS threshold, n, round(prevalence, 6) AS prevalence, true_positives, false_positives, "
        "round(true_positives / n - false_positives / n * (threshold / (1 - threshold)), 6) AS net_benefit_model, "
        "round(prevalence - (1 - prevalence) * (threshold / (1 - threshold)), 6) AS net_benefit_treat_all, "
        "0.0::DOUBLE AS net_benefit_treat_none FROM c"
    )


def _nulls(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{name}' AS \"column\", count(*) - count({sql}) AS n_null, count(*) AS n_rows FROM "
        + {"hospitalization": "hosp", "patient_assessments": "assess", "respiratory_support": "resp"}.get(table, table)
        for name, sql in columns
    )


_NULL_COUNTS = " UNION ALL ".join(
    _nulls(table, [c if isinstance(c, tuple) else (c, c) for c in columns])
    for table, columns in {
        "adt": ["hospitalization_id", "location_category"],
        "hospitalization": [
            "patient_id", "hospitalization_id", "admission_dttm", "discharge_dttm", "discharge_category"
        ],
        "labs": [
            "hospitalization_id", ("lab_collect_dttm", "ts"), ("lab_category", "category"), "lab_value",
            ("lab_value_numeric", "value"),
        ],
        "patient": ["patient_id", "age", "sex_category"],
        "patient_assessments": [
            "hospitalization_id", ("recorded_dttm", "ts"), ("assessment_category", "category"), ("numerical_value", "value")
        ],
        "respiratory_support": ["hospitalization_id", ("recorded_dttm", "ts"), ("device_category", "category")],
        "vitals": ["hospitalization_id", ("recorded_dttm", "ts"), ("vital_category", "category"), ("vital_value", "value")],
    }.items()
)

_WATERFALL = (
    "SELECT (SELECT count(DISTINCT hospitalization_id) FROM hosp) AS total_hospitalizations, "
    "(SELECT count(DISTINCT hospitalization_id) FROM adult) AS after_age_filter, "
    "(SELECT count(DISTINCT hospitalization_id) FROM cohort) AS after_icu_filter, "
    "(SELECT count(*) FROM cohort) AS final, 'age' AS age_col_used, "
    "'location_category' AS icu_location_col_used, true AS icu_filter_applied"
)

_HOSP_GROUPS = "(SELECT DISTINCT patient_id AS g FROM hosp)"

def _kfold(table: str, row: str, group: str) -> str:
    """Greedy folds: the largest group left goes to the lightest fold, the first of equals.

    Groups of one size are interchangeable: how many of them a fold gets is counted, which ones follows from their hash.
    """
    return (
        f"WITH RECURSIVE sizes AS (SELECT {group} AS g, count(*) AS n FROM {table} GROUP BY 1), "
        "ranked AS (SELECT g, n, row_number() OVER (ORDER BY n DESC) AS i, row_number() OVER (PARTITION BY n ORDER BY "
        "sha256(concat('stable-split-v1:', CAST(g AS VARCHAR)))) - 1 AS r FROM sizes), "
        "dealt(i, n, fold, loads) AS (SELECT 0::BIGINT, 0::BIGINT, 0, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL "
        "SELECT q.i, q.n, list_position(d.loads, list_min(d.loads)) - 1, "
        "[CASE WHEN f = list_position(d.loads, list_min(d.loads)) THEN d.loads[f] + q.n ELSE d.loads[f] END FOR f IN [1, 2, 3, 4, 5]] "
        "FROM dealt d JOIN ranked q ON q.i = d.i + 1), "
        "shares AS (SELECT n, fold, count(*) AS c FROM dealt WHERE i > 0 GROUP BY 1, 2), "
        "spans AS (SELECT n, fold, sum(c) OVER (PARTITION BY n ORDER BY fold) AS upto, c FROM shares), "
        "placed AS (SELECT g, fold FROM ranked JOIN spans ON ranked.n = spans.n AND r >= upto - c AND r < upto) "
        f"SELECT t.{row}, t.{group}, CAST(fold AS BIGINT) AS fold FROM {table} t JOIN placed ON placed.g = t.{group}"
    )


ORACLES = {
    "table_inventory": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS n_columns FROM (DESCRIBE {t})" for t in _TABLES
    ),
    "contract_validation": (
        "WITH want AS (SELECT * FROM (VALUES "
        "('events', ['event_id', 'ts', 'user_id', 'value']), ('customer', ['c_birth_date', 'c_custkey']), "
        "('admissions', ['hospitalization_id', 'patient_id'])) v(tab, required)), "
        "have AS (SELECT 'events' AS tab, column_name AS c FROM (DESCRIBE events) "
        "UNION ALL SELECT 'customer', column_name FROM (DESCRIBE customer)), "
        "seen AS (SELECT w.tab, w.required, coalesce(list(h.c) FILTER (WHERE h.c IS NOT NULL), []) AS observed "
        "FROM want w LEFT JOIN have h USING (tab) GROUP BY ALL), "
        "checked AS (SELECT *, list_filter(required, lambda x: NOT list_contains(observed, x)) AS missing FROM seen) "
        "SELECT tab AS \"table\", len(observed) > 0 AS present, len(observed) > 0 AND len(missing) = 0 AS ok, "
        "array_to_string(required, ',') AS required_columns, array_to_string(missing, ',') AS missing_columns, "
        "CAST(len(observed) AS BIGINT) AS n_observed_columns FROM checked"
    ),
    "contract_validation_optional": (
        "SELECT t AS \"table\", n > 0 AS present, n > 0 AS ok, 'hospitalization_id' AS required_columns, "
        "CASE WHEN n > 0 THEN '' ELSE 'hospitalization_id' END AS missing_columns, CAST(n AS BIGINT) AS n_observed_columns "
        "FROM (VALUES ('vitals', 4), ('labs', 5), ('medication_admin_continuous', 0), "
        "('medication_admin_intermittent', 0), ('respiratory_support', 3)) v(t, n)"
    ),
    "qc_table_summary": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS n_rows, count(*) AS n_columns, "
        f"false AS missing_truncated, count(*) AS missing_inspected FROM (DESCRIBE {t})"
        for t in _TABLES
    ),
    "qc_table_summary_truncated": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS n_rows, count(*) AS n_columns, "
        f"count(*) > 5 AS missing_truncated, least(count(*), 5) AS missing_inspected FROM (DESCRIBE {t})"
        for t in _TABLES
    ),
    "discovered_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS n_columns FROM (DESCRIBE {t})" for t in _TABLES
    ),
    "qc_null_counts": _with(_NULL_COUNTS),
    "qc_missingness_pct": _with(
        "SELECT *, round(n_null / n_rows * 100, 1) AS pct_null FROM counts WHERE n_null > 0",
        f"counts AS ({_NULL_COUNTS})",
    ),
    "cohort_adult_icu": _with("SELECT patient_id, hospitalization_id, age FROM cohort"),
    "cohort_no_icu": _with(
        "SELECT h.patient_id, h.hospitalization_id, p.age FROM hosp h JOIN patient p USING (patient_id) WHERE p.age >= 40"
    ),
    "cohort_waterfall": _with(_WATERFALL),
    "cohort_waterfall_skipped": _with(
        "SELECT count(DISTINCT hospitalization_id) AS total_hospitalizations, count(DISTINCT hospitalization_id) AS "
        "after_age_filter, count(DISTINCT hospitalization_id) AS after_icu_filter, count(*) AS final, "
        "NULL::VARCHAR AS age_col_used, NULL::VARCHAR AS icu_location_col_used, false AS icu_filter_applied FROM hosp"
    ),
    "cohort_waterfall_steps": _with(
        "SELECT 0::BIGINT AS step_no, 'All hospitalizations' AS step, total_hospitalizations AS n FROM w "
        "UNION ALL SELECT 1, 'Age at least 18', after_age_filter FROM w "
        "UNION ALL SELECT 2, 'ICU location in location_category', after_icu_filter FROM w "
        "UNION ALL SELECT 3, 'Final cohort', final FROM w",
        f"w AS ({_WATERFALL})",
    ),
    "label_mortality": _with("SELECT hospitalization_id, mortality FROM mortality"),
    "label_mortality_hospice": _with(
        "SELECT hospitalization_id, CAST(discharge_category IN ('Expired', 'Hospice') AS BIGINT) AS mortality "
        "FROM hosp WHERE discharge_category IS NOT NULL"
    ),
    "label_los": _with(
        "SELECT hospitalization_id, CAST((epoch_us(discharge_dttm) - epoch_us(admission_dttm)) // 1000000 / 3600.0 > 120.5 "
        "AS BIGINT) AS long_los FROM hosp"
    ),
    "label_derived": _with(
        "SELECT hospitalization_id, CASE WHEN discharge_category IN ('Expired', 'Hospice') THEN 1 "
        "WHEN discharge_category IS NULL THEN NULL ELSE 0 END::BIGINT AS in_hospital_mortality FROM hosp"
    ),
    "label_balance": _with(
        "SELECT CAST(sum(outcome) AS BIGINT) AS n_positive, CAST(count(*) - sum(outcome) AS BIGINT) AS n_negative, "
        "round(avg(outcome), 6) AS prevalence FROM labelled"
    ),
    "censoring_guard": _with(
        "SELECT l.hospitalization_id, l.outcome FROM labelled l JOIN hosp h USING (hospitalization_id) "
        "WHERE epoch_us(h.discharge_dttm) - epoch_us(h.admission_dttm) >= 24 * 3600000000"
    ),
    "anchors": _with("SELECT hospitalization_id, epoch_us(anchor) AS anchor_us FROM anchors"),
    "agg_whole_stay": _with(
        _onto("cohort", [("s", ["labs_mean", "labs_min", "labs_max"], ["labs_n"])]),
        f"s AS (SELECT hospitalization_id, {_four('labs')} FROM labs GROUP BY 1)",
    ),
    "agg_parse_quality": _with(
        "SELECT count(*) AS n_rows, count(lab_value) AS n_non_null, count(TRY_CAST(lab_value AS DOUBLE)) AS n_numeric, "
        "count(lab_value) - count(TRY_CAST(lab_value AS DOUBLE)) AS n_unparseable, "
        "round((count(lab_value) - count(TRY_CAST(lab_value AS DOUBLE))) / count(lab_value), 6) AS unparseable_fraction "
        "FROM labs"
    ),
    "agg_windowed_24h": _windowed("vitals", 24),
    "agg_windowed_72h": _windowed("labs", 72),
    "agg_windowed_fractional_hours": _windowed("vitals", 4.8),
    "agg_windowed_salted": _windowed("labs", 72),
    "agg_per_category": (
        lambda part: _with(_onto("cohort", [part[1]]), part[0])
    )(_category_part("s", "vitals", "vitals_{}", VITAL_CATEGORIES, 72)),
    "resp_indicator": (lambda part: _with(_onto("anchors", [part[1]]), part[0]))(
        _device_part("s", (*RESPIRATORY_DEVICES, "Trach Collar"), 24)
    ),
    "matrix_basic": _with(_onto("cohort", _BASIC_PARTS), _BASIC_CTES),
    "matrix_rich": _matrix_rich(),
    "model_frame": _with("SELECT * FROM frame", _FRAME_CTES),
    "hourly_means": _with(
        "SELECT hospitalization_id, CAST(hour AS BIGINT) AS hour, category, round(avg(value), 6) AS value, "
        "1::BIGINT AS observed "
        "FROM w WHERE hospitalization_id IN (SELECT hospitalization_id FROM cohort) GROUP BY ALL",
        f"w AS ({_in_window('vitals', 24)})",
    ),
    "hourly_indicator": _with(
        "SELECT DISTINCT hospitalization_id, CAST(hour AS BIGINT) AS hour, "
        "category, 1.0::DOUBLE AS value FROM w "
        "WHERE category IN ('IMV', 'High Flow NC') AND hospitalization_id IN (SELECT hospitalization_id FROM cohort)",
        f"w AS ({_in_window('resp', 24)})",
    ),
    "hourly_grid_ffill": _with(
        "SELECT hospitalization_id, hour, "
        + ", ".join(f"round({_filled(n)}, 6) AS {n}" for n, _ in _EVENT_NUMERIC)
        + ", "
        + ", ".join(f"CAST(coalesce(s_{n}, 0) AS DOUBLE) AS {n}" for n, _ in _EVENT_FLAGS)
        + " FROM grid",
        _EVENT_GRID,
    ),
    "hourly_mask": _with(
        "SELECT hospitalization_id, hour, "
        + ", ".join(f"coalesce(s_{n}, 0) AS mask_{n}" for n, _ in _EVENT_NUMERIC)
        + " FROM grid",
        _EVENT_GRID,
    ),
    "sequence_long": _sequence_long(),
    "sequence_per_stay": _sequence_per_stay(),
    "stable_split": _with(
        f"SELECT hospitalization_id, {_split_case('hospitalization_id', DEFAULT_SEED)} AS split FROM hosp"
    ),
    "stable_split_counts": _with(f"SELECT {_split_case('patient_id', 'audit')} AS split, count(*) AS n FROM hosp GROUP BY 1"),
    "group_split": _with(
        "SELECT patient_id, hospitalization_id, CASE WHEN patient_id IN (SELECT g FROM held) THEN 'test' ELSE 'train' END "
        "AS split FROM hosp",
        f"held AS ({_held(_HOSP_GROUPS, chr(39) + '42' + chr(39), '0.2::DOUBLE')})",
    ),
    "group_split_stratified": _with(
        "SELECT r.hospitalization_id, CASE WHEN t.g IS NOT NULL THEN 'test' ELSE 'train' END AS split FROM rws r "
        "LEFT JOIN (SELECT g FROM tests WHERE seed = (SELECT seed FROM best)) t ON t.g = r.patient_id",
        "rws AS (SELECT h.patient_id, h.hospitalization_id, m.mortality AS y FROM hosp h JOIN mortality m USING (hospitalization_id)), "
        "sizes AS (SELECT patient_id AS g, count(*) AS n, sum(y) AS pos FROM rws GROUP BY 1), "
        "seeds AS (SELECT unnest(range(42, 74)) AS seed), "
        "ranked AS (SELECT seed, g, n, pos, row_number() OVER (PARTITION BY seed ORDER BY sha256(CAST(seed AS VARCHAR) || ':' || g)) "
        "AS r, count(*) OVER (PARTITION BY seed) AS total FROM sizes, seeds), "
        "tests AS (SELECT * FROM ranked WHERE r <= ceil(0.2::DOUBLE * total)), "
        "folds AS (SELECT seed, sum(pos) / sum(n) AS prev, sum(pos) AS pos FROM tests GROUP BY 1), "
        "best AS (SELECT seed FROM folds WHERE pos > 0 ORDER BY abs(prev - (SELECT sum(pos) / sum(n) FROM sizes)), seed LIMIT 1)",
    ),
    "group_kfold": _kfold("events", "event_id", "user_id"),
    "group_kfold_small_groups": _kfold("lineitem", "l_linenumber", "l_orderkey"),
    "three_way_split": _with(
        "SELECT patient_id, hospitalization_id, CASE WHEN patient_id IN (SELECT g FROM held) THEN 'test' "
        "WHEN patient_id IN (SELECT g FROM second) THEN 'validation' ELSE 'train' END AS split FROM hosp",
        f"held AS ({_held(_HOSP_GROUPS, chr(39) + '42' + chr(39), '0.15::DOUBLE')}), "
        "remaining AS (SELECT g FROM (SELECT DISTINCT patient_id AS g FROM hosp) WHERE g NOT IN (SELECT g FROM held)), "
        f"second AS ({_held('remaining', chr(39) + '43' + chr(39), '(0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))')})",
    ),
    "split_summary": _with(
        "SELECT CASE WHEN g IN (SELECT g FROM held) THEN 'test' ELSE 'train' END AS split, count(*) AS n, "
        "count(DISTINCT g) AS n_groups, round(avg(y), 6) AS prevalence FROM rws GROUP BY 1",
        "rws AS (SELECT h.patient_id AS g, m.mortality AS y FROM hosp h JOIN mortality m USING (hospitalization_id)), "
        f"held AS ({_held('(SELECT DISTINCT g FROM rws)', chr(39) + '42' + chr(39), '0.2::DOUBLE')})",
    ),
    "clean_scores": (
        f"WITH {_EVENT_PREDICTIONS}, raw AS (SELECT CASE WHEN event_id % 7 <> 3 THEN label END AS label, "
        "CASE WHEN event_id % 10 IN (0, 1) THEN NULL WHEN event_id % 10 = 2 THEN score * 1000 ELSE score END AS score FROM pred) "
        "SELECT round(least(greatest(score, 1e-15), 1 - 1e-15), 6) AS score, count(*) AS n, CAST(sum(label) AS BIGINT) AS events "
        "FROM raw WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY least(greatest(score, 1e-15), 1 - 1e-15)"
    ),
    "binary_metrics": f"WITH {_EVENT_PREDICTIONS}, {_metrics('pred')} SELECT {_METRIC_COLUMNS} FROM sums",
    "binary_metrics_bucketed": f"WITH {_EVENT_PREDICTIONS}, {_metrics('pred')} SELECT {_METRIC_COLUMNS} FROM sums",
    "auroc_ties": f"WITH {_TIED_PREDICTIONS}, {_metrics('pred')} SELECT auroc FROM (SELECT {_METRIC_COLUMNS} FROM sums)",
    "average_precision": (
        f"WITH {_TIED_PREDICTIONS}, "
        "ranked AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk, "
        "sum(label) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / "
        "count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS precision_here FROM pred), "
        "s AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS pos, sum(rk) FILTER (WHERE label = 1) AS rank_sum, "
        "sum(precision_here) FILTER (WHERE label = 1) AS precision_sum, avg((score - label) * (score - label)) AS brier FROM ranked) "
        "SELECT round((rank_sum - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auroc, "
        "round(precision_sum / pos, 6) AS auprc, round(brier, 6) AS brier_score, round(pos / n, 6) AS prevalence FROM s"
    ),
    "calibration_equal_freq": f"WITH {_calibration(_EVENT_PREDICTIONS, 10)} {_BIN_COLUMNS}",
    "calibration_equal_freq_ties": f"WITH {_calibration(_TIED_PREDICTIONS, 7)} {_BIN_COLUMNS}",
    "ece": (
        f"WITH {_calibration(_EVENT_PREDICTIONS, 10)} SELECT round(sum(n * abs(mean_predicted_risk - observed_event_rate)) "
        "/ sum(n), 6) AS expected_calibration_error FROM bins"
    ),
    "reliability_deciles": (
        f"WITH {_TIED_PREDICTIONS} SELECT CAST("
        + " + ".join(f"CAST(score >= {e!r}::DOUBLE AS INTEGER)" for e in DECILE_EDGES)
        + " AS BIGINT) AS bin, round(avg(score), 6) AS mean_pred, round(avg(label), 6) AS mean_actual, count(*) AS count "
        "FROM pred GROUP BY 1"
    ),
    "subgroup_metrics": (
        f"WITH {_EVENT_PREDICTIONS}, both_cols AS (SELECT 'subgroup' || '/' || coalesce(subgroup, 'Unknown') AS k, label, score "
        "FROM pred UNION ALL SELECT 'band/' || CASE WHEN label = 1 THEN 'event' ELSE 'Unknown' END, label, score FROM pred), "
        f"{_metrics('both_cols', 'k')} "
        "SELECT split_part(k, '/', 1) AS subgroup_col, split_part(k, '/', 2) AS subgroup_value, n, prevalence, auroc, brier, "
        "log_loss, CASE WHEN auroc IS NULL THEN 'AUROC is undefined: only one class among these rows' END AS warning "
        f"FROM (SELECT k, {_METRIC_COLUMNS} FROM sums)"
    ),
    "decision_curve": _curve(_TIED_PREDICTIONS, "[0.1, 0.25, 0.4, 0.6]"),
    "net_benefit_default": _curve(_EVENT_PREDICTIONS, "[0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]"),
    # Newton steps for intercept a and slope b of label on logit(score).
    "calibration_slope": (
        f"WITH RECURSIVE {_EVENT_PREDICTIONS}, "
        "logits AS (SELECT label, ln(p / (1 - p)) AS x FROM (SELECT label, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM pred)), "
        "fit(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL "
        "SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) "
        "FROM (SELECT i, a, b, sum(label - m) AS g0, sum((label - m) * x) AS g1, sum(m * (1 - m)) AS h00, "
        "sum(m * (1 - m) * x) AS h01, sum(m * (1 - m) * x * x) AS h11 "
        "FROM (SELECT f.i, f.a, f.b, l.label, l.x, 1 / (1 + exp(-(f.a + f.b * l.x))) AS m FROM fit f, logits l WHERE f.i < 12) "
        "GROUP BY i, a, b)) "
        "SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM fit WHERE i = 12"
    ),
    "imputation_medians": _with(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM frame" for c in _BASIC_FEATURES
        ),
        _FRAME_CTES,
    ),
}

ORACLES["label_outcome_long_stay"] = f"SELECT hospitalization_id, long_los AS outcome FROM ({ORACLES['label_los']})"


def _cells(section: str, key: str, metrics: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({source})" for m in metrics
    )


_FIVE = ("n", "prevalence", "auroc", "brier", "log_loss")
_BIN_VALUES = ("n", "mean_predicted_risk", "observed_event_rate", "min_predicted_risk", "max_predicted_risk")
ORACLES["evaluation_report"] = " UNION ALL ".join(
    [
        _cells("overall", "''", _FIVE, ORACLES["binary_metrics"]),
        _cells("calibration_error", "''", ("expected_calibration_error",), ORACLES["ece"]),
        _cells("calibration_bins", "CAST(bin AS VARCHAR)", _BIN_VALUES, ORACLES["calibration_equal_freq"]),
        _cells(
            "subgroups", "subgroup_col || '=' || subgroup_value", _FIVE,
            f"SELECT * FROM ({ORACLES['subgroup_metrics']}) WHERE subgroup_col = 'subgroup'",
        ),
    ]
)

ORACLES["training_sides"] = _with(
    "SELECT split, outcome, count(*) AS n, round(CASE WHEN outcome = 1 THEN count(*) * ((any_value(rows_here) - any_value(pos)) "
    "/ any_value(pos)::DOUBLE) ELSE count(*)::DOUBLE END, 6) AS weight FROM (SELECT split, outcome, count(*) OVER (PARTITION BY split) "
    "AS rows_here, sum(outcome) OVER (PARTITION BY split) AS pos FROM sides) GROUP BY split, outcome",
    f"{_FRAME_CTES}, held AS ({_held('(SELECT DISTINCT patient_id AS g FROM frame)', chr(39) + '42' + chr(39), '0.2::DOUBLE')}), "
    "sides AS (SELECT outcome, CASE WHEN patient_id IN (SELECT g FROM held) THEN 'test' ELSE 'train' END AS split FROM frame)",
)

_TRAIN_SIDE = (
    f"{_FRAME_CTES}, held AS ({_held('(SELECT DISTINCT patient_id AS g FROM frame)', chr(39) + '42' + chr(39), '0.2::DOUBLE')}), "
    "train AS (SELECT * FROM frame WHERE patient_id NOT IN (SELECT g FROM held))"
)
ORACLES["logistic_design"] = _with(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, 0.0::DOUBLE AS slope "
        f"FROM (SELECT coalesce({c}, (SELECT median({c}) FROM train)) AS x FROM train)"
        for c in _BASIC_FEATURES
    ),
    _TRAIN_SIDE,
)

# Bins of the boosted trees: every value of a column of at most 63, else values at ranks floor(k n / 63) + 1 and the largest.
_CUTS = (
    "vals AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, outcome FROM train" for i, c in enumerate(_BASIC_FEATURES))
    + "), placed AS (SELECT feature, v, row_number() OVER w AS rank, count(*) OVER (PARTITION BY feature) AS n, "
    "dense_rank() OVER w AS d FROM vals WHERE v IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY v)), "
    "sizes AS (SELECT feature, max(d) AS d, max(n) AS n FROM placed GROUP BY feature), "
    "cuts AS (SELECT DISTINCT p.feature, p.v AS cut FROM placed p JOIN sizes s USING (feature) WHERE s.d <= 63 "
    "OR list_contains([least(k * s.n // 63 + 1, s.n) for k in range(1, 64)], p.rank))"
)
ORACLES["feature_bins"] = _with("SELECT feature, round(cut, 6) AS cut FROM cuts", f"{_TRAIN_SIDE}, {_CUTS}")
# All splits of all training rows: at a cut or with no value right (cut null), missing values on either side.
ORACLES["gbt_first_split"] = _with(
    "SELECT feature, least(nl, n - nl) AS n_smaller, greatest(nl, n - nl) AS n_larger, round(gain, 6) AS gain FROM gains "
    "ORDER BY round(gain, 12) DESC, i LIMIT 1",
    f"{_TRAIN_SIDE}, {_CUTS}, "
    "tried AS (SELECT feature, cut FROM cuts UNION ALL SELECT DISTINCT feature, CAST(NULL AS DOUBLE) FROM cuts), "
    "counts AS (SELECT any_value(v.i) AS i, feature, cut, m.side, count(*) AS n, sum(outcome) AS pos, "
    "count(*) FILTER (WHERE CASE WHEN v IS NULL THEN m.side ELSE cut IS NULL OR v < cut END) AS nl, "
    "coalesce(sum(outcome) FILTER (WHERE CASE WHEN v IS NULL THEN m.side ELSE cut IS NULL OR v < cut END), 0) AS pl "
    "FROM vals v JOIN tried USING (feature), (VALUES (true), (false)) AS m(side) GROUP BY feature, cut, m.side), "
    "gains AS (SELECT *, 4 * (pos / n * (1 - pos / n) - (pl * (1 - pl / nl) + (pos - pl) * (1 - (pos - pl) / (n - nl))) / n) AS gain "
    "FROM counts WHERE nl > 0 AND nl < n)",
)
ORACLES["gbt_leaf_means"] = _with(
    "SELECT CAST(t AS INTEGER) AS tree, (SELECT count(*) FROM train) AS n, 0.0::DOUBLE AS gap FROM range(8) AS r(t)", _TRAIN_SIDE
)



def _six(name: str, predictions: str) -> str:
    ranking = ORACLES["average_precision"].replace(_TIED_PREDICTIONS, predictions)
    line = ORACLES["calibration_slope"].replace(_EVENT_PREDICTIONS, predictions)
    return (
        f"SELECT '{name}' AS model, r.*, l.intercept AS calibration_intercept, l.slope AS calibration_slope "
        f"FROM ({ranking}) AS r, ({line}) AS l"
    )


ORACLES["comparison_table"] = f"{_six('events', _EVENT_PREDICTIONS)} UNION ALL {_six('lines', _TIED_PREDICTIONS)}"

ORACLES["qc_table_count"] = (
    f"SELECT {len(_TABLES)}::BIGINT AS n_tables, count(*) AS n_rows, CAST(sum(n_columns) AS BIGINT) AS n_columns FROM ({ORACLES['qc_table_summary']})"
)
ORACLES["cohort_csv"] = ORACLES["cohort_adult_icu"]
ORACLES["decision_report_json"] = f"SELECT *, 0.0::DOUBLE AS gap FROM ({ORACLES['net_benefit_default']})"
ORACLES["prediction_file"] = ORACLES["binary_metrics"]
ORACLES["read_with_limit"] = "SELECT least(count(*), 7) AS n_rows, (SELECT count(*) FROM (DESCRIBE events)) AS n_columns FROM events"
ORACLES["label_guards"] = _with(
    "SELECT 'all' AS rows, min(mortality) = max(mortality) AS objects FROM mortality UNION ALL "
    "SELECT unnest(['negatives', 'positives']), true"
)
