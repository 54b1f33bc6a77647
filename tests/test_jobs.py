import json
import random
from pathlib import Path

import pytest

from staywise.__main__ import main
from staywise.functions.scale import ensure_checkpoint_dir, materialize
from staywise.operators.cohort import CohortSpec
from staywise.operators.models import METRICS, load_model
from staywise.plans.baseline import run_baseline, run_sequence_baseline
from staywise.plans.reports import decision_report, evaluation_report, run_payload, write_report
from staywise.sources.catalog import TableCatalog

from helpers import at

EVENTS = "hospitalization_id string, {ts} timestamp, {extra}value double"
WARDS = ("Medical ICU", "Surgical ICU", "Cardiac ICU")


def hospital(spark, n=24, vitals=True, labs=True, categories=False):
    """Stays of uneven length admitted at odd hours; every third patient dies, with values that drift upwards."""
    draw = random.Random(11)
    stays = []
    for i in range(n):
        start = at(31 * i + draw.randint(0, 9))
        stays.append((f"person-{i}", f"stay-{7 * i}", start, at(130 + 5 * (i % 7), start), "Died" if i % 3 == 1 else draw.choice(["Home", "Rehab"])))
    frames = {
        "patient": spark.createDataFrame([(s[0], draw.randint(19, 92)) for s in stays], "patient_id string, age int"),
        "hospitalization": spark.createDataFrame(
            stays, "patient_id string, hospitalization_id string, admission_dttm timestamp, discharge_dttm timestamp, discharge_category string"
        ),
        "adt": spark.createDataFrame(
            [(s[1], WARDS[i % 3]) for i, s in enumerate(stays)], "hospitalization_id string, location_category string"
        ),
    }

    def readings(names, base, every):
        rows = []
        for _, stay, start, _, fate in stays:
            for k, hour in enumerate(range(1, 24, every)):
                drift = 0.04 * base * k if fate == "Died" else 0.0
                value = base + drift + draw.uniform(-0.1, 0.1) * base
                rows.append((stay, at(hour + draw.random(), start), *([names[k % len(names)]] if categories else []), value))
        return rows

    extra = "{0} string, " if categories else ""
    if vitals:
        schema = EVENTS.format(ts="recorded_dttm", extra=extra.format("vital_category"))
        frames["vitals"] = spark.createDataFrame(readings(("heart_rate", "sbp"), 72, 3), schema)
    if labs:
        schema = EVENTS.format(ts="lab_result_dttm", extra=extra.format("lab_category"))
        frames["labs"] = spark.createDataFrame(readings(("sodium", "lactate"), 5, 6), schema)
    return TableCatalog(spark, frames=frames)


def test_baseline_job(spark):
    report = run_baseline(hospital(spark), trees=3)
    assert report.split["train"]["n"] + report.split["test"]["n"] == 24
    assert report.split["train"]["n_patients"] + report.split["test"]["n_patients"] == 24
    assert len(report.features) == 8 and {"vitals_mean", "labs_mean"} <= set(report.features)
    assert report.warnings == ()
    assert all(tuple(r.metrics) == METRICS for r in report.models.values())
    payload = run_payload(report, "/some/place/site_a/")
    assert payload["config"]["data_root_basename"] == "site_a"
    assert set(payload) >= {"config", "cohort_waterfall", "n_features", "feature_names", "split", "models", "warnings", "generated_at", "code_version"}
    text = json.dumps(payload, allow_nan=False)
    assert "stay-" not in text and "person-" not in text
    assert payload["chosen_model"] in payload["models"]
    assert {m["calibration"] for m in payload["models"].values()} <= {"reasonably calibrated", "miscalibrated"}


def test_baseline_without_tables(spark):
    report = run_baseline(hospital(spark, vitals=False), trees=2)
    assert len(report.warnings) == 1 and "vitals" in report.warnings[0]
    with pytest.raises(ValueError, match="no usable feature table"):
        run_baseline(hospital(spark, vitals=False, labs=False), trees=2)


def test_baseline_guards(spark):
    catalog = hospital(spark)
    with pytest.raises(ValueError, match="cohort is empty"):
        run_baseline(catalog, CohortSpec(min_age=200))
    with pytest.raises(ValueError, match="feature_set"):
        run_baseline(catalog, feature_set="huge")
    with pytest.raises(ValueError, match="outcome"):
        run_baseline(catalog, outcome="other")
    with pytest.raises(ValueError, match="degenerate"):
        run_baseline(catalog, outcome="los_gt_7d")
    with pytest.raises(KeyError, match="patient"):
        run_baseline(TableCatalog(spark, frames={"hospitalization": catalog["hospitalization"]}))


def test_sequence_job(spark):
    catalog = hospital(spark, n=30, categories=True)
    report = run_sequence_baseline(catalog, penalties=(0.01, 0.1), max_iter=20, window_hours=6)
    assert sum(s["n"] for s in report.split.values()) == 30 and set(report.split) == {"train", "validation", "test"}
    (result,) = report.models.values()
    assert tuple(result.metrics) == METRICS and len(report.features) == 26
    assert report.training["candidates_tried"] == 3 and set(report.training["validation_auroc"]) == {"logistic", "boosted_trees"}
    with pytest.raises(ValueError, match="covers the window"):
        run_sequence_baseline(catalog, window_hours=161)


def test_commands(spark, tmp_path):
    root = tmp_path / "site"
    catalog = hospital(spark)
    for name in catalog:
        catalog[name].write.parquet(str(root / f"clif_{name}.parquet"))
    out = {k: str(tmp_path / k) for k in ("cohort", "qc", "run", "model")}
    main(["inspect", "--data-root", str(root)], spark)
    main(["cohort", "--data-root", str(root), "--out", out["cohort"], "--no-require-icu-location"], spark)
    cohort = spark.read.csv(out["cohort"], header=True)
    assert cohort.count() == 24 and cohort.columns == ["patient_id", "hospitalization_id", "age"]
    main(["qc", "--data-root", str(root), "--out", out["qc"]], spark)
    assert spark.read.json(out["qc"]).count() == 5
    main(["baseline", "--data-root", str(root), "--metrics-out", out["run"], "--model-out", out["model"], "--trees", "2"], spark)
    payload = json.loads(spark.read.text(out["run"]).first()[0])
    assert payload["config"]["data_root_basename"] == "site" and set(payload["models"]) == {"boosted_trees", "logistic"}
    assert load_model(out["model"]).stages
    with pytest.raises(FileNotFoundError):
        main(["inspect", "--data-root", str(tmp_path / "nowhere")], spark)


def test_prediction_commands(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.7, "x"), (0, 0.2, "y"), (0, 0.7, "x"), (1, 0.9, None), (0, 0.3, "y")], "in_hospital_mortality int, predicted_risk double, sex string")
    path, out = str(tmp_path / "p.csv"), str(tmp_path / "out")
    frame.coalesce(1).write.csv(path, header=True)
    main(["evaluate-predictions", "--predictions", path, "--out", out, "--subgroup-cols", "sex", "--calibration-bins", "2"], spark)
    assert spark.read.json(out + "/overall").first().auroc == pytest.approx(5.5 / 6)
    assert spark.read.json(out + "/calibration_bins").count() == 2
    lines = [line for part in Path(out, "subgroups").glob("part-*") for line in part.read_text().splitlines()]
    assert [json.loads(x)["subgroup_value"] for x in lines] == ["Unknown", "x", "y"] and json.loads(lines[2])["auroc"] is None
    main(["decision-curve", "--predictions", path, "--out", out + "2", "--thresholds", "0.2", "0.5"], spark)
    assert spark.read.json(out + "2/decision_curve").count() == 2


def test_report_sections(spark, tmp_path):
    frame = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, 0.6)], "y int, p double")
    assert set(evaluation_report(frame, "y", "p")) == {"overall", "calibration_error", "calibration_bins", "subgroups"}
    write_report(decision_report(frame, "y", "p"), str(tmp_path))
    assert spark.read.json(str(tmp_path / "decision_curve")).count() == 10


def test_checkpoints_use_the_configured_folder(spark):
    ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir")
    assert Path(configured).name in spark.sparkContext.getCheckpointDir()
    kept = materialize(spark.range(10).selectExpr("id * 2 AS x"))
    assert kept.agg({"x": "sum"}).first()[0] == 90
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
