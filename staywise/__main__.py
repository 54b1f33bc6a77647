"""Job entry point: ``spark-submit`` or ``python -m staywise <command>``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from staywise.operators.cohort import CohortSpec, adult_icu_cohort
from staywise.operators.contracts import contract_report
from staywise.operators.models import save_model
from staywise.operators.qc import qc_report
from staywise.plans import reports
from staywise.plans.baseline import run_baseline, run_sequence_baseline
from staywise.sources.catalog import TableCatalog
from staywise.sources.predictions import read_predictions


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="staywise")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(option, required=True)
        return command

    add("inspect", "--data-root")
    add("qc", "--data-root", "--out")
    cohort = add("cohort", "--data-root", "--out")
    baseline = add("baseline", "--data-root", "--metrics-out")
    sequence = add("sequence-baseline", "--data-root", "--metrics-out")
    evaluate = add("evaluate-predictions", "--predictions", "--out")
    curve = add("decision-curve", "--predictions", "--out")
    switch = argparse.BooleanOptionalAction
    for command in (cohort, baseline, sequence):
        command.add_argument("--min-age", type=int, default=18)
        command.add_argument("--require-icu-location", action=switch, default=True)
    for command, hours in ((baseline, float), (sequence, int)):
        command.add_argument("--model-out")
        command.add_argument("--window-hours", type=hours, default=hours(24))
        command.add_argument("--seed", type=int, default=42)
        command.add_argument("--include-hospice", action=switch, default=False)
        command.add_argument("--outcome", default="mortality")
        command.add_argument("--los-threshold-hours", type=float, default=168.0)
    baseline.add_argument("--test-size", type=float, default=0.2)
    baseline.add_argument("--feature-set", default="basic")
    baseline.add_argument("--trees", type=int, default=200)
    sequence.add_argument("--use-pos-weight", action=switch, default=False)
    sequence.add_argument("--patience", type=int, default=3)
    for command in (evaluate, curve):
        command.add_argument("--label-col", default="in_hospital_mortality")
        command.add_argument("--score-col", default="predicted_risk")
    evaluate.add_argument("--subgroup-cols", nargs="*", default=[])
    evaluate.add_argument("--calibration-bins", type=int, default=10)
    curve.add_argument("--thresholds", nargs="*", type=float)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("staywise").getOrCreate()
    if args.command in ("evaluate-predictions", "decision-curve"):
        frame = read_predictions(spark, args.predictions, [args.label_col, args.score_col])
        if args.command == "decision-curve":
            sections = reports.decision_report(frame, args.label_col, args.score_col, args.thresholds)
        else:
            sections = reports.evaluation_report(
                frame, args.label_col, args.score_col, args.subgroup_cols, args.calibration_bins
            )
        reports.write_report(sections, args.out)
        return

    catalog = TableCatalog.discover(spark, args.data_root)
    if args.command == "inspect":
        catalog.inventory().show(len(catalog), truncate=False)
        contract_report(catalog).show(truncate=False)
        return
    if args.command == "qc":
        reports.write_json(qc_report(catalog), args.out)
        return
    spec = CohortSpec(args.min_age, args.require_icu_location)
    if args.command == "cohort":
        reports.write_cohort(adult_icu_cohort(catalog, spec), args.out)
        return
    shared = dict(
        window_hours=args.window_hours,
        seed=args.seed,
        include_hospice=args.include_hospice,
        outcome=args.outcome,
        los_threshold_hours=args.los_threshold_hours,
    )
    if args.command == "baseline":
        report = run_baseline(
            catalog, spec, test_size=args.test_size, feature_set=args.feature_set, trees=args.trees, **shared
        )
    else:
        report = run_sequence_baseline(
            catalog, spec, use_pos_weight=args.use_pos_weight, patience=args.patience, **shared
        )
    reports.write_run(spark, report, args.metrics_out, args.data_root)
    if args.model_out:
        save_model(report.models[report.chosen].model, args.model_out)


if __name__ == "__main__":
    main()
