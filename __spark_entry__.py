"""

Doubles are rounded to six places and integers widened to bigint on both sides.
"""

from __future__ import annotations

import importlib.util
import os
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_sql import ORACLES
from staywise.functions.scale import ensure_checkpoint_dir, materialize
from staywise.functions.vocab import ANCHOR, OPTIONAL_CONTRACTS, PATIENT, STAY, VITAL_CATEGORIES
from staywise.operators import cohort as co
from staywise.operators import contracts as ct
from staywise.operators import evaluation as ev
from staywise.operators import labels as lb
from staywise.operators import models as md
from staywise.operators import qc
from staywise.operators import sequences as sq
from staywise.operators import splits as sp
from staywise.operators import windows as wi
from staywise.plans import matrix as mx
from staywise.plans import reports as rp
from staywise.plans.baseline import run_baseline, run_sequence_baseline
from staywise.sources.catalog import TableCatalog
from staywise.sources.predictions import read_predictions
from staywise.sources.sample import (
    event_predictions,
    hospital_catalog,
    lineitem_predictions,
    sample_catalog,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

SAMPLE_CONTRACTS = {
    "events": {"event_id", "user_id", "ts", "value"},
    "customer": {"c_custkey", "c_birth_date"},
    "admissions": {"hospitalization_id", "patient_id"},
}
EVENT_SOURCES = sq.rich_sources(
    ("heart_rate", "sbp", "map", "spo2", "temp_c"),
    ("sodium", "lactate", "creatinine"),
    ("gcs_total", "RASS"),
)


def _tidy(frame: DataFrame) -> DataFrame:
    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.round(column.cast("double"), 6).alias(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return column.cast("bigint").alias(field.name)
        return column

    return frame.select(*[plain(f) for f in frame.schema])


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = lambda spark, folder: _tidy(build(spark, folder))
    return build


def _cohort(catalog: TableCatalog) -> DataFrame:
    return co.adult_icu_cohort(catalog)


def _labelled(catalog: TableCatalog) -> DataFrame:
    return _cohort(catalog).join(lb.outcome_labels(catalog, validate=False), STAY)


# Catalog, contracts, QC


@_query
def table_inventory(spark, folder):
    return sample_catalog(spark, folder).inventory().select("table", "n_columns")


@_query
def contract_validation(spark, folder):
    return ct.contract_report(sample_catalog(spark, folder), SAMPLE_CONTRACTS)


@_query
def contract_validation_optional(spark, folder):
    return ct.contract_report(hospital_catalog(spark, folder), OPTIONAL_CONTRACTS)


@_query
def qc_table_summary(spark, folder):
    report = qc.qc_report(sample_catalog(spark, folder))
    return report.select("table", "n_rows", "n_columns", "missing_truncated", "missing_inspected")


@_query
def qc_table_summary_truncated(spark, folder):
    """The same with the inspection limited to five columns of each table."""
    report = qc.qc_report(sample_catalog(spark, folder), max_columns=5)
    return report.select("table", "n_rows", "n_columns", "missing_truncated", "missing_inspected")


@_query
def qc_table_count(spark, folder):
    """Number of tables of the report, beside what it counts over all of them."""
    report = qc.qc_report(sample_catalog(spark, folder))
    return report.groupBy("n_tables").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_columns").alias("n_columns"))


@_query
def discovered_tables(spark, folder):
    """Tables found in the folder by their file names."""
    return TableCatalog.discover(spark, folder).inventory().select("table", "n_columns")


@_query
def qc_null_counts(spark, folder):
    return qc.null_counts(qc.qc_report(hospital_catalog(spark, folder)))


@_query
def qc_missingness_pct(spark, folder):
    return qc.missingness(qc.qc_report(hospital_catalog(spark, folder)))


# Cohort


@_query
def cohort_adult_icu(spark, folder):
    return _cohort(hospital_catalog(spark, folder))


@_query
def cohort_no_icu(spark, folder):
    return co.adult_icu_cohort(hospital_catalog(spark, folder), co.CohortSpec(40, require_icu_location=False))


@_query
def cohort_waterfall(spark, folder):
    return co.cohort_with_waterfall(hospital_catalog(spark, folder))[1]


@_query
def cohort_waterfall_skipped(spark, folder):
    whole = hospital_catalog(spark, folder)
    bare = {"hospitalization": whole["hospitalization"], "patient": whole["patient"].drop("age")}
    return co.cohort_with_waterfall(TableCatalog(spark, frames=bare))[1]


@_query
def cohort_waterfall_steps(spark, folder):
    return co.waterfall_steps(co.cohort_with_waterfall(hospital_catalog(spark, folder))[1])


# Labels


@_query
def label_mortality(spark, folder):
    return lb.mortality_labels(hospital_catalog(spark, folder))


@_query
def label_mortality_hospice(spark, folder):
    return lb.mortality_labels(hospital_catalog(spark, folder), include_hospice=True)


@_query
def label_los(spark, folder):
    return lb.long_stay_labels(hospital_catalog(spark, folder), threshold_hours=120.5)


@_query
def label_outcome_long_stay(spark, folder):
    """The outcome chosen by its name."""
    return lb.outcome_labels(hospital_catalog(spark, folder), "los_gt_7d", los_threshold_hours=120.5)


@_query
def label_derived(spark, folder):
    stays = hospital_catalog(spark, folder)["hospitalization"]
    died = F.when(F.col("discharge_category") == "Hospice", F.col("discharge_dttm"))
    return lb.derived_mortality(
        stays.withColumn("death_dttm", died), STAY, "discharge_category", "death_dttm"
    )


@_query
def label_balance(spark, folder):
    return lb.class_balance(_labelled(hospital_catalog(spark, folder)))


@_query
def censoring_guard(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return lb.drop_short_stays(_labelled(catalog), catalog, 24).select(STAY, "outcome")


# Windowed aggregation


@_query
def anchors(spark, folder):
    origin = "timestamp_ntz'1970-01-01 00:00:00'"
    micros = F.expr(f"timestampdiff(MICROSECOND, {origin}, {ANCHOR})")
    return wi.admission_anchors(hospital_catalog(spark, folder)).select(STAY, micros.alias("anchor_us"))


@_query
def agg_whole_stay(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return wi.whole_stay_stats(catalog, "labs", "labs", _cohort(catalog))


@_query
def agg_parse_quality(spark, folder):
    return wi.parse_quality(hospital_catalog(spark, folder)["labs"], "lab_value")


def _windowed(spark, folder, hours, table="vitals", salting=None):
    catalog = hospital_catalog(spark, folder)
    starts = wi.admission_anchors(catalog)
    return wi.windowed_stats(catalog, table, table, starts, hours, _cohort(catalog), salting=salting)


@_query
def agg_windowed_24h(spark, folder):
    return _windowed(spark, folder, 24)


@_query
def agg_windowed_72h(spark, folder):
    return _windowed(spark, folder, 72, "labs")


@_query
def agg_windowed_fractional_hours(spark, folder):
    return _windowed(spark, folder, 4.8)


@_query
def agg_windowed_salted(spark, folder):
    """The 72-hour window through the hot-key path, whatever the table sizes."""
    return _windowed(spark, folder, 72, "labs", salting=True)


@_query
def agg_per_category(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return wi.category_stats(
        catalog, "vitals", "vital_category", VITAL_CATEGORIES, "vitals_{category}",
        wi.admission_anchors(catalog), 72, _cohort(catalog),
    )


@_query
def resp_indicator(spark, folder):
    catalog = hospital_catalog(spark, folder)
    devices = ("IMV", "NIPPV", "High Flow NC", "Nasal Cannula", "CPAP", "Trach Collar")
    return wi.device_flags(catalog, devices, wi.admission_anchors(catalog), 24)


@_query
def matrix_basic(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return mx.basic_matrix(catalog, _cohort(catalog), wi.admission_anchors(catalog), 24).frame


@_query
def matrix_rich(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return mx.rich_matrix(catalog, _cohort(catalog), wi.admission_anchors(catalog), 24).frame


def _model_frame(spark, folder):
    catalog = hospital_catalog(spark, folder)
    labelled = _labelled(catalog)
    matrix = mx.basic_matrix(catalog, labelled, wi.admission_anchors(catalog), 24)
    return mx.model_frame(matrix, labelled)


@_query
def model_frame(spark, folder):
    return _model_frame(spark, folder)


# Sequences


@_query
def hourly_means(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return sq.hourly_means(
        catalog, "vitals", "vital_category", VITAL_CATEGORIES, wi.admission_anchors(catalog), 24, _cohort(catalog)
    )


@_query
def hourly_indicator(spark, folder):
    catalog = hospital_catalog(spark, folder)
    return sq.hourly_indicator(
        catalog, "respiratory_support", "device_category", ("IMV", "High Flow NC"),
        wi.admission_anchors(catalog), 24, _cohort(catalog),
    )


def _sequences(spark, folder, sources=None):
    catalog = hospital_catalog(spark, folder)
    return sq.build_sequences(catalog, _cohort(catalog), wi.admission_anchors(catalog), 24, sources, validate=False)


@_query
def hourly_grid_ffill(spark, folder):
    built = _sequences(spark, folder, EVENT_SOURCES)
    return built.grid.select(STAY, sq.HOUR, *built.channels)


@_query
def hourly_mask(spark, folder):
    built = _sequences(spark, folder, EVENT_SOURCES)
    return built.grid.select(STAY, sq.HOUR, *[f"mask_{c}" for c in built.numeric_channels])


@_query
def sequence_long(spark, folder):
    """The float arrays of all 26 channels, unnested: position is the channel number."""
    arrays = _sequences(spark, folder).arrays()
    return arrays.select(STAY, sq.HOUR, F.posexplode("features").alias("position", "value"))


@_query
def sequence_per_stay(spark, folder):
    """Shape and totals of the nested form."""
    nested = _sequences(spark, folder, EVENT_SOURCES).per_stay()
    observed = F.aggregate(F.flatten("mask"), F.lit(0).cast("bigint"), lambda total, m: total + m)
    total = F.aggregate(F.flatten("features"), F.lit(0.0), lambda s, x: s + x)
    return nested.select(
        STAY,
        F.size("features").alias("n_hours"),
        F.size(F.col("features")[0]).alias("n_channels"),
        F.size(F.col("mask")[0]).alias("n_masks"),
        observed.alias("n_observed"),
        F.round(total, 2).alias("feature_total"),
    )


# Splits


@_query
def stable_split(spark, folder):
    return sp.add_stable_split(hospital_catalog(spark, folder)["hospitalization"].select(STAY), STAY)


@_query
def stable_split_counts(spark, folder):
    stays = sp.add_stable_split(hospital_catalog(spark, folder)["hospitalization"], PATIENT, seed="audit")
    return stays.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _stay_outcomes(spark, folder):
    catalog = hospital_catalog(spark, folder)
    outcomes = lb.mortality_labels(catalog, validate=False)
    return catalog["hospitalization"].select(PATIENT, STAY).join(outcomes, STAY)


@_query
def group_split(spark, folder):
    return sp.group_train_test_split(hospital_catalog(spark, folder)["hospitalization"].select(PATIENT, STAY), PATIENT)


@_query
def group_split_stratified(spark, folder):
    return sp.group_train_test_split(
        _stay_outcomes(spark, folder), PATIENT, label="mortality", stratify=True
    ).select(STAY, "split")


@_query
def group_kfold(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id")
    return sp.group_kfold(events, "user_id", 5)


@_query
def group_kfold_small_groups(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_linenumber", "l_orderkey")
    return sp.group_kfold(lines, "l_orderkey", 5)


@_query
def three_way_split(spark, folder):
    return sp.three_way_split(hospital_catalog(spark, folder)["hospitalization"].select(PATIENT, STAY), PATIENT)


@_query
def split_summary(spark, folder):
    outcomes = sp.group_train_test_split(_stay_outcomes(spark, folder), PATIENT)
    return sp.split_summary(outcomes, PATIENT, "mortality")


# Evaluation


@_query
def clean_scores(spark, folder):
    """Rows that survive cleaning, after some labels and scores were made unusable."""
    raw = event_predictions(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 7 != 3, F.col("label")).alias("label"),
        F.when(F.col("event_id") % 10 == 0, float("nan"))
        .when(F.col("event_id") % 10 == 1, float("inf"))
        .when(F.col("event_id") % 10 == 2, F.col("score") * 1000)
        .otherwise(F.col("score"))
        .alias("score"),
    )
    return ev.clean_scores(raw, "label", "score").groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("events")
    )


@_query
def binary_metrics(spark, folder):
    return ev.binary_metrics(event_predictions(spark, folder), "label", "score")


@_query
def binary_metrics_bucketed(spark, folder):
    """The same numbers through the multi-bucket global order."""
    return ev.binary_metrics(event_predictions(spark, folder), "label", "score", buckets=16)


@_query
def auroc_ties(spark, folder):
    return ev.auroc(lineitem_predictions(spark, folder), "label", "score")


@_query
def average_precision(spark, folder):
    return ev.ranking_metrics(lineitem_predictions(spark, folder), "label", "score")


@_query
def calibration_equal_freq(spark, folder):
    return ev.calibration_bins(event_predictions(spark, folder), "label", "score")


@_query
def calibration_equal_freq_ties(spark, folder):
    return ev.calibration_bins(lineitem_predictions(spark, folder), "label", "score", n_bins=7, buckets=8)


@_query
def ece(spark, folder):
    return ev.expected_calibration_error(ev.calibration_bins(event_predictions(spark, folder), "label", "score"))


@_query
def reliability_deciles(spark, folder):
    return ev.reliability_deciles(lineitem_predictions(spark, folder), "label", "score")


@_query
def subgroup_metrics(spark, folder):
    predictions = event_predictions(spark, folder).withColumn("band", F.when(F.col("label") == 1, "event"))
    return ev.subgroup_metrics(predictions, "label", "score", ["subgroup", "band"])


@_query
def decision_curve(spark, folder):
    return ev.decision_curve(lineitem_predictions(spark, folder), "label", "score", [0.1, 0.25, 0.4, 0.6])


@_query
def net_benefit_default(spark, folder):
    return ev.decision_curve(event_predictions(spark, folder), "label", "score")


@_query
def calibration_slope(spark, folder):
    counts = ev.score_counts(event_predictions(spark, folder), "label", "score", clip=None)
    intercept, slope = ev.calibration_line(counts)
    return spark.createDataFrame([(intercept, slope)], "intercept double, slope double")


@_query
def evaluation_report(spark, folder):
    """All sections of the prediction report as typed rows."""
    sections = rp.evaluation_report(event_predictions(spark, folder), "label", "score", ["subgroup"])
    keys = {"calibration_bins": ["bin"], "subgroups": ["subgroup_col", "subgroup_value"]}
    return rp.long_report(sections, keys)


# Sinks and readers: written, read back, compared


def _scratch(spark, name):
    """A new place in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@_query
def cohort_csv(spark, folder):
    path = _scratch(spark, "cohort")
    cohort = _cohort(hospital_catalog(spark, folder))
    rp.write_cohort(cohort, path)
    return spark.read.csv(path, header=True, schema=cohort.schema)


@_query
def decision_report_json(spark, folder):
    """The decision report as it is written; NaN has become null on the way."""
    path = _scratch(spark, "decision")
    report = rp.decision_report(event_predictions(spark, folder), "label", "score")
    report = {"decision_curve": report["decision_curve"].withColumn("gap", F.lit(float("nan")))}
    rp.write_report(report, path)
    schema = report["decision_curve"].schema
    found = spark.read.schema(schema).json(f"{path}/decision_curve")
    return found.withColumn("gap", F.coalesce("gap", F.lit(0.0)))


@_query
def prediction_file(spark, folder):
    """Metrics of predictions that went through a CSV file."""
    path = _scratch(spark, "predictions") + ".csv"
    event_predictions(spark, folder).select("label", "score").write.csv(path, header=True)
    return ev.binary_metrics(read_predictions(spark, path, ["label", "score"]), "label", "score")


@_query
def read_with_limit(spark, folder):
    """The feature is the limit: any 7 rows of a table, all columns."""
    found = sample_catalog(spark, folder).read("events", 7)
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(found.columns)).alias("n_columns"))


@_query
def label_guards(spark, folder):
    """Does the guard on degenerate labels object to the labels, to their positives alone, to their negatives alone?"""
    outcomes = _stay_outcomes(spark, folder)
    objects = []
    for name, rows in (("all", outcomes), ("negatives", outcomes.where("mortality = 0")), ("positives", outcomes.where("mortality = 1"))):
        found = lb.class_balance(rows, "mortality").first()
        try:
            lb.require_two_classes(found.n_positive, found.n_positive + found.n_negative)
            objects.append((name, False))
        except ValueError:
            objects.append((name, True))
    return spark.createDataFrame(objects, "rows string, objects boolean")


# Models


@_query
def imputation_medians(spark, folder):
    frame = materialize(_model_frame(spark, folder))
    features = [c for c in frame.columns if c not in (STAY, PATIENT, "outcome")]
    found = md.exact_medians(frame, features)
    return spark.createDataFrame(list(found.items()), "feature string, median double")


@_query
def training_sides(spark, folder):
    """Rows, positives and total class weight of both sides, after the checks that a fit makes."""
    sides = sp.group_train_test_split(_model_frame(spark, folder), PATIENT)
    found = md.check_training_data(sides, "split")
    weight = F.lit(None).cast("double")
    for side, (n, positives) in found.items():
        weight = F.when(F.col("split") == side, md.class_weights("outcome", n, positives)).otherwise(weight)
    return sides.groupBy("split", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))


def _fitted(spark, folder, fit):
    frame = materialize(_model_frame(spark, folder))
    features = [c for c in frame.columns if c not in (STAY, PATIENT, "outcome")]
    sides = sp.group_train_test_split(frame, PATIENT)
    model = fit(sides.where("split = 'train'"), features)
    return md.predict(model, sides.where("split = 'test'")).select(STAY, "outcome", md.SCORE)


@_query
def logistic_design(spark, folder):
    """Mean and deviation of each imputed training feature, and the slope of the penalised loss at the fitted weights.

    The loss is strictly convex: weights at which every slope is zero are the solution.
    """
    frame = materialize(_model_frame(spark, folder))
    features = [c for c in frame.columns if c not in (STAY, PATIENT, "outcome")]
    train = sp.group_train_test_split(frame, PATIENT).where("split = 'train'")
    model = md.fit_logistic(train, features)
    scaler, fit = model.stages[-3], model.stages[-1]
    residual = vector_to_array("probability").getItem(1) - F.col("outcome")
    slopes = (
        model.transform(train)
        .select(residual.alias("r"), F.posexplode(vector_to_array("__features")).alias("i", "z"))
        .groupBy("i").agg(F.sum(F.col("r") * F.col("z")).alias("g"), F.count(F.lit(1)).alias("n"))
    )
    rows = [  # one per feature
        (features[r.i], float(scaler.mean[r.i]), float(scaler.std[r.i]) * ((r.n - 1) / r.n) ** 0.5,
         round(abs(r.g + float(fit.coefficients[r.i])) / r.n, 6))
        for r in slopes.collect()
    ]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double, slope double")


@_query
def logistic_baseline(spark, folder):
    return _fitted(spark, folder, md.fit_logistic)


def _training_side(spark, folder):
    frame = materialize(_model_frame(spark, folder))
    features = [c for c in frame.columns if c not in (STAY, PATIENT, "outcome")]
    return sp.group_train_test_split(frame, PATIENT).where("split = 'train'"), features


@_query
def feature_bins(spark, folder):
    """The cuts that the boosted trees may use, per feature of the training side."""
    train, features = _training_side(spark, folder)
    cuts = [(c, float(v)) for c, own in md.bin_cuts(train, features).items() for v in own]
    return spark.createDataFrame(cuts, "feature string, cut double")


@_query
def gbt_first_split(spark, folder):
    """Where the first tree splits all training rows, as its rows say: sizes of both sides and the fall of the variance."""
    train, features = _training_side(spark, folder)
    top = md.tree_splits(md.fit_boosted_trees(train, features, trees=1), features)[0]
    value = F.nanvl(F.col(top["feature"]).cast("double"), F.lit(None).cast("double"))
    left = F.lit(top["missing"] == "right") if top["cut"] is None else value < top["cut"]
    sides = train.groupBy(F.when(value.isNull(), top["missing"] == "left").otherwise(left).alias("left")).count()
    return sides.agg(
        F.lit(top["feature"]).alias("feature"), F.min("count").alias("n_smaller"), F.max("count").alias("n_larger"),
        F.lit(top["gain"]).alias("gain"),
    )


@_query
def gbt_leaf_means(spark, folder):
    """Boosting by its definition: a leaf of a tree predicts the mean of what the trees before it leave over.

    Per tree: training rows, and the largest gap between a leaf and that mean (zero if the trees are right).
    """
    train, features = _training_side(spark, folder)
    model = md.fit_boosted_trees(train, features, trees=8)
    boosted = model.stages[-1]
    frame = boosted.setLeafCol("leaf").transform(md.PipelineModel(model.stages[:-1]).transform(train))
    sign, so_far = F.col("outcome") * 2.0 - 1.0, F.lit(0.0)
    steps = []
    for i, (tree, weight) in enumerate(zip(boosted.trees, boosted.treeWeights, strict=True)):
        frame = tree.setPredictionCol(f"tree_{i}").setLeafCol("").transform(frame)
        left_over = sign if i == 0 else sign * 4.0 / (F.exp(sign * 2.0 * so_far) + 1.0)
        leaf = vector_to_array("leaf").getItem(i)
        steps.append(F.struct(F.lit(i).alias("tree"), leaf.alias("leaf"), F.col(f"tree_{i}").alias("said"), left_over.alias("r")))
        so_far = so_far + F.col(f"tree_{i}") * weight
    leaves = frame.select(F.inline(F.array(*steps))).groupBy("tree", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("said"))).alias("said"), F.abs(F.avg("r")).alias("r")
    )
    return leaves.groupBy("tree").agg(F.sum("n").alias("n"), F.round(F.max(F.abs(F.col("said") - F.col("r"))), 6).alias("gap"))


@_query
def gbt_baseline(spark, folder):
    return _fitted(spark, folder, lambda train, features: md.fit_boosted_trees(train, features))


@_query
def model_comparison(spark, folder):
    report = run_baseline(hospital_catalog(spark, folder), los_threshold_hours=120.0, outcome="los_gt_7d")
    return md.comparison(list(report.models.values()))


@_query
def comparison_table(spark, folder):
    """The six metrics of two sets of predictions, one row each."""
    sets = {"events": event_predictions(spark, folder), "lines": lineitem_predictions(spark, folder)}
    found = [
        md.scored(name, None, materialize(rows.select("label", F.col("score").cast("double").alias(md.SCORE))), "label")
        for name, rows in sets.items()
    ]
    return md.comparison(found)


@_query
def sequence_baseline(spark, folder):
    report = run_sequence_baseline(hospital_catalog(spark, folder))
    return md.comparison(list(report.models.values()))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: leakage-safe per-category feature matrix of the adult ICU cohort."""
    return _QUERIES["matrix_rich"](spark, "/root/testdata/sf0.001")


# The subpackage llm and the pipeline made of its operators may be absent; if they are there, a fault in them is one.
_LLM, _LLM_SQL = {}, {}
if importlib.util.find_spec("staywise.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline
    from staywise.llm.queries import ORACLES as LLM_ORACLES
    from staywise.llm.queries import QUERIES as LLM_QUERIES

    _LLM = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    _LLM_SQL = dict(LLM_ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        _LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def _ready(build: Query) -> Query:
    """Python workers find the package wherever the session was started."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        here = str(Path(__file__).resolve().parent)
        if here not in known:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])
        return build(spark, folder)

    return run


def queries() -> dict[str, Query]:
    return {name: _ready(build) for name, build in {**_QUERIES, **_LLM}.items()}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **_LLM_SQL}
