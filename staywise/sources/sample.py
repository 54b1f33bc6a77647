"""Hospital tables derived from the sample star schema (``events`` and ``customer``).

A stay is one user in one seven-day block since 2024-01-01. Nothing is made up: every row comes from a
sample row, so the work of a query grows with the sample tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.vocab import PATIENT, STAY
from staywise.sources.catalog import TableCatalog

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def sample_catalog(spark: SparkSession, folder: str) -> TableCatalog:
    """The sample tables themselves."""
    return TableCatalog(spark, paths={name: f"{folder}/{name}.parquet" for name in TABLES})


def _choose(column: str, cases: dict[str, str], default: str | None) -> Column:
    picked = F
    for value, result in cases.items():
        picked = picked.when(F.col(column) == value, result)
    return picked.otherwise(F.lit(default).cast("string"))


def stay_events(spark: SparkSession, folder: str) -> DataFrame:
    week = F.expr("datediff(ts, timestamp_ntz'2024-01-01 00:00:00') div 7")
    stay = F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string"))
    return spark.read.parquet(f"{folder}/events.parquet").withColumn(STAY, stay)


def hospital_catalog(spark: SparkSession, folder: str) -> TableCatalog:
    events = stay_events(spark, folder)
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    stays = (
        events.groupBy(F.col("user_id").cast("string").alias(PATIENT), STAY)
        .agg(F.min("ts").alias("admission_dttm"), F.max("ts").alias("discharge_dttm"), last.alias("last_type"))
        .select(
            PATIENT,
            STAY,
            "admission_dttm",
            "discharge_dttm",
            F.when(F.col("last_type") != "view", _choose("last_type", {"error": "Expired", "signup": "Hospice"}, "Home"))
            .alias("discharge_category"),
        )
    )
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    frames = {
        "hospitalization": stays,
        "patient": customer.select(
            F.col("c_custkey").cast("string").alias(PATIENT),
            (10 + (F.col("c_custkey") * 7) % 80).alias("age"),
            F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("sex_category"),
        ),
        "adt": events.select(
            STAY, _choose("event_type", {"purchase": "Medical ICU"}, "Ward").alias("location_category")
        ),
        "vitals": events.select(
            STAY,
            F.col("ts").alias("recorded_dttm"),
            _choose(
                "event_type",
                {"click": "heart_rate", "view": "sbp", "purchase": "map", "error": "spo2", "signup": "temp_c"},
                None,
            ).alias("vital_category"),
            F.col("value").alias("vital_value"),
        ),
        "labs": events.select(
            STAY,
            F.col("ts").alias("lab_collect_dttm"),
            _choose("event_type", {"purchase": "sodium", "error": "lactate"}, "creatinine").alias("lab_category"),
            F.when(F.col("value") < 20, "<20").otherwise(F.col("value").cast("string")).alias("lab_value"),
            F.when(F.col("value") >= 20, F.col("value")).alias("lab_value_numeric"),
        ),
        "patient_assessments": events.where(F.col("event_type").isin("signup", "error")).select(
            STAY,
            F.col("ts").alias("recorded_dttm"),
            _choose("event_type", {"signup": "gcs_total"}, "RASS").alias("assessment_category"),
            (F.col("value") % 15).alias("numerical_value"),
        ),
        "respiratory_support": events.select(
            STAY,
            F.col("ts").alias("recorded_dttm"),
            _choose(
                "event_type",
                {"click": "High Flow NC", "view": "IMV", "error": "CPAP", "signup": "NIPPV"},
                "Nasal Cannula",
            ).alias("device_category"),
        ),
    }
    return TableCatalog(spark, frames=frames)


def event_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction rows with many distinct scores: event_id, label, score, subgroup."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("value") / 500).alias("score"),
        F.nullif(F.col("user_id") % 4, F.lit(3)).cast("string").alias("subgroup"),
    )


def lineitem_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction rows with heavy ties: label and score only."""
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lineitem.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 5 + F.col("l_tax") * 3).alias("score"),
    )
