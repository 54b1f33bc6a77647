"""Row counts and missingness, one aggregation pass per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.functions.columns import ref
from staywise.sources.catalog import TableCatalog

def table_profile(catalog: TableCatalog, name: str, max_columns: int | None = None) -> DataFrame:
    """One row: sizes, columns and a map of null counts over all columns, or the first ``max_columns`` of them.

    NaN is not null.
    """
    frame = catalog[name]
    inspected = frame.columns[:max_columns]
    counted = frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(ref(c).isNull()).alias(f"null_{i}") for i, c in enumerate(inspected)],
    )
    nulls = (
        F.create_map(*[part for i, c in enumerate(inspected) for part in (F.lit(c), F.col(f"null_{i}"))])
        if inspected
        else F.create_map().cast("map<string,bigint>")
    )
    return counted.select(
        F.lit(name).alias("table"),
        F.lit(catalog.paths.get(name)).cast("string").alias("path"),
        "n_rows",
        F.lit(len(frame.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in frame.columns]).cast("array<string>").alias("columns"),
        nulls.alias("missing_first_columns"),
        F.lit(len(inspected) < len(frame.columns)).alias("missing_truncated"),
        F.lit(len(inspected)).alias("missing_inspected"),
    )


def qc_report(catalog: TableCatalog, max_columns: int | None = None) -> DataFrame:
    """Profiles of all tables in name order; each row also tells how many tables there are."""
    profiles = reduce(DataFrame.unionByName, [table_profile(catalog, name, max_columns) for name in catalog])
    return profiles.withColumn("n_tables", F.lit(len(catalog)))


def null_counts(report: DataFrame) -> DataFrame:
    """Long form of a QC report: one row per inspected column."""
    return report.select(
        "table", "n_rows", F.explode("missing_first_columns").alias("column", "n_null")
    ).select("table", "column", "n_null", "n_rows")


def missingness(report: DataFrame) -> DataFrame:
    """Columns that have nulls, with their share in percent; an empty table contributes nothing."""
    return (
        null_counts(report)
        .where(F.col("n_null") > 0)
        .withColumn("pct_null", F.round(F.col("n_null") / F.col("n_rows") * 100, 1))
    )
