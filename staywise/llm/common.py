"""What several operators of this subpackage share: table access, bounded Arrow batches, skew-proof splitting."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.scale import ensure_checkpoint_dir

__all__ = ["chunks", "ensure_checkpoint_dir", "in_batches", "materialize", "missing", "packed", "table", "tidy"]

#: An Arrow batch for Python holds about so many bytes (one row at least), however long the texts are.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table, through Spark's reader whatever the store."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*[F.col(f"`{c}`") for c in columns]) if columns else frame


def in_batches(frame: DataFrame) -> DataFrame:
    """The frame, with batches for Python that are bounded in bytes."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame


def packed(frame: DataFrame) -> DataFrame:
    """One column ``_row`` that holds all columns, so that no name of theirs can clash with a helper column."""
    return frame.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in frame.columns]).alias("_row"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run inside remove their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint of the frame; the shuffle files that led to it are removed once it is written."""
    ensure_checkpoint_dir(frame.sparkSession)
    with tidy(frame.sparkSession):
        return frame.select("*").checkpoint(eager=True)


def missing(frame: DataFrame, *columns: str) -> None:
    """Raise when a column the operator needs is not there."""
    absent = [c for c in columns if c not in frame.columns]
    if absent:
        raise ValueError(f"columns {absent} not found in {frame.columns}")


def chunks(texts: Sequence[str | None], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about ``most`` characters in all; a longer text is a run of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 1
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
