"""Plan-level helpers: size estimates, skew-proof joins, exact global running counts, reliable checkpoints."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# At least this many slices of the data: a key holding more than one slice is hot.
MIN_SLICES = 2048
# A global order is cut into buckets of about this many rows.
BUCKET_ROWS = 2_000_000


def skew_safe_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    how: str = "inner",
    salting: bool | None = None,
    hot_share: float | None = None,
) -> DataFrame:
    """Equi-join of a large frame with one row per key, safe when one key holds a large share of the rows.

    By default it is a plain join in which adaptive execution splits the partitions of hot keys at run time, also where
    what follows wants the same partitioning (that then moves partial aggregates once more, not rows): nothing is
    counted beforehand and the facts are read once. With ``salting=True`` keys above ``hot_share`` of all rows, of which there
    are fewer than ``1 / hot_share``, are counted exactly and cut into slices in proportion to their rows; facts go
    to one slice, the matching dims row is copied to every slice. That needs no adaptive execution, but one more pass.
    Results do not depend on it.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, got {how!r}")
    if not salting:
        if salting is None:
            facts.sparkSession.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        return facts.join(dims, key, how)

    sizes = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = hot_share or 1.0 / max(MIN_SLICES, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = sizes.agg(F.sum("_rows").alias("_all")).select(F.col("_all") * share).scalar()
    hot = sizes.where(F.col(key).isNotNull() & (F.col("_rows") > limit)).select(
        key, F.ceil(F.col("_rows") / limit).cast("int").alias("_slices")
    )
    lookup = F.broadcast(hot)
    # Content plus map partition: distinct rows spread by content, exact copies by where they were read.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns], F.spark_partition_id()), F.col("_slices"))
    sliced_facts = (
        facts.join(lookup, key, "left")
        .withColumn("_slice", F.when(F.col("_slices").isNull(), 0).otherwise(spread).cast("int"))
        .drop("_slices")
    )
    sliced_dims = (
        dims.join(lookup, key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    return sliced_facts.join(sliced_dims, [key, "_slice"], how).drop("_slice")


def _cuts(counts: DataFrame, order: str, buckets: int | None) -> list[float]:
    """Inner bucket limits near the quantiles of ``order``; none when one task can order everything."""
    if buckets is None:
        buckets = -(-counts.count() // BUCKET_ROWS)
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    return sorted(set(counts.approxQuantile(order, shares, 0.25 / buckets)))


def running_counts(
    counts: DataFrame,
    order: str,
    totals: list[str],
    by: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``below_<c>`` = exact sum of ``c`` over the rows of the same group with a smaller ``order``.

    Rows must be unique per (by, order). Large inputs are cut at approximate quantiles of ``order`` so that
    no task sorts everything: totals per bucket give the offsets, a window inside each bucket the rest. Where
    the cuts fall does not change the result, and they are fixed as literals before the plan is built.
    """
    by = list(by or [])
    if buckets is None:
        counts = materialize(counts)  # counted, cut and read again: the source is scanned once
    cuts = _cuts(counts, order, buckets)
    if not cuts:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"below_{c}") for c in totals]
        )

    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(counts)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_BUCKETS rows per group, whatever the size of the input.
    offsets = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in totals])
    offsets = offsets.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in totals]
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = bucketed.select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{c}") for c in totals]
    )
    joined = inside.join(offsets, [*by, "_bucket"])
    return joined.select(
        *counts.columns, *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"below_{c}") for c in totals]
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; where it is unset, one in the warehouse.

    The warehouse is a place that the driver and all executors share; one on the driver's own disk is refused on a
    cluster, whose executors could not read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not folder and warehouse.startswith("file:") and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on the driver's own disk")
        context.setCheckpointDir(folder or f"{warehouse}/_checkpoints")


def materialize(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors do not restart the scans."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
