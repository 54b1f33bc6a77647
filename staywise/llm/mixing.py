"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole and fractional repetitions.

The size of a document is its number of words. Sources in code-point order (null last) get the weights in turn and
share the total size by weight; no source gets more than ``max_epochs`` times what it has, and what it cannot take
goes to the others by weight until nobody is above. A source that must give 2.4 times its size gives every document
twice and four tenths of its words once more: documents are visited from large to small, and one is taken again
when what the source still owes reaches a seeded share of its size, so that what remains owed shrinks with the
documents. Large sources are split by hash into blocks that are visited side by side.

Null and empty texts have size 0. Equal sizes are ordered by the hash of the key. An empty table gives no rows. Rows
that repeat a key, or have none, are planned each for itself: those of one source and size are interchangeable, so they are
counted and numbered, and the number spreads them over the blocks. ``repeat`` gives all rows of a key the largest number of
repetitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import in_batches, materialize, missing, packed

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 20
#: Documents of a source that are visited one after the other.
BLOCK_DOCS = 4000
#: Sources are looked up by broadcast up to so many, by a shuffled join beyond.
FEW_SOURCES = 50_000


def sizes(frame: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, source, size): words of every whole text."""
    missing(frame, key, text, source)
    schema = T.StructType([frame.schema[key], T.StructField("source", T.StringType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes part at the blanks of ASCII only.
            own = [len((t.as_py() or "").encode().split()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64())], names=schema.names)

    return in_batches(frame).select(
        F.col(f"`{key}`"), F.col(f"`{source}`").cast("string"), F.col(f"`{text}`").cast("string")
    ).mapInArrow(run, schema)


def targets(counted: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Rows (source, docs, source_size, target) from rows (source, size); only sums reach the driver."""
    sources = counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    # A global order without one task for all: ids rise with the partition, whose counts give the offsets.
    placed = materialize(sources.orderBy(F.asc_nulls_last("source")).withColumn("_id", F.monotonically_increasing_id()))
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before, seen = {}, 0
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):
        before[p], seen = seen, seen + n
    if not before:
        return placed.select("source", "docs", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), part.cast("long"))
    turn = F.pmod(offset + within, F.lit(len(weights))).cast("int")
    weighed = placed.select(
        "source", "docs", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level) if clamped >= 0 else F.lit(False)
        held = weighed.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if held[0] == clamped or not held[2]:
            break
        clamped, level = held[0], max(level, (total - held[1]) / held[2])
    return weighed.select("source", "docs", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def plan(
    frame: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Rows (key, source, size, source_size, target, repeats, taken) for every row of the frame."""
    counted = materialize(sizes(frame, key, text, source))
    per_source = materialize(targets(counted, weights, max_epochs))
    few = per_source.count() <= FEW_SOURCES
    right = per_source.select(F.col("source").alias("_source"), "docs", "source_size", "target")
    equal = counted.groupBy(F.col(f"`{key}`"), "source", "size").agg(F.count(F.lit(1)).alias("_equal"))
    counted = equal.withColumn("_number", F.explode(F.sequence(F.lit(1), F.col("_equal").cast("int"))))
    joined = counted.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source")))
    mark = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), "_number")
    rows = joined.select(
        F.col(f"`{key}`"), "source", "size", "source_size", "target", mark.alias("_mark"),
        F.pmod(mark, F.ceil(F.col("docs") / BLOCK_DOCS)).alias("_block"),
    )
    kind = frame.schema[key]
    schema = T.StructType([
        kind, *[T.StructField(n, t) for n, t in (
            ("source", T.StringType()), ("size", T.LongType()), ("source_size", T.LongType()),
            ("target", T.DoubleType()), ("repeats", T.LongType()), ("taken", T.LongType()),
        )]
    ])

    def visit(group: pa.Table) -> pa.Table:
        size = group.column("size").to_numpy()
        mark = group.column("_mark").to_numpy()
        source_size, target = group.column("source_size")[0].as_py(), group.column("target")[0].as_py()
        epochs = target / source_size if source_size else 0.0
        whole = int(epochs)
        share = epochs - whole
        chance = (mark.view(np.uint64) >> np.uint64(11)) / float(1 << 53)
        again = np.zeros(len(size), np.int64)
        owed = 0.0
        for i in np.lexsort((mark, -size)).tolist():
            n = int(size[i])
            owed += share * n
            if (owed > 0 and owed >= chance[i] * n) if n else chance[i] < share:
                again[i] = 1
                owed -= n
        repeats = whole + again
        return pa.table([
            *[group.column(c) for c in (kind.name, "source", "size", "source_size", "target")],
            pa.array(repeats), pa.array(repeats * size),
        ], names=schema.names)

    return rows.groupBy("source", "_block").applyInArrow(visit, schema)


def repeat(frame: DataFrame, planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The frame with each row as often as the plan says."""
    times = planned.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max("repeats").cast("int").alias("_times")).where("_times > 0")
    rows = packed(frame).join(times, F.col("_row")[key].eqNullSafe(F.col("_key")))
    return rows.select("_row", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")


def mixture(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return plan(documents).select("doc_id", "size", "source_size", "target", "taken", "repeats")
