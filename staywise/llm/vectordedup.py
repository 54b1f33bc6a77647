"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector kept per group.

Vectors that are equal and have the same label are one point with a count. Centroids are fitted on at most
SAMPLE points, chosen by hash; every point is then assigned to its PROBES nearest cells. Where that leaves more than
CELL_POINTS points to a cell, all cells are cut once more by what a vector has beside its centroid, with a second set
of centroids fitted on the same sample: a thousand and a thousand centroids make a million cells, so the number of
cells follows the number of points up to two billion of them. Points of one label and cell are compared by cosine in
double precision, in blocks, so that a cell of any size is cut into bounded tasks. A pair that meets in several cells
counts in the first common one only. A task returns, for each of its points, the number of links and one edge of a
spanning forest, never the pairs.

A pair is missed only if none of the nearest cells is common; tests measure the recall against brute force.
Vectors that are null, empty, zero or hold null or non-finite components, and rows without id or label, link with
nothing: no links, a component of their own, kept. Vectors of different lengths do not link. Every row counts as a
vector of its own, also if an id repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import materialize, missing
from staywise.llm.components import Forest, connected

THRESHOLD = 0.98
#: Points on which centroids are fitted, at most (expected number), and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12
#: Cells are made so that a cell has about this many points; centroids of one level, at most.
CELL_POINTS, LARGEST_K = 2000, 1000
#: Nearest cells in which a point is compared, and in each the nearest cells of the second level if there is one.
PROBES, INNER_PROBES = 3, 2
#: Points of a block; two blocks are compared in one task.
BLOCK = 2048
#: Hot cells are looked up by broadcast up to so many, by a shuffled join beyond.
HOT_CELLS = 50_000


def _padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values[:width]
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components must stay finite.
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids: each is the direction of the sum of the unit points nearest to it by cosine."""
    points = _unit(points)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(points, 1 + len(points) // 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def cells_for(points: int, sample: int) -> tuple[int, int]:
    """Centroids of both levels; one of the second level stands for none."""
    most = min(LARGEST_K, max(1, sample // 10))
    first = min(most, max(1, -(-points // CELL_POINTS)))
    return first, min(most, max(1, -(-points // (CELL_POINTS * first))))


def _beside(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """What unit vectors have at right angles to the unit centroid of the same row."""
    return unit - (unit * centres).sum(axis=1, keepdims=True) * centres


def _inner_nearest(rest: np.ndarray, inner: np.ndarray, most: int) -> np.ndarray:
    """The nearest centroids of the second level, by distance: what lies near its own centroid has no direction."""
    return np.argsort((inner * inner).sum(axis=1) / 2 - rest @ inner.T, axis=1, kind="stable")[:, :most]


def inner_kmeans(rest: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Centroids of the second level: each is the mean of the rests nearest to it."""
    inner = rest[np.random.default_rng(seed).choice(len(rest), min(k, len(rest)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([_inner_nearest(part, inner, 1)[:, 0] for part in np.array_split(rest, 1 + len(rest) // 4096)])
        sums, sizes = np.zeros_like(inner), np.bincount(nearest, minlength=len(inner))[:, None]
        np.add.at(sums, nearest, rest)
        inner = np.where(sizes > 0, sums / np.maximum(sizes, 1), inner)
    return inner


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, inner: np.ndarray | None) -> np.ndarray:
    """Numbers of the nearest cells of each vector, one column for each."""
    unit = _unit(vectors)
    near = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :PROBES]
    if inner is None:
        return near.astype(np.int32)
    columns = [near[:, [c]] * len(inner) + _inner_nearest(_beside(unit, centres[near[:, c]]), inner, INNER_PROBES) for c in range(near.shape[1])]
    return np.concatenate(columns, axis=1).astype(np.int32)


def _takes_part(key: str, vector: str, label: str) -> Column:
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.coalesce(good, F.lit(False))


def _points(frame: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows that take part as (id, label, s1, s2), points as (point, label, s1, s2, n, v))."""
    rows = frame.where(_takes_part(key, vector, label))
    v = F.col(f"`{vector}`").cast("array<double>")
    named = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    hashed = named.select("id", "label", F.xxhash64("v").alias("s1"), F.xxhash64(F.lit(7), "v").alias("s2"), "v")
    points = hashed.groupBy("label", "s1", "s2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    # An id may stand on several vectors: a point is named by its smallest id and, to tell it apart, what it is.
    return hashed.drop("v"), materialize(points.withColumn("point", F.struct("id", "label", "s1", "s2")).drop("id"))


def _assigned(points: DataFrame) -> DataFrame:
    """(group, point, n, v, cells) rows, one for each of a point's cells; group names label, length and cell."""
    total = points.count()
    share = min(1.0, SAMPLE / max(1, total))
    chosen = points.where(F.pmod(F.xxhash64("s1", "s2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    sample = [np.asarray(x.as_py()) for x in chosen.column("v")]
    width = max(map(len, sample), default=1)
    centres, inner = np.ones((1, width)) / np.sqrt(width), None
    if sample:
        first, second = cells_for(total, len(sample))
        unit = _unit(_padded(sample, width))
        centres = spherical_kmeans(unit, first)
        if second > 1:
            own = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(unit, 1 + len(unit) // 4096)])
            inner = inner_kmeans(_beside(unit, centres[own]), second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(x) for x in batch.column(2).to_pylist()]
            if not vectors:
                continue
            parts = range(0, len(vectors), 2048)
            near = np.concatenate([nearest_cells(_padded(vectors[i : i + 2048], width), centres, inner) for i in parts])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(list(near)), batch.column(3)],
                names=["point", "n", "v", "cells", "label"],
            )

    kind = points.schema["label"].dataType.simpleString()
    id_kind = points.schema["point"].dataType.simpleString()
    placed = points.select("point", "n", "v", "label").mapInArrow(
        run, f"point {id_kind}, n long, v array<double>, cells array<int>, label {kind}"
    )
    return placed.select("point", "n", "v", "cells", "label", F.size("v").alias("width"), F.explode("cells").alias("cell"))


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """(point, links, root): links found and an edge to another point of the task, for each point and task."""
    group = ["label", "width", "cell"]
    hot = materialize(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
        .withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int")).drop("_n")
    )
    count = hot.count()
    rows = rows.join(F.broadcast(hot) if count <= HOT_CELLS else hot, group, "left") if count else rows.withColumn("_blocks", F.lit(1))
    blocks = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64("point"), blocks).cast("int")
    # Block i meets block j in the task (min, max): a point goes to as many tasks as its cell has blocks.
    tasks = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = tasks.select(
        *group, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "point", "n", "v", "cells"
    )

    def compare(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        unit = _unit(np.asarray(flat, float).reshape(table.num_rows, -1))
        own, cell = table.column("own").to_numpy(), table.column("cell")[0].as_py()
        cells = np.array(table.column("cells").to_pylist())
        weight = table.column("n").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links, forest = np.zeros(table.num_rows, np.int64), Forest(table.num_rows)
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = np.nonzero(unit[some] @ unit[right].T >= threshold)
            i, j = some[i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            # The first common cell counts the pair.
            shared = (cells[i][:, :, None] == cells[j][:, None, :]).any(axis=2)
            first = np.where(shared, cells[i], np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max)
            i, j = i[first == cell], j[first == cell]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            forest.union(i, j)
        touched = np.flatnonzero(links)
        names = table.column("point").take(pa.array(touched))
        roots = table.column("point").take(pa.array(forest.parent[touched]))
        return pa.table({"point": names, "links": pa.array(links[touched]), "root": roots})

    kind = rows.schema["point"].dataType.simpleString()
    return tasks.groupBy(*group, "low", "high").applyInArrow(compare, f"point {kind}, links long, root {kind}")


def near_duplicates(
    frame: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Rows (key, n_links, component, kept) for every row of the frame."""
    missing(frame, key, vector, label)
    rows, points = _points(frame, key, vector, label)
    found = materialize(_linked(_assigned(points), threshold))
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    groups = connected(found, "point", "root").select(F.col("node").alias("point"), "root")
    known = materialize(
        points.select("label", "s1", "s2", "point", "n").join(counts, "point", "left").join(groups, "point", "left").select(
            "label", "s1", "s2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("root", "point").getField("id").alias("component"),
        )
    )
    linked = rows.join(known, ["label", "s1", "s2"]).select("id", "links", "component")
    alone = frame.where(~_takes_part(key, vector, label)).select(
        F.col(f"`{key}`").alias("id"), F.lit(0).cast("long").alias("links"), F.col(f"`{key}`").alias("component")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), "component",
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def groups(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(embeddings).withColumnRenamed("component", "component_id")
