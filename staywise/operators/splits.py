"""Patient-disjoint splits. Rows never move: a split is a function of the group's hash.

Random group splits order the groups by SHA-256 of "seed:group" and send the first ceil(share * groups) to the
held-out side. Only the cut hash is needed, so the rows are classified by one comparison each.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.functions.columns import hash_fraction, hash_hex, ref, require_columns
from staywise.functions.scale import materialize

DEFAULT_SEED = "stable-split-v1"
STRATIFY_ATTEMPTS = 32
# Groups are counted per leading hash digits; so many of them that a task orders about GROUPS_PER_TASK.
GROUPS_PER_TASK = 500_000


def assign_split(
    column: Column, train: float = 0.70, validation: float = 0.15, seed: str = DEFAULT_SEED
) -> Column:
    """'train', 'validation' or 'test' from an identifier alone; null stays null."""
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise ValueError("need train > 0, validation > 0 and train + validation < 1")
    share = hash_fraction(column, seed)
    return (
        F.when(share < F.lit(float(train)), "train")
        .when(share < F.lit(float(train + validation)), "validation")
        .when(share.isNotNull(), "test")
    )


def add_stable_split(
    frame: DataFrame,
    id_column: str,
    split_column: str = "split",
    train: float = 0.70,
    validation: float = 0.15,
    seed: str = DEFAULT_SEED,
) -> DataFrame:
    """Add a split column that depends on the identifier only, not on row order or on other rows."""
    require_columns(frame, [id_column], "stable split")
    return frame.withColumn(split_column, assign_split(ref(id_column), train, validation, seed))


@dataclass(frozen=True)
class _Cut:
    """Held-out side of one seed: every group whose hash is at most ``hash``."""

    seed: int
    hash: str
    rows: int
    positives: int


def _group_sizes(frame: DataFrame, group: str, label: str | None) -> DataFrame:
    """(g, rows, positives) per group, written once: the cuts read it several times."""
    positives = F.sum(ref(label).cast("bigint")) if label else F.lit(0).cast("bigint")
    return materialize(
        frame.groupBy(ref(group).alias("g")).agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(positives, F.lit(0)).alias("positives")
        )
    )


def _digits(groups: int) -> int:
    """Leading hash digits that part so many groups into runs one task orders."""
    return max(1, math.ceil(math.log(max(1, groups) / GROUPS_PER_TASK, 16)))


def _cuts(sizes: DataFrame, seeds: list[int], share: float) -> tuple[list[_Cut], int, int, int]:
    """Exact cut per seed, plus (groups, rows, positives) overall.

    First job: totals per (seed, hash prefix) tell which prefix holds the cut; the depth of the prefix follows the
    number of groups. Second job: only the groups under those prefixes are ordered, one window per seed.
    """
    digits = max(2, _digits(sizes.count()))
    hashed = sizes.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "h", F.sha2(F.concat(F.col("seed").cast("string"), F.lit(":"), F.coalesce(F.col("g").cast("string"), F.lit(""))), 256)
    )
    hashed = hashed.withColumn("prefix", F.substring("h", 1, digits))
    per_prefix = defaultdict(list)
    for row in (
        hashed.groupBy("seed", "prefix")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))
        .collect()
    ):
        per_prefix[row.seed].append(row)
    if not per_prefix:
        raise ValueError("cannot split empty data")
    first = per_prefix[seeds[0]]
    groups, rows, positives = (sum(getattr(r, k) for r in first) for k in ("n", "rows", "positives"))
    if groups == 1:
        return [], groups, rows, positives
    wanted = math.ceil(share * groups)

    located = []
    for seed, parts in per_prefix.items():
        before = [0, 0, 0]
        for part in sorted(parts, key=lambda r: r.prefix):
            if before[0] + part.n >= wanted:
                located.append((seed, part.prefix, wanted - before[0], before[1], before[2]))
                break
            before = [before[0] + part.n, before[1] + part.rows, before[2] + part.positives]
    cut_prefixes = sizes.sparkSession.createDataFrame(
        located, "seed int, prefix string, need int, rows_before bigint, positives_before bigint"
    )
    order = Window.partitionBy("seed").orderBy("h")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        hashed.join(F.broadcast(cut_prefixes), ["seed", "prefix"])  # one row per seed
        .select(
            "seed",
            "h",
            "need",
            F.row_number().over(order).alias("position"),
            (F.sum("rows").over(upto) + F.col("rows_before")).alias("rows"),
            (F.sum("positives").over(upto) + F.col("positives_before")).alias("positives"),
        )
        .where("position = need")
        .collect()
    )
    found = [_Cut(c.seed, c.h, c.rows, c.positives) for c in cuts]
    return sorted(found, key=lambda c: c.seed), groups, rows, positives


def _held_out(group: str, cut: _Cut) -> Column:
    return hash_hex(F.coalesce(ref(group).cast("string"), F.lit("")), cut.seed) <= F.lit(cut.hash)


def _require_share(share: float) -> None:
    if not 0 < share < 1:
        raise ValueError(f"the held-out share must lie strictly between 0 and 1, got {share}")


def group_train_test_split(
    frame: DataFrame,
    group: str,
    test_size: float = 0.2,
    seed: int = 42,
    label: str | None = None,
    stratify: bool = False,
    split_column: str = "split",
) -> DataFrame:
    """Add 'train'/'test' so that no group is on both sides; ``test_size`` is a share of groups.

    A single group goes to train. ``stratify`` tries 32 consecutive seeds and keeps the one whose test
    prevalence is closest to the overall one (the earliest on ties), skipping folds without a positive.
    """
    _require_share(test_size)
    require_columns(frame, [group] + ([label] if stratify and label else []), "group split")
    if stratify and label is None:
        raise ValueError("stratify needs a label column")
    seeds = list(range(seed, seed + STRATIFY_ATTEMPTS)) if stratify else [seed]
    cuts, groups, rows, positives = _cuts(_group_sizes(frame, group, label if stratify else None), seeds, test_size)
    if groups == 1:
        return frame.withColumn(split_column, F.lit("train"))
    if stratify:
        usable = [c for c in cuts if c.positives > 0]
        if not usable:
            raise ValueError(
                f"stratify: no positives in the test fold after {STRATIFY_ATTEMPTS} seeds; use a larger test share"
            )
        overall = positives / rows
        cut = min(usable, key=lambda c: abs(c.positives / c.rows - overall))
    else:
        cut = cuts[0]
    return frame.withColumn(split_column, F.when(_held_out(group, cut), "test").otherwise("train"))


def three_way_split(
    frame: DataFrame,
    group: str,
    seed: int = 42,
    test_size: float = 0.15,
    validation_size: float = 0.15,
    split_column: str = "split",
) -> DataFrame:
    """Add 'train'/'validation'/'test' by group: test first with ``seed``, then validation out of the rest
    with ``seed + 1`` and its share rescaled to the whole."""
    _require_share(test_size)
    _require_share(validation_size)
    sizes = _group_sizes(frame, group, None)
    cuts, groups, _, _ = _cuts(sizes, [seed], test_size)
    if groups < 3:
        raise ValueError(f"a three-way split needs at least 3 groups, found {groups}")
    test = _held_out(group, cuts[0])
    rest = sizes.where(~(hash_hex(F.coalesce(F.col("g").cast("string"), F.lit("")), seed) <= F.lit(cuts[0].hash)))
    inner, left, _, _ = _cuts(rest, [seed + 1], validation_size / (1.0 - test_size))
    validation = _held_out(group, inner[0]) if left > 1 else F.lit(False)
    return frame.withColumn(
        split_column, F.when(test, "test").when(validation, "validation").otherwise("train")
    )


def greedy_shares(histogram: Sequence[tuple[int, int]], folds: int) -> dict[int, list[int]]:
    """How many groups of each size every fold gets when the largest group left always goes to the lightest fold.

    ``histogram`` holds (size, groups of that size). Groups of one size are interchangeable: a fold with ``load`` rows
    offers places at load, load + size, load + 2 * size, ..., and the cheapest places over all folds are taken, the
    first fold among equals. The limit below which all places are taken is found by bisection, so the work grows with
    the number of distinct sizes and not with the number of groups.
    """
    loads = [0] * folds
    shares = {}
    for size, groups in sorted(histogram, reverse=True):

        def below(limit: int, size: int = size) -> list[int]:
            return [max(0, -((load - limit) // size)) for load in loads]

        low, high = min(loads), max(loads) + groups * size + 1
        while high - low > 1:  # most places that lie below a limit without exceeding the groups
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= groups else (low, middle)
        taken = below(low)
        left = groups - sum(taken)
        for fold, load in enumerate(loads):
            if left and low >= load and (low - load) % size == 0:
                taken[fold] += 1
                left -= 1
        shares[size] = taken
        loads = [load + n * size for load, n in zip(loads, taken, strict=True)]
    return shares


def group_kfold(frame: DataFrame, group: str, n_splits: int = 5, fold_column: str = "fold") -> DataFrame:
    """Add the test fold 0..n_splits-1 of each row; whole groups, folds balanced by rows, no seed.

    Groups are dealt largest first, each to the fold with the fewest rows so far. Only a histogram of group sizes,
    which has fewer rows than the square root of twice the table, is dealt on the driver; it says how many groups of
    a size each fold gets. Which ones they are follows from their exact rank by the hash of their text among groups of
    that size. The rank needs no global order: groups are counted per leading hash digits, running totals of these
    counts give the offsets, and only the groups under one size and one run of digits are ordered in a task.
    """
    if n_splits < 2:
        raise ValueError(f"n_splits must be at least 2, got {n_splits}")
    require_columns(frame, [group], "k-fold")
    text = F.coalesce(ref(group).cast("string"), F.lit(""))
    sizes = materialize(
        frame.groupBy(ref(group).alias("_g"), hash_hex(text, DEFAULT_SEED).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    )
    histogram = [tuple(r) for r in sizes.groupBy("_n").agg(F.count(F.lit(1))).collect()]
    total = sum(n for _, n in histogram)
    if not total:
        raise ValueError("cannot split empty data")
    if total < n_splits:
        raise ValueError(f"cannot make {n_splits} folds from {total} groups")
    # Of the groups of one size the first ranks go to fold 0, the next to fold 1 and so on.
    ends = [(size, list(itertools.accumulate(n))) for size, n in greedy_shares(histogram, n_splits).items()]
    limits = frame.sparkSession.createDataFrame(ends, "_n bigint, _ends array<bigint>")
    digits = _digits(max(n for _, n in histogram))
    placed = sizes.withColumn("_p", F.substring("_h", 1, digits))
    before = Window.partitionBy("_n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_groups"))
    offsets = parts.select("_n", "_p", F.coalesce(F.sum("_groups").over(before), F.lit(0)).alias("_offset")).join(limits, "_n")
    # Equal hashes mean equal texts: such groups (null and the empty text) keep a fixed order by being null or not.
    within = Window.partitionBy("_n", "_p").orderBy("_h", F.col("_g").isNull())
    ranked = placed.join(offsets, ["_n", "_p"]).select(
        "_g", "_ends", (F.col("_offset") + F.row_number().over(within) - 1).alias("_rank")
    )
    fold = F.expr("size(filter(_ends, e -> e <= _rank))")
    folds = materialize(ranked.select("_g", fold.cast("int").alias("_fold")))
    # Both sides are plain shuffles, so that adaptive execution may split a hot group.
    joined = frame.join(folds, ref(group).eqNullSafe(F.col("_g")))
    return joined.select(*[ref(c) for c in frame.columns if c != fold_column], F.col("_fold").alias(fold_column))


def split_summary(
    frame: DataFrame, group: str, label: str, split_column: str = "split"
) -> DataFrame:
    """Rows, distinct groups and prevalence per side."""
    # Two steps instead of a distinct count, so one very large group is combined before it is shuffled.
    per_group = frame.groupBy(split_column, ref(group).alias("g")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(ref(label).cast("bigint")).alias("positives")
    )
    return per_group.groupBy(split_column).agg(
        F.sum("rows").alias("n"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.sum("positives") / F.sum("rows")).alias("prevalence"),
    )
