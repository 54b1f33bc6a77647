import hashlib
import random
import math
from collections import Counter

import pytest

from staywise.operators.splits import (
    DEFAULT_SEED,
    add_stable_split,
    greedy_shares,
    group_kfold,
    group_train_test_split,
    split_summary,
    three_way_split,
)


def stays_of(spark, patients=50, each=2):
    return spark.range(patients * each).selectExpr(f"CAST(id % {patients} AS string) AS p", "id", "CAST(id % 5 = 0 AS int) AS y")


def sides(frame, column="split"):
    found = {}
    for row in frame.collect():
        found.setdefault(row[column], []).append(row.p)
    return found


def test_stable_split_follows_the_hash(spark):
    def expected(value):
        share = int(hashlib.sha256(f"{DEFAULT_SEED}:{value}".encode()).hexdigest()[:16], 16) / 16**16
        return "train" if share < 0.7 else "validation" if share < 0.7 + 0.15 else "test"

    found = add_stable_split(spark.range(300), "id").collect()
    assert all(r.split == expected(r.id) for r in found)
    assert {r.split for r in found} == {"train", "validation", "test"}
    nulls = add_stable_split(spark.createDataFrame([(None,)], "x string"), "x")
    assert nulls.first().split is None
    for bad in ({"train": 0.0}, {"train": 0.9, "validation": 0.1}, {"validation": 0}):
        with pytest.raises(ValueError):
            add_stable_split(spark.range(1), "id", **bad)
    with pytest.raises(ValueError, match="missing"):
        add_stable_split(spark.range(1), "nope")


def test_group_split_is_disjoint_exact_and_repeatable(spark):
    frame = stays_of(spark)
    found = sides(group_train_test_split(frame, "p", 0.2, 42))
    assert not set(found["train"]) & set(found["test"])
    assert len(set(found["test"])) == 10 and len(found["test"]) == 20
    again = sides(group_train_test_split(frame.repartition(3), "p", 0.2, 42))
    assert sorted(again["test"]) == sorted(found["test"])
    assert set(sides(group_train_test_split(frame, "p", 0.2, 43))["test"]) != set(found["test"])
    order = sorted({str(i) for i in range(50)}, key=lambda g: hashlib.sha256(f"42:{g}".encode()).hexdigest())
    assert set(found["test"]) == set(order[:10])


def test_group_split_edges(spark):
    assert set(sides(group_train_test_split(stays_of(spark, 1, 4), "p"))) == {"train"}
    with pytest.raises(ValueError, match="empty"):
        group_train_test_split(stays_of(spark).limit(0), "p")
    with pytest.raises(ValueError, match="strictly"):
        group_train_test_split(stays_of(spark), "p", 1.0)
    with pytest.raises(ValueError, match="missing"):
        group_train_test_split(stays_of(spark), "q")
    assert len(set(sides(group_train_test_split(stays_of(spark, 2, 2), "p"))["test"])) == 1


def test_stratified_split_matches_brute_force(spark):
    rows = [(f"g{i}", int(i % 9 == 0)) for i in range(40) for _ in range(1 + i % 3)]
    frame = spark.createDataFrame(rows, "p string, y int")
    groups = sorted({g for g, _ in rows})
    overall = sum(y for _, y in rows) / len(rows)
    best = None
    for seed in range(7, 7 + 32):
        held = set(sorted(groups, key=lambda g: hashlib.sha256(f"{seed}:{g}".encode()).hexdigest())[: math.ceil(0.1 * len(groups))])
        ys = [y for g, y in rows if g in held]
        if sum(ys) and (best is None or abs(sum(ys) / len(ys) - overall) < best[0]):
            best = (abs(sum(ys) / len(ys) - overall), held)
    found = sides(group_train_test_split(frame, "p", 0.1, 7, "y", stratify=True))
    assert set(found["test"]) == best[1]
    with pytest.raises(ValueError, match="no positives"):
        group_train_test_split(frame.selectExpr("p", "0 AS y"), "p", 0.1, 7, "y", stratify=True)


def test_three_way_split(spark):
    found = sides(three_way_split(stays_of(spark, 20, 6), "p"))
    sets = {k: set(v) for k, v in found.items()}
    assert sum(len(v) for v in sets.values()) == 20 == len(set.union(*sets.values()))
    assert len(sets["test"]) == 3 and len(sets["validation"]) == math.ceil(0.15 / 0.85 * 17)
    assert sum(len(v) for v in found.values()) == 120
    with pytest.raises(ValueError, match="at least 3"):
        three_way_split(stays_of(spark, 2, 3), "p")


def test_kfold_places_each_group_once_and_balances(spark):
    folds = sides(group_kfold(stays_of(spark, 50, 2), "p", 5), "fold")
    assert sorted(folds) == [0, 1, 2, 3, 4] and all(len(v) == 20 for v in folds.values())
    assert sum(len(set(v)) for v in folds.values()) == 50
    with pytest.raises(ValueError, match="cannot make"):
        group_kfold(stays_of(spark, 3, 2), "p", 5)
    with pytest.raises(ValueError, match="empty"):
        group_kfold(stays_of(spark).limit(0), "p", 5)


def greedy(sizes, k):
    """Fold of each group: largest first to the lightest fold; groups of one size follow their hash, fold by fold."""
    loads, counts = [0] * k, {}
    for n in sorted(sizes.values(), reverse=True):
        fold = loads.index(min(loads))
        loads[fold] += n
        counts.setdefault(n, [0] * k)[fold] += 1
    out = {}
    for n, share in counts.items():
        own = sorted((g for g in sizes if sizes[g] == n), key=lambda g: hashlib.sha256(f"stable-split-v1:{g}".encode()).hexdigest())
        out.update(zip(own, [f for f in range(k) for _ in range(share[f])], strict=True))
    return out


@pytest.mark.parametrize("per_task", [500_000, 3])
def test_kfold_is_greedy_along_the_exact_rank(spark, monkeypatch, per_task):
    from staywise.operators import splits

    monkeypatch.setattr(splits, "GROUPS_PER_TASK", per_task)  # orders more or fewer groups in a task: same folds
    frame = spark.range(6000).selectExpr("IF(id < 2000, 'hot', CAST(id % 1500 AS string)) AS p", "id")
    found = group_kfold(frame, "p", 5).collect()
    sizes = Counter(r.p for r in found)
    expected = greedy(sizes, 5)
    assert len(found) == 6000 and all(r.fold == expected[r.p] for r in found)
    assert sorted(found) == sorted(group_kfold(frame.repartition(7), "p", 5).collect())


def test_kfold_balances_rows_around_a_hot_group(spark):
    """One group of 4,000 rows and 1,000 of 6: it fills a fold alone, the others share the rest."""
    frame = spark.range(10_000).selectExpr("IF(id < 4000, 'hot', CAST((id - 4000) % 1000 AS string)) AS p", "id")
    rows = sorted(r["count"] for r in group_kfold(frame, "p", 5).groupBy("fold").count().collect())
    assert rows == [1500, 1500, 1500, 1500, 4000]


def test_greedy_shares_equal_dealing_one_by_one():
    rng = random.Random(7)
    for _ in range(300):
        k = rng.randint(2, 6)
        histogram = [(n, rng.randint(1, 9)) for n in rng.sample(range(1, 30), rng.randint(1, 8))]
        loads, counts = [0] * k, {}
        for n, groups in sorted(histogram, reverse=True):
            for _ in range(groups):
                fold = loads.index(min(loads))
                loads[fold] += n
                counts.setdefault(n, [0] * k)[fold] += 1
        assert greedy_shares(histogram, k) == counts
    # A billion groups of one size cost no more than a few.
    assert greedy_shares([(10**6, 1), (1, 10**9)], 4)[1] == [249_250_000, 250_250_000, 250_250_000, 250_250_000]


def test_kfold_keeps_null_groups_together(spark):
    frame = spark.range(60).selectExpr("IF(id % 6 = 0, NULL, CAST(id % 6 AS string)) AS p", "id", "1 AS fold")
    found = group_kfold(frame, "p", 3)
    assert found.columns == ["p", "id", "fold"] and found.count() == 60
    assert len({r.fold for r in found.where("p IS NULL").collect()}) == 1


def test_split_summary(spark):
    frame = stays_of(spark, 10, 2).selectExpr("p", "y", "IF(id % 10 < 8, 'train', 'test') AS split")
    found = {r.split: tuple(r)[1:] for r in split_summary(frame, "p", "y").collect()}
    assert found["train"] == (16, 8, 0.25) and found["test"] == (4, 2, 0.0)


def test_split_does_not_shuffle_rows(spark):
    plan = group_train_test_split(stays_of(spark), "p")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
