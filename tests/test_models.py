import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from staywise.functions.vocab import STAY
from staywise.operators import models
from staywise.operators.models import (
    METRICS,
    SCORE,
    ModelResult,
    better_model,
    bin_cuts,
    calibration_verdict,
    check_training_data,
    comparison,
    evaluate,
    exact_medians,
    fit_boosted_trees,
    fit_logistic,
    load_model,
    predict,
    save_model,
    tree_splits,
)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 101, 5000])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if rng.random() < 0.5 else rng.random(), None, float("nan")) for _ in range(n)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    found = exact_medians(frame, ["a", "b", "c", "d", "e"])
    for name, i in (("a", 0), ("b", 1), ("c", 2)):
        values = [r[i] for r in rows if r[i] is not None]
        assert found[name] == (pytest.approx(float(np.median(values))) if values else None)
    assert found["d"] is None and found["e"] is None
    assert exact_medians(frame, []) == {}


def test_medians_with_one_dominant_value(spark):
    frame = spark.range(50000).selectExpr("IF(id % 3 = 0, 1.0D, CAST(id AS double)) AS x")
    values = [1.0 if i % 3 == 0 else float(i) for i in range(50000)]
    assert exact_medians(frame, ["x"])["x"] == float(np.median(values))


def test_medians_of_values_of_every_size(spark):
    tiny, near = 5e-324, [1.0]
    for _ in range(40):
        near.append(math.nextafter(near[-1], 2))
    columns = {
        "spread": [s * 2.0**e for e in range(-1074, 1024, 7) for s in (1, -1)] + [1e300, -tiny, tiny, 0.0, -0.0, 3.0],
        "near": near + [-1e308, 1e308, 1e308],
        "infinite": [float("inf")] * 3 + [float("-inf")] * 2 + [7.0, 8.0],
        "ends": [float("inf"), float("-inf"), float("inf")],
        "far": [-1e308, -1e308, 1e308 / 2, 1e308],
        "zeros": [0.0, -0.0, -0.0, 0.0],
        "powers": [math.nextafter(2.0**k, side) for k in range(-60, 60) for side in (0, math.inf)] + [2.0**k for k in range(-60, 60)],
    }
    longest = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(longest)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    found = exact_medians(frame, list(columns))
    for name, values in columns.items():
        ordered = sorted(values)
        first, second = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
        assert found[name] == (first if first == second else (first + second) / 2), name


def test_medians_of_no_rows_and_of_odd_names(spark):
    assert exact_medians(spark.createDataFrame([], "x double"), ["x"]) == {"x": None}
    frame = spark.createDataFrame([(1, "2"), (4, None), (2, "5")], "`a.b` int, `i` string")
    assert exact_medians(frame, ["a.b", "i"]) == {"a.b": 2.0, "i": 3.5}


def newton(x, y, penalty):
    """Reference fit: minimise sum of losses + |w|^2 / (2 penalty), intercept unpenalised."""
    design = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [1.0 / penalty] * x.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-13:
            break
    return w


def test_logistic_is_impute_scale_and_ridge(spark):
    rng = np.random.default_rng(1)
    raw = rng.normal(3, 5, size=(120, 3))
    y = (rng.uniform(size=120) < 1 / (1 + np.exp(-(raw[:, 0] - 3) / 5))).astype(int)
    raw[rng.uniform(size=raw.shape) < 0.2] = np.nan
    rows = [(int(t), *[None if math.isnan(v) else float(v) for v in r], None) for t, r in zip(y, raw)]
    frame = spark.createDataFrame(rows, "outcome int, a double, b double, c double, empty double")
    model = fit_logistic(frame, ["a", "b", "c", "empty"])

    filled = np.where(np.isnan(raw), np.nanmedian(raw, axis=0), raw)
    scaled = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    w = newton(scaled, y, 1.0)
    expected = 1 / (1 + np.exp(-(w[0] + scaled @ w[1:])))
    found = np.array([r.predicted_risk for r in predict(model, frame.coalesce(1)).collect()])
    assert np.allclose(np.sort(found), np.sort(expected), atol=1e-5)
    assert predict(model, frame).columns == ["outcome", "a", "b", "c", "empty", "predicted_risk"]


def separable(spark, n=80):
    return spark.range(n).selectExpr("id", "CAST(id % 2 AS int) AS outcome", "CAST(id % 2 AS double) AS x", "CAST(id % 7 AS int) AS z")


def test_perfect_feature_reaches_full_auroc(spark, tmp_path):
    frame = separable(spark)
    trees = fit_boosted_trees(frame, ["x", "z"], trees=3)
    linear = fit_logistic(frame, ["x", "z"])
    results = [evaluate(n, m, frame) for n, m in (("boosted_trees", trees), ("logistic", linear))]
    assert all(r.metrics["auroc"] == 1.0 and r.metrics["auprc"] == 1.0 for r in results)
    assert comparison(results).columns == ["model", *METRICS] and comparison(results).count() == 2
    assert better_model(*results).name == "boosted_trees"
    for model in (trees, linear):
        save_model(model, str(tmp_path / "m"))
        again = predict(load_model(str(tmp_path / "m")), frame).collect()
        assert sorted(again) == sorted(predict(model, frame).collect())


def test_same_seed_same_trees(spark):
    frame = separable(spark)
    a, b = (sorted(predict(fit_boosted_trees(frame, ["z"], trees=3, seed=5), frame).collect()) for _ in range(2))
    assert a == b


def test_trees_grow_on_equal_parts(spark, monkeypatch):
    """A pass over the rows gives every core the same work, wherever the rows were; few rows stay where they are."""
    seen, fit = [], GBTClassifier.fit

    def watched(self, rows):
        seen.append(rows.rdd.glom().map(len).collect())
        return fit(self, rows)

    monkeypatch.setattr(GBTClassifier, "fit", watched)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 30_000 * cores, 1, 1).selectExpr("CAST(id % 2 AS int) AS outcome", "CAST((id * 7) % 50 AS double) AS x")
    fit_boosted_trees(rows, ["x"], trees=1, depth=1)
    assert len(seen[0]) == cores and max(seen[0]) - min(seen[0]) <= 1 and sum(seen[0]) == 30_000 * cores
    fit_boosted_trees(rows.limit(500).repartition(3), ["x"], trees=1, depth=1)
    assert len(seen[1]) == 3 and sum(seen[1]) == 500
    assert models._parts(50_000, 12) == 3 and models._parts(5_000_000, 12) == 12 and models._parts(30_000_000, 12) == 36


def test_missing_values_can_be_split_on(spark):
    frame = spark.range(60).selectExpr("CAST(id % 2 AS int) AS outcome", "IF(id % 2 = 0, 1.0D, NULL) AS x", "CAST(NULL AS double) AS gone")
    result = evaluate("t", fit_boosted_trees(frame, ["x", "gone"], trees=2), frame)
    assert result.metrics["auroc"] == 1.0


def plain_cuts(values, bins):
    ordered = sorted(values)
    if len(set(ordered)) <= bins:
        return sorted(set(ordered))
    return sorted({ordered[min(k * len(ordered) // bins, len(ordered) - 1)] for k in range(1, bins + 1)})


@pytest.mark.parametrize("bins", [2, 7, 63])
def test_bins_hold_equal_shares_or_one_value_each(spark, bins):
    rng = random.Random(bins)
    rows = [
        (rng.gauss(0, 1), float(rng.randint(0, 3)), float(rng.random() < 0.004), rng.choice([None, rng.random()]), None,
         rng.choice([0.0, -0.0, float("nan"), float("inf"), 5.0]), float(int(rng.paretovariate(0.7))))
        for _ in range(2500)
    ]
    names = ["a", "b", "rare", "d", "empty", "odd", "long"]
    found = bin_cuts(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5), names, bins)
    for i, name in enumerate(names):
        values = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        assert found[name] == plain_cuts([v + 0.0 for v in values], bins), name


def test_bins_of_no_rows(spark):
    none = spark.createDataFrame([], "x double")
    assert bin_cuts(none, ["x"]) == {"x": []} and bin_cuts(none, []) == {}
    with pytest.raises(ValueError, match="two at least"):
        bin_cuts(none, ["x"], 1)


def plain_best_split(rows, names, bins):
    """Every (column, cut, side of missing values): the largest fall of the variance of the labels -1 and 1."""

    def variance(part):
        share = sum(y for y, _ in part) / len(part)
        return 4 * share * (1 - share)

    best = (0.0, None)
    for i, name in enumerate(names):
        values = [r[i] for _, r in rows if r[i] is not None]
        for cut in [*plain_cuts(values, bins), math.inf]:
            for missing_left in (False, True):
                left = [(y, r) for y, r in rows if (missing_left if r[i] is None else r[i] < cut)]
                right = [(y, r) for y, r in rows if not (missing_left if r[i] is None else r[i] < cut)]
                if left and right:
                    gain = variance(rows) - (len(left) * variance(left) + len(right) * variance(right)) / len(rows)
                    best = max(best, (round(gain, 10), name))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_the_first_splits_are_the_best_ones_and_missing_values_have_a_side(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        x, z, flag = rng.gauss(0, 1), float(rng.randint(0, 40)), float(rng.random() < 0.02)
        gone = rng.random() < 0.3
        chance = (0.8 if seed % 2 else 0.1) if gone else 0.2 + 0.5 * (x > 0.4)
        rows.append((int(rng.random() < chance), (None if gone else x, z, flag)))
    names = ["x", "z", "flag"]
    frame = spark.createDataFrame([(y, *r) for y, r in rows], "outcome int, x double, z double, flag double")
    model = fit_boosted_trees(frame, names, trees=1, depth=2, bins=15)
    splits = {s["node"]: s for s in tree_splits(model, names)}
    top = splits[1]
    assert (round(top["gain"], 10), top["feature"]) == plain_best_split(rows, names, 15)
    place = names.index(top["feature"])
    below = lambda v: top["missing"] == "left" if v is None else (top["missing"] == "right" if top["cut"] is None else v < top["cut"])
    for node, side in ((2, True), (3, False)):
        part = [(y, r) for y, r in rows if below(r[place]) is side]
        if node in splits:
            assert round(splits[node]["gain"], 10) == plain_best_split_with_cuts(part, rows, names, 15)
    scores = {r.predicted_risk for r in predict(model, frame).collect()}
    assert 2 <= len(scores) <= 4


def plain_best_split_with_cuts(part, rows, names, bins):
    """As plain_best_split, on some rows only, with the cuts of all rows."""
    variance = lambda p: 4 * (sum(y for y, _ in p) / len(p)) * (1 - sum(y for y, _ in p) / len(p))
    best = 0.0
    for i in range(len(names)):
        for cut in [*plain_cuts([r[i] for _, r in rows if r[i] is not None], bins), math.inf]:
            for missing_left in (False, True):
                goes = [missing_left if r[i] is None else r[i] < cut for _, r in part]
                left, right = ([p for p, g in zip(part, goes) if g is side] for side in (True, False))
                if left and right:
                    best = max(best, variance(part) - (len(left) * variance(left) + len(right) * variance(right)) / len(part))
    return round(best, 10)


def test_missing_values_at_scoring_only_count_as_the_largest(spark):
    frame = spark.range(80).selectExpr("CAST(id >= 40 AS int) AS outcome", "CAST(id AS double) AS x")
    model = fit_boosted_trees(frame, ["x"], trees=3)
    asked = spark.createDataFrame([(None,), (float("nan"),), (1e9,), (float("inf"),), (-1.0,)], "x double")
    scores = [r.predicted_risk for r in predict(model, asked).collect()]
    assert scores[0] == scores[1] == scores[2] == scores[3] > 0.5 > scores[4]


def test_infinite_values_and_odd_names(spark):
    rows = [(i % 2, float("inf") if i % 2 else float(i), float("-inf") if i % 3 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "outcome int, `a.b` double, `q` double")
    result = evaluate("t", fit_boosted_trees(frame, ["a.b", "q"], trees=2), frame)
    assert result.metrics["auroc"] == 1.0


def test_reweighting_lifts_the_risk_of_a_rare_class(spark):
    frame = spark.range(200).selectExpr("CAST(id % 10 = 0 AS int) AS outcome", "CAST(id % 3 AS double) AS x")
    means = [
        predict(fit(frame, ["x"], **{option: flag}), frame).agg({"predicted_risk": "avg"}).first()[0]
        for fit, option in ((fit_logistic, "reweight"), (fit_boosted_trees, "is_unbalance"))
        for flag in (False, True)
        for fit in (fit if fit is fit_logistic else lambda f, c, **o: fit_boosted_trees(f, c, trees=3, **o),)
    ]
    assert means[0] == pytest.approx(0.1, abs=0.02) and means[1] == pytest.approx(0.5, abs=0.02)
    assert means[3] > means[2]


def test_training_guards(spark):
    frame = separable(spark).selectExpr("*", "IF(id < 60, 'train', 'test') AS split")
    assert check_training_data(frame, "split") == {"train": (60, 30), "test": (20, 10)}
    with pytest.raises(ValueError, match="no rows on the test side"):
        check_training_data(frame.where("split = 'train'"), "split")
    with pytest.raises(ValueError, match="one class"):
        check_training_data(frame.selectExpr("0 AS outcome", "split"), "split")
    with pytest.raises(ValueError, match="binary"):
        check_training_data(frame.selectExpr("outcome * 2 AS outcome", "split"), "split")
    single = evaluate("x", fit_logistic(frame, ["x"]), frame.where("outcome = 0"))
    assert math.isnan(single.metrics["auroc"]) and math.isnan(single.metrics["calibration_slope"])


def test_verdict_and_tie():
    assert calibration_verdict({"calibration_intercept": 0.4, "calibration_slope": 1.4}) == "reasonably calibrated"
    assert calibration_verdict({"calibration_intercept": 0.5, "calibration_slope": 1.0}) == "miscalibrated"
    trees, linear = (ModelResult(n, None, None, {"auroc": 0.7}, None) for n in ("t", "l"))
    assert better_model(trees, linear) is trees
    assert STAY == "hospitalization_id"


def test_vector_fit_along_principal_axes(spark):
    """Values that hardly change from hour to hour: the optimum of the z-scores, found in few steps; a constant hour is no harm."""
    draw = random.Random(5)
    rows = []
    for _ in range(600):
        level, hours = draw.gauss(0, 1), []
        for _ in range(40):
            level += draw.gauss(0, 1) if draw.random() < 0.05 else 0.0
            hours.append(level)
        p = 1 / (1 + math.exp(1 - hours[-1] + 0.5 * hours[20]))
        rows.append((int(draw.random() < p), [0.0, *hours]))
    names = [f"h{i}" for i in range(1, 41)]
    frame = spark.createDataFrame(rows, "outcome int, a array<double>").select(
        "outcome", array_to_vector("a").alias("x"), *[F.col("a")[i].alias(f"h{i}") for i in range(1, 41)]
    )
    found = fit_logistic(frame, "x", penalty=1.0, tol=1e-6)
    assert found.stages[-1].summary.totalIterations < 60
    exact = fit_logistic(frame, names, penalty=1.0)
    ours, theirs = ([r[0] for r in predict(m, frame).select(SCORE).collect()] for m in (found, exact))
    assert max(abs(a - b) for a, b in zip(ours, theirs, strict=True)) < 5e-3
    flat = frame.select("outcome", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("x"))
    share = sum(y for y, _ in rows) / len(rows)
    assert all(abs(r[0] - share) < 1e-6 for r in predict(fit_logistic(flat, "x"), flat).select(SCORE).collect())
