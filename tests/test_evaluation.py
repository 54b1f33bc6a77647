import math
import random

import pytest

from staywise.operators.evaluation import (
    auroc,
    binary_metrics,
    calibration_bins,
    calibration_line,
    decision_curve,
    default_thresholds,
    expected_calibration_error,
    model_metrics,
    ranking_metrics,
    reliability_deciles,
    score_counts,
    subgroup_metrics,
)

SMALL = [(1, 0.92), (0, 0.55), (1, 0.15), (0, 0.05), (1, 0.6)]


def frame_of(spark, rows):
    return spark.createDataFrame([(y, None if p is None else float(p)) for y, p in rows], "y int, p double")


def pairwise_auroc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_known_metrics(spark):
    row = binary_metrics(frame_of(spark, SMALL), "y", "p").first()
    assert (row.n, row.prevalence) == (5, 0.6)
    assert row.auroc == pytest.approx(pairwise_auroc(SMALL))
    assert row.brier == pytest.approx(sum((y - p) ** 2 for y, p in SMALL) / 5)
    assert row.log_loss == pytest.approx(-sum(math.log(p if y else 1 - p) for y, p in SMALL) / 5)


@pytest.mark.parametrize("buckets", [1, 2, 9])
def test_auroc_with_ties_matches_all_pairs(spark, buckets):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(400)] + [(1, 0.5)] * 150 + [(0, 0.5)] * 150
    assert auroc(frame_of(spark, rows), "y", "p", buckets=buckets).first()[0] == pytest.approx(pairwise_auroc(rows))
    assert ranking_metrics(frame_of(spark, rows), "y", "p", buckets).first().auroc == pytest.approx(pairwise_auroc(rows))


def test_single_class_unfinite_and_bad_labels(spark):
    assert auroc(frame_of(spark, [(1, 0.1), (1, 0.9)]), "y", "p").first()[0] is None
    dirty = SMALL + [(1, None), (None, 0.3), (1, float("nan")), (0, float("inf")), (0, float("-inf"))]
    assert binary_metrics(frame_of(spark, dirty), "y", "p").first().n == 5
    with pytest.raises(Exception, match="no finite"):
        binary_metrics(frame_of(spark, [(1, None)]), "y", "p").collect()
    with pytest.raises(Exception, match="binary"):
        binary_metrics(frame_of(spark, [(2, 0.5)]), "y", "p").collect()
    with pytest.raises(ValueError, match="missing"):
        binary_metrics(frame_of(spark, SMALL), "y", "q")


def test_clipping_creates_ties(spark):
    rows = [(1, -3.0), (0, 0.0), (1, 1.0), (0, 7.0)]
    row = binary_metrics(frame_of(spark, rows), "y", "p").first()
    assert row.auroc == 0.5 and math.isfinite(row.log_loss)


def average_precision(rows):
    total = sum(y for y, _ in rows)
    result = 0.0
    for cut in sorted({p for _, p in rows}):
        chosen = [y for y, p in rows if p >= cut]
        result += sum(y for y, p in rows if p == cut) / total * sum(chosen) / len(chosen)
    return result


def test_average_precision_is_the_step_version(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(200)]
    row = ranking_metrics(frame_of(spark, rows), "y", "p").first()
    assert row.auprc == pytest.approx(average_precision(rows))
    assert row.brier_score == pytest.approx(sum((p - y) ** 2 for y, p in rows) / len(rows))
    single = model_metrics(frame_of(spark, [(0, 0.2), (0, 0.3)]), "y", "p").first()
    assert math.isnan(single.auroc) and math.isnan(single.auprc) and math.isnan(single.calibration_slope)
    assert single.prevalence == 0.0 and single.brier_score == pytest.approx(0.065)


def test_calibration_line_matches_newton(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(800):
        p = rng.uniform(0.02, 0.98)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-(0.4 + 0.7 * math.log(p / (1 - p)))))), round(p, 3)))
    a = b = 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for y, p in rows:
            x = math.log(p / (1 - p))
            m = 1 / (1 + math.exp(-(a + b * x)))
            w = m * (1 - m)
            g0, g1 = g0 + y - m, g1 + (y - m) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        a, b = a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det
    found = calibration_line(score_counts(frame_of(spark, rows), "y", "p", clip=None))
    assert found == pytest.approx((a, b), abs=1e-5)


def test_equal_frequency_bins_and_error(spark):
    frame = frame_of(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    bins = calibration_bins(frame, "y", "p", 2)
    assert bins.count() == 2
    assert expected_calibration_error(bins).first()[0] == pytest.approx(0.15)
    assert math.isnan(expected_calibration_error(bins.limit(0)).first()[0])
    assert calibration_bins(frame, "y", "p", 10).count() == 4
    with pytest.raises(ValueError, match="at least 2"):
        calibration_bins(frame, "y", "p", 1)
    with pytest.raises(ValueError, match="no valid rows"):
        calibration_bins(frame_of(spark, [(1, 1.5), (None, 0.5), (1, float("nan"))]), "y", "p")


@pytest.mark.parametrize("buckets", [1, 5])
@pytest.mark.parametrize(("n", "k"), [(10, 4), (37, 10), (200, 7), (3, 10)])
def test_bins_match_row_index_arithmetic(spark, n, k, buckets):
    rng = random.Random(n * k)
    rows = [(int(rng.random() < 0.5), round(rng.random(), 1)) for _ in range(n)]
    # Brute force: order by score, positives of a run of equal scores spread evenly over it.
    ordered = []
    for score in sorted({p for _, p in rows}):
        run = [y for y, p in rows if p == score]
        c, m = len(run), sum(run)
        ordered += [(score, (j + 1) * m // c - j * m // c) for j in range(c)]
    bins = min(k, n)
    expected = {}
    for i, (score, y) in enumerate(ordered):
        expected.setdefault(i * bins // n, []).append((score, y))
    found = {r.bin: r for r in calibration_bins(frame_of(spark, rows), "y", "p", k, buckets).collect()}
    assert set(found) == set(expected)
    for b, members in expected.items():
        assert found[b].n == len(members)
        assert found[b].observed_event_rate == pytest.approx(sum(y for _, y in members) / len(members))
        assert found[b].mean_predicted_risk == pytest.approx(sum(s for s, _ in members) / len(members))
        assert (found[b].min_predicted_risk, found[b].max_predicted_risk) == (members[0][0], members[-1][0])


def test_reliability_deciles_at_the_edges(spark):
    scores = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 0.8, 0.9, 1.0]
    found = {r.bin: r["count"] for r in reliability_deciles(frame_of(spark, [(1, s) for s in scores]), "y", "p").collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 8: 1, 9: 2}


def test_subgroups(spark):
    frame = spark.createDataFrame(
        [(1, 0.33, "x", 7), (0, 0.21, "x", 7), (0, 0.65, "y", 8), (1, 0.44, None, 8), (0, 0.44, "y", 7)], "y int, p double, sex string, unit int"
    )
    found = {(r.subgroup_col, r.subgroup_value): r for r in subgroup_metrics(frame, "y", "p", ["sex", "unit"]).collect()}
    assert set(found) == {("sex", "x"), ("sex", "y"), ("sex", "Unknown"), ("unit", "7"), ("unit", "8")}
    assert found["sex", "x"].auroc == 1.0 and found["sex", "x"].warning is None
    assert found["unit", "8"].auroc == 0.0 and found["unit", "7"].auroc == 0.5
    assert found["sex", "y"].auroc is None and found["sex", "y"].warning
    assert found["sex", "Unknown"].warning and found["sex", "Unknown"].n == 1
    assert subgroup_metrics(frame, "y", "p", []).count() == 0
    with pytest.raises(ValueError, match="missing"):
        subgroup_metrics(frame, "y", "p", ["nope"])
    broken = frame.union(spark.createDataFrame([(1, None, "X", 1)], "y int, p double, sex string, unit int"))
    with pytest.raises(Exception, match="in a group"):
        subgroup_metrics(broken, "y", "p", ["sex"]).collect()


def test_hot_subgroup_in_buckets(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < 0.4), rng.random(), "big" if i % 3 else f"s{i % 7}") for i in range(900)]
    frame = spark.createDataFrame(rows, "y int, p double, g string")
    found = {r.subgroup_value: r.auroc for r in subgroup_metrics(frame, "y", "p", ["g"], buckets=6).collect()}
    for group in {g for _, _, g in rows}:
        assert found[group] == pytest.approx(pairwise_auroc([(y, p) for y, p, g in rows if g == group]))


def test_decision_curve(spark):
    scored = [(1, 0.45), (0, 0.3), (0, 0.12), (1, 0.07), (0, 0.02), (1, 0.77), (0, 0.3), (1, 0.3)]
    frame = frame_of(spark, scored)
    for r in decision_curve(frame, "y", "p", [0.07, 0.3, 0.6]).collect():
        odds = r.threshold / (1 - r.threshold)
        tp, fp = (sum(y == wanted and p >= r.threshold for y, p in scored) for wanted in (1, 0))
        assert (r.n, r.prevalence, r.true_positives, r.false_positives) == (8, 0.5, tp, fp)
        assert r.net_benefit_model == pytest.approx((tp - fp * odds) / 8)
        assert r.net_benefit_treat_all == pytest.approx(0.5 - 0.5 * odds) and r.net_benefit_treat_none == 0.0
    assert default_thresholds() == [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
    assert decision_curve(frame, "y", "p").count() == 10
    nan = decision_curve(frame_of(spark, [(1, float("nan")), (0, 0.9), (1, None)]), "y", "p", [0.5]).first()
    assert (nan.n, nan.true_positives, nan.false_positives) == (2, 0, 1)
    with pytest.raises(ValueError, match="strictly"):
        decision_curve(frame, "y", "p", [0.0])
    with pytest.raises(Exception, match="no valid rows"):
        decision_curve(frame_of(spark, [(1, None)]), "y", "p").collect()
    with pytest.raises(Exception, match="binary"):
        decision_curve(frame_of(spark, [(3, 0.5)]), "y", "p").collect()


def test_curve_needs_one_scan_and_no_cross_join(spark):
    plan = decision_curve(frame_of(spark, SMALL), "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
