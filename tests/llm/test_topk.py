from __future__ import annotations

import math

import numpy as np
import pytest

from staywise.llm import topk


def brute(rows, every=20, k=20):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        best[i] = min(best.get(i, q), q)
    out = []
    for i, q in best.items():
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in best.items() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")
    return sorted(map(tuple, topk.search(frame).collect()))


def vectors(n, width=12, seed=0):
    draw = np.random.default_rng(seed)
    m = draw.normal(0, 0.3, (n, width)).astype(np.float32)
    m[draw.random((n, width)) < 0.4] = 0  # sparse terms
    m[::7] = m[0]  # ties
    return [(i, list(map(float, row))) for i, row in enumerate(m)]


@pytest.mark.parametrize("block", [4096, 50])
def test_all_queries_against_all_rows(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", max(3, block // 20))
    rows = vectors(230)
    assert run(spark, rows) == brute(rows)


def test_hard_rows(spark):
    rows = [*vectors(45), (60, None), (80, []), (100, [1.0, None]), (120, [float("nan")]), (140, [float("inf")]), (None, [1.0]),
            (160, [0.5]), (180, [0.0] * 12), (-20, [1.5] * 20), (3, vectors(45)[3][1]), (5, [9.0] * 12)]
    assert run(spark, rows) == brute(rows)


def test_few_candidates_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []
    assert run(spark, [(20, [1.0]), (21, [-0.01])]) == [(20, 1, 21, -64)]


def test_widths_of_accumulators():
    small = np.array([[3, -2]])
    assert topk._accumulators(small, small) is np.int32
    assert topk._accumulators(small * 10**6, small * 10**6) is np.int64
    huge = np.array([[1 << 62, 1 << 62]])
    assert topk._accumulators(huge, huge) is object
    q, c, s = topk.best_of_block(np.array([0]), huge, np.array([1, 2]), np.array([[1 << 62, 1 << 62], [0, -1]]), 2)
    assert (c.tolist(), s.tolist()) == ([1, 2], [(1 << 63) - 1, -(1 << 62)])
