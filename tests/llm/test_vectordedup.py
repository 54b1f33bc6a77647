from __future__ import annotations

import numpy as np

from staywise.llm import vectordedup

SCHEMA = "vec_id long, embedding array<double>, label int, component long, n int"


def brute(rows, limit=0.98):
    """id list, links and smallest reachable id of every row."""
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def good(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    unit = [np.array(r[1]) / np.max(np.abs(r[1])) if good(r) else None for r in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if unit[i] is None or unit[j] is None or a[2] != b[2] or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], links[i], least[find(i)]) for i, r in enumerate(rows)), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = vectordedup.near_duplicates(frame).collect()
    assert all(r.kept == (r.vec_id == r.component) for r in got if r.vec_id is not None)
    return sorted(((r.vec_id, r.n_links, r.component) for r in got), key=str)


def clusters(n, width=16, labels=3, seed=0, noise=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(max(1, n // 12), width))
    rows = []
    for i in range(n):
        v = centres[draw.integers(len(centres))] + draw.normal(0, noise, width)
        rows.append((i, list(map(float, v * draw.uniform(0.5, 2))), int(draw.integers(labels))))
    return rows


def test_links_and_groups(spark):
    rows = clusters(260)
    assert run(spark, rows) == brute(rows)


def test_cells_in_blocks_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "BLOCK", 25)
    monkeypatch.setattr(vectordedup, "CELL_POINTS", 60)
    rows = clusters(150, labels=2, seed=3)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "CELL_POINTS", 40)
    rows = clusters(900, width=32, labels=1, seed=5, noise=0.09)
    got, expected = run(spark, rows), brute(rows)
    assert sum(x[1] for x in expected) > 1000
    assert sum(x[1] for x in got) >= 0.9 * sum(x[1] for x in expected)
    assert all(a[1] <= b[1] for a, b in zip(got, expected, strict=True))  # none that is no link


def test_cells_follow_the_points():
    assert vectordedup.cells_for(0, 0) == (1, 1) and vectordedup.cells_for(50_000, 20_000) == (25, 1)
    assert vectordedup.cells_for(2_000_000, 20_000) == (1000, 1) and vectordedup.cells_for(20_000_000, 20_000) == (1000, 10)
    assert vectordedup.cells_for(5_000_000_000, 20_000) == (1000, 1000)


def test_recall_with_cells_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "CELL_POINTS", 15)
    monkeypatch.setattr(vectordedup, "LARGEST_K", 8)
    assert vectordedup.cells_for(900, 900) == (8, 8)
    for noise, width in ((0.09, 32), (0.02, 6)):
        rows = clusters(900, width=width, labels=1, seed=6, noise=noise)
        rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(40)]
        got, expected = run(spark, rows), brute(rows)
        assert sum(x[1] for x in expected) > 1000
        assert sum(x[1] for x in got) >= 0.95 * sum(x[1] for x in expected)
        assert all(a[1] <= b[1] for a, b in zip(got, expected, strict=True))


def test_hard_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0), (8, [1.0, None, 2.0], 0),
            (9, [1.0, float("nan"), 2.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (None, v, 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0),
            (13, [1e200, 2e200, 3e200], 0), (14, [-1.0, -2.0, -3.0], 0), (15, [1e-200, 2e-200, 3e-200], 0)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(1, 0, 1)]


def test_an_id_on_several_vectors(spark):
    """Each row links by its own vector; components name the smallest id, whichever vectors it stands on."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.02], 0), (4, [0.01, 1.0], 0), (2, [5.0, 5.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component, r.kept) for r in vectordedup.near_duplicates(frame).collect())
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (2, 0, 2, True)])
