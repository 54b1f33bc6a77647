from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from staywise.llm import mixing


def water(sizes, weights, cap):
    """Reference: clamp whoever is above, share the rest, again."""
    total, full = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        if not rest:
            return [cap * s for s in sizes]
        level = (total - sum(cap * sizes[i] for i in full)) / sum(weights[i] for i in rest)
        above = {i for i in rest if level * weights[i] > cap * sizes[i]}
        if not above:
            return [cap * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= above


def corpus():
    draw = random.Random(4)
    rows = []
    for s, (n, longest) in enumerate([(300, 60), (40, 400), (9, 10), (60, 50), (1, 3), (120, 90)]):
        for _ in range(n):
            rows.append((len(rows), "w " * draw.randint(1, longest), "en", None if s == 5 else f"s{s}"))
    return [*rows, (9000, None, None, "s1"), (9001, "", None, "s1"), (9002, "a\x0bb\x1fc　d", None, "é"), (9003, None, None, "zzz")]


def test_targets_and_taken_words(docs):
    rows = corpus()
    got = mixing.mixture(docs(rows)).collect()
    assert len(got) == len(rows)
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        sizes[source[r.doc_id]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = dict(zip(order, water([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(expected[s], abs=1e-6)
        assert r.taken == r.repeats * r["size"] <= 3 * r["size"]
        taken[s] += r.taken
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))
    for s in order:
        assert abs(taken[s] - expected[s]) <= max(0.02 * expected[s], 3)


def test_reruns_and_blocks(docs, monkeypatch):
    rows = corpus()
    once = {r.doc_id: r.taken for r in mixing.mixture(docs(rows)).collect()}
    assert once == {r.doc_id: r.taken for r in mixing.mixture(docs(rows[::-1]).repartition(7)).collect()}
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 30)
    cut = mixing.mixture(docs(rows)).collect()
    assert len(cut) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for r in cut:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= max(0.05 * t, 10) for s, t in target.items())


def test_repeat(docs):
    rows = [*corpus(), (None, "no id at all", None, "s0"), (3, "again", "en", "s0")]
    frame = docs(rows)
    plan = mixing.plan(frame)
    times = {}
    for r in plan.collect():
        times[r.doc_id] = max(times.get(r.doc_id, 0), r.repeats)
    got = mixing.repeat(frame, plan)
    assert got.columns == frame.columns
    expected = Counter({r: 0 for r in rows})
    for r in rows:
        expected[(r + (None,) * 4)[:4]] += times[r[0]]
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got.collect()) == +expected


def test_empty_tables(docs):
    assert mixing.mixture(docs([])).collect() == []
    only = mixing.mixture(docs([(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2


def test_rows_without_ids_are_spread(spark, docs, monkeypatch):
    """A source of rows with one key or none is visited in many blocks, and still gives what it must."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 50)
    rows = [(None, "w " * (1 + i % 7), "en", "a") for i in range(1500)] + [(5, "v " * 3, "en", "b")] * 900 + [(i, "x " * 4, "en", "c") for i in range(800)]
    planned = mixing.plan(docs(rows))
    assert planned.count() == len(rows)
    for r in planned.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 7 * 40
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = mixing.plan(docs(rows)).where("source = 'a'").rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(parts) < 750  # 30 blocks dealt over the partitions
