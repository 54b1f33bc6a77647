from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from staywise.llm import components, simhash


def plain(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [words] if len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \t\n", "One", "one", "a b c", "A  B\tc", "a b c d", "x " * 5000, "É é É é a", "a\x0bb\x0cc\rd e", "a\x1fb c d e"]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text, 4) == plain(text)


def test_groups_of_documents(docs):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for group in range(12):
        text = [draw.choice(words) for _ in range(150)]
        for copy in range(8):
            own = list(text)
            for _ in range(copy // 3):
                own[draw.randrange(150)] = "changed"
            rows.append((100 + group * 10 + copy, " ".join(own)))
    rows += [(None, "nobody has this id"), (7, TEXTS[7])]
    got = simhash.groups(docs(rows)).collect()
    assert len(got) == len(rows)
    fps = [(i, plain(t)) for i, t in rows if i is not None]
    pairs = [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 4]
    expected = classes(pairs, {i for i, _ in fps})
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{dict(fps)[r.doc_id]:016x}"
            assert r.component_id == expected[r.doc_id]


@pytest.mark.parametrize(("bits", "shard"), [(0, 512), (2, 1), (3, 512), (4, 512), (4, 4), (4, 2**-16), (5, 1 / 64), (7, 1), (8, 512)])
def test_links_are_exact(spark, bits, shard, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)  # hot shards are cut
    monkeypatch.setattr(simhash, "SHARD", shard)  # trees of different depths
    draw = np.random.default_rng(bits)
    centres = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = [int(c) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 7), replace=False)) for c in centres for _ in range(40)]
    values += [int(x) for x in draw.integers(0, 1 << 63, 100, dtype=np.uint64)] + [0, (1 << 64) - 1]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = classes([(r.a, r.b) for r in simhash.links(frame, bits).collect()], signed)
    expected = classes([(s, t) for s, v in zip(signed, values) for t, w in zip(signed, values) if (v ^ w).bit_count() <= bits], signed)
    assert found == expected


def test_tree_depth_follows_the_count():
    """Deeper trees tell more values apart, and the rows of a fingerprint do not grow with them without bound."""
    assert simhash.depth_for(0) == simhash.depth_for(1000) == 1
    depths = [simhash.depth_for(10**k) for k in range(3, 14)]
    assert depths == sorted(depths) and depths[-1] <= simhash.DEEPEST
    draw = np.random.default_rng(1).integers(0, 1 << 22, 200_000, dtype=np.uint64)
    before = None
    for depth in (1, 4, 6, 8, simhash.DEEPEST):
        points = simhash.vantage_points(depth, 22)
        assert len(set(points)) == depth
        near = np.stack([np.bitwise_count(draw ^ np.uint64(v)) for v in points], 1).astype(np.uint8)
        _, sizes = np.unique(near, axis=0, return_counts=True)
        met = float((sizes / len(draw) * sizes).sum())  # values that an average one meets at home
        assert before is None or met < before / 4 or met < 2
        before = met
        offsets = simhash._offsets(points, 22, 1)
        sent = sum(((~draw & np.uint64(clear) & np.uint64((1 << 22) - 1)) != 0).mean() for clear in offsets.values())
        assert len(offsets) <= 22 and sent < 12


def test_empty_table(docs):
    assert simhash.groups(docs([])).collect() == []


def test_components(spark):
    draw = random.Random(9)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(150)]
    edges = [*chain, *star, *noise, (5, 5), (5, 6), (6, 5), (None, 3)]
    draw.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected(frame).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes(real, {x for e in real for x in e})
    assert components.connected(frame.where("a < 0")).collect() == []


def test_forest():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 300, 250), draw.integers(0, 300, 250)
    forest = components.Forest(300)
    for part in range(0, 250, 50):
        forest.union(a[part : part + 50], b[part : part + 50])
    expected = classes(list(zip(a.tolist(), b.tolist(), strict=True)), range(300))
    assert forest.parent.tolist() == [expected[i] for i in range(300)]
    member, root = forest.links()
    assert all(expected[m] == r and m != r for m, r in zip(member.tolist(), root.tolist(), strict=True))
