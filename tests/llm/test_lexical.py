from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from staywise.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(documents, items, k=20):
    docs = [(i, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in documents]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n, length = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc, c, size in docs:
            m = 100 - 25 + (25 * size * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in WORD.findall(text.translate(LOWER)) if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scores[:k], 1)]
    return Counter(out)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, rank int")


def corpus(seed, size=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "Word"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    sentence = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, sentence(rng.randint(0, 40))) for i in range(size)]
    docs += [(1000 - i, docs[5][1]) for i in range(70)] + [(3, docs[5][1])] * 3 + [(None, docs[5][1])] * 2
    docs += [(None, None), (7, None), (8, ""), (9, "?!"), (11, "w1 " * 5000), (12, "w1-W2.w3"), (13, "unseen words only")]
    items = [(i, sentence(rng.randint(1, 30))) for i in range(15)]
    items += [items[0], (1, "w50 w51"), (None, "w3 w3 w40"), (60, None), (61, ""), (62, "nowhere"), (63, docs[5][1] or "w1")]
    return docs, items


@pytest.mark.parametrize(("seed", "leaf", "tree"), [(1, 24, 8192), (2, 2, 64), (3, 1, 7)])
def test_against_all_scores(spark, docs, items, monkeypatch, seed, leaf, tree):
    monkeypatch.setattr(lexical, "TREE_DOCS", tree)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    texts, asked = corpus(seed)
    got = lexical.search(docs(texts).repartition(3), items(asked))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(texts, asked)


def test_items_in_blocks(spark, docs, items, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    texts, asked = corpus(4, 80)
    assert Counter(map(tuple, lexical.search(docs(texts), items(asked), k=3).collect())) == plain(texts, asked, 3)


def test_empty_tables(docs, items):
    assert lexical.search(docs([]), items([(1, "a b")])).count() == 0
    assert lexical.search(docs([(1, "a b c")]), items([])).count() == 0
    assert lexical.search(docs([(1, "a b c")]), items([(1, "d")])).count() == 0


def test_bounds_hold_and_prune():
    """No document scores above the bound of a node over it, and part of the tree is never visited."""
    rng = np.random.default_rng(2)
    width, size = 200, 4000
    # A third of the documents are copies of a few; the rest draws from a long tail.
    rows = [np.unique(np.minimum(rng.zipf(1.3, 30) - 1, width - 1)) for _ in range(size)]
    rows = [rows[i % 5] if i % 3 == 0 else r for i, r in enumerate(rows)]
    sizes = np.array([len(r) for r in rows])
    tf = rng.integers(1, 5, int(sizes.sum()))
    m = rng.integers(76, 400, size)
    tree = lexical.Tree(list(range(size)), m, sizes, np.concatenate(rows), tf, width)
    df = np.bincount(np.concatenate(rows), minlength=width)
    seen = total = 0
    for _ in range(30):
        term = rows[rng.integers(size)]
        w = np.array([lexical.weight(int(df[t]), size) for t in term])
        exact = tree.docs.scores(np.arange(size), term, w)
        for node, (low, high) in enumerate(tree.spans):
            assert tree.nodes.scores(np.array([node]), term, w)[0] >= exact[low:high].max()
        best = []
        seen += tree.search(term, w, best, 20)
        total += len(tree.spans)
        want = sorted(zip((-exact).tolist(), tree.ids, strict=True))[:20]
        assert sorted((-s, i.id) for s, i in best) == [x for x in want if x[0] < 0]
    assert seen < 0.75 * total


def test_measure_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert lexical.measure(n, 10**12, 10**15).tolist() == [75 + 25 * int(x) * 10**12 // 10**15 for x in n]
