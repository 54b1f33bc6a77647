from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staywise.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(documents, items, length=10):
    windows = {}
    for item, text in items:
        ws = tokens(text)
        n = min(length, len(ws))
        for s in range(len(ws) - n + 1) if n else ():
            windows.setdefault(tuple(ws[s : s + n]), set()).add(item)
    out = []
    for doc, text in documents:
        ws, hit, found = tokens(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(ws) - n + 1):
                if tuple(ws[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(ws[s : s + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, words string")


def corpus(seed):
    """Few distinct words, so that runs repeat; long items, short items, ties and copies."""
    rng = random.Random(seed)
    vocabulary = ["Aa", "b", "É", "c1", "日本", "dd", "E", "ff"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(12)]
    items += [(3, items[3][1]), (3, sentence(12)), (None, sentence(14)), (50, None), (51, ""), (52, "...")]
    docs = [(i, sentence(rng.randint(0, 120))) for i in range(30)]
    docs += [(100 + i, f"{sentence(20)}, {t}! {sentence(3)}") for i, (_, t) in enumerate(items) if t]
    docs += [(7, docs[40][1])] * 5 + [(None, docs[40][1].upper()), (None, None), (8, ""), (8, "--"), (9, "é É"), (9, "the " * 3000)]
    return docs, items


@pytest.mark.parametrize(("seed", "length", "few"), [(1, 10, 100_000), (2, 10, 0), (3, 4, 0), (4, 1, 100_000)])
def test_against_all_windows(spark, docs, items, seed, length, few):
    texts, asked = corpus(seed)
    if length < 10:
        asked = asked[:3] + asked[-6:]
    got = decontam.decontaminate(docs(texts), items(asked), length=length, few=few)
    rows = got.select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256), "contaminated"
    ).collect()
    assert Counter(map(tuple, rows)) == Counter(plain(texts, asked, length))


def test_every_shared_run_has_a_kept_gram(spark):
    """The guarantee: any two texts with a common run keep a common gram inside it, whatever surrounds it."""
    rng = random.Random(5)
    rows = []
    for i in range(200):
        run = [rng.randrange(4) for _ in range(10)]
        for side in range(2):
            around = [[rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in range(2)]
            rows.append((i, side, len(around[0]), around[0] + run + around[1]))
    frame = spark.createDataFrame(rows, "i int, side int, at int, hs array<long>")
    kept = {(r.i, r.side): {(x.at - r.at, x.h) for x in r.kept} for r in frame.select("i", "side", "at", decontam.kept_grams(F.col("hs"), 10).alias("kept")).collect()}
    for i in range(200):
        inside = [{h for at, h in kept[i, side] if 0 <= at <= 5} for side in range(2)]
        assert inside[0] & inside[1]


def test_few_of_the_grams_are_kept(spark):
    text = spark.createDataFrame([(list(range(10_000)),)], "hs array<long>")
    n = text.select(F.size(decontam.kept_grams(F.col("hs"), 10)).alias("n")).first().n
    assert 10_000 / 6 < n < 10_000 / 2.5


def test_empty_tables(docs, items):
    assert decontam.digests(docs([]), items([(1, "a b")])).count() == 0
    rows = decontam.digests(docs([(1, "a b c")]), items([])).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_main_path_has_no_python(docs, items):
    texts, asked = corpus(1)
    plan = decontam.digests(docs(texts), items(asked))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
