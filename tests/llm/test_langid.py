from __future__ import annotations

import math
import random

import numpy as np

from staywise.llm import langid

SOUNDS = {"aa": ["ba", "na", "lo", "mi"], "bb": ["sch", "ung", "er", "ei"], "cc": ["ción", "ñ", "que", "os"]}


def text(lang, words, seed):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SOUNDS[lang]) for _ in range(draw.randint(1, 4))) for _ in range(words))


def corpus(n=240):
    return [(i, text("abc"[i % 3] * 2, 60, i), "abc"[i % 3] * 2) for i in range(n)]


def test_held_out_documents_are_recognised(docs):
    got = langid.identify(docs(corpus())).collect()
    assert len(got) == 240
    held = [r for r in got if r.held_out]
    assert 20 < len(held) < 90
    assert all(r.lang_pred == "abc"[r.doc_id % 3] * 2 and not r.rejected and 0.5 < r.score <= 1 for r in held)


def test_nothing_of_a_held_out_document_is_learned(docs):
    rows = corpus()
    before = {r.doc_id: r for r in langid.identify(docs(rows)).collect()}
    held = {i for i, r in before.items() if r.held_out}
    changed = [(i, "zz xx yy" if i in held else t, "cc" if i in held else lang) for i, t, lang in rows]
    after = {r.doc_id: r for r in langid.identify(docs(changed)).collect()}
    assert all(before[i][1:] == after[i][1:] for i in before if i not in held)


def test_hard_rows(docs):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "123 !!! \n"), (1003, text("bb", 30_000, 1)), (None, text("cc", 20, 2)),
            (1004, "qxzkjwv" * 300), (1005, text("aa", 40, 3) + " " + text("bb", 40, 4)), (3, text("aa", 60, 3), "aa")]
    got = langid.identify(docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[1003].lang_pred == "bb" and not by_id[1003].rejected
    assert by_id[None].lang_pred == "cc" and by_id[None].held_out
    assert by_id[1004].rejected  # letters of no learned language
    assert not by_id[1005].rejected  # two learned languages


def test_nothing_to_learn_from(docs):
    assert [r.lang_pred for r in langid.identify(docs([(1, "abc"), (2, None)])).collect()] == ["und", "und"]
    assert langid.identify(docs([])).collect() == []


def test_calibration_is_that_of_all_rows(docs):
    rows = [(i, text("abc"[i % 3] * 2, 1 + i % 5, i), "abc"[i % 3] * 2) for i in range(9_000)]
    model = langid.train(docs([*rows, (9_001, "12", "bb"), (9_002, None, "cc"), (9_003, "ba", None)]))
    costs, squares, n = langid.cross_entropies(model, [t for _, t, _ in rows])
    truth = np.array([model.languages.index(lang) for _, _, lang in rows])
    own = costs[truth, np.arange(len(rows))]
    spread = squares[truth, np.arange(len(rows))] - own**2
    for k in range(3):
        mine = truth == k
        assert model.centre[k] == np.median(own[mine])
        assert math.isclose(model.between[k], (1.4826 * np.median(np.abs(own[mine] - model.centre[k]))) ** 2, rel_tol=1e-12)
        assert math.isclose(model.within[k], 4 * spread[mine].mean(), rel_tol=1e-9)
        assert math.isclose(model.foreign[k], costs[k, ~mine].mean(), rel_tol=1e-9)

    def loss(sharpness):
        p = np.exp(-(costs - costs.min(axis=0)) * n * sharpness)
        return -np.maximum(np.log((p / p.sum(axis=0))[truth, np.arange(len(rows))]), -20).mean()

    assert model.sharpness == min(2.0 ** np.arange(-8, 4), key=loss)


def test_counts_are_those_of_all_rows(docs):
    rows = corpus(60)
    counted = {(r.lang, r.gram): r.n for r in langid.count_grams(docs(rows)).collect()}
    expected = {}
    for _, t, lang in rows:
        symbols = [0]
        for c in t.lower():
            s = ord(c) - 96 if "a" <= c <= "z" else (27 + ord(c) % 37 if c.isalpha() else 0)
            if s or symbols[-1]:
                symbols.append(s)
        padded = [0, 0, *symbols]
        for k in range(len(symbols)):
            a, b, c = padded[k : k + 3]
            key = (lang, (a << 12) | (b << 6) | c)
            expected[key] = expected.get(key, 0) + 1
    assert counted == expected


def test_probabilities_are_interpolated_kneser_ney():
    draw = np.random.default_rng(1)
    grams = {}
    for a, b, c in draw.integers(0, 5, (400, 3)):
        grams[(a, b, c)] = grams.get((a, b, c), 0) + 1
    packed = np.array([(a << 12) | (b << 6) | c for a, b, c in grams])
    model = langid.KneserNey(packed, np.array(list(grams.values())))

    def level(counts):
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    pairs, singles = {}, {}
    for g in grams:
        pairs[g[1:]] = pairs.get(g[1:], 0) + 1
    for g in pairs:
        singles[g[1:]] = singles.get(g[1:], 0) + 1

    def p(g, counts_by_length):
        if not g:
            return 1 / 64
        counts = counts_by_length[len(g)]
        d = level(counts)
        same = {k: n for k, n in counts.items() if k[:-1] == g[:-1]}
        rest = p(g[1:], counts_by_length)
        if not same:
            return rest
        total = sum(same.values())
        return max(counts.get(g, 0) - d, 0) / total + d * len(same) / total * rest

    for g in [(0, 1, 2), (4, 4, 4), (1, 2, 63), (60, 1, 2), (60, 61, 62)]:
        got = model.probability(np.array([(g[0] << 12) | (g[1] << 6) | g[2]]))[0]
        assert math.isclose(got, p(g, {3: grams, 2: pairs, 1: singles}), rel_tol=1e-12)
    for a, b in [(0, 1), (3, 3), (60, 2)]:
        every = np.array([(a << 12) | (b << 6) | c for c in range(64)])
        assert math.isclose(model.probability(every).sum(), 1, rel_tol=1e-9)
