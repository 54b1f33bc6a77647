from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from staywise.llm import linededup


def sets(rows):
    """(id, line number) to the set of words of each line that has any."""
    found = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words and i is not None:
                found[i, pos] = words
    return found


def brute(rows, limit=0.8):
    """Text that is left for each id."""
    own = sets(rows)
    order = sorted(own)
    removed = {b for k, b in enumerate(order) for a in order[:k] if len(own[a] & own[b]) >= limit * len(own[a] | own[b]) - 1e-12}
    out = {}
    for i, text in rows:
        out[i] = None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if (i, pos) not in removed)
    return out


def corpus(seed=1, documents=40):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(3000)]
    pool = [[draw.choice(words) for _ in range(draw.choice([1, 2, 4, 5, 9, 20, 60]))] for _ in range(60)]
    rows = []
    for i in range(documents):
        lines = []
        for _ in range(draw.randint(0, 9)):
            line = list(draw.choice(pool))
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                line[draw.randrange(len(line))] = draw.choice([*words, f"new{draw.random()}"])
            lines.append(draw.choice([" ", "  ", "\t"]).join(line))
        rows.append((i, "\n".join(lines)))
    return rows


HARD = [(100, None), (101, ""), (102, "\n\n"), (103, " \t\r\n x \n\n y\x0bx\n"), (104, "x y\r\ny x\nX y"), (105, "é ñ 漢 é"), (106, "ñ é 漢"),
        (107, "a\x1fb"), (108, "word " * 20_000), (109, " ".join(f"u{i}" for i in range(8000))), (110, " ".join(f"u{i}" for i in range(7000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(docs, seed):
    rows = [*corpus(seed), *HARD]
    frame = docs(rows)
    got = linededup.dedup_lines(frame)
    assert got.columns == [c for c in frame.columns if c != "n_lines"] + ["n_lines", "n_kept"]
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)


def test_digests_and_the_sql(spark, docs):
    rows = [*corpus(3), *HARD]
    frame = docs(rows)
    got = {r.doc_id: r for r in linededup.digests(frame).collect()}
    for i, text in brute(rows).items():
        assert got[i].text_sha256 == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
    documents = frame.select("doc_id", "text").toPandas()  # read by name below
    assert len(documents)
    theirs = duckdb.sql(linededup.ORACLE).fetchall()
    assert sorted(theirs) == sorted((r.doc_id, r.n_lines, r.n_kept, r.text_sha256) for r in got.values())


def test_many_variants_of_one_line(docs):
    base = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"v{i}", *base[i % 40 + 1 :]])) for i in range(300)]
    rows += [(1000 + i, "the same line in very many documents") for i in range(300)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(rows)).collect()}
    assert got == brute(rows)
    assert sum(map(bool, got.values())) < 10


def test_repeated_rows_null_keys_and_empty_tables(docs):
    rows = [(1, "one two three four five\nsix"), (1, "one two three four five\nsix"), (None, "six"), (None, "six"), (2, "six")]
    got = sorted((r.doc_id or 0, r.text) for r in linededup.dedup_lines(docs(rows)).collect())
    assert got == [(0, "six"), (0, "six"), (1, rows[0][1]), (1, rows[0][1]), (2, "")]
    assert linededup.dedup_lines(docs([])).collect() == []
    assert linededup.dedup_lines(docs([(1, None)])).first().text is None


def test_repeated_keys_with_different_texts(docs):
    """Clean lines stay and similar ones go, whichever row of a key they stand on."""
    rows, expected = [], []
    for g in range(12):
        word = lambda x: f"{x}{g}"  # noqa: E731, B023
        line = lambda text: " ".join(map(word, text.split()))  # noqa: E731, B023
        first, similar, clean = line("a b c d e"), line("a b c d e f"), line("x y z w v")
        rows += [(10 * g, first), (10 * g + 1, similar), (10 * g + 1, clean), (None, similar)]
        expected += [(10 * g, first), (10 * g + 1, ""), (10 * g + 1, clean), (-1, similar)]
    got = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in linededup.dedup_lines(docs(rows)).collect()]
    assert sorted(got) == sorted(expected)


def test_repeated_keys_like_brute_force(docs):
    """Lines named by key, place and set: order by key and place, no two sets share both."""
    rows = [(i // 2, text if i % 2 else "\n" * 9 + text) for i, (_, text) in enumerate(corpus(6, 60))]
    own = {}
    for n, (i, text) in enumerate(rows):
        for pos, line in enumerate(text.split("\n")):
            if words := frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)):
                own[i, pos, n] = words
    order = sorted(own)
    removed = {b for k, b in enumerate(order) for a in order[:k] if 9 * len(own[a] & own[b]) >= 4 * (len(own[a]) + len(own[b]))}
    expected = [(i, "\n".join(x for pos, x in enumerate(t.split("\n")) if (i, pos, n) not in removed)) for n, (i, t) in enumerate(rows)]
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(docs(rows)).collect()) == sorted(expected)


def test_other_thresholds(docs):
    rows = corpus(4)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(rows), 1, 2).collect()}
    assert got == brute(rows, 0.5)


def test_lines_around_the_length_of_wide_maps(docs):
    """Near copies and others whose sizes are at and about the bounds of the two kinds of maps."""
    draw, rows = random.Random(7), []
    for n in (150, 153, 154, 155, 191, 192, 193, 230, 240, 241, 300):
        base = [f"w{draw.randrange(3000)}" for _ in range(n)]
        for share in (0, 0.08, 0.1, 0.11, 0.12, 0.2):
            line = [f"c{n}x{draw.random()}" if draw.random() < share else w for w in base]
            rows.append((len(rows), " ".join(draw.sample(line, n)) + "\n" + " ".join(line[: round(n * 0.82)])))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(rows)).collect()}
    assert got == brute(rows)
    assert 11 < sum(len(sets([(i, t)])) for i, t in got.items()) < len(rows)  # some copies stay, most go


def test_pairs_are_sized_before_their_names_are_compared(docs, monkeypatch):
    """Most pairs of rows that share a word end at sizes and maps; structs of names are made for the others only."""
    plans, written = [], linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda frame: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or written(frame))
    linededup.dedup_lines(docs(corpus(1, 10)))
    met = [line for plan in plans for line in plan.split("\n") if "Join Inner" in line and "bit_count" in line]
    assert len(met) == 1 + linededup.ROUNDS
    assert all(line.index("bit_count(") < line.index("struct(doc") for line in met)


def test_hashes_are_made_outside_of_other_lambdas(docs):
    """Distinct hashes come from generated code: inside another array function's lambda input they would be interpreted."""
    sets = linededup.distinct_sets(docs(corpus(1, 10)), bytes(1 << linededup.RARITY_BITS), None, "doc_id", "text", 4, 5)
    plan = sets._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = [line for line in plan if "array_distinct(" in line]
    assert len(made) == 1 and made[0].count("lambdafunction(") == 1
