from __future__ import annotations

import math
import re
import textwrap
from collections import Counter

from staywise.llm import licenses

MIT, APACHE = licenses.TEMPLATES[0][1], licenses.TEMPLATES[2][1]


def brute(files, threshold=licenses.THRESHOLD):
    """path to (license, origin, line, levels)."""
    words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    texts = [t for _, t in files if t is not None]
    df = Counter(w for t in texts for w in set(words(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    models = [vector(t) for _, t in licenses.TEMPLATES]

    def best(unit):
        v = vector(unit)
        if not v:
            return None
        scored = [(-round(sum(x * m.get(w, 0) for w, x in v.items()) / norm(v) / norm(m), 6), k) for k, m in enumerate(models)]
        s, k = min(scored)
        return (s, k) if -s >= threshold else None

    def units(text):
        lines = text.split("\n")
        runs = []
        for n, line in enumerate(lines):
            if words(line):
                if runs and runs[-1][-1] == n - 1:
                    runs[-1].append(n)
                else:
                    runs.append([n])
        start = runs[0][0] if runs else None
        yield -1, -1, False, text
        for run in runs:
            yield from ((n, n, n == start, lines[n]) for n in run)
            if len(run) > 1:
                yield run[0], run[-1], run[0] == start, "\n".join(lines[n] for n in run)

    own, folders = {}, {}
    for path, text in sorted((p, t) for p, t in files if p is not None and t is not None):
        found = [(b[0], line, last, b[1], first) for line, last, first, u in units(text) if (b := best(u))]
        if found:
            own[path] = min([x[:4] for x in found] + ([own[path]] if path in own else []))
        for s, line, _, k, first in found:
            if line == -1 or (first and k >= licenses.FIRST_TITLE):
                folder, mine = path.rpartition("/")[0], (path, s, k)
                folders[folder] = min(folders.get(folder, mine), mine)
    out = {}
    for path in {p for p, _ in files if p is not None}:
        if path in own:
            _, line, _, k = own[path]
            out[path] = (licenses.TEMPLATES[k][0], path, line, None)
            continue
        out[path] = (None, None, None, None)
        above, levels = path, -1
        while above:
            above, levels = above.rpartition("/")[0], levels + 1
            if above in folders:
                origin, _, k = folders[above]
                out[path] = (licenses.TEMPLATES[k][0], origin, None, levels)
                break
    return out


FILES = [
    ("LICENSE", MIT), ("a.txt", "some words of a file"), ("lib/LICENSE.txt", f"\n{APACHE}\n"), ("lib/COPYING", licenses.TEMPLATES[3][1]),
    ("lib/x/y/z.txt", "nothing\nat all"), ("lib/x/own.txt", f"first\n{licenses.TEMPLATES[8][1].upper()}\nlast"), ("lib/x/null.txt", None),
    ("lib/x/empty.txt", ""), ("doc/long.txt", "filler words here " * 20_000 + "\n" + MIT), ("doc/close.txt", "Released under the new MIT License!"),
    ("doc/far.txt", "the license of the thing was released under the table"), ("doc/two.txt", f"{APACHE}\n{MIT}\n{MIT}"), (None, MIT), ("a.txt", "again"),
    ("doc/accents.txt", "Réleased ünder the MIT License. é"), ("doc/tie.txt", "Licensed under CC BY 4.0. and Licensed under CC BY-SA 4.0."),
]


def run(spark, files):
    frame = spark.createDataFrame([(p, t, "x", 1) for p, t in files], "path string, text string, license string, line int")
    return {r.path: (r.license, r.origin, r.line, r.levels) for r in licenses.scan(frame).collect()}


def test_like_brute_force(spark):
    assert run(spark, FILES) == brute(FILES)
    without_root = FILES[1:]
    assert run(spark, without_root) == brute(without_root)


def wrapped(text, before="", width=80):
    return "\n".join(before + line for line in textwrap.wrap(text, width))


def test_whole_licence_files_and_wrapped_headers(spark):
    """Complete licence files, wrapped as they are usually written, give; headers in comments state."""
    whole = dict(licenses.WHOLE_TEXTS)
    mit = "MIT License\n\nCopyright (c) 2024 Some Author\n\n" + wrapped(whole["MIT"])
    bare = "Copyright (c) 2024 Some Author\n\n" + wrapped(whole["BSD-3-Clause"], width=72)
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n"
    apache += "   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + "\n\n".join(f"   {i}. Some clause about many things, number {i}, and what follows." for i in range(40))
    files = [
        ("a/LICENSE", mit), ("a/src/x.txt", "code"), ("b/LICENSE", bare), ("b/y.txt", "code"), ("c/LICENSE", apache), ("c/d/z.txt", "code"),
        ("e/hash.py", wrapped(whole["Apache-2.0"], "# ") + "\n\nimport os\n" + "x = 1\n" * 30),
        ("e/star.c", "/*\n" + wrapped(whole["GPL-3.0"], " * ", 60) + "\n */\nint main() { return 0; }\n" + "call(a, b);\n" * 30),
        ("e/none.txt", "The license question was left open."),
    ] + [(f"prose/{i}", f"words of file {i} and the rest of it, by any means") for i in range(60)]
    found = run(spark, files)
    assert found == brute(files)
    assert [found[p][0] for p in ("a/LICENSE", "a/src/x.txt", "b/LICENSE", "b/y.txt", "c/d/z.txt")] == ["MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "Apache-2.0"]
    assert found["e/hash.py"][0] == "Apache-2.0" and found["e/star.c"][0] == "GPL-3.0" and found["e/none.txt"][0] is None
    # Beside common words a statement keeps its score however large the table is; the words are counted, not guessed.
    more = files + [(f"more/{i}", f"en on filler {i}") for i in range(300)] + [("s/1", "En on released under the MIT License.")]
    assert run(spark, more)["s/1"][0] == "MIT"
    frame = spark.createDataFrame(files, "path string, text string")
    far = {r.path: r.license for r in licenses.scan(frame, few=0).collect()}  # counts by a shuffled join
    assert far == {p: x[0] for p, x in found.items()}


def test_only_words_near_a_template_are_counted(spark, monkeypatch):
    """Prose of words from many templates is near none of them: its other words are not counted over all files."""
    counted, write = set(), licenses.materialize

    def spy(frame):
        if frame.columns == ["w"]:
            counted.update(r.w for r in frame.collect())
        return write(frame)

    monkeypatch.setattr(licenses, "materialize", spy)
    prose = " ".join(sorted(licenses._vocabulary())) + " zebra"
    files = [("a/prose", prose), ("b/near", "Released under the new MIT License!"), ("c/other", "giraffe")]
    assert run(spark, files) == brute(files)
    assert counted == {"new"}


def test_every_template_is_found(spark):
    files = [(f"f{i}", f"text before it\n{t}\nand after") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    assert {p: x[0] for p, x in run(spark, files).items()} == {f"f{i}": name for i, (name, _) in enumerate(licenses.TEMPLATES)}


def test_telling_words_are_enough():
    idf = {w: 1 + len(w) for w in licenses._vocabulary()}
    weights = licenses._weights(idf)
    telling = licenses._telling(weights, 0.8)
    for k in range(len(licenses.TEMPLATES)):
        rest = math.sqrt(sum(x * x for w, j, x in weights if j == k and w not in telling))
        assert rest < 0.8


def test_empty_tables(spark, docs):
    assert run(spark, []) == {}
    assert run(spark, [("a", None)]) == {"a": (None, None, None, None)}
    assert licenses.documents(docs([])).collect() == []
    row = licenses.documents(docs([(7, "x\n" + MIT, None, "s")])).first()
    assert (row.path, row.license, row.line, row.levels) == ("s/_/7", "MIT", 1, -2)
