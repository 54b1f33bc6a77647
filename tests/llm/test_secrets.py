from __future__ import annotations

import hashlib
import random
import re

import pytest

from staywise.llm import secrets

BASE = {
    "assign": re.compile(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain(text):
    found = []
    for rank, (kind, least) in enumerate((("assign", 8), ("access", 16), ("hex", 32))):
        for m in BASE[kind].finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


HEX = "0123456789abcdef"
TEXTS = [
    None, "", "password", "password=", "password=short", "PassWord : 'longenough1", "api_key=abcdefgh apikey:ABCDEFGH", "paſſword=longenough1",
    "toKen=longenough1", "secret = \"a/b+c==d\"é", "token=x token=yyyyyyyyy", "password=password=abcdefghij", "😀secret=abcdefgh😀", "AKIA" + "A" * 12,
    "AKIAAKIA" + "B" * 8, "xAKIA" + "0" * 30, "f" * 31, "f" * 32 + "g" + "0" * 40, "token=" + "a" * 40, "passwd\t=abcdefgh", "passwd   =   abcdefgh",
    "secret=" + "ab" * 20_000, "x" * 50_000 + " token='12345678'",
]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    value = lambda n, of=HEX: "".join(draw.choice(of) for _ in range(n))
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 20))) for _ in range(400)]
    for i in range(100, 700):
        parts = [draw.choice(words) for _ in range(30)]
        if i % 3 == 0:
            parts.insert(7, f"password={value(18)}")
        if i % 7 == 0:
            parts.insert(3, "AKIA" + value(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        rows.append((i, " ".join(parts) + f" mail{i}.some-host.example.com call 4{value(15, '0123456789')}"))
    rows += [(900, f"it is {value(18)} for you"), (901, "he said ASIA" + value(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), (None, "no id"), (3, TEXTS[3])]
    return rows


def test_base_spans_of_hard_texts():
    for text in TEXTS:
        assert [f"{k}:{a}:{b}" for k, a, b, _ in secrets.base_spans(text or "")] == plain(text)


def test_scan_of_documents(docs, corpus):
    got = secrets.digests(docs(corpus)).collect()
    assert len(got) == len(corpus)
    texts = dict(corpus)
    for r in got:
        expected = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in expected) for k in ("assign", "access", "hex")]
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("like_")] == expected
        assert r.n_added == len(spans) - len(expected)
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
    added = {r.doc_id: r.spans for r in got if r.n_added}
    assert added == {900: "like_assign:6:24", 901: "like_access:8:28"}  # and no mail address, number or word


def test_nothing_labelled_and_empty_tables(docs):
    assert [r.spans for r in secrets.digests(docs([(1, "abcdefghijklmnopqrst"), (2, None)])).collect()] == ["", ""]
    assert secrets.digests(docs([])).collect() == []


def test_automaton_folds_to_the_format():
    draw = random.Random(1)
    loop = secrets.Automaton(["".join(draw.choice("0a") for _ in range(draw.randint(1, 30))) for _ in range(400)])
    assert len(loop.log) <= 3
    fixed = secrets.Automaton(["ab-" + "".join(draw.choice("0123456789") for _ in range(6)) for _ in range(400)])
    inside, outside = fixed.score("cd-123456"), [fixed.score(x) for x in ("cd123456-", "123456", "cd-12x456", "-")]
    assert fixed.low <= inside <= fixed.high and all(x < fixed.low for x in outside)


def test_short_credentials_in_the_format_of_labelled_ones(docs):
    """Bare values of 8 to 15 characters are scored like longer ones; words of such lengths are not added."""
    draw = random.Random(3)
    value = lambda n: "".join(draw.choice(HEX) for _ in range(n))
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 20))) for _ in range(400)]
    for length in (8, 12, 15):
        rows = [(i, " ".join([*[draw.choice(words) for _ in range(30)], f"password={value(length)}"])) for i in range(300)]
        rows.append((900, f"it is {value(length)} for you"))
        added = {r.doc_id: r.spans for r in secrets.digests(docs(rows)).collect() if r.n_added}
        assert added == {900: f"like_assign:6:{6 + length}"}


def test_precision_and_recall_on_planted_credentials(docs):
    """Bare credentials of three formats among card numbers, phone numbers, hosts, addresses, ids and words."""
    draw = random.Random(12)
    of = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    formats = [lambda: of(40, HEX), lambda: f"{of(20, mixed)}", lambda: "AKIA" + of(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")]
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 20))) for _ in range(600)]
    rows, planted = [], {}
    for i in range(900):
        text = " ".join(draw.choice(words) for _ in range(20))
        plain_tokens = [
            of(16, "0123456789"), f"555-{of(4, '0123456789')}", f"mail{i}.example.com", ".".join(str(draw.randrange(256)) for _ in range(4)),
            f"2024-0{draw.randint(1, 9)}-1{draw.randrange(10)}", f"item-{of(6, '0123456789')}", f"some/path/{draw.choice(words)}.html",
        ]
        text += " " + " ".join(plain_tokens)
        if i % 3 == 0:
            text += f" password={formats[i // 3 % 2]()} {formats[2]()}"
        if i % 20 == 7:
            secret = formats[i // 20 % 2]()
            planted[i] = (len(text) + 1, len(text) + 1 + len(secret))
            text += f" {secret}"
        rows.append((i, text))
    # A planted hexadecimal value is found by the base pattern already; what counts is what is found at all.
    found = {}
    for r in secrets.digests(docs(rows)).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        found[r.doc_id] = [(int(a), int(b)) for k, a, b in spans if k.startswith("like_") or (k == "hex" and int(a) == planted.get(r.doc_id, (-1,))[0])]
    hits = sum(planted[i] in found[i] for i in planted)
    extra = sum(len(x) for x in found.values()) - hits
    assert hits >= 0.9 * len(planted) and extra <= 0.05 * hits
