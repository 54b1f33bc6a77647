from __future__ import annotations

import itertools
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from staywise.llm import htmltext

ROOT = Path(__file__).resolve().parents[2]
PLAIN = np.array(htmltext.PLAIN_WEIGHTS)
PAGE = """<!DOCTYPE html><html lang="en"><head><title>No title</title><style>p{margin:0}</style></head><body class="has-sidebar">
<header><h1>Site</h1><a href="/x">Log in</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies. They are, as ever, good for you.</p></div>
<div class="left-sidebar"><p>About the author, who wrote many long sentences here.</p></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph,&nbsp;with <b>bold</b>\nand <a href="z>y">a link</a>.<br>Next line.</p>
<div class="ad-slot"><p>Buy now, it is cheap, it is good, it is yours.</p></div><p>x</p><ul><li>one<li>two</ul><!-- <p>hidden</p> -->
<form><label>Name</label><input value="v"><button>Go</button></form><aside>Related stories</aside>
<script>if (a < b) { x = "<p>no</p>" }</script><blockquote>1 &lt; 2 &#x41; &unknown; a < b</blockquote>
<section id="comments"><h2>Comments</h2><div class="comment-body"><p>Great article, I liked it very much, thank you.</p></div></section>
</article></main><footer>&copy; someone</footer></body></html>"""


def text(page, weights=PLAIN):
    return htmltext.main_text(page, weights)[0]


def test_page_with_everything():
    assert text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with bold and a link. Next line.", "x", "one", "two", "1 < 2 A &unknown; a < b",
    ]


def test_page_without_telling_elements():
    body = "<p>A long paragraph with words, commas, and sentences. It goes on.</p>" * 3
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>A title</h1>{body}</div><ul><li><a href=x>Privacy</a><li><a href=y>Terms</a></ul>"
    assert text(page).split("\n") == ["A title", *["A long paragraph with words, commas, and sentences. It goes on."] * 3]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p>", "</p></div>", "<script>x", "<!-- open", "<nav>Menu</nav>", "<article><p class='x", "<!doctype html"])
def test_nothing_to_find(page):
    assert text(page) == ""


def test_cut_off_and_broken_pages():
    assert text("<article><p>One &am") == "One &am"
    assert text("<article><p>One</b></i></div><p>Two<a href='") == "One\nTwo"
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<article><p>a<br>b<br/>c</p>tail") == "a b c\ntail"
    assert text("<article>5 > 3 <3 &amp;lt;") == "5 > 3 <3 &lt;"


def test_pages_cut_off_after_a_long_tag():
    """In a process of its own: a pattern that tries all ways would never end."""
    cuts = ["<a " + "href title " * 40, '<a title="x ' + "abc " * 100, "<word and text " * 40, '<a title="x ' + "abc " * 100 + "> two"]
    code = f"from staywise.llm import htmltext as h\nfor c in {cuts!r}: print([''.join(b.parts) for b in h.blocks('<article><p>One</p>' + c)])"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=30, check=True)
    assert done.stdout.splitlines() == ["['One']"] * 3 + ["['One', ' two']"]


def test_long_pages():
    many = "".join(f"<p>Paragraph {i}, with some words.</p><div class=ad>Buy {i}</div>" for i in range(3000))
    got = text(f"<body><nav>Menu</nav><article>{many}</article></body>").split("\n")
    assert got == [f"Paragraph {i}, with some words." for i in range(3000)]
    assert len(text("<article><p>" + "word " * 200_000)) == 999_999


def cost(gain, edges, side):
    return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side)) + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_is_minimal():
    draw = random.Random(6)
    for _ in range(150):
        n = draw.randint(1, 9)
        gain = [draw.choice([-6, -2, -0.5, 0.3, 1, 6]) for _ in range(n)]
        edges = [(a, b, draw.choice([0.3, 0.6, 4])) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]
        best = min(cost(gain, edges, side) for side in itertools.product([False, True], repeat=n))
        assert cost(gain, edges, htmltext.minimum_cut(gain, edges)) == pytest.approx(best)


def test_table_of_pages(spark):
    rows = [(i, f"u{i}", PAGE.replace("First", f"No {i}"), 1) for i in range(30)] + [(30, None, None, 1), (31, "", "", 1), (None, "x", PAGE, 1), (3, "u3", PAGE, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmltext.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in (30, 31):
            assert r.text == ""
        else:
            assert r.text.split("\n")[0] == "Title & more" and "cookies" not in r.text
    assert htmltext.extract(pages.where("page_id < 0")).collect() == []


def test_text_model_learns_from_telling_elements():
    content = [htmltext.blocks("<article><p>Some words, with commas, and an end.</p></article>")[0] for _ in range(20)]
    menu = [htmltext.blocks("<nav><a href=x>Home</a></nav>")[0] for _ in range(20)]
    rows = np.array([htmltext.features(b) for b in content + menu])
    w = htmltext.fit_text_model(rows, np.array([True] * 20 + [False] * 20))
    assert (rows[:20] @ w > 0).all() and (rows[20:] @ w < 0).all()
    assert htmltext.fit_text_model(rows[:20], np.array([True] * 20)).tolist() == list(htmltext.PLAIN_WEIGHTS)


LONG = [f"A long paragraph number {i}, with words, commas, and sentences. It goes on and on, as prose does." for i in range(3)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize("wrapper", [
    ('<div class="content has-sidebar">', "</div>"), ('<div class="post-content no-sidebar">', "</div>"), ('<div class="main with-comments">', "</div>"),
    ('<article class="post tag-news comments-open">', "</article>"), ('<form action="/">', "</form>"),
    ('<div class="page sidebar-layout">', "</div>"), ('<form><div id="social">', "</div></form>"),
])
@pytest.mark.parametrize("copies", [1, 10])
def test_wrappers_with_unlucky_names(wrapper, copies):
    page = f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav>{wrapper[0]}{PARAGRAPHS * copies}{wrapper[1]}<footer>Imprint</footer></body>"
    assert text(page).split("\n") == LONG * copies


def test_long_comments_beside_an_article():
    page = f"<body><article><p>{LONG[0]}</p></article><section id=comments>{PARAGRAPHS * 5}</section></body>"
    assert text(page) == LONG[0]


def test_the_cut_decides():
    """A paragraph with an unlucky class among its like is content, and a lone prose block between notices is not."""
    body = f"<p>{LONG[0]}</p><p class='notice'>{LONG[1]}</p><p>{LONG[2]}</p>"
    own = htmltext.blocks(f"<article>{body}</article>")
    assert [b.tells for b in own] == [1, -1, 1]  # by itself it would go
    assert text(f"<article>{body}</article>").split("\n") == LONG
    menu = "<ul><li><a href=a>Home</a></li><li>Read more, now.</li><li><a href=b>News</a></li><li><a href=c>Imprint</a></li></ul>"
    assert text(f"<div>{menu}</div><article>{PARAGRAPHS}</article>").split("\n") == LONG
    assert htmltext.minimum_cut([-0.7, 0.4, -0.7], [(0, 1, 0.9), (1, 2, 0.9)]) == [False] * 3


def test_whole_pages_by_brute_force():
    """Every labelling of a page's blocks is tried: the text is that of the one of least cost."""
    draw = random.Random(4)
    parts = [f"<p>{LONG[0]}</p>", "<p>Short</p>", "<li><a href=x>Link</a></li>", f"<p class=notice>{LONG[1]}</p>", "<div class=ad>Buy now, buy here.</div>", "<h2>Heading</h2>"]
    for _ in range(60):
        inside = "".join(draw.choice(parts) for _ in range(draw.randint(1, 8)))
        page = draw.choice(["<article>{}</article>", "<div>{}</div>", "<div><ul>{}</ul></div>"]).format(inside)
        own, gain, edges = htmltext.costs(page, PLAIN)
        best = min(itertools.product([False, True], repeat=len(own)), key=lambda side: round(cost(gain, edges, side), 9))
        lowest = cost(gain, edges, best)
        got = text(page)
        chosen = [side for side in itertools.product([False, True], repeat=len(own)) if abs(cost(gain, edges, side) - lowest) < 1e-9]
        assert got in ["\n".join(b.text for b, s in zip(own, side) if s) for side in chosen]


def test_unmatched_closing_tags_are_linear():
    from time import process_time

    page = "<article>" + "<div>" * 40_000 + "deep" + "</section>" * 40_000
    started = process_time()
    assert text(page) == "deep"
    assert process_time() - started < 5
