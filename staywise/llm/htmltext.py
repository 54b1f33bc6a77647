"""HTML main text by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags. A classifier gives every block a cost of being content and one
of being boilerplate: what the nearest telling element around it says, and a logistic model of its text, fitted on
blocks where such an element is present. The costs are the capacities of edges from the source and to the sink;
neighbouring blocks and blocks of the same parent are joined by smoothness edges, which together are worth about as much
as a telling element. The minimum cut, found by maximum flow, is the labelling of least cost: blocks on the source side
are the article.

An element tells by its tag, role or the words of its class and id. Words of a class that only says what a page has or
has not (``has-sidebar``, ``comments-open``) say nothing about the text. An element that speaks against content, but holds
more than HALF of the page's text, says nothing if the page has no article outside of it: it is a wrapper.

Scripts, styles and other raw elements never become blocks. Character references are decoded, white space inside a
block becomes one space, blocks are joined by line ends. Null pages, pages without text and pages whose blocks are
all boilerplate give an empty text. Broken markup is read as far as it goes: unclosed elements end with the page, a
tag that is cut off is dropped. Repeated rows are extracted each for itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import in_batches, missing

# Fixed vocabulary of HTML.
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a new one of the key ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# What elements tell: their tags, roles and the words of their class and id.
AGAINST_TAGS = frozenset("nav footer aside form menu dialog button select fieldset noscript head".split())
FOR_TAGS = frozenset("article main".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FOR_ROLES = frozenset("main article".split())
AGAINST_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar"
    " navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay newsletter subscribe subscription signup login register comment comments"
    " commentlist respond reply replies disqus discussion share sharing social related recommended recommendations"
    " pagination pager toolbar widget copyright legal disclaimer search form tags byline".split()
)
FOR_WORDS = frozenset("article content post entry story main articlebody maincontent".split())
#: With one of these in it a class says what there is on a page, or about what, and not what its element is.
ABOUT_WORDS = frozenset("has no not with without open closed enabled disabled tag category".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Capacity that a telling element gives, bound of the text model's capacity, and capacities of smoothness edges.
TELLING, TEXT_BOUND, NEXT_TO, SAME_PARENT = 3.0, 1.5, 0.9, 0.45
#: Share of a page's text from which on an element that speaks against content may be a wrapper.
HALF = 0.5
#: Pages (expected number) on whose blocks the text model is fitted, and blocks of them.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 40_000


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("element", "linked", "parent", "parts", "tag", "tells", "text")

    def __init__(self, parent: int, tag: str, element: int):
        self.parent, self.tag, self.element = parent, tag, element
        self.parts: list[str] = []
        self.linked = self.tells = 0
        self.text = ""


def _tells(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Does an element speak for content, and does it speak against?"""
    against = tag in AGAINST_TAGS or (tag == "header" and not inside_article)
    positive = tag in FOR_TAGS
    if attributes and "=" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                roles = set(value.lower().split())
                against |= bool(roles & AGAINST_ROLES)
                positive |= bool(roles & FOR_ROLES)
            elif name in ("class", "id"):
                if tag in ("body", "html"):
                    continue
                for own in value.split():
                    words = {w.lower() for w in _WORD.findall(own)}
                    if not words & ABOUT_WORDS:
                        against |= bool(words & AGAINST_WORDS)
                        positive |= bool(words & FOR_WORDS)
            elif name == "itemprop":
                positive |= value.lower() == "articlebody"
            elif (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and value == "true"):
                against = True
    return positive, against


def _settle(found: list[Block], above: list[int], says: list[tuple[bool, bool]]) -> None:
    """What the nearest telling element says about each block, once it is known how much text the elements hold."""
    size = [0] * len(above)
    for b in found:
        size[b.element] += len(b.text)
    for e in range(len(above) - 1, 0, -1):  # children have larger numbers
        size[above[e]] += size[e]
    article = [0] * len(above)  # text inside elements that speak for content, the outermost of each counted
    for e in range(len(above) - 1, 0, -1):
        if says[e][0]:
            article[e] = size[e]
        article[above[e]] += article[e]
    tells = [0] * len(above)
    for e in range(1, len(above)):
        positive, against = says[e]
        if against and size[e] > HALF * size[0] and article[e] == article[0]:
            against = False
        tells[e] = -1 if against else 1 if positive else tells[above[e]]
    for b in found:
        b.tells = tells[b.element]


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, each with what the nearest telling element around it says."""
    found: list[Block] = []
    # Open block-level elements: (tag, number, is an article open?), and how many of each tag are open.
    stack = [("", 0, False)]
    opened: Counter[str] = Counter()
    above, says = [0], [(False, False)]
    links, current = 0, None

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text.strip():
                return
            tag, element, _ = stack[-1]
            own = tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "dd", "dt", "figcaption")
            current = Block(stack[-2][1] if own and len(stack) > 1 else element, tag, element)
            found.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(html.unescape(page[at:]))
            break
        match = TAG.match(page, lt)
        if match is None:  # a bare sign
            add(html.unescape(page[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            add(html.unescape(page[at:lt]))
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        current = None
        if tag in VOID:
            continue
        links = 0
        if closing:
            if opened[tag]:  # otherwise it closes nothing, and the open elements need not be searched
                while True:
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
            continue
        ends = ENDS.get(tag, ())
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in ends):
            opened[stack.pop()[0]] -= 1
        _, outer, article = stack[-1]
        above.append(outer)
        says.append(_tells(tag, attributes, article))
        stack.append((tag, len(above) - 1, article or tag in FOR_TAGS))
        opened[tag] += 1
    kept = []
    for b in found:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    _settle(kept, above, says)
    return kept


def features(block: Block) -> list[float]:
    """What the text model sees of a block."""
    text = block.text
    words = text.count(" ") + 1
    return [
        1.0, min(6.0, np.log1p(len(text)) / 1.5), min(5.0, np.log1p(words)), min(1.0, block.linked / len(text)),
        min(3.0, sum(text.count(c) for c in ".,;:!?") / words * 4), float(text[-1] in ".!?:\"'"),
        float(block.tag in ("li", "td", "th", "dt", "dd")), float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(block.tag == "p"),
    ]


#: Weights of the text model where no labelled blocks of both kinds are found.
PLAIN_WEIGHTS = (-2.0, 0.4, 0.3, -4.0, 0.3, 0.5, -1.0, 1.0, 1.0)


def fit_text_model(rows: np.ndarray, content: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic weights, both classes counting alike, with a small penalty."""
    if not len(rows) or content.all() or not content.any():
        return np.array(PLAIN_WEIGHTS)
    weight = np.where(content, 0.5 / content.mean(), 0.5 / (1 - content.mean())) / len(rows)
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (weight * (p - content)) + 1e-3 * w
        curvature = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of the minimum cut; a positive gain is an edge from the source.

    Maximum flow by shortest augmenting levels (Dinic), without recursion.
    """
    n = len(gain)
    if all(g > 0 for g in gain) or all(g <= 0 for g in gain):
        return [g > 0 for g in gain]  # nothing to cut
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def connect(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            connect(source, i, g, 0.0)
        elif g < 0:
            connect(i, sink, -g, 0.0)
    for a, b, capacity in edges:
        connect(a, b, capacity, capacity)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(head[a]):
                path.append(head[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1
            else:
                break


def costs(page: str | None, weights: np.ndarray) -> tuple[list[Block], list[float], list[tuple[int, int, float]]]:
    """Blocks of a page, what each gains by being content, and the smoothness edges between them."""
    own = blocks(page or "")
    if not own:
        return own, [], []
    text = np.clip(np.array([features(b) for b in own]) @ weights, -TEXT_BOUND, TEXT_BOUND)
    gain = [TELLING * b.tells + float(t) for b, t in zip(own, text, strict=True)]
    edges, last = [], {}
    for i, b in enumerate(own):
        if i:
            edges.append((i - 1, i, NEXT_TO if own[i - 1].parent == b.parent else NEXT_TO / 3))
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return own, gain, edges


def main_text(page: str | None, weights: np.ndarray) -> tuple[str, int, int]:
    """(text, number of blocks, number of content blocks) of one page."""
    own, gain, edges = costs(page, weights)
    content = minimum_cut(gain, edges) if own else []
    kept = [b.text for b, c in zip(own, content, strict=True) if c]
    return "\n".join(kept), len(own), len(kept)


def train(pages: DataFrame, key: str = "page_id", page: str = "html") -> np.ndarray:
    """Weights of the text model from blocks with a telling element, on about SAMPLE_PAGES pages chosen by hash."""
    missing(pages, key, page)
    share = min(1.0, SAMPLE_PAGES / max(1, pages.count()))
    mark = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 30))
    chosen = in_batches(pages).where(mark < int(share * (1 << 30))).select(F.col(f"`{page}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [b for t in batch.column(0) for b in blocks(t.as_py() or "") if b.tells]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tells > 0 for b in told], pa.bool_()), pa.array([features(b) for b in told], pa.list_(pa.float64()))],
                names=["content", "x"],
            )

    found = chosen.mapInArrow(run, "content boolean, x array<double>")
    # A page may have very many blocks: as many of them all as the bound allows.
    rows = found.orderBy(F.xxhash64("content", "x")).limit(SAMPLE_BLOCKS).toArrow()
    if not rows.num_rows:
        return np.array(PLAIN_WEIGHTS)
    return fit_text_model(np.array(rows.column("x").to_pylist()), np.array(rows.column("content").to_pylist(), bool))


def extract(pages: DataFrame, weights: np.ndarray | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars, n_blocks, n_content) of every page."""
    missing(pages, key, url, page)
    weights = train(pages, key, page) if weights is None else weights
    schema = T.StructType([
        pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("n_blocks", T.LongType()), T.StructField("n_content", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [main_text(t.as_py(), weights) for t in batch.column(2)]
            texts = [x[0] for x in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()),
                 pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.int64())],
                names=schema.names,
            )

    return in_batches(pages).select(*[F.col(f"`{c}`") for c in (key, url)], F.col(f"`{page}`").cast("string").alias("_page")).mapInArrow(run, schema)
