"""Ranked lexical search: branch and bound over an FP-tree of the documents.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. Of every
document only the terms of the items are kept, the most frequent first, so that documents share the beginnings of
their term vectors: these are the paths of a trie. Where a path does not branch its nodes are one, and at most LEAF
documents below a node are not parted further. Each node holds the largest tf of every term and the smallest length
measure m below it. As a term's score rises with tf and falls with m, they bound the score of every document below.
For each item the trie is searched depth first, best bound first, and what cannot reach the item's k-th best score so
far is left out. The k best of all tries are merged.

A task builds a trie for every TREE_DOCS documents it reads (fewer if their vectors are long) and keeps the k best
documents of each item from one to the next. Items are taken in blocks of BLOCK_BYTES of text, so what is sent to the
tasks is bounded, however many items there are: each block is one pass over the documents. Counts over the corpus (N,
L, df) are taken from all documents. All scores are integers; only a term's weight goes through a logarithm.

A null text has no terms. Rows that repeat a doc_id, or have none, are documents of their own (null is the largest
id); equal item rows count once, and rows that share an item_id with different texts are items of their own. An item
without terms, or whose terms no document holds, has no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import in_batches, materialize, missing

TOP = 20
#: Documents and postings of one trie, and documents below a node that is not parted.
TREE_DOCS, TREE_POSTINGS, LEAF = 8192, 1 << 21, 24
#: Text of the items of one block, in bytes.
BLOCK_BYTES = 1 << 20
_OWN = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TERMS = bytes(c + 32 if 0x41 <= c < 0x5B else c if c in _OWN else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode().translate(_TERMS).split()


def _vectors(documents: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """Rows (doc, n, t, f): number of terms of every document; its terms that have a number, and their tf."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            n, sizes, t, f = [], [0], [], []
            for x in batch.column(1):
                words = terms(x.as_py())
                held = Counter(map(get, words))
                held.pop(None, None)
                n.append(len(words))
                t.extend(held.keys())
                f.extend(held.values())
                sizes.append(len(t))
            at = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (t, f)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc", "n", "t", "f"])

    rows = in_batches(documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")))
    return rows.mapInArrow(run, f"doc {kind}, n long, t array<int>, f array<int>")


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def measure(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of documents with n terms; exact however large the corpus is."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + (25 * n * documents) // length
    return np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)


def contribution(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms add to a score; never less for a larger tf or a smaller m."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the largest value of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.maximum.reduceat(values, first) if len(first) else values


@dataclass
class Table:
    """tf by (row, term): sorted keys row * width + term."""

    width: int
    keys: np.ndarray
    tf: np.ndarray
    m: np.ndarray  #: of each row

    def scores(self, rows: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Score (or bound) of each row for the weighted terms."""
        asked = rows[:, None] * self.width + term
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        tf = np.where(self.keys[at] == asked, self.tf[at], 0)
        return contribution(w, tf, self.m[rows][:, None]).sum(axis=1)


class Tree:
    """FP-tree of documents given by their vectors: terms as ranks from frequent to rare, each with its tf."""

    def __init__(self, ids: list, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int):
        of = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(of * width + term, kind="stable")
        term, tf = term[order], tf[order]
        stops = np.cumsum(sizes)
        paths = term.astype(">u4").tobytes()
        path = [paths[4 * p : 4 * q] for p, q in zip(stops - sizes, stops, strict=True)]
        along = sorted(range(len(ids)), key=path.__getitem__)
        place = np.empty(len(ids), np.int64)
        place[along] = np.arange(len(ids))
        keys = place[of] * width + term
        order = np.argsort(keys, kind="stable")
        self.ids = [ids[i] for i in along]
        self.docs = Table(width, keys[order], tf[order], m[along])
        shared = np.zeros(len(ids), np.int64)  # terms that a document's path shares with the one before
        for i in range(1, len(along)):
            a, b = (np.frombuffer(path[along[j]], ">u4") for j in (i - 1, i))
            least = min(len(a), len(b))
            differ = np.flatnonzero(a[:least] != b[:least])
            shared[i] = differ[0] if len(differ) else least
        self._grow(shared, width)

    def _grow(self, shared: np.ndarray, width: int) -> None:
        self.spans: list[tuple[int, int]] = [(0, len(shared))]
        self.children: list[np.ndarray | None] = []
        while len(self.children) < len(self.spans):
            low, high = self.spans[len(self.children)]
            inner = shared[low + 1 : high]
            if high - low <= LEAF or inner.min() == inner.max() and self._same(low, high):
                self.children.append(None)
                continue
            starts = low + 1 + np.flatnonzero(inner == inner.min())
            parts = []
            for p, q in zip([low, *starts], [*starts, high], strict=True):
                if parts and q - parts[-1][0] <= LEAF:  # small neighbours stay together
                    parts[-1] = (parts[-1][0], q)
                else:
                    parts.append((int(p), int(q)))
            self.children.append(np.arange(len(self.spans), len(self.spans) + len(parts)))
            self.spans.extend(parts)
        held: list[tuple[np.ndarray, np.ndarray]] = [None] * len(self.spans)
        least = np.empty(len(self.spans), np.int64)
        for node in range(len(self.spans) - 1, -1, -1):  # children have larger numbers
            low, high = self.spans[node]
            least[node] = self.docs.m[low:high].min()
            if self.children[node] is None:
                p, q = np.searchsorted(self.docs.keys, [low * width, high * width])
                held[node] = _largest(self.docs.keys[p:q] % width, self.docs.tf[p:q])
            else:
                below = [held[c] for c in self.children[node]]
                held[node] = _largest(np.concatenate([k for k, _ in below]), np.concatenate([v for _, v in below]))
        keys = np.concatenate([k + i * width for i, (k, _) in enumerate(held)])
        self.nodes = Table(width, keys, np.concatenate([v for _, v in held]), least)

    def _same(self, low: int, high: int) -> bool:
        """Do the documents have one path? Then there is nothing to part."""
        p, *_, q = np.searchsorted(self.docs.keys, np.arange(low, high + 1) * self.docs.width)
        rows = high - low
        if (q - p) % rows:
            return False
        term = (self.docs.keys[p:q] % self.docs.width).reshape(rows, -1)
        return bool((term == term[0]).all())

    def search(self, term: np.ndarray, w: np.ndarray, best: list, k: int) -> int:
        """Merge the documents into ``best``, a heap of (score, inverted id), for one item; the nodes visited."""
        root = np.zeros(1, np.int64)
        waiting = [(int(self.nodes.scores(root, term, w)[0]), 0)]
        seen = 0
        while waiting:
            bound, node = waiting.pop()
            if bound <= 0 or len(best) == k and bound < best[0][0]:
                continue
            seen += 1
            below = self.children[node]
            if below is not None:
                bounds = self.nodes.scores(below, term, w)
                order = np.argsort(bounds, kind="stable")
                waiting.extend(zip(bounds[order].tolist(), below[order].tolist(), strict=True))
                continue
            low, high = self.spans[node]
            scores = self.docs.scores(np.arange(low, high), term, w)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= max(1, least)).tolist():
                entry = (int(scores[i]), _Last(self.ids[low + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif best[0] < entry:
                    heapq.heapreplace(best, entry)
        return seen


class _Last:
    """An id that is smaller the later it comes; null is the last of all."""

    __slots__ = ("id",)

    def __init__(self, own):
        self.id = own

    def __lt__(self, other: _Last) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return other.id < self.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.id == other.id


def _best(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """Rows (at, doc, score): the k best documents that each task found for the item at that place."""
    kind = vectors.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        waiting: list[pa.RecordBatch] = []
        id_type = pa.int64()

        def search() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            lists = [whole.column(c).combine_chunks() for c in ("t", "f")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            n = whole.column("n").to_numpy()
            tree = Tree(whole.column("doc").to_pylist(), measure(n, documents, length), sizes, rank[term], tf, len(rank))
            for own, (q, w) in zip(best, queries, strict=True):
                tree.search(q, w, own, k)

        for batch in batches:
            id_type = batch.column(0).type
            at = 0
            while at < batch.num_rows:
                docs = sum(b.num_rows for b in waiting)
                room = TREE_DOCS - docs
                part = batch.slice(at, room)
                postings = sum(len(b.column(2).flatten()) for b in waiting)
                ends = np.cumsum(np.asarray(pc.list_value_length(part.column(2)))) + postings
                fits = max(int(np.searchsorted(ends, TREE_POSTINGS, "right")), 0 if waiting else 1)
                if fits:
                    waiting.append(part.slice(0, fits))
                    at += fits
                if fits == room or at < batch.num_rows:
                    search()
        if waiting:
            search()
        rows = [(i, e[1].id, e[0]) for i, own in enumerate(best) for e in own]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        types = (pa.int32(), id_type, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["at", "doc", "score"])

    return in_batches(vectors.where("size(t) > 0")).mapInArrow(run, f"at int, doc {kind}, score long")


def search(
    documents: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (item, rank, key, score): the k documents with the highest scores above 0 of each item."""
    missing(documents, key, text)
    missing(items, item, item_text)
    spark = documents.sparkSession
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).distinct()
    asked = materialize(asked.where(F.col("text").isNotNull()))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        held = [Counter(terms(r.text)) for r in mine]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for c in held for t in c))}
        if not number and block:
            continue
        vectors = materialize(_vectors(documents, key, text, number))
        counted = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)
        for r in vectors.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # one row for each term of the block
            df[r.t] = r["count"]
        order = np.argsort(-df, kind="stable")
        rank = np.empty(len(df), np.int64)
        rank[order] = np.arange(len(df))
        queries = []
        for c in held:
            own = np.array([number[t] for t in c], np.int64)
            times = np.array(list(c.values()), np.int64)
            w = np.array([weight(int(df[i]), counted[0]) for i in own], np.int64) * times
            queries.append((rank[own], w))
        found = _best(vectors, queries, rank, counted[0], counted[1], k)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(mine)], f"at int, item {asked.schema['item'].dataType.simpleString()}")
        first = Window.partitionBy("at").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        out.append(ranked.join(F.broadcast(names), "at"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")


#: The same in DuckDB.
ORACLE = r"""
with split as (select 'd' as kind, doc_id as id, row_number() over () as r, text from documents
  union all select 'i', item_id, row_number() over (), text from (select distinct item_id, text from benchmark)),
worded as (select kind, id, r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws
  from split),
docs as (select id, r, ws, len(ws)::hugeint as n from worded where kind = 'd' and len(ws) > 0),
stats as (select count(*)::hugeint as big_n, sum(n)::hugeint as l from docs),
asked as (select r as q, id as item_id, w, count(*) as times from (select r, id, unnest(ws) as w from worded where kind = 'i') group by all),
tfs as (select r, w, count(*)::hugeint as tf from (select r, unnest(ws) as w from docs) where w in (select w from asked) group by all),
weights as (select w, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::hugeint as wt
  from (select w, count(*) as df from tfs group by w), stats),
scored as (select q, item_id, id as doc_id, sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::bigint as score
  from asked join tfs using (w) join weights using (w) join docs using (r), stats group by q, item_id, r, id),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 20
"""
