"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text is the sequence of its words: maximal runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z lower-cased. Of every run of ``w`` k-grams the smallest hash is kept, with all its places in that run, for
k = ceil(length / 2) and w = length - k + 1: two texts that share ``length`` words share a kept k-gram, whichever
texts they are. Kept k-grams of documents and items are joined by hash, and each hit is extended to the windows of
``length`` words around it, which are joined with the items' windows word by word. So nothing long enough is missed
and nothing else is reported. An item of fewer words, but not none, is one window of its own length, and is found by
the same steps with that length; only lengths that items have are looked for.

Documents with one text are one: they are named by two 64-bit hashes of it, and the answer for a text is joined to
all of them. Item hashes, texts with hits and answers are broadcast if there are few, which is counted; otherwise
they are shuffled, and a name that many documents share is salted.

A null text has no words. Rows that repeat a key or have none are documents of their own. Equal item rows count once;
an item is an item_id, whatever its number of rows. A null item_id marks words but is no item. The marker of an answer
without items is the digest of an empty text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staywise.functions.scale import skew_safe_join
from staywise.llm.common import materialize, missing

#: Words of a window.
LENGTH = 10
#: Rows that are joined by broadcast, at most.
FEW = 100_000
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order, as they are written; null for a null text."""
    return F.array_remove(F.split(text, _BETWEEN), "")


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is named: as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lowered(word: Column) -> Column:
    """A-Z in lower case, nothing else changed; most words are so already and pass as they are."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _CAPITALS, _SMALL))


def _name(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _few(frame: DataFrame, few: int) -> DataFrame:
    """The frame, marked for a broadcast if it is counted as small."""
    return F.broadcast(frame) if frame.count() <= few else frame


def kept_grams(hashes: Column, length: int) -> Column:
    """(at, h) of the k-grams that winnowing keeps of a text of at least ``length`` words, given their hashes."""
    k = -(-length // 2)
    w = length - k + 1

    def of_text(hs: Column) -> Column:
        grams = hs if k == 1 else F.transform(
            F.sequence(F.lit(0), F.size(hs) - k), lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(k)])
        )
        return F.when(F.size(hs) >= length, _held(grams, of_grams)).otherwise(F.array().cast("array<struct<at:int,h:long>>"))

    def of_grams(g: Column) -> Column:
        if w == 1:
            return F.transform(g, lambda x, i: F.struct(i.alias("at"), x.alias("h")))
        runs = F.sequence(F.lit(0), F.size(g) - w)
        # The place of the smallest of each run; equal ones are all kept, as the runs that end with each of them.
        least = F.transform(runs, lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))
        return _held(least, lambda m: placed(g, m))

    def placed(g: Column, m: Column) -> Column:
        # A k-gram is kept if it is the smallest of some run that holds it: runs i - w + 1 to i, as far as they exist.
        smallest = lambda x, i: F.greatest(*[F.get(m, F.when(i >= j, i - j)) for j in range(w)]) == x
        marked = F.transform(g, lambda x, i: F.when(smallest(x, i), F.struct(i.alias("at"), x.alias("h"))))
        return F.filter(marked, lambda x: x.isNotNull())

    return _held(hashes, of_text)


def item_windows(items: DataFrame, length: int, item: str, text: str) -> DataFrame:
    """Rows (item, window, n): the distinct windows of the items, each as its words parted by blanks."""
    own = items.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).distinct()

    def cut(ws: Column) -> Column:
        n = F.least(F.size(ws), F.lit(length))
        every = F.sequence(F.lit(1), F.size(ws) - n + 1)
        return F.transform(every, lambda i: F.struct(n.alias("n"), F.array_join(F.slice(ws, i, n), " ").alias("window")))

    rows = own.where(F.size(words(F.col("text"))) > 0)
    windows = _held(F.transform(words(F.col("text")), _lowered), cut)
    return rows.select("item", F.explode(windows).alias("x")).select("item", "x.n", "x.window").distinct()


def contaminated_texts(documents: DataFrame, windows: DataFrame, text: str, few: int = FEW) -> DataFrame:
    """Rows (k1, k2, n_hit, items): for each text with a window of an item, its words hit and the items."""
    windows = materialize(windows)
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most as many as a window has words
    given = documents.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    hashes = F.transform(words(F.col("text")), lambda x: F.xxhash64(_lowered(x)))
    spans = []
    for length in lengths:
        grams = F.transform(F.split("window", " "), lambda x: F.xxhash64(x))
        mine = windows.where(F.col("n") == length).select(F.explode(kept_grams(grams, length)).alias("x"))
        asked = materialize(mine.select("x.h").distinct())
        found = given.select(*_name(F.col("text")), F.explode(kept_grams(hashes, length)).alias("x")).select("k1", "k2", "x.at", "x.h")
        seeds = found.join(_few(asked, few), "h", "left_semi").select("k1", "k2", "at").distinct()
        # A hit at one place is extended to all windows that hold its k-gram.
        reach = length - -(-length // 2)
        spans.append(seeds.select("k1", "k2", F.lit(length).alias("n"), F.explode(F.sequence(F.col("at") - reach, F.col("at"))).alias("start")))
    if not spans:
        return given.select(*_name(F.col("text")), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).where("false")
    starts = reduce(DataFrame.unionByName, spans).where("start >= 0").distinct()
    around = materialize(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    # Copies of a text are read once: the rows are grouped by name before the words are made again.
    texts = given.select(*_name(F.col("text")), "text")
    asked = texts.join(_few(around.select("k1", "k2"), few), ["k1", "k2"], "left_semi")
    held = asked.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(around, ["k1", "k2"])

    def cut(ws: Column) -> Column:
        inside = F.filter("spans", lambda x: x["start"] + x["n"] <= F.size(ws))
        window = lambda x: F.array_join(F.slice(ws, x["start"] + 1, x["n"]), " ")
        return F.transform(inside, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), window(x).alias("window")))

    cuts = _held(F.transform(words(F.col("text")), _lowered), cut)
    rows = held.select("k1", "k2", F.explode(cuts).alias("x")).select("k1", "k2", "x.*")
    present = windows.select("window").distinct()
    hits = materialize(rows.join(_few(materialize(present), few), "window", "left_semi").select("k1", "k2", "window", "start", "n"))
    marked = hits.select("k1", "k2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    counts = marked.distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
    held_by = windows.where(F.col("item").isNotNull()).select("window", F.col("item").cast("string").alias("item"))
    named = hits.select("k1", "k2", "window").distinct().join(held_by, "window").select("k1", "k2", "item").distinct()
    lists = named.groupBy("k1", "k2").agg(F.collect_list("item").alias("items"))
    return counts.join(lists, ["k1", "k2"], "left")


def decontaminate(
    documents: DataFrame, items: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", few: int = FEW,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted as text) and contaminated."""
    missing(documents, key, text)
    missing(items, item, item_text)
    answers = materialize(contaminated_texts(documents, item_windows(items, length, item, item_text), text, few))
    name = F.struct(*_name(F.col(f"`{text}`")))
    rows = documents.select(
        F.col(f"`{key}`").alias("_doc"), name.alias("_name"),
        F.coalesce(F.size(words(F.col(f"`{text}`"))), F.lit(0)).cast("long").alias("n_words"),
    )
    found = answers.select(F.struct("k1", "k2").alias("_name"), "n_hit", F.sort_array("items").alias("items"))
    joined = rows.join(F.broadcast(found), "_name", "left") if answers.count() <= few else skew_safe_join(rows, found, "_name", "left")
    return joined.select(
        F.col("_doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def digests(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return decontaminate(documents, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: The same in DuckDB, window by window.
ORACLE = r"""
with split as (select 'd' as kind, doc_id as id, row_number() over () as r, text from documents
  union all select 'i', item_id, 0, text from (select distinct item_id, text from benchmark)),
worded as (select kind, id, r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from split),
items as (select id, ws, least(10, len(ws)) as n from worded where kind = 'i' and len(ws) > 0),
windows as (select distinct id, n, array_to_string(ws[s:s + n - 1], ' ') as win
  from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as s from items)),
docs as (select id, r, coalesce(ws, []) as ws from worded where kind = 'd'),
spans as (select r, n, s, array_to_string(ws[s:s + n - 1], ' ') as win
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as s from docs, (select distinct n from windows))),
hits as (select r, s, h.n, w.id from spans h join windows w on h.n = w.n and h.win = w.win),
marked as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hits) group by r),
named as (select r, count(*) as n_items, string_agg(id::varchar, ',' order by id::varchar) as ids
  from (select distinct r, id from hits where id is not null) group by r)
select d.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join marked using (r) left join named using (r)
"""
