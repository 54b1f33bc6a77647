"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte of a text.

A text is encoded by a byte-level BPE (A) and by a piece model (B). A common end near the middle of an interval is
located by bisecting B's ends for A's ends, nearest the middle first; the interval is parted there and both halves
are treated alike, until an interval has no common end inside: it is a leaf, one group of tokens. All intervals of one
depth, over all texts of a chunk, are treated at once. Tokens whose byte ranges overlap are linked.

Both tokenizers never join a character that is no blank with the blank after it, so a text is encoded as words (parted
at single blanks between other characters) through a cache of words seen before; tokenizers for which that is not so
encode whole texts. Encoded words are gathered as arrays; nothing is done token by token in Python.

Documents are handled in blocks of what one task reads, of at most BLOCK_CHARS characters. A block numbers its id
pairs by first appearance, and a document refers to them by number: only the blocks' pair tables are joined with the
counts of the whole corpus, not the links of every document. The blocks are written once, so that a lost executor
changes no number.

Null and empty texts, and texts whose tokens of A or B do not spell them, have no tokens: zeros and an empty digest.
Rows that repeat a key, or have none, are documents of their own. Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import chunks, in_batches, materialize, missing

#: Characters aligned at once, and characters of one block.
CHUNK_CHARS, BLOCK_CHARS = 1 << 20, 1 << 25
#: Words remembered by one Python worker, and the longest of them in characters.
CACHE_WORDS, CACHE_CHARS = 600_000, 64
#: A blank that parts two words.
_PARTS = re.compile(r"(?<=\S) (?=\S)")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest shifted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs (start, size), one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the cache of encoded words."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte = _byte_of()
        known = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        raw = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = []
        inner = False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            as_byte = raw.fullmatch(piece)
            self.b_bytes.append(bytes([int(as_byte[1], 16)]) if as_byte else piece.replace("▁", " ").encode())
            inner |= "▁" in piece.lstrip("▁")
        setup = json.loads(self.a.to_str())
        before = setup.get("pre_tokenizer") or {}
        self.by_words = (
            not inner
            and setup.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        width = max(len(self.a_bytes), len(self.b_bytes))
        number = np.array([str(i).encode() for i in range(width)], object)
        self.comma, self.bar, self.semi = number + b",", number + b"|", number + b";"
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        # Ids of A and B of all words, tokens of each word, is it spelt? Word 0 is "no tokens".
        none = np.zeros(0, np.int64)
        self.table = (none, none, *[np.zeros(1, np.int64)] * 3)

    def _encode(self, text: str) -> tuple[list[int], list[int], bool]:
        """(ids of A, ids of B, do both spell a blank and the text?)"""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        whole = (" " + text).encode()
        good = b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole
        return a, b, good

    def _learn(self, new: list[str]) -> None:
        """Encode words not seen before as one text; one by one if that does not spell them."""
        a, b, good = self._encode(" ".join(new))
        sizes, fine = [], np.ones(len(new), np.int64)
        if good:
            ends = np.cumsum([len(w.encode()) + 1 for w in new])
            for ids, size in ((a, self.a_size), (b, self.b_size)):
                stops = np.cumsum(size[ids])
                at = np.searchsorted(stops, ends)
                good = good and bool((stops[at] == ends).all())
                sizes.append(np.diff(at, prepend=-1))
        if not good:
            found = [(x, y, 1) if spelt else ([], [], 0) for x, y, spelt in map(self._encode, new)]
            a, b = ([i for x in found for i in x[k]] for k in (0, 1))
            sizes = [np.array([len(x[k]) for x in found]) for k in (0, 1)]
            fine = np.array([x[2] for x in found])
        known = len(self.words) + 1
        self.words.update(zip(new, range(known, known + len(new)), strict=True))
        more = (np.array(a, np.int64), np.array(b, np.int64), *sizes, fine)
        self.table = tuple(np.concatenate(x) for x in zip(self.table, more, strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens of A for each text, the same of B); a text that is not spelt has none."""
        if not self.by_words:
            every = [self._encode(t) if t else ([], [], False) for t in texts]
            every = [(a, b) if good else ([], []) for a, b, good in every]
            flat = [np.array([i for x in every for i in x[k]], np.int64) for k in (0, 1)]
            count = [np.array([len(x[k]) for x in every], np.int64) for k in (0, 1)]
            return flat[0], count[0], flat[1], count[1]
        parts = [_PARTS.split(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self._forget()
        get = self.words.get
        places = [get(w) for ws in parts for w in ws]
        own: dict[str, None] = {}
        if None in places:
            flat_words = [w for ws in parts for w in ws]
            own = dict.fromkeys(w for w, p in zip(flat_words, places, strict=True) if p is None)
            self._learn(list(own))
            places = [get(w) for w in flat_words]
        a, b, na, nb, good = self.table
        at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        places = np.array(places, np.int64)
        words = np.array([len(ws) for ws in parts], np.int64)
        of = np.repeat(np.arange(len(parts)), words)
        bad = np.zeros(len(parts), bool)
        bad[of[good[places] == 0]] = True
        places = np.where(bad[of], 0, places)
        out = (
            a[_ragged(at_a[places], na[places])], np.bincount(of, na[places], len(parts)).astype(np.int64),
            b[_ragged(at_b[places], nb[places])], np.bincount(of, nb[places], len(parts)).astype(np.int64),
        )
        if any(len(w) > CACHE_CHARS for w in own):
            self._forget()  # long words are not worth the memory
        return out


@functools.cache
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """One pair of tokenizers for each Python worker."""
    return Tokenizers(a_file, b_file)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places in ``a_ends`` whose end is also one of ``b_ends``, by divide and conquer.

    Both arrays rise. ``low`` and ``high`` name the places of A's ends strictly inside each interval.
    """
    found = []
    while len(low):
        left = low < high
        low, high = low[left], high[left]
        middle = (low + high) >> 1
        cut = np.full(len(low), -1)
        open_ = np.arange(len(low))
        reach = 0
        while len(open_):
            for side in (reach, -reach) if reach else (0,):
                at = middle[open_] + side
                inside = (at >= low[open_]) & (at < high[open_])
                asked, at = open_[inside], at[inside]
                hit = b_ends[np.minimum(np.searchsorted(b_ends, a_ends[at]), len(b_ends) - 1)] == a_ends[at]
                cut[asked[hit]] = at[hit]
                open_ = open_[cut[open_] < 0]
            reach += 1
            open_ = open_[(middle[open_] + reach < high[open_]) | (middle[open_] - reach >= low[open_])]
        parted = cut >= 0
        cut = cut[parted]
        found.append(cut)
        low, high = np.concatenate([low[parted], cut + 1]), np.concatenate([cut, high[parted]])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Aligned:
    """The alignment of several texts; token arrays hold one text after the other."""

    a: np.ndarray  #: ids of A
    b: np.ndarray
    n_a: np.ndarray  #: tokens of A in each text
    n_b: np.ndarray
    a_group: np.ndarray  #: number of the group of each token of A, over all texts
    b_group: np.ndarray
    group_ends: np.ndarray  #: end of each group in bytes, counted over all texts
    n_groups: np.ndarray  #: groups of each text
    links: tuple[np.ndarray, np.ndarray]  #: places of linked tokens of A and B


def align(both: Tokenizers, texts: list[str]) -> Aligned:
    """Groups and links of several texts."""
    a, n_a, b, n_b = both.encode(texts)
    a_ends, b_ends = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    a_stop = np.cumsum(n_a)
    filled = n_a > 0
    inner = shared_cuts(a_ends, b_ends, (a_stop - n_a)[filled], a_stop[filled] - 1)
    cut = np.zeros(len(a), bool)
    cut[inner] = True
    cut[a_stop[filled] - 1] = True
    group_ends = a_ends[cut]
    a_group = np.cumsum(cut) - cut
    b_group = np.searchsorted(group_ends, b_ends)
    n_groups = np.diff(np.concatenate([[0], np.cumsum(cut)])[np.concatenate([[0], a_stop])])
    first = np.searchsorted(b_ends, a_ends - both.a_size[a], "right")
    count = np.searchsorted(b_ends - both.b_size[b], a_ends) - first
    links = np.repeat(np.arange(len(a)), count), _ragged(first, count)
    return Aligned(a, b, n_a, n_b, a_group, b_group, group_ends, n_groups, links)


def group_texts(both: Tokenizers, x: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    last_a = np.diff(x.a_group, append=-1) != 0
    last_b = np.diff(x.b_group, append=-1) != 0
    out = np.empty(len(x.a) + len(x.b), object)
    b_before = np.searchsorted(x.b_group, x.a_group)  # tokens of B in earlier groups
    a_until = np.searchsorted(x.a_group, x.b_group, "right")  # tokens of A up to this group
    out[np.arange(len(x.a)) + b_before] = np.where(last_a, both.bar[x.a], both.comma[x.a])
    out[np.arange(len(x.b)) + a_until] = np.where(last_b, both.semi[x.b], both.comma[x.b])
    stops = np.cumsum(x.n_a + x.n_b).tolist()
    return [b"".join(out[p:q].tolist())[:-1] for p, q in zip([0, *stops], stops, strict=False)]


def _pack(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * count, asbytes=True), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class Pairs:
    """Numbers for the id pairs of a block, by first appearance, and in how many documents each stands."""

    def __init__(self):
        self.keys = self.numbers = np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; each of them stands for one document that has the pair."""
        distinct, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == distinct[at < len(self.keys)]
        numbers = np.empty(len(distinct), np.int64)
        numbers[known] = self.numbers[at[known]]
        fresh = np.arange(len(self.docs), len(self.docs) + int((~known).sum()))
        numbers[~known] = fresh
        self.keys = np.insert(self.keys, at[~known], distinct[~known])
        self.numbers = np.insert(self.numbers, at[~known], fresh)
        self.docs = np.concatenate([self.docs, np.zeros(len(fresh), np.int64)])
        self.docs[numbers] += count
        return numbers[where]

    def in_order(self) -> np.ndarray:
        out = np.empty(len(self.keys), np.int64)
        out[self.numbers] = self.keys
        return out


def _blocks(documents: DataFrame, key: str, text: str, a_file: str, b_file: str) -> DataFrame:
    """Rows of two kinds for each block: its documents, a chunk of them a row, and (at last) its id pairs."""
    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "sha array<string>, n_refs array<long>, refs binary, times binary, pairs array<long>, n_docs array<long>"
    )
    names = ("ids", "n_a", "n_b", "n_groups", "n_links", "sha", "n_refs", "refs", "times", "pairs", "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_file, b_file)
        vocabulary = len(both.b_bytes)
        id_type = None
        block, chars, table = TaskContext.get().partitionId() << 24, 0, Pairs()

        def row(**given) -> pa.RecordBatch:
            types = [pa.list_(id_type), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 2]
            columns = [pa.array([given.get(n)], t) for n, t in zip(names, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *columns], ["block", *names])

        def end() -> pa.RecordBatch:
            return row(pairs=table.in_order(), n_docs=table.docs)

        for batch in batches:
            id_type = batch.column(0).type
            ids, every = batch.column(0), batch.column(1).to_pylist()
            for p, q in chunks(every, CHUNK_CHARS):
                texts = [t or "" for t in every[p:q]]
                x = align(both, texts)
                n = len(texts)
                of_a = np.repeat(np.arange(n), x.n_a)[x.links[0]]
                pair = x.a[x.links[0]] * vocabulary + x.b[x.links[1]]
                width = len(both.a_bytes) * vocabulary
                own, times = np.unique(of_a * width + pair, return_counts=True)
                doc, pair = own // width, own % width
                refs = table.add(pair)
                order = np.lexsort((refs, doc))
                refs, times, doc = refs[order], times[order], doc[order]
                n_refs = np.bincount(doc, minlength=n)
                steps = np.diff(refs, prepend=0)
                starts = (np.cumsum(n_refs) - n_refs)[n_refs > 0]
                steps[starts] = refs[starts]
                sha = [hashlib.sha256(g).hexdigest() if k else "" for g, k in zip(group_texts(both, x), x.n_a, strict=True)]
                yield row(
                    ids=ids.slice(p, q - p).to_pylist(), n_a=x.n_a, n_b=x.n_b, n_groups=x.n_groups,
                    n_links=np.bincount(of_a, minlength=n), sha=sha, n_refs=n_refs, refs=_pack(steps), times=_pack(times),
                )
                chars += sum(map(len, texts))
                if chars >= BLOCK_CHARS:
                    yield end()
                    block, chars, table = block + 1, 0, Pairs()
        if chars:
            yield end()

    rows = in_batches(documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")))
    return rows.mapInArrow(run, schema)


def pair_counts(tables: DataFrame, vocabulary: int) -> DataFrame:
    """Rows (pair, count, best): in how many documents an id pair is linked, and is that the most of its id of A?"""
    counts = tables.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / vocabulary))
    top = F.max("count").over(Window.partitionBy("a"))  # at most one row for each id of B
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def alignment(documents: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    missing(documents, key, text)
    vocabulary = len(tokenizers(a_file, b_file).b_bytes)
    blocks = materialize(_blocks(documents, key, text, a_file, b_file))
    tables = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "x"))
    tables = tables.select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n"))
    counts = materialize(pair_counts(tables, vocabulary))
    known = tables.select("block", "at", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "at", "count", "best")
    kind = documents.schema[key].dataType.simpleString()

    def finish(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = pairs.column("count").to_numpy()
        best[at] = pairs.column("best").to_numpy(zero_copy_only=False)
        out = []
        for i in range(docs.num_rows):
            n_refs = docs.column("n_refs")[i].values.to_numpy()
            total = int(n_refs.sum())
            steps = _unpack(docs.column("refs")[i].as_py(), total)
            times = _unpack(docs.column("times")[i].as_py(), total)
            of = np.repeat(np.arange(len(n_refs)), n_refs)
            summed = np.cumsum(steps)
            before = np.concatenate([[0], summed])[np.cumsum(n_refs) - n_refs]
            refs = summed - before[of]
            exact = lambda v: np.add.reduceat(np.append(v, 0), np.minimum(np.cumsum(n_refs) - n_refs, total)) * (n_refs > 0)  # noqa: E731, B023
            lists = {n: docs.column(n)[i].values for n in ("ids", "n_a", "n_b", "n_groups", "n_links", "sha")}
            out.append(pa.table([
                lists["ids"], lists["n_a"], lists["n_b"], lists["n_groups"], lists["n_links"],
                pa.array(exact(times * best[refs]), pa.int64()), pa.array(exact(times * count[refs]), pa.int64()), lists["sha"],
            ], names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    chunks_of = blocks.where("pairs is null").drop("pairs", "n_docs")
    return chunks_of.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        finish, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def groups(documents: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, groups): the groups of every document in order, with the ids of A and B and the end in bytes of a blank and the text."""
    missing(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()
    element = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_file, b_file)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for p, q in chunks(every, CHUNK_CHARS):
                x = align(both, [t or "" for t in every[p:q]])
                number = np.arange(len(x.group_ends) + 1)
                a_at, b_at = np.searchsorted(x.a_group, number), np.searchsorted(x.b_group, number)
                of_text = np.concatenate([[0], np.cumsum(x.n_groups)])
                base = np.repeat(np.concatenate([[0], x.group_ends])[of_text[:-1]], x.n_groups)
                parts = pa.StructArray.from_arrays([
                    pa.ListArray.from_arrays(pa.array(a_at, pa.int32()), pa.array(x.a, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(b_at, pa.int32()), pa.array(x.b, pa.int32())),
                    pa.array(x.group_ends - base, pa.int64()),
                ], fields=list(element))
                lists = pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p, q - p), lists], [key, "groups"])

    rows = in_batches(documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")))
    return rows.mapInArrow(run, f"`{key}` {kind}, groups array<struct<a:array<int>,b:array<int>,end:long>>")
