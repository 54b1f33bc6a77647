"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each code point is mapped to a class; the class of apostrophes and white space also tells what follows. A finite
state machine over these classes says where a piece begins. Reading one code point is a function from state to
state, composition of such functions is associative, and all functions that can arise form a small monoid, so
the states before all code points come from a blocked prefix scan over one table of compositions: no regular
expression is run over a text. The pieces are merged by rank through a cache of pieces seen before.

Nulls are empty texts: no ids, no bytes. Repeated rows are encoded each for itself; other columns are dropped.
"""

from __future__ import annotations

import base64
import functools
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import chunks, in_batches, missing

#: Code points handled at once by the scan.
SCAN_CHARS = 1 << 19
#: Pieces remembered by one Python worker, and the longest of them in characters.
CACHE_PIECES, CACHE_CHARS = 400_000, 48
#: Steps that a lane of the blocked scan takes by itself.
LANE = 64

# Symbols. PREFIX is a blank before other text, LAST other white space before it, SPACE any other white space;
# SHORT and LONG are apostrophes that may begin a contraction of two or three characters; EDGE parts two texts.
LETTER, NUMBER, OTHER, PREFIX, LAST, SPACE, SHORT, LONG, EDGE = range(9)
# States: what the piece that is being read consists of, or how many letters a contraction still takes.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_PREFIX, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a piece begin at this symbol?)"""
    if symbol == EDGE:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_PREFIX):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == PREFIX:
        return AFTER_PREFIX, True
    if symbol == LAST:
        return FRESH, True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_SPACES}[symbol]
    joins = state == run or (state == AFTER_PREFIX and symbol != SPACE)
    return run, not joins


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(function of each symbol, table of compositions, table of values, begins table, number of functions).

    Functions are numbered; ``compose[f * n + g]`` is f, then g; ``value[f * 8 + s]`` is f's state from s.
    """
    states, symbols = range(8), range(9)
    known: dict[tuple[int, ...], int] = {tuple(states): 0}
    first = []
    for x in symbols:
        f = tuple(_step(s, x)[0] for s in states)
        first.append(known.setdefault(f, len(known)))
    todo = list(known)
    generators = [tuple(_step(s, x)[0] for s in states) for x in symbols]
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    order = list(known)
    n = len(order)
    compose = np.empty(n * n, np.uint8 if n <= 256 else np.uint16)
    for i, f in enumerate(order):
        for j, g in enumerate(order):
            compose[i * n + j] = known[tuple(g[s] for s in f)]
    value = np.array([s for f in order for s in f], np.uint8)
    begins = np.array([_step(s, x)[1] for s in states for x in symbols], bool)
    return np.array(first, compose.dtype), compose, value, begins, n


def _scan(functions: np.ndarray) -> np.ndarray:
    """Compositions of all prefixes (each including its own element), by a blocked associative scan."""
    _, compose, _, _, n = _monoid()
    size = len(functions)
    wide = np.uint16 if n * n < 1 << 16 else np.uint32
    if size <= LANE:
        out = functions.copy()
        for i in range(1, size):
            out[i] = compose[int(out[i - 1]) * n + int(functions[i])]
        return out
    lanes = -(-size // LANE)
    padded = np.zeros(lanes * LANE, functions.dtype)  # function 0 changes nothing
    padded[:size] = functions
    rows = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    for r in range(1, LANE):
        rows[r] = compose[rows[r - 1].astype(wide) * wide(n) + rows[r]]
    before = np.zeros(lanes, functions.dtype)
    before[1:] = _scan(rows[-1])[:-1]
    whole = compose[before.astype(wide) * wide(n) + rows]
    return np.ascontiguousarray(whole.T).reshape(-1)[:size]


@functools.cache
def codepoint_classes() -> bytes:
    """One byte for each code point: LETTER, NUMBER, SPACE or OTHER, by the Unicode tables of the tokenizer library.

    Its tables may be newer than Python's, and a letter it knows must be a letter here.
    """
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for name, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        of = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        found = bytes(of.encode_ordinary(every)).decode()  # what does not match is left out
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = symbol
    return out.tobytes()


def boundaries(texts: list[str], classes: np.ndarray) -> Iterator[tuple[str, list[int], list[int]]]:
    """For each text: itself, the starts of its pieces and their ends, in code points."""
    joined = "\0".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = classes[points]
    symbols[edges] = EDGE

    spaces = np.flatnonzero(symbols == SPACE)
    after = symbols[spaces + 1]
    ends_run = spaces[(after != SPACE) & (after != EDGE)]
    symbols[ends_run] = np.where(points[ends_run] == 0x20, PREFIX, LAST).astype(np.uint8)

    marks = np.flatnonzero(points == 0x27)
    marks = marks[symbols[marks] != EDGE]
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        # An edge reads as code point 0, which is none of the letters below.
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        long = (
            ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        )
        symbols[marks[short]] = SHORT
        symbols[marks[long]] = LONG

    first, _, value, begins, _ = _monoid()
    scanned = _scan(first[symbols])
    before = np.empty(len(symbols), np.uint8)
    before[0] = FRESH
    before[1:] = value[scanned[:-1].astype(np.uint32) * 8]
    starts = np.flatnonzero(begins[before * np.uint8(9) + symbols])
    at = np.searchsorted(starts, edges)  # an edge counts as a piece of its own
    for k, text in enumerate(texts):
        own = (starts[at[k] + 1 : at[k + 1] + 1] - (edges[k] + 1)).tolist()  # the last one is the next edge
        yield text, own[:-1], own[1:]


class Merger:
    """Pieces to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[str, bytes] = {}

    def __call__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Ids after merging the pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        if len(raw) > 64:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2]) for i in range(len(raw) - 1)]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same over a linked list with a heap, so that a piece of any length costs n log n."""
        n, ranks = len(raw), self.ranks
        end = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (rank := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, until = heapq.heappop(heap)
            if not alive[i] or (j := right[i]) >= n or end[j] != until:
                continue
            end[i], right[i], alive[j] = until, right[j], False
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = right[i]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 and rank pairs."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_MERGERS: dict[str, tuple[Merger, np.ndarray, np.ndarray]] = {}


def _merger(name: str, shared) -> tuple[Merger, np.ndarray, np.ndarray]:
    """This worker's merger, token lengths and classes; the cache lives as long as the worker."""
    if name not in _MERGERS:
        _MERGERS.clear()
        ranks, classes = shared.value
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _MERGERS[name] = Merger(ranks), lengths, np.frombuffer(classes, np.uint8)
    return _MERGERS[name]


_PACKED = ("ids", "token_ends", "piece_ends")


def _encoder(frame: DataFrame, ranks: dict[bytes, int]):
    """Function from batches (key, text) to batches (key, ids, token_ends, piece_ends)."""
    shared = frame.sparkSession.sparkContext.broadcast((ranks, codepoint_classes()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, lengths, classes = _merger(name, shared)
        cache = merger.cache
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, SCAN_CHARS):
                columns: list[list[bytes]] = [[], [], []]
                for whole, starts, ends in boundaries(texts[a:b], classes):
                    pieces = [whole[i:j] for i, j in zip(starts, ends, strict=True)]
                    packed = b"".join([cache.get(p) or merger(p) for p in pieces])
                    token_ends = np.cumsum(lengths[np.frombuffer(packed, "<u4")]).astype("<u4").tobytes()
                    for column, value in zip(columns, (packed, token_ends, np.array(ends, "<u4").tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), *[pa.array(x, pa.binary()) for x in columns]], names=[batch.schema.names[0], *_PACKED]
                )

    return run


def _decoder(frame: DataFrame, ranks: dict[bytes, int]):
    """Function from batches (key, ids, token_ends, ...) to batches (key, ids, decoded)."""
    shared = frame.sparkSession.sparkContext.broadcast(sorted((i, token) for token, i in ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (shared.value[-1][0] + 1)
        for i, token in shared.value:
            tokens[i] = token
        for batch in batches:
            out = []
            for packed, ends in zip(batch.column(1), batch.column(2), strict=True):
                packed, ends = packed.as_py() or b"", ends.as_py() or b""
                own = b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])
                if len(own) != int.from_bytes(ends[-4:], "little"):
                    raise ValueError("the offsets do not belong to these ids")
                out.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[batch.schema.names[0], "ids", "decoded"]
            )

    return run


def _schema(frame: DataFrame, key: str, *columns: str) -> T.StructType:
    return T.StructType([frame.schema[key], *[T.StructField(c, T.BinaryType()) for c in columns]])


def encode(frame: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, token_ends, piece_ends), each array packed as little-endian unsigned 32-bit integers.

    ``ids`` are the tokens, ``token_ends`` the byte offset at which each ends in the UTF-8 text, ``piece_ends`` the
    code point at which each pre-token ends. The ranks (one vocabulary, whatever the data) are broadcast.
    """
    missing(frame, key, text)
    rows = in_batches(frame).select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(_encoder(frame, ranks), _schema(frame, key, *_PACKED))


def decode(encoded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, decoded): the bytes of the ids, checked against the retained offsets."""
    missing(encoded, key, "ids", "token_ends")
    rows = in_batches(encoded).select(F.col(f"`{key}`"), "ids", "token_ends")
    return rows.mapInArrow(_decoder(encoded, ranks), _schema(encoded, key, "ids", "decoded"))


def round_trip(frame: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(frame))`` in one pass, so that a task needs one Python worker."""
    missing(frame, key, text)
    encoder, decoder = _encoder(frame, ranks), _decoder(frame, ranks)
    rows = in_batches(frame).select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(lambda batches: decoder(encoder(batches)), _schema(frame, key, "ids", "decoded"))


def spans(token_ends: bytes, first: int, last: int) -> tuple[int, int]:
    """Bytes [start, end) of the text that the tokens first..last-1 stand for."""
    ends = np.frombuffer(token_ends, "<u4")
    return (int(ends[first - 1]) if first else 0), (int(ends[last - 1]) if last else 0)


def digests(documents: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return round_trip(documents, ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
