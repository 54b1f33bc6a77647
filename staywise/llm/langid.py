"""Language identification by interpolated Kneser-Ney character models.

Text is read as lower-case letters: a to z stand for themselves, every other letter or mark for one of 37 more
symbols, any run of other characters for one boundary. With 64 symbols there are at most 64**ORDER n-grams for a
language, so a model has a proven size bound (64**3 entries of 16 bytes) whatever the corpus; the counts and
the calibration of score and rejection come from all labelled documents. A model is one pair of sorted hash arrays for each order. The language with the lowest
cross-entropy for each symbol wins; a document that fits its language far worse than labelled documents do, and no
better than texts of other languages, is rejected.

Null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the language that sorts
first; with nothing to learn from, every document is ``und``. Repeated rows are predicted each for itself.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import chunks, in_batches, materialize, missing

ORDER, BITS = 3, 6
SYMBOLS = 1 << BITS
UNKNOWN = "und"
SCAN_CHARS = 1 << 19
#: A document is rejected when its cross-entropy is more standard deviations than this above its language's, and
#: also above what texts of other languages have in that language's model. Mixed documents stay.
REJECT_Z = 8.0


@functools.cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 boundary, 1 to 26 a to z, 27 to 63 other letters and marks."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed n-grams of all texts, first n-gram of each text, has each text a letter?); no n-gram spans two texts."""
    points = np.frombuffer("\0".join(["", *texts]).encode("utf-32-le"), np.uint32)
    symbols = _symbols()[points]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
    counted = np.concatenate([[0], np.cumsum(_letters()[points])])
    has_letter = counted[edges + 1 + lengths] > counted[edges]
    # A boundary stays where no boundary stands before it; the one that opens a text always stays.
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[edges] = True
    kept = symbols[keep].astype(np.uint32)
    at = np.cumsum(keep) - 1
    first = at[edges]
    packed = kept.copy()
    for back in range(1, ORDER):
        packed[back:] |= kept[:-back] << np.uint32(BITS * back)
    # Before the opening boundary of a text stands another text: read that as boundaries.
    for step in range(ORDER - 1):
        where = first + step
        where = where[where < len(packed)]
        packed[where] &= np.uint32((1 << BITS * (step + 1)) - 1)
    return packed, first, has_letter


def _hash(keys: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that equal hashes are equal n-grams."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class KneserNey:
    """Interpolated Kneser-Ney probabilities of packed n-grams, in sorted hash arrays for each order."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray):
        self.levels = []
        packed, counts = packed.astype(np.int64), counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            # The discount of absolute discounting from the n-grams seen once and twice.
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            context = packed >> BITS
            groups, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, counts)
            kinds = np.bincount(where)
            self.levels.append(
                (*self._sorted(packed, np.maximum(counts - discount, 0) / total[where]),
                 *self._sorted(groups, discount * kinds / total))
            )
            # Lower orders count the different symbols seen before an n-gram, not its occurrences.
            shorter = packed & ((1 << BITS * (order - 1)) - 1)
            packed, counts = np.unique(shorter, return_counts=True)
            counts = counts.astype(np.float64)

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = _hash(keys)
        order = np.argsort(hashed)
        return hashed[order], values[order]

    @staticmethod
    def _find(keys: np.ndarray, hashes: np.ndarray, values: np.ndarray, absent: float) -> np.ndarray:
        wanted = _hash(keys)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, values[at], absent)

    def probability(self, packed: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram, given those before it."""
        out = np.full(len(packed), 1.0 / SYMBOLS)
        for order, (seen, parts, contexts, rest) in zip(range(1, ORDER + 1), reversed(self.levels), strict=True):
            own = packed.astype(np.int64) & ((1 << BITS * order) - 1)
            out = self._find(own, seen, parts, 0.0) + self._find(own >> BITS, contexts, rest, 1.0) * out
        return out

    def entries(self) -> int:
        return sum(len(level[0]) + len(level[2]) for level in self.levels)


def count_grams(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows; each task adds up its own rows before anything is shuffled."""
    size = 1 << BITS * ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush():
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = np.array(batch.column(1).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                own = texts[names == name].tolist()
                for a, b in chunks(own, SCAN_CHARS):
                    packed, _, has_letter = grams(own[a:b])
                    if not has_letter.any():
                        continue
                    if name not in held:
                        if len(held) >= 32:
                            yield from flush()
                        held[name] = np.zeros(size, np.int64)
                    held[name] += np.bincount(packed, minlength=size)
        yield from flush()

    rows = in_batches(labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()))
    counted = rows.select(F.col(f"`{lang}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(
        run, "lang string, gram long, n long"
    )
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, their models, and the calibration of score and rejection."""

    def __init__(self, models: dict[str, KneserNey]):
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.centre = np.zeros(len(models))
        self.between = np.full(len(models), np.inf)
        self.within = np.zeros(len(models))
        self.foreign = np.full(len(models), np.log(SYMBOLS))
        self.sharpness = 1.0
        self.name = uuid.uuid4().hex


_TABLES: dict[str, np.ndarray] = {}


def _table(model: Model) -> np.ndarray:
    """-log p of every n-gram in every language, looked up once by each worker."""
    if model.name not in _TABLES:
        _TABLES.clear()
        every = np.arange(1 << BITS * ORDER)
        _TABLES[model.name] = np.array([-np.log(m.probability(every)) for m in model.models], np.float32)
    return _TABLES[model.name]


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages x texts cross-entropies, languages x texts mean squares, symbols of each text; 0: no letter)."""
    out = np.zeros((len(model.languages), len(texts)))
    squares = np.zeros_like(out)
    sizes = np.zeros(len(texts), np.int64)
    for a, b in chunks(texts, SCAN_CHARS):
        packed, first, has_letter = grams(texts[a:b])
        n = np.diff(np.append(first, len(packed)))
        sizes[a:b] = np.where(has_letter, n, 0)
        for k, row in enumerate(_table(model)):
            costs = row[packed]
            out[k, a:b] = np.add.reduceat(costs, first, dtype=np.float64) / n
            squares[k, a:b] = np.add.reduceat(costs * costs, first, dtype=np.float64) / n
    return out, squares, sizes


def train(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> Model:
    """Models from all labelled rows, calibrated on all of them."""
    missing(labelled, key, lang, text)
    counts = count_grams(labelled, lang, text).toPandas()
    model = Model({x: KneserNey(own["gram"].to_numpy(), own["n"].to_numpy()) for x, own in counts.groupby("lang")})
    if model.languages:
        _calibrate(model, labelled, lang, text)
    return model


def _calibrate(model: Model, labelled: DataFrame, lang: str, text: str) -> None:
    """Score and rejection from every labelled row: tasks add up what is a sum, medians are exact.

    What reaches the driver is bounded by the number of languages.
    """
    from staywise.operators.models import exact_medians  # workers import this module and need none of it

    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    size = len(model.languages)
    grid = 2.0 ** np.arange(-8, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the rows of each language: how many, their spreads, their costs in every language; then the loss by sharpness.
        number, spreads, totals, losses = np.zeros(size), np.zeros(size), np.zeros((size, size)), np.zeros(len(grid))
        names = ["k", "own", "sums"]
        for batch in batches:
            costs, squares, sizes = cross_entropies(shared.value, batch.column(1).to_pylist())
            known = sizes > 0
            if not known.any():
                continue
            costs, squares, n = costs.T[known], squares.T[known], sizes[known].astype(float)
            truth = np.searchsorted(shared.value.languages, np.array(batch.column(0).to_pylist(), str)[known])
            every = np.arange(len(n))
            own = costs[every, truth]
            number += np.bincount(truth, minlength=size)
            spreads += np.bincount(truth, squares[every, truth] - own**2, minlength=size)
            np.add.at(totals, truth, costs)
            for g, sharpness in enumerate(grid):
                scaled = -costs * n[:, None] * sharpness
                scaled -= scaled.max(axis=1, keepdims=True)
                log_p = scaled[every, truth] - np.log(np.exp(scaled).sum(axis=1))
                losses[g] -= np.maximum(log_p, -20).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(truth, pa.int32()), pa.array(own), pa.nulls(len(own), pa.list_(pa.float64()))], names=names
            )
        sums = np.concatenate([number, spreads, totals.ravel(), losses])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.array([sums])], names=names)

    found = materialize(
        in_batches(rows).select(F.col(f"`{lang}`").cast("string"), F.col(f"`{text}`").cast("string"))
        .mapInArrow(run, "k int, own double, sums array<double>")
    )
    added = found.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("x")).collect()
    flat = np.array([r.x for r in sorted(added, key=lambda r: r.pos)])
    number, spreads, totals, losses = np.split(flat, np.cumsum([size, size, size * size]))
    if not number.any():
        return
    totals = totals.reshape(size, size)

    def medians(value) -> list[float | None]:
        """Of a value made for each language, over the rows of that language."""
        columns = [f"v{k}" for k in range(size)]
        cells = found.where("k is not null").select(*[F.when(F.col("k") == k, value(k)).alias(c) for k, c in enumerate(columns)])
        middle = exact_medians(cells, columns)
        return [middle[c] for c in columns]

    centres = medians(lambda k: F.col("own"))
    offs = medians(lambda k: F.abs(F.col("own") - F.lit(centres[k])))
    for k in np.flatnonzero(number):
        model.centre[k] = centres[k]
        model.within[k] = 4 * spreads[k] / number[k]  # neighbouring symbols are not independent
        model.between[k] = (1.4826 * offs[k]) ** 2
        others = number.sum() - number[k]
        if others:
            model.foreign[k] = (totals[:, k].sum() - totals[k, k]) / others
    model.sharpness = float(grid[losses.argmin()])


def predict(frame: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, carried columns, lang_pred, score, cross_entropy, rejected) for every row of the frame."""
    missing(frame, key, text, *carry)
    shared = frame.sparkSession.sparkContext.broadcast(model)
    kept = [frame.schema[c] for c in (key, *carry)]
    schema = T.StructType([
        *kept,
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            size = len(texts)
            names, score, best = [UNKNOWN] * size, np.zeros(size), np.full(size, np.nan)
            rejected = np.ones(size, bool)
            if m.languages and size:
                costs, _, n = cross_entropies(m, texts)
                at = costs.argmin(axis=0)
                low = costs.min(axis=0)
                scaled = (low - costs) * n * m.sharpness
                known = n > 0
                score = np.where(known, 1 / np.exp(scaled).sum(axis=0), 0.0)
                best = np.where(known, low, np.nan)
                far = low - m.centre[at] > REJECT_Z * np.sqrt(m.between[at] + m.within[at] / np.maximum(n, 1))
                rejected = far & (low > m.foreign[at]) | ~known
                names = [m.languages[a] if k else UNKNOWN for a, k in zip(at, known, strict=True)]
            columns = [batch.column(k) for k in range(len(kept))]
            columns += [pa.array(names, pa.string()), pa.array(score), pa.array(best, from_pandas=True), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    columns = [F.col(f"`{c}`") for c in (key, *carry)]
    return in_batches(frame).select(*columns, F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """True for the fifth of the documents that is never learned from (a null id: always true)."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    model = train(documents.where(~held_out()))
    return predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
