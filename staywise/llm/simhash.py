"""SimHash near-duplicates, found exactly through vantage-point trees over parts of the fingerprint.

If two fingerprints differ in at most t bits, then in one of three parts (22, 21 and 21 bits) they differ in at most
r = t // 3. So each part has a vantage-point tree of its own that is searched with radius r. The tree parts the values
by their Hamming distance to one vantage point after the other. By the triangle inequality the distances of two
partners differ by at most r each, and which differences occur together is known: a bit that differs adds or takes
one from each distance, by the vantage point's own bit. So the partners of a value lie in the shards at these few
offsets; all other branches are pruned. A fingerprint has one home shard for each part and is sent as a query to the
shards at the offsets of one sign, so each pair meets; there all 64 bits are compared. No pair is missed.

The tree is as deep as the number of fingerprints asks for (SHARD of them in a shard, as far as the bits of a part
can tell them apart), while the rows of a fingerprint stay near three dozen: work grows in proportion to the input.

Null texts are empty texts: fingerprint zero, linked like any other. Rows with a null key get a fingerprint and the
component of their fingerprint; it is null only if all keys in it are. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import in_batches, materialize, missing
from staywise.llm.components import Forest, connected

SEED = 42
#: First bit and number of bits of each part.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that a shard should hold, and vantage points of a part at most (far more than tell all its values apart).
SHARD, DEEPEST = 512, 12
#: Fingerprints of a shard that are compared in one task; a larger shard is cut into blocks of about this size.
BLOCK = 4096
#: Hot shards are looked up by broadcast up to so many, by a shuffled join beyond.
HOT_SHARDS = 50_000
#: Pairs compared at once.
CELLS = 1 << 20


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of word shingles: a bit is set if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: A to Z and the blanks of ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[i:j], SEED) for i, j in pairs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        octets = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(frame: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp): the fingerprint as a signed long."""
    missing(frame, key, text)
    schema = T.StructType([frame.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=schema.names)

    return in_batches(frame).select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def depth_for(count: int) -> int:
    """Vantage points of a part: the first one tells 2**3.1 shards apart on average, each other one 2**2 times as many."""
    wanted = math.log2(max(1, count) / SHARD)
    return min(DEEPEST, max(1, 1 + math.ceil((wanted - 3.1) / 2)))


def vantage_points(depth: int, bits: int) -> list[int]:
    """Zero, then drawn patterns of half the bits (always the same ones): each says something new."""
    draw = random.Random(bits)
    return [0, *(sum(1 << b for b in draw.sample(range(bits), bits // 2)) for _ in range(depth - 1))]


def _offsets(points: list[int], bits: int, radius: int) -> dict[tuple[int, ...], int]:
    """Differences of vantage distances that partners within the radius can show, one of each +/- pair.

    With each the bits that, being zero, make it possible (all bits where that is not asked).
    """
    # What setting a bit adds to the distances; the first is always 1, as the first vantage point is zero.
    columns = [tuple(1 - 2 * (v >> b & 1) for v in points) for b in range(bits)]
    if radius == 1:
        found: dict[tuple[int, ...], int] = {}
        for b, column in enumerate(columns):
            found[column] = found.get(column, 0) | 1 << b
        return found
    zero, sums = tuple([0] * len(points)), {tuple([0] * len(points))}
    steps = {tuple(s * x for x in column) for column in columns for s in (1, -1)}
    for _ in range(radius):
        sums |= {tuple(map(sum, zip(a, b, strict=True))) for a in sums for b in steps}
    return {d: -1 for d in sorted(sums) if d > zero}


def _shards(values: DataFrame, radius: int, depth: int) -> DataFrame:
    """(shard, fp, query) rows: a home row for each part, and query rows for the overlapping shards."""
    trees = []
    for first, bits in PARTS:
        points = vantage_points(depth, bits)
        trees.append((first, bits, points, _offsets(points, bits, radius)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, (first, bits, points, offsets) in enumerate(trees):
                own = fp >> np.uint64(first) & np.uint64((1 << bits) - 1)
                near = np.stack([np.bitwise_count(own ^ np.uint64(v)).astype(np.int64) for v in points], 1)
                for shift, clear in [(None, -1), *offsets.items()]:
                    at = near if shift is None else near + np.array(shift)
                    fits = ((at >= 0) & (at <= bits)).all(axis=1)
                    if clear >= 0:
                        fits &= (~own & np.uint64(clear)) != 0
                    shard = np.zeros(int(fits.sum()), np.int64)
                    for k in range(len(points)):
                        shard = shard * (bits + 1) + at[fits, k]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard * len(PARTS) + part),
                            pa.array(fp[fits].view(np.int64)),
                            pa.array(np.full(len(shard), shift is not None)),
                        ],
                        names=["shard", "fp", "query"],
                    )

    return values.select("fp").mapInArrow(run, "shard long, fp long, query boolean")


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) edges between fingerprints that say which ones are connected by links of at most ``max_bits`` bits.

    ``distinct`` is read several times, so it should be written beforehand.

    Shards are cut into blocks where they are large: home rows go to one block, everything that must be compared
    with the shard goes to all its blocks. A block returns a spanning forest of its links, never all pairs.
    """
    rows = _shards(distinct, max_bits // len(PARTS), depth_for(distinct.count()))
    hot = materialize(
        rows.where("not query").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        .select("shard", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    if count := hot.count():
        rows = rows.join(F.broadcast(hot) if count <= HOT_SHARDS else hot, "shard", "left")
        every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        # In a shard of several blocks a home row is a query of the other blocks.
        rows = rows.select(
            "shard", "fp", F.explode(every).alias("block"), F.col("query").alias("_query"), own.alias("_own")
        ).select("shard", "block", "fp", (F.col("_query") | (F.col("block") != F.col("_own"))).alias("query"))
    else:
        rows = rows.withColumn("block", F.lit(0))

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        asked = group.column("query").to_numpy()
        homes = np.flatnonzero(~asked)
        forest = Forest(len(fp))
        target = fp[homes]
        step = max(1, CELLS // max(1, len(homes)))
        for at in range(0, len(fp) if len(homes) else 0, step):
            apart = np.bitwise_count(fp[at : at + step, None] ^ target[None, :])
            i, j = np.nonzero(apart <= max_bits)
            forest.union(i + at, homes[j])
        member, root = forest.links()
        return pa.table({"a": fp[member].view(np.int64), "b": fp[root].view(np.int64)})

    return rows.groupBy("shard", "block").applyInArrow(compare, "a long, b long")


def near_duplicates(
    frame: DataFrame, shingle: int = 4, max_bits: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (key, fp, component): component is the smallest key reachable by links of at most ``max_bits`` bits."""
    own = materialize(fingerprints(frame, shingle, key, text))
    first = own.groupBy("fp").agg(F.min(key).alias("first"))
    reached = connected(links(materialize(own.select("fp").distinct()), max_bits))
    lowest = reached.join(first, reached["node"] == first["fp"]).select("root", "node", "first")
    groups = lowest.groupBy("root").agg(F.min("first").alias("component"))
    linked = lowest.join(groups, "root").select(F.col("node").alias("fp"), "component")
    # Written first: then both sides below are plain shuffles, and a fingerprint of very many copies can be split.
    ends = materialize(first.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component")))
    return own.join(ends, "fp").select(key, "fp", "component")


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal digits, component_id of every document."""
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
