"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights: component d with weight w is a posting (row, w) of term d. Queries and
candidates are cut into blocks by hash, and each pair of a query block and a candidate block is scored by itself:
for one term after the other the weighted postings are added into dense score arrays, one for each query; a
partition selection keeps the k best candidates of each query, and the selections of all blocks are merged. A term
that most candidates have is kept as a dense column, others as row numbers and weights; both add the same numbers.

Scores are exact integers. Ties go to the smaller id. Vectors that are null, empty or hold null or non-finite
components, and null ids, take no part; an id that repeats counts once, with its smallest vector. A query has no
more rows than there are other candidates. Vectors of different lengths are compared over the common components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staywise.llm.common import materialize, missing

SCALE, TOP = 64, 20
#: Rows of a query block and of a candidate block: bounds what a task holds.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Scores held at once in a task.
SCORES = 1 << 22
_LONG = (1 << 63) - 1


def quantised(frame: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows (id, v): floor(scale * x) of every component, x as double, for the vectors that take part."""
    missing(frame, key, vector)
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = frame.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    weights = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), weights.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, one row of weights each); short vectors are filled with zeros."""
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _accumulators(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The narrowest integers that no score can leave."""
    largest = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    bound = largest(queries) * largest(candidates) * max(1, candidates.shape[1])
    return np.int32 if bound < 1 << 31 else np.int64 if bound <= _LONG else object


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores) of the k best candidates of each query in one block."""
    kind = _accumulators(queries, candidates)
    terms = min(queries.shape[1], candidates.shape[1])
    postings = []
    for d in range(terms):
        column = candidates[:, d].astype(kind)
        rows = np.flatnonzero(column)
        postings.append((None, column) if 2 * len(rows) > len(ids) else (rows, column[rows]))
    found = []
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        mine = query_ids[at : at + step]
        scores = np.zeros((len(mine), len(ids)), kind)
        for acc, row in zip(scores, queries[at : at + step, :terms].astype(kind), strict=True):
            for d in np.flatnonzero(row):
                rows, weights = postings[d]
                if rows is None:
                    acc += row[d] * weights
                else:
                    acc[rows] += row[d] * weights
        for q, own, acc in zip(range(len(mine)), mine, scores, strict=True):
            self_at = np.searchsorted(ids, own)
            other = np.ones(len(ids), bool)
            if self_at < len(ids) and ids[self_at] == own:
                other[self_at] = False
            left = np.flatnonzero(other)
            take = min(k, len(left))
            if not take:
                continue
            values = acc[left]
            edge = np.sort(values)[len(left) - take] if kind is object else np.partition(values, len(left) - take)[len(left) - take]
            above = np.flatnonzero(values > edge)
            ties = np.flatnonzero(values == edge)[: take - len(above)]  # ids rise, so these are the smallest
            chosen = left[np.concatenate([above, ties])]
            final = [max(-_LONG - 1, min(_LONG, int(x))) for x in acc[chosen]] if kind is object else acc[chosen].astype(np.int64)
            found.append((np.full(take, own), ids[chosen], np.array(final, np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for queries and candidates given as rows (id, v)."""
    asked, offered = materialize(queries), materialize(candidates)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = max(1, -(-offered.count() // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", block(query_blocks).alias("qb"), every(blocks).alias("cb"))
    right = offered.select("id", "v", block(blocks).alias("cb"), every(query_blocks).alias("qb"))

    def score(own: pa.Table, others: pa.Table) -> pa.Table:
        if own.num_rows and others.num_rows:
            q, c, s = best_of_block(*_matrix(own), *_matrix(others), k)
        else:
            q = c = s = np.zeros(0, np.int64)
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    selected = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        score, "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = selected.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(embeddings: DataFrame, every: int = 20, k: int = TOP) -> DataFrame:
    """The k best of all other rows for each row whose vec_id is divisible by ``every``."""
    rows = materialize(quantised(embeddings, "vec_id", "embedding"))
    return top_k(rows.where(F.col("id") % every == 0), rows, k)


#: The same in DuckDB.
ORACLE = """
with rows as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
