"""Exact top-k search by block-at-a-time pruning.

Rows are kept in order of id and cut into blocks of consecutive rows.  A block holds the largest and the
smallest component of each term (dimension); the sum of a query's products with whichever is larger
bounds all its scores in the block.  For each query a task visits its blocks by falling bound, scores
them through their rows (the block's forward index), and stops once a bound falls below the k-th best
score so far; at first that is the k-th best among the queries' own rows.

Defined results: ids null, vectors null or with null or non-finite components take no part; vectors are
compared with those of their length only; rows with the query's id are not its candidates; a repeated
query id is searched once, with its smallest vector, and repeated candidate rows all count; equal scores
go to the smaller id; other columns are not returned; an empty table gives no rows.  Sums beyond a long wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import by_length, query_chunks, read_batches, sound, tasks_for

OUT = "query_id long, vec_id long, score long"
BLOCK_ROWS = 64
#: Blocks scored between two looks at the bounds.
STRIDE = 4
#: Queries whose own rows give the first lower bounds.
SEEDS = 2048


def _exact(m: np.ndarray) -> np.ndarray:
    """As doubles where their products and sums are exact, else as longs."""
    return m.astype(np.float64) if m.size == 0 or (np.abs(m).max() <= 1 << 20 and m.shape[1] <= 1 << 12) else m.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def first_bounds(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """k-th best score of each query among up to SEEDS queries; lowest long where there are fewer than k."""
    seeds = _exact(vectors[:SEEDS])
    out = np.full(len(ids), -(2.0**63))
    if seeds.dtype != np.float64 or _exact(vectors).dtype != np.float64 or len(seeds) <= k:
        return out
    for lo in range(0, len(ids), 512):
        s = vectors[lo : lo + 512].astype(np.float64) @ seeds.T
        s[ids[lo : lo + 512][:, None] == ids[:SEEDS][None, :]] = -np.inf
        out[lo : lo + 512] = np.partition(s, -k, axis=1)[:, -k]
    return np.maximum(out, -(2.0**63))


def search_rows(ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best among ``rows`` that can still be among the k best of all."""
    m, q = _exact(rows), _exact(q)
    exact = m.dtype == q.dtype == np.float64
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    top = np.maximum.reduceat(rows, starts, axis=0)
    low = np.minimum.reduceat(rows, starts, axis=0)
    for i, qi in enumerate(q):
        if exact:
            bounds = np.maximum(top * qi, low * qi).sum(axis=1)
            order = np.argsort(-bounds, kind="stable")
        else:  # bounds may wrap around: look at all
            m, qi, order, bounds = rows.astype(np.int64), qi.astype(np.int64), np.arange(len(starts)), None
        scores, found = np.empty(0, dtype=m.dtype), np.empty(0, dtype=np.int64)
        kth = floor[i]
        for at in range(0, len(order), STRIDE):
            blocks = order[at : at + STRIDE]
            if bounds is not None:
                blocks = blocks[bounds[blocks] >= kth]
                if not len(blocks):
                    break
            where = (starts[blocks][:, None] + np.arange(BLOCK_ROWS)[None, :]).ravel()
            where = where[where < len(ids)]
            s = m[where] @ qi
            keep = (s >= kth) & (ids[where] != q_ids[i]) if bounds is not None else ids[where] != q_ids[i]
            scores, found = _best(np.concatenate([scores, s[keep]]), np.concatenate([found, ids[where][keep]]), k)
            if len(scores) == k:
                kth = max(kth, scores[-1])
        if len(found):
            yield q_ids[i], found, scores


def exact_top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for ``items`` and ``queries``, both (id long, v array<long>)."""
    spark = items.sparkSession
    rows = staged(items.where(F.col("id").isNotNull()), "topk-rows")
    n = rows.count()
    laid = rows.repartitionByRange(tasks_for(n), "id")
    out = spark.createDataFrame([], OUT)
    for ids, vectors in query_chunks(queries.where(F.col("id").isNotNull())):
        sent = spark.sparkContext.broadcast({d: (qi, q, first_bounds(qi, q, k)) for d, (qi, q) in by_length(ids, vectors).items()})

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for length, (ids, rows) in read_batches(batches).items():
                if length not in sent.value:
                    continue
                found = list(search_rows(ids, rows, *sent.value[length], k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))],
                        names=["query_id", "vec_id", "score"],
                    )

        out = out.unionByName(laid.mapInArrow(search, OUT))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(sound(F.col("embedding")))
    items = e.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    return exact_top_k(items, items.where(F.col("id") % 50 == 0), 5)


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {"op5_exact_topk": op5_exact_topk}
SQL = {"op5_exact_topk": OP5_SQL}
