"""Approximate nearest neighbours: forests of random-projection trees.

Rows are dealt by a hash of their id to shards of bounded size; every row is indexed.  A shard builds a
forest over its rows: each node splits its rows at the median of their projections on the difference of
two of them.  A query walks all trees of a shard through one priority queue, ordered by the smallest
margin on the way, until it has met enough leaf candidates; those are reranked by exact distance.

Defined results: ids null, vectors null, zero, or with null or non-finite components take no part;
vectors are compared with those of their length only; rows with the query's id are not its candidates; a
repeated query id is searched once, with its smallest vector; equal distances go to the smaller id; rows
that cannot be split (all alike) stay in one leaf; other columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import by_length, query_chunks, read_batches, sound, tasks_for

OUT = "query_id long, vec_id long, score double"
TREES, LEAF_ROWS, SEARCH_SHARE, SEARCH_LEAST = 16, 48, 0.6, 600


class Forest:
    """Trees over the rows of a matrix.  Node i has a plane (planes[i], offsets[i]) and children, or a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.rows, self.leaf_rows, self.rng = rows, leaf_rows, np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, np.ndarray] = {}
        self.roots = [self._grow(np.arange(len(rows))) for _ in range(trees)]
        self.planes, self.offsets = np.array(self.planes), np.array(self.offsets)

    def _node(self) -> int:
        self.planes.append(np.zeros(self.rows.shape[1]))
        self.offsets.append(0.0)
        self.children.append(None)
        return len(self.children) - 1

    def _grow(self, members: np.ndarray) -> int:
        root = self._node()
        todo = [(root, members)]
        while todo:
            node, members = todo.pop()
            cut = self._split(members) if len(members) > self.leaf_rows else None
            if cut is None:
                self.leaves[node] = members
                continue
            self.planes[node], self.offsets[node], right = cut
            self.children[node] = left_node, right_node = self._node(), self._node()
            todo += [(left_node, members[~right]), (right_node, members[right])]
        return root

    def _split(self, members: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        for _ in range(3):
            a, b = self.rng.choice(members, 2, replace=False)
            plane = self.rows[a] - self.rows[b]
            norm = np.linalg.norm(plane)
            if not norm > 0 or not np.isfinite(norm):
                continue
            plane = plane / norm
            at = self.rows[members] @ plane
            middle = np.median(at)
            right = at > middle
            if right.any() and not right.all():
                return plane, float(middle), right
        return None

    def candidates(self, margins: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of the leaves met before ``wanted`` of them; margins: of the query at each node."""
        queue = [(-np.inf, r) for r in self.roots]
        met: list[np.ndarray] = []
        n = 0
        while queue and n < wanted:
            worst, node = heapq.heappop(queue)
            pair = self.children[node]
            if pair is None:
                met.append(self.leaves[node])
                n += len(met[-1])
                continue
            margin = margins[node]
            heapq.heappush(queue, (max(worst, margin), pair[0]))
            heapq.heappush(queue, (max(worst, -margin), pair[1]))
        return np.unique(np.concatenate(met)) if met else np.empty(0, dtype=np.int64)


def search_rows(ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, trees: int = TREES, share: float = SEARCH_SHARE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, distances) of the k nearest that a forest over ``rows`` finds for each query."""
    rows, q = rows.astype(np.float64), q.astype(np.float64)
    forest = Forest(rows, trees)
    # as many are met several times, in several trees, the queue is asked for more than the share
    wanted = int(max(SEARCH_LEAST, share * len(ids))) * 2
    with np.errstate(over="ignore", invalid="ignore"):
        for lo in range(0, len(q), 256):
            margins = np.nan_to_num(q[lo : lo + 256] @ forest.planes.T - forest.offsets)
            for i in range(lo, min(lo + 256, len(q))):
                found = forest.candidates(margins[i - lo], wanted)
                found = found[ids[found] != q_ids[i]]
                if not len(found):
                    continue
                d = np.sqrt(((rows[found] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[found], d))[:k]
                yield q_ids[i], ids[found][order], d[order]


def nearest(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for ``items`` and ``queries``, both (id long, v array<double>)."""
    spark = items.sparkSession
    rows = staged(items.where(F.col("id").isNotNull()), "ann-rows")
    laid = rows.repartition(tasks_for(rows.count()), F.xxhash64("id"))
    out = spark.createDataFrame([], OUT)
    for ids, vectors in query_chunks(queries.where(F.col("id").isNotNull())):
        sent = spark.sparkContext.broadcast(by_length(ids, vectors))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for length, (ids, rows) in read_batches(batches).items():
                if length not in sent.value:
                    continue
                found = list(search_rows(ids, rows, *sent.value[length], k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]))],
                        names=["query_id", "vec_id", "score"],
                    )

        out = out.unionByName(laid.mapInArrow(search, OUT))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(sound(F.col("embedding")))
    e = e.where(F.exists("embedding", lambda x: x != 0))
    items = e.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest(items, items.where(F.col("id") % 100 == 0), 10)


QUERIES = {"op10_ann": op10_ann}
SQL: dict[str, str] = {}
