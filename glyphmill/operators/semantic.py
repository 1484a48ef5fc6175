"""Exact semantic scores: blocks of query vectors against all vectors, as matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Queries that are sent to the tasks at a time, and their components at most: 32 MB.
BLOCK, BLOCK_COMPONENTS = 4096, 1 << 22
#: Scores that a task holds at a time; a batch of vectors is taken in slices.
HELD = 1 << 19


def _sound(column: pa.Array, ids: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors without nulls, by their length."""
    rows: dict[int, list] = {}
    for key, v in zip(ids.to_pylist(), column.to_pylist(), strict=True):
        if key is not None and v and None not in v:
            rows.setdefault(len(v), []).append((key, v))
    for found in rows.values():
        yield np.array([k for k, _ in found], dtype=np.int64), np.array([v for _, v in found], dtype=np.float64)


def scores(queries: DataFrame, vectors: DataFrame, floor: int | None = None, top: int | None = None) -> DataFrame:
    """query_id, vec_id, score in millionths, half away from zero, of vectors (vec_id, v) of the query's length.

    ``floor`` drops lower scores; ``top`` leaves at least that many best of each query, ties included, and drops what no
    task has among its own best.  Blocks of queries follow one another; each is written before the next if there are several."""
    spark = vectors.sparkSession
    shape = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, shape[1] or 1)))
    blocks = max(1, -(-shape[0] // size))
    out = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v").toArrow()
        sent = spark.sparkContext.broadcast({m.shape[1]: (ids, m) for ids, m in _sound(own.column("v"), own.column("vec_id"))})

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, m in _sound(batch.column(1), batch.column(0)):
                    if m.shape[1] not in sent.value:
                        continue
                    names, q = sent.value[m.shape[1]]
                    step = max(1, HELD // max(1, len(q)), 4 * (top or 0))  # so many that ``top`` still drops most
                    for lo in range(0, len(ids), step):
                        own, x = ids[lo : lo + step], m[lo : lo + step] @ q.T
                        s = np.clip(np.sign(x) * np.floor(np.abs(x) * 1_000_000 + 0.5), -1_000_000, 1_000_000).astype(np.int32)
                        keep = np.ones(s.shape, dtype=bool) if floor is None else s >= floor
                        if top is not None and len(own) > top:
                            keep &= s >= np.partition(s, len(own) - top, axis=0)[len(own) - top]
                        row, col = np.nonzero(keep)
                        yield pa.RecordBatch.from_arrays([pa.array(names[col]), pa.array(own[row]), pa.array(s[row, col])], names=["query_id", "vec_id", "score"])

        made = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(score, "query_id long, vec_id long, score int")
        if blocks > 1:
            made = staged(made, "semantic-block")
            sent.destroy()
        out.append(made)
    return reduce(DataFrame.union, out)
