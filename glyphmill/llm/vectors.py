"""Reading vector tables: which rows take part, query chunks, and tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that are sent to every task at once; more are searched chunk by chunk.
QUERY_CHUNK = 8192
#: Rows that one task searches.
TASK_ROWS = 8192


def sound(vec: Column) -> Column:
    """Not null, and neither null nor non-finite components."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(ok, F.lit(False))


def query_chunks(queries: DataFrame, chunk: int = QUERY_CHUNK) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, vectors) of ``queries`` (id, v), one row an id, sorted by id, about ``chunk`` rows at a time."""
    once = queries.groupBy("id").agg(F.min("v").alias("v"))
    n = once.count()
    parts = -(-n // chunk)
    for i in range(parts):
        part = once if parts == 1 else once.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        rows = sorted(part.collect(), key=lambda r: r["id"])
        if rows:
            yield np.array([r["id"] for r in rows], dtype=np.int64), [np.array(r["v"]) for r in rows]


def by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length as a matrix; only those can be compared."""
    lengths = np.array([len(v) for v in vectors])
    return {int(n): (ids[lengths == n], np.array([v for v, m in zip(vectors, lengths, strict=True) if m == n])) for n in np.unique(lengths)}


def read_batches(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """All (id, v) rows of a task, in order of id, as one matrix a length."""
    ids, vectors, lengths = [], [], []
    for b in batches:
        col = b.column(b.schema.get_field_index("v"))
        offsets = col.offsets.to_numpy()
        ids.append(b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False))
        flat = col.values.to_numpy(zero_copy_only=False)
        vectors.append(flat[offsets[0] : offsets[-1]])
        lengths.append(np.diff(offsets))
    if not ids:
        return {}
    ids, flat, lengths = np.concatenate(ids), np.concatenate(vectors), np.concatenate(lengths)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[int(n)] = ids[rows], flat[starts[rows][:, None] + np.arange(n)[None, :]]
    return out


def tasks_for(n: int, rows: int = TASK_ROWS) -> int:
    return max(1, -(-n // rows))
