"""Sharding by histogram sort: equal bytes in every shard.

Rows are ordered by (content hash, row key).  Starting from evenly spread probes, each round counts the
exact bytes below all probes in one aggregation; every splitter whose bracket is still wider than the
tolerance gets new probes inside the bracket.  Once all splitters hold, rows are dealt out in one exchange.

Equal texts share a content hash, so they are neighbours in that order.  A splitter is put between
groups of equal texts wherever such a place lies within the tolerance; only a group too large for that is
cut, by its row keys, because the ``bytes`` law comes first.

Defined results: a null text has no bytes and the hash of null; null row keys sort first; rows with equal
key and text cannot be told apart and take neighbouring slots; other columns pass through, but those named size,
shard or slot are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, staged, table

LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Probes inside the bracket of each splitter and round.
FANOUT = 15
#: Most ranges that shards are cut into for the exchange.
MAX_RANGES = 10_000


def _bucket_udf(probes: list[tuple[int, int]]):
    """Number of probes at or below (hash, key); ``probes`` is sorted and without repeats."""
    highs = np.array([p[0] for p in probes], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def bucket(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, k in batches:
            h, k = h.to_numpy(dtype=np.int64), k.to_numpy(dtype=np.int64)
            out = np.searchsorted(highs, h, "left")
            for i in np.flatnonzero(np.searchsorted(highs, h, "right") > out):
                out[i] = bisect_right(probes, (h[i], k[i]))
            yield pd.Series(out.astype(np.int32))

    return bucket


def _between(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys strictly between two, evenly spread: over hashes, or over row keys within one hash."""
    if low[0] + 1 < high[0]:
        step = max(1, (high[0] - low[0]) // (n + 1))
        return [(h, LOWEST) for h in range(low[0] + step, high[0], step)][: n + 1]
    if low[0] + 1 == high[0] and high[1] == LOWEST:  # one hash is left: split its row keys
        high = (low[0], HIGHEST + 1)
    elif low[0] != high[0]:
        return [(high[0], LOWEST)] if low < (high[0], LOWEST) < high else []
    step = max(1, (high[1] - low[1]) // (n + 1))
    return [(low[0], k) for k in range(low[1] + step, high[1], step)][: n + 1]


def find_splitters(keys: DataFrame, total: int, parts: int, tolerance: int) -> list[tuple[int, int]]:
    """parts-1 keys; the bytes below the i-th differ from i/parts of ``total`` by ``tolerance`` at most,
    unless rows of one key, or one row, are larger than that.  ``keys`` has h, k and size."""
    ends = {(LOWEST, LOWEST): 0, (HIGHEST + 1, LOWEST): total}
    goals = [total * i // parts for i in range(1, parts)]
    new = _between((LOWEST, LOWEST), (HIGHEST, LOWEST), max(FANOUT, parts * 4))
    while new:
        probes = sorted(set(new) | {p for p in ends if LOWEST < p[0] <= HIGHEST})
        probes = [p for p in probes if p[0] <= HIGHEST and p[1] <= HIGHEST]
        counted = dict(keys.groupBy(_bucket_udf(probes)("h", "k").alias("b")).agg(F.sum("size")).collect())
        below = 0
        for i, p in enumerate(probes):
            below += counted.get(i, 0)
            ends[p] = below
        order = sorted(ends)
        sums = [ends[p] for p in order]
        new = []
        for goal in goals:
            i = bisect_left(sums, goal)
            near = [order[j] for j in (i - 1, i) if 0 <= j < len(order)]
            if min(abs(ends[p] - goal) for p in near) > tolerance and len(near) == 2:
                new += _between(near[0], near[1], FANOUT)
        new = [p for p in new if p not in ends]
        keep = set()
        for goal in goals:  # brackets only, so that the probes sent stay few
            i = bisect_left(sums, goal)
            keep |= {order[j] for j in (i - 1, i) if 0 <= j < len(order)}
        ends = {p: s for p, s in ends.items() if p in keep or s in (0, total)}
        ends[(LOWEST, LOWEST)], ends[(HIGHEST + 1, LOWEST)] = 0, total
    order = sorted(ends)
    sums = [ends[p] for p in order]
    found = []
    for goal in goals:
        i = bisect_left(sums, goal)
        near = [order[j] for j in (i - 1, i) if 0 <= j < len(order)]
        found.append(min(near, key=lambda p: (abs(ends[p] - goal), p)))
    return found


def shard_by_bytes(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16, tolerance: float = 0.01, task_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with size, shard and slot.  A shard larger than ``task_bytes`` is dealt to several tasks:
    finer splitters cut it, and slots go on from one cut to the next."""
    hc, kc, rc = free_name(df, "hash"), free_name(df, "key"), free_name(df, "range")
    keyed = df.withColumns({hc: F.xxhash64(F.col(text)), kc: F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)), "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead})
    keys = staged(keyed.select(F.col(hc).alias("h"), F.col(kc).alias("k"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    fine = min(max(1, -(-total // (shards * task_bytes))), max(1, MAX_RANGES // shards))
    cuts = find_splitters(keys, total, shards * fine, int(total / shards / fine * tolerance)) if total else []
    inner = [c for c in cuts if LOWEST < c[0] <= HIGHEST]
    before = len([c for c in cuts if c[0] <= LOWEST])
    distinct = sorted(set(inner))
    # ranges[i]: number of splitters at or below what lies between the i-th and the next distinct one
    ranges = [before + bisect_right(inner, distinct[i - 1]) if i else before for i in range(len(distinct) + 1)]
    bucket = _bucket_udf(distinct)
    counts = {r: n for r, n in keys.groupBy(bucket("h", "k").alias("b")).count().collect()}
    first, seen = [], {}
    for i, r in enumerate(ranges):
        s = min(r // fine, shards - 1)
        first.append((i, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + counts.get(i, 0)
    sc, fc = free_name(keyed, "shard"), free_name(keyed, "first")
    starts = F.broadcast(df.sparkSession.createDataFrame(first, f"{rc} int, {sc} int, {fc} long"))  # MAX_RANGES rows at most
    dealt = keyed.withColumn(rc, bucket(hc, kc)).repartition(len(ranges), rc)
    place = F.row_number().over(W.partitionBy(rc).orderBy(hc, kc, "size")) - 1
    return dealt.withColumn("slot", place).join(starts, rc).withColumns({"slot": F.col("slot") + F.col(fc), "shard": F.col(sc)}).drop(hc, kc, rc, sc, fc)


def op7_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
