"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Texts are tokenised once, with their closing id, and cut into pieces of at most ``size`` tokens.  All
planning is done on the histogram of piece lengths, which has ``size`` counters at any scale:

1. lengths are rounded up to ``bins`` classes, and all patterns of one to three classes that fill a
   sequence are listed;
2. non-negative least squares fits the patterns' repeat counts to the histogram of classes, weighting
   classes by their size; counts are rounded down;
3. each pattern is carried out on real lengths: its larger documents are taken from their classes, the
   last is the longest left that fits, and what room remains is filled likewise;
4. the residual lengths are packed longest first, each followed by the longest left that fits.

Equal steps are done in bulk, so a plan has a few entries for each length.  A piece finds its place by
its rank among the pieces of its length: per-task counts give the offsets, and no task sorts or holds a
length's pieces.

Defined results: a null text is empty, and an empty text is the closing id alone; only documents longer
than ``size`` are cut, the first piece taking what is over; rows of a repeated key are packed each on its
own; other columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

SIZE = 2048
BINS = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_encoders: dict[int, Callable[[str], np.ndarray]] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(model: bytes) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, as the tokenizers library gives for ``model`` without special tokens added.

    For plain byte-level models whose merges are in order of id, tiktoken gives the same ids faster."""
    key = zlib.crc32(model)
    if key not in _encoders:
        _encoders[key] = _ranked(json.loads(model)) or _plain(model)
    return _encoders[key]


def _plain(model: bytes) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _ranked(spec: dict) -> Callable[[str], np.ndarray] | None:
    bpe, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if bpe.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor") or spec.get("truncation"):
        return None
    if any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        return None
    vocab, alphabet = bpe["vocab"], byte_alphabet()
    special = {t["content"]: t["id"] for t in added}
    last = -1
    for m in bpe["merges"]:
        made = vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1)
        if made <= last:
            return None
        last = made
    import public_tokenizers
    import tiktoken

    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    coder = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: coder.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; what is over comes first."""
    over = n % size
    return ([(0, over)] if over else []) + [(s, size) for s in range(over, n, size)]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    gradient = a.T @ b
    tol = 1e-10 * max(1.0, np.abs(gradient).max(initial=0.0))
    for _ in range(rounds or 3 * n):
        free = np.where(used, -np.inf, gradient)
        if used.all() or free.max() <= tol:
            break
        used[int(free.argmax())] = True
        while True:
            s = np.zeros(n)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if not used.any() or s[used].min() > 0:
                break
            bad = used & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            used &= x > 1e-12
            x[~used] = 0
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Multisets of one to three classes that sum to ``bins``."""
    two = [(a, bins - a) for a in range(bins // 2 + bins % 2, bins)]
    three = [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    return [(bins,), *two, *three]


def plan(histogram: np.ndarray, size: int = SIZE, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of the pieces of a sequence, how many such sequences)]; histogram[n]: pieces of length n."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    bins = min(bins, size)
    unit = -(-size // bins)
    of_class = -(-np.arange(size + 1) // unit)

    def longest(limit: int) -> int:
        """Longest length left that is at most ``limit``; 0 if none."""
        if limit < 1:
            return 0
        at = np.flatnonzero(left[1 : limit + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def fill(lengths: list[int], most: int) -> int:
        """Fills up sequences that begin with ``lengths``; takes at most ``most`` of them off the histogram."""
        room = size - sum(lengths)
        taken = {n: lengths.count(n) for n in lengths}
        while room > 0:
            n = longest(room)
            while n and left[n] <= taken.get(n, 0):
                n = longest(n - 1)
            if not n:
                break
            lengths.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        times = min(most, *(int(left[n]) // m for n, m in taken.items()))
        for n, m in taken.items():
            left[n] -= m * times
        out.append((tuple(lengths), times))
        return times

    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    shapes = patterns(bins)
    goal = np.bincount(of_class[1:], weights=left[1:], minlength=bins + 1)[1:]
    a = np.zeros((bins, len(shapes)))
    for j, shape in enumerate(shapes):
        for c in shape:
            a[c - 1, j] += 1
    weight = np.arange(1, bins + 1) / bins
    counts = np.floor(nnls(a * weight[:, None], goal * weight) + 1e-6).astype(np.int64)
    for j in sorted(np.flatnonzero(counts), key=lambda j: [-c for c in shapes[j]]):
        todo = int(counts[j])
        while todo:
            lengths: list[int] = []
            for c in shapes[j][:-1] or shapes[j]:
                n = longest(min(c * unit, size))
                while n and left[n] <= lengths.count(n):
                    n = longest(n - 1)
                if not n or of_class[n] != c:
                    break
                lengths.append(n)
            if len(lengths) < max(1, len(shapes[j]) - 1):
                break  # a class has run out: its documents went where they fitted better
            todo -= fill(lengths, todo)
    while n := longest(size):
        fill([n], int(left[n]))
    return out


def slots(planned: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first sequence and the offset there; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in planned:
        at = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, at))
            used[n] = used.get(n, 0) + times
            at += n
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3], "first": np.searchsorted(cols[:, 0], np.arange(size + 2))}


def tokenise(docs: DataFrame, model: bytes, size: int = SIZE, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """One row for each piece, with its task and its rank among the task's pieces of its length."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(sent.value), TaskContext.get().partitionId()
        met = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(body) if body else np.empty(0, dtype=np.uint32), np.uint32(end_id)).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), size)):
                    for col, v in zip(cols, (doc, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, int(met[length])), strict=True):
                        col.append(v)
                    met[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, model: bytes, size: int = SIZE, key: str = "doc_id", text: str = "text", end_id: int = 0, bins: int = BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    cut_up = staged(tokenise(docs, model, size, key, text, end_id), "pack-pieces")
    counts = cut_up.groupBy("task", "length").count()
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # ``size`` rows at most
        histogram[length] = n
    sent = spark.sparkContext.broadcast(slots(plan(histogram, size, bins), size))
    before = F.sum("count").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        s = sent.value
        for length, rank in batches:
            length, rank = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
            low, high = s["first"][length], s["first"][length + 1]
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                lo, hi = low[own[0]], high[own[0]]
                at[own] = lo + np.searchsorted(s["rank"][lo:hi], rank[own], "right") - 1
            yield pd.DataFrame({"sequence_id": s["sequence"][at] + rank - s["rank"][at], "offset": s["offset"][at]})

    ranked = cut_up.join(offsets, ["task", "length"]).withColumn("p", place("length", F.col("nth") + F.col("before")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def model_bytes(name: str = "byte_bpe_50k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), model_bytes())


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
