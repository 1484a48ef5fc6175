"""Compact forms of small objects: raw deflate with a dictionary for each kind, kept only where it is smaller.

Deflate learns nothing from one short text; a dictionary of what texts of its kind have in common lets it point back
from the first byte.  Dictionaries are made once, from a bounded sample of each kind, and travel to the tasks; a
compact form names the dictionary it was made with, by digest.

Form: MAGIC, eight bytes of the dictionary's digest, the length as eight bytes, then the stream.

Defined results: null content is left as it is; content over MOST bytes, or not smaller when compact, stays as it is;
a form of another dictionary, of a wrong length, cut off, or with bytes behind its end decodes to null with a fault.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: What marks a compact form; the most bytes of content; the most bytes of a dictionary that deflate can reach.
MAGIC, MOST, WINDOW = b"GMCF\x01", 16 << 20, 32_000
HEAD = struct.Struct(">5s8sQ")
#: Contents of each kind, and bytes of each, that a dictionary is made from.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 4_096


def dictionary(samples: list[bytes]) -> bytes:
    """The words and pairs of words that repeat from sample to sample, those that save most at the end, where they are nearest."""
    seen: Counter[bytes] = Counter()
    for s in samples:
        words = s.split(b" ")
        seen.update({*words, *(a + b" " + b for a, b in zip(words, words[1:], strict=False))})
    worth = sorted(((n - 1) * (len(w) - 2), w) for w, n in seen.items() if n > 1 and len(w) > 3)
    out: list[bytes] = []
    size = 0
    for _, w in reversed(worth):
        if size + len(w) + 1 > WINDOW:
            break
        out.append(w)
        size += len(w) + 1
    return b" ".join(reversed(out))


def dictionaries(objects: DataFrame, kind: str = "kind", content: str = "content") -> dict[str, bytes]:
    """A dictionary for each kind (kinds are few), from different contents whose hash falls to the sample.

    One hash in so many does, by the number of rows of a kind, so about SAMPLE_ROWS contents of each reach the driver."""
    parts = objects.where(F.col(content).isNotNull()).select(F.col(kind).alias("kind"), F.xxhash64(content).alias("h"), F.substring(content, 1, SAMPLE_BYTES).alias("s"))
    rows = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return {}
    every = F.coalesce(*(F.when(F.col("kind").eqNullSafe(F.lit(k)), F.lit(max(1, n // SAMPLE_ROWS))) for k, n in rows.items()))
    picked = parts.where(F.pmod("h", every) == 0).groupBy("kind", "h").agg(F.first("s").alias("s")).collect()
    return {k: dictionary([bytes(r["s"]) for r in sorted((r for r in picked if r["kind"] == k), key=lambda r: r["h"])[:SAMPLE_ROWS]]) for k in rows}


def name_of(words: bytes) -> bytes:
    return hashlib.sha256(words).digest()[:8]


def encoded(content: bytes, words: bytes) -> bytes | None:
    """The compact form; null if it is not smaller."""
    if len(content) > MOST:
        return None
    c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=words)
    form = HEAD.pack(MAGIC, name_of(words), len(content)) + c.compress(content) + c.flush()
    return form if len(form) < len(content) else None


def decoded(form: bytes, words: bytes) -> bytes:
    """The content of a compact form; ValueError says what is wrong with it."""
    if len(form) < HEAD.size:
        raise ValueError("head is cut off")
    magic, name, length = HEAD.unpack_from(form)
    if magic != MAGIC or length > MOST:
        raise ValueError("not a compact form")
    if name != name_of(words):
        raise ValueError("made with another dictionary")
    d = zlib.decompressobj(-15, zdict=words)
    try:
        content = d.decompress(form[HEAD.size :], length + 1)
    except zlib.error as e:
        raise ValueError("stream is broken") from e
    if not d.eof and not d.unconsumed_tail and len(content) <= length:
        raise ValueError("stream is cut off")
    if len(content) != length or not d.eof:
        raise ValueError("length differs")
    if d.unused_data:
        raise ValueError("bytes behind the end")
    return content


def compact(objects: DataFrame, known: dict[str, bytes], kind: str = "kind", content: str = "content") -> DataFrame:
    """``objects`` with ``stored`` (compact form or the content itself) and ``form`` (compact or plain)."""
    sent = objects.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(BinaryType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, contents in batches:
            yield pd.Series([None if c is None else encoded(bytes(c), sent.value.get(k, b"")) for k, c in zip(kinds, contents, strict=True)], dtype=object)

    out = objects.withColumn("__c", run(F.col(kind), F.col(content)))
    return out.withColumns({"stored": F.coalesce("__c", content), "form": F.when(F.col("__c").isNotNull(), "compact").when(F.col(content).isNotNull(), "plain")}).drop("__c")


def restored(objects: DataFrame, known: dict[str, bytes], kind: str = "kind") -> DataFrame:
    """``objects`` (kind, stored, form) with ``content`` and ``fault``."""
    sent = objects.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf(StructType([StructField("content", BinaryType()), StructField("fault", StringType())]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for kinds, stored, forms in batches:
            rows: list[tuple] = []
            for k, s, f in zip(kinds, stored, forms, strict=True):
                try:
                    rows.append((None if s is None else decoded(bytes(s), sent.value.get(k, b"")) if f == "compact" else bytes(s), None))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["content", "fault"], dtype=object)

    return objects.withColumn("__r", run(F.col(kind), "stored", "form")).withColumns({"content": F.col("__r.content"), "fault": F.col("__r.fault")}).drop("__r")
