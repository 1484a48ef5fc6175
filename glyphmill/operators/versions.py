"""Versions of documents: single phases of matching, dispositions and heads (all phases: ``reconcile``).

Blocks: doc_id, block_id, native_id, kind, parent_id, ordinal, sibling, hash, text.  Every phase is an equi
join inside a document; unique means that the key occurs once on either side.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Limits that results must agree on.
NEAR, SEQUENCE, SIMILAR, MARGIN, COMPARED = 8, 256, 970_000, 50_000, 4096
# End of fixed values.


def only_once(b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur once; null keys never match."""
    return b.dropna(subset=keys).withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where("__n = 1").drop("__n")


def unique_phase(previous: DataFrame, current: DataFrame, keys: list[str], method: str, confidence: int) -> DataFrame:
    """doc_id, previous_id, current_id, method, confidence of keys that are unique on both sides."""
    p = only_once(previous, keys).select(*keys, F.col("block_id").alias("previous_id"))
    c = only_once(current, keys).select(*keys, F.col("block_id").alias("current_id"))
    return p.join(c, keys).select("doc_id", "previous_id", "current_id", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))


def similarity(a: str | None, b: str | None) -> int:
    """Matching ratio in millionths of texts with single spaces, case-folded, cut to COMPARED characters."""
    x, y = (" ".join((t or "").split()).casefold()[:COMPARED] for t in (a, b))
    return round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() * 1_000_000)


@F.pandas_udf(IntegerType())
def similarity_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def similar_phase(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mutual best matches of one kind within NEAR places, similar enough and clearly before the second best.

    Also returns all compared pairs.  Places are dealt to bands of NEAR + 1, so candidates meet in an
    equi join of neighbouring bands."""
    band = F.floor(F.col("ordinal") / (NEAR + 1))
    p = previous.select("doc_id", "kind", band.alias("band"), F.col("ordinal").alias("po"), F.col("block_id").alias("previous_id"), F.col("text").alias("pt"))
    c = current.select("doc_id", "kind", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("ordinal").alias("co"), F.col("block_id").alias("current_id"), F.col("text").alias("ct"))
    pairs = p.join(c, ["doc_id", "kind", "band"]).where(F.abs(F.col("po") - F.col("co")) <= NEAR).withColumn("score", similarity_column("pt", "ct"))
    sides = {}
    for side in ("previous_id", "current_id"):
        w = W.partitionBy("doc_id", side).orderBy(F.desc("score"), "po", "co")
        sides[side] = (F.row_number().over(w), F.coalesce(F.lead("score").over(w), F.lit(-MARGIN)))
    judged = pairs.withColumns({"rp": sides["previous_id"][0], "sp": sides["previous_id"][1], "rc": sides["current_id"][0], "sc": sides["current_id"][1]})
    good = judged.where((F.col("rp") == 1) & (F.col("rc") == 1) & (F.col("score") >= SIMILAR) & (F.col("score") - F.greatest("sp", "sc") >= MARGIN))
    return good.select("doc_id", "previous_id", "current_id", F.lit("similarity").alias("method"), F.col("score").alias("confidence")), pairs


def sequence_phase(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Same parent, kind and hash, unique among what is left, within SEQUENCE places."""
    keys = ["doc_id", "parent_id", "kind", "hash"]
    p = only_once(previous, keys).select(*keys, F.col("ordinal").alias("po"), F.col("block_id").alias("previous_id"))
    c = only_once(current, keys).select(*keys, F.col("ordinal").alias("co"), F.col("block_id").alias("current_id"))
    near = p.join(c, keys).where(F.abs(F.col("po") - F.col("co")) <= SEQUENCE)
    return near.select("doc_id", "previous_id", "current_id", F.lit("sequence").alias("method"), F.lit(900_000).alias("confidence"))


def dispositions(sources: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """added, updated or unchanged for each source; removed for what is known and not there any more."""
    k = known.select(key, F.col(digest).alias("__old"), F.lit(1).alias("__k"))
    s = sources.select(key, F.col(digest).alias("__new"), F.lit(1).alias("__s"))
    outcome = F.when(F.col("__k").isNull(), "added").when(F.col("__s").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("updated")
    return s.join(k, key, "full").select(key, outcome.alias("outcome"))


def heads(observations: DataFrame) -> DataFrame:
    """The newest observation of each document, and how many scopes share its time (over one: a conflict)."""
    newest = observations.groupBy("doc_id").agg(F.max("observed_at").alias("observed_at"))
    at_head = observations.join(newest, ["doc_id", "observed_at"])
    return at_head.groupBy("doc_id", "observed_at").agg(F.min("scope").alias("scope"), F.count_distinct("scope").alias("scopes"), F.max("ingested_at").alias("ingested_at"))


def head_events(observations: DataFrame) -> DataFrame:
    """Observations in order of ingest, each with its number and whether it moved the head."""
    w = W.partitionBy("doc_id").orderBy("ingested_at", "scope")
    before = F.max("observed_at").over(w.rowsBetween(W.unboundedPreceding, -1))
    same = F.max(F.struct("observed_at", "scope")).over(w.rowsBetween(W.unboundedPreceding, -1))["scope"]
    moved = before.isNull() | (F.col("observed_at") > before) | ((F.col("observed_at") == before) & (F.col("scope") == same))
    return observations.withColumns({"sequence": F.row_number().over(w).cast("long"), "head_advanced": moved})
