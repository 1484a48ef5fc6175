"""Reconciling two versions of documents, block by block, with parents that must match.

Phases: native id; equal content; equal asset or table; similar text; equal content in sequence.  Each works on what
those before have left.  A key pairs two blocks where it occurs once on either side; but for native ids, a pair
counts only if both blocks are at the top or their parents are a pair themselves.  So pairs go down the tree: each
round takes the candidates whose parents the round before has paired, until none is left.  Only the newest pairs are
joined, by (document, both parents), and candidates of a phase never change, so rounds are as many as the tree is
deep and their order does not matter.

Blocks: doc_id, block_id, native_id, kind, parent_id, ordinal, hash, asset_id, structured_hash, text.

Defined results: rows without doc_id or block_id match nothing; of null keys none matches; null text is not compared,
empty texts are equal; blocks whose id repeats within a document match nothing; a block
whose parent is not there, or that is its own ancestor, finds no pair but by native id; empty tables give no pairs.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources.scratch import staged

# Limits that results must agree on.
NEAR, SEQUENCE, SIMILAR, MARGIN, COMPARED, CERTAIN = 8, 256, 970_000, 50_000, 4096, 1_000_000
# End of fixed values.

KEYS = ["doc_id", "previous_id", "current_id"]


class Reconciled(NamedTuple):
    """matches: doc_id, previous_id, current_id, method, confidence, reusable; counts: a row a document."""

    matches: DataFrame
    counts: DataFrame


def normal(text: str) -> str:
    return " ".join(text.casefold().split())[:COMPARED]


def similarity(a: str, b: str) -> int:
    """Matching ratio of two normal texts in millionths; 0 where it cannot reach SIMILAR, by their lengths or letters."""
    if not a and not b:
        return CERTAIN
    both, least = len(a) + len(b), (SIMILAR - 0.5) / CERTAIN
    if 2 * min(len(a), len(b)) < least * both or 2 * (Counter(a) & Counter(b)).total() < least * both:
        return 0
    return round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() * CERTAIN)


@F.pandas_udf(IntegerType())
def similarity_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([similarity(normal(x), normal(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def left_of(blocks: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Blocks of one side that have no pair yet."""
    return blocks.join(matches.select("doc_id", F.col(side).alias("block_id")), ["doc_id", "block_id"], "left_anti")


def candidates(previous: DataFrame, current: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs by a key that occurs once on either side, with both parents; and the current blocks whose key occurs before."""
    sides = []
    for blocks, name in ((previous, "previous"), (current, "current")):
        keyed = blocks.withColumn("__key", key).where("__key is not null and doc_id is not null and block_id is not null")
        sides.append((keyed, keyed.groupBy("doc_id", "__key").agg(F.count("*").alias(f"n_{name}"), F.first("block_id").alias(f"{name}_id"), F.first("parent_id").alias(f"{name}_parent"))))
    both = sides[0][1].join(sides[1][1], ["doc_id", "__key"])
    pairs = both.where("n_previous = 1 and n_current = 1").select(*KEYS, "previous_parent", "current_parent")
    seen = sides[1][0].join(sides[0][1], ["doc_id", "__key"], "left_semi").select("doc_id", "block_id")
    return pairs, seen


def accepted(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs whose parents are both none or a pair, round by round down the tree."""
    out: list[DataFrame] = []
    newest = matches
    while True:
        parents = newest.select("doc_id", F.col("previous_id").alias("previous_parent"), F.col("current_id").alias("current_parent"))
        below = pairs.join(parents, ["doc_id", "previous_parent", "current_parent"], "left_semi").select(KEYS)
        if not out:
            below = below.unionByName(pairs.where("previous_parent is null and current_parent is null").select(KEYS))
        newest = staged(below, "reconcile-round")
        out.append(newest)
        if newest.isEmpty():
            return reduce(DataFrame.unionByName, out)


def similar(previous: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """Compared pairs (KEYS, po, co, score): texts of one kind within NEAR places, with compatible parents.

    Places are dealt to bands of NEAR + 1, so that pairs meet in an equi join of neighbouring bands."""
    band, known = F.floor(F.col("ordinal") / (NEAR + 1)), "text is not null and doc_id is not null and block_id is not null"
    mapped = matches.select("doc_id", F.col("current_id").alias("parent_id"), F.col("previous_id").alias("mapped"))
    at = lambda parent: F.when(F.col("parent_id").isNull(), F.struct(F.lit(True), F.lit(""))).otherwise(F.struct(F.lit(False), parent.cast("string")))
    p = previous.where(known).select("doc_id", "kind", at(F.col("parent_id")).alias("at"), band.alias("band"), F.col("ordinal").alias("po"), F.col("block_id").alias("previous_id"), F.col("text").alias("pt"))
    c = current.where(known).join(mapped, ["doc_id", "parent_id"], "left").where("parent_id is null or mapped is not null")
    c = c.select("doc_id", "kind", at(F.col("mapped")).alias("at"), F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("ordinal").alias("co"), F.col("block_id").alias("current_id"), F.col("text").alias("ct"))
    pairs = p.join(c, ["doc_id", "kind", "at", "band"]).where(F.abs(F.col("po") - F.col("co")) <= NEAR)
    return pairs.select(*KEYS, "po", "co", similarity_column("pt", "ct").alias("score"))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs similar enough that are best for both blocks, by a margin over the next one that is similar enough."""
    good = pairs.where(F.col("score") >= SIMILAR)
    for side, other in (("previous_id", "co"), ("current_id", "po")):
        w = W.partitionBy("doc_id", side).orderBy(F.desc("score"), other)
        good = good.withColumns({f"r_{side}": F.row_number().over(w), f"n_{side}": F.coalesce(F.lead("score").over(w), F.lit(-MARGIN))})
    sure = F.col("score") - F.greatest("n_previous_id", "n_current_id") >= MARGIN
    return good.where((F.col("r_previous_id") == 1) & (F.col("r_current_id") == 1) & sure)


def reconcile(previous: DataFrame, current: DataFrame) -> Reconciled:
    """All phases; see the module."""
    skinny = ["doc_id", "block_id", "native_id", "kind", "parent_id", "ordinal", "hash", "asset_id", "structured_hash"]
    once = F.count("*").over(W.partitionBy("doc_id", "block_id")) == 1
    p, every = (staged(x.select(*skinny, "text", once.alias("once")), "reconcile-blocks") for x in (previous, current))
    p, c = p.where("once"), every.where("once")
    phases = [
        ("native_id", F.when(F.col("native_id").isNotNull(), F.struct("native_id", "kind"))),
        ("exact", F.when(F.col("hash").isNotNull(), F.struct("kind", "hash"))),
        ("asset_or_table", F.coalesce(F.when(F.col("asset_id").isNotNull(), F.struct(F.col("kind"), F.col("asset_id").alias("x"))), F.when((F.col("kind") == "table") & F.col("structured_hash").isNotNull(), F.struct(F.col("kind"), F.col("structured_hash").alias("x"))))),
    ]
    told = p.sparkSession.createDataFrame([], f"doc_id {p.schema['doc_id'].dataType.simpleString()}, previous_id {p.schema['block_id'].dataType.simpleString()}, current_id {c.schema['block_id'].dataType.simpleString()}, method string, confidence int")
    seen: list[DataFrame] = []

    def take(new: DataFrame, method: str, confidence: Column) -> DataFrame:
        """All pairs so far, as one table."""
        return staged(told.unionByName(new.select(*KEYS, F.lit(method).alias("method"), confidence.cast("int").alias("confidence"))), "reconcile-matches")

    for method, key in phases:
        pairs, met = candidates(left_of(p.select(skinny), told, "previous_id"), left_of(c.select(skinny), told, "current_id"), key)
        seen.append(met)
        told = take(pairs if method == "native_id" else accepted(staged(pairs, "reconcile-pairs"), told), method, F.lit(CERTAIN))
    compared = staged(similar(left_of(p, told, "previous_id"), left_of(c, told, "current_id"), told), "reconcile-compared")
    seen.append(compared.select("doc_id", F.col("current_id").alias("block_id")))
    told = take(mutual_best(compared), "similarity", F.col("score"))

    # In sequence: under the parent that a block's parent was, and unique there; what has no known parent counts as at the top.
    mapped = told.select("doc_id", F.col("current_id").alias("parent_id"), F.col("previous_id").alias("under"))
    sides = [left_of(p.select(skinny), told, "previous_id").withColumn("under", F.col("parent_id")), left_of(c.select(skinny), told, "current_id").join(mapped, ["doc_id", "parent_id"], "left")]
    pairs, met = candidates(*sides, F.when(F.col("hash").isNotNull(), F.struct("under", "kind", "hash")))
    seen.append(met)
    places = [x.select("doc_id", F.col("block_id").alias(f"{n}_id"), F.col("ordinal").alias(o)) for x, n, o in ((p, "previous", "po"), (c, "current", "co"))]
    near = pairs.join(places[0], ["doc_id", "previous_id"]).join(places[1], ["doc_id", "current_id"]).where(F.abs(F.col("po") - F.col("co")) <= SEQUENCE)
    near = staged(near, "reconcile-near")
    top = near.where("previous_parent is null and current_parent is null").select(KEYS)
    parents = told.select("doc_id", F.col("previous_id").alias("previous_parent"), F.col("current_id").alias("current_parent"))
    told = take(top.unionByName(near.join(parents, ["doc_id", "previous_parent", "current_parent"], "left_semi").select(KEYS)), "sequence", F.lit(CERTAIN))

    hashes = [x.select("doc_id", F.col("block_id").alias(f"{n}_id"), F.col("hash").alias(f"{n}_hash")) for x, n in ((p, "previous"), (c, "current"))]
    all_told = told.join(hashes[0], ["doc_id", "previous_id"]).join(hashes[1], ["doc_id", "current_id"])
    out = staged(all_told.select(*KEYS, "method", "confidence", F.col("previous_hash").eqNullSafe(F.col("current_hash")).alias("reusable")), "reconcile-matches")
    return Reconciled(out, totals(out, every, reduce(DataFrame.unionByName, seen), compared))


def totals(matches: DataFrame, current: DataFrame, seen: DataFrame, compared: DataFrame) -> DataFrame:
    """doc_id, matched, reusable, new, ambiguous (had candidates, found none), comparisons of each current document."""
    of = lambda df, *aggs: df.groupBy("doc_id").agg(*aggs)
    lost = seen.distinct().join(matches.select("doc_id", F.col("current_id").alias("block_id")), ["doc_id", "block_id"], "left_anti")
    rows = of(current.where("doc_id is not null"), F.count("*").alias("n"))
    for part in (of(matches, F.count("*").alias("matched"), F.count_if("reusable").alias("reusable")), of(lost, F.count("*").alias("ambiguous")), of(compared, F.count("*").alias("comparisons"))):
        rows = rows.join(part, "doc_id", "left")
    number = {c: F.coalesce(c, F.lit(0)) for c in ("matched", "reusable", "ambiguous", "comparisons")}
    return rows.withColumns(number).select("doc_id", "matched", "reusable", (F.col("n") - F.col("matched")).alias("new"), "ambiguous", "comparisons")
