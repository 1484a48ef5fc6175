"""Inverted index as plain DataFrames: postings, statistics, BM25, coverage and the search orders over them.

Postings are aggregated by (term, unit) with partial aggregation before the one shuffle.  Scoring starts
from the query terms, which are few, so only their postings move; statistics are global over the index
and taken before any filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import index_fold, parts_of
from ..sources.scratch import staged
from . import sums

K1, B = 1.2, 0.75
#: Query terms that are broadcast; beyond, the join shuffles.
BROADCAST_TERMS = 100_000
#: Query terms that are told to the scan, which then reads only where they lie.
PUSHED_TERMS = 1_000
#: Letters by which prefixes meet terms.
HEAD = 4


def postings(units: DataFrame, keys: list[str], fields: dict[str, float] | None = None) -> DataFrame:
    """keys, term, tf (weighted over fields), hits (unweighted).  Every field is read and folded once.

    Weights are added up as decimals: as doubles, tf would depend on the order."""

    def marked(field: str, weight: float) -> Column:
        return F.transform(parts_of(index_fold(F.coalesce(F.col(field), F.lit("")))), lambda t: F.struct(t.alias("term"), F.lit(str(weight)).cast("decimal(9,6)").alias("w")))

    each = units.select(*keys, F.explode(F.concat(*(marked(c, w) for c, w in (fields or {"text": 1.0}).items()))).alias("x")).select(*keys, "x.term", "x.w")
    return each.groupBy(*keys, "term").agg(F.count("*").alias("hits"), F.sum("w").cast("double").alias("tf"))


def laid_out(posted: DataFrame) -> DataFrame:
    """Postings as they are stored: terms in ranges and in order, so that a reader of few terms skips the rest."""
    return posted.repartitionByRange("term").sortWithinPartitions("term")


def unit_lengths(units: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """``lengths`` straight from the units: one number a unit is shuffled, not its postings."""
    tokens = sum((F.size(parts_of(index_fold(F.coalesce(F.col(c), F.lit(""))))) for c in fields or ["text"]), F.lit(0)).cast("long")
    return units.select(*keys, tokens.alias("length")).where("length > 0").groupBy(*keys).agg(F.sum("length").alias("length"))


def lengths(posted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, length: tokens of the units that have any."""
    return posted.groupBy(*keys).agg(F.sum("hits").alias("length"))


def totals(length: DataFrame) -> DataFrame:
    """One row: n units, avgd."""
    return length.agg(F.count("*").alias("n"), F.avg("length").alias("avgd"))


def few(terms: DataFrame, n: int | None = None) -> DataFrame:
    """Broadcast of query terms of a checked number."""
    n = terms.limit(BROADCAST_TERMS + 1).count() if n is None else n
    return F.broadcast(terms) if n <= BROADCAST_TERMS else terms


def nearby(posted: DataFrame, whole: DataFrame, n: int) -> DataFrame:
    """Postings of the items of ``whole`` (query_id, item; n rows)."""
    items = [r["item"] for r in whole.select("item").distinct().limit(PUSHED_TERMS + 1).collect()]
    if 0 < len(items) <= PUSHED_TERMS:
        return posted.where(F.col("term").isin(items))
    return posted.join(few(whole.select(F.col("item").alias("term")).distinct(), n), "term", "left_semi")


def by_unit(near: DataFrame, keys: list[str]) -> DataFrame:
    """Postings dealt out by unit, before they meet queries: what follows by query and unit is shuffled no more.

    As many tasks as there are: each posting makes a row a query, which its size does not show."""
    return near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def matching(posted: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, item, keys, tf: a term's postings; those of a prefix are summed.  terms: query_id, item, prefix.

    A prefix meets terms on its first letters, HEAD at most, and then on the rest of it."""
    whole, beginnings = terms.where(~F.col("prefix")).select("query_id", "item").distinct(), terms.where("prefix")
    head = F.least(F.length("item"), F.lit(HEAD))
    heads = sorted(r[0] for r in beginnings.select(head).distinct().collect())
    n = whole.limit(BROADCAST_TERMS + 1).count()
    near = nearby(posted, whole, n)
    near = near if heads or n > BROADCAST_TERMS else by_unit(near, keys)
    found = [near.join(few(whole, n), F.col("term") == F.col("item")).select("query_id", "item", *keys, "tf")]
    if not heads:
        return found[0]  # a term has one posting a unit
    for size in heads:
        wanted = few(beginnings.where(head == size)).withColumn("head", F.substring("item", 1, size))
        meet = posted.withColumn("__head", F.substring("term", 1, size)).join(wanted, (F.col("__head") == F.col("head")) & F.col("term").startswith(F.col("item")))
        found.append(meet.select("query_id", "item", *keys, "tf"))
    return reduce(DataFrame.unionByName, found).groupBy("query_id", "item", *keys).agg(F.sum("tf").alias("tf"))


def phrase_hits(posted: DataFrame, units: DataFrame, phrases: DataFrame, keys: list[str], fields: dict[str, float] | None = None) -> DataFrame:
    """query_id, item, keys, tf of phrases (query_id, item, words, prefix): words side by side, the last as a prefix.

    Only units that hold all words are read; in them every place counts where the phrase begins."""
    fields = fields or {"text": 1.0}
    each = phrases.select("query_id", "item", F.size("words").alias("n"), "prefix", F.posexplode("words").alias("i", "word"))
    parts = each.select(F.struct("query_id", F.col("item").alias("phrase")).alias("query_id"), F.col("word").alias("item"), (F.col("prefix") & (F.col("i") == F.col("n") - 1)).alias("prefix")).distinct()
    both = conjunctive(matching(posted, parts, keys), parts, keys).select("query_id.query_id", F.col("query_id.phrase").alias("item"), *keys)

    @F.pandas_udf("array<double>")
    def places(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for words, prefix, *texts in batches:
            out = []
            for wanted, open_end, *own in zip(words, prefix, *texts, strict=True):
                wanted = list(wanted)
                last = str.startswith if open_end else str.__eq__
                out.append([float(sum(t[i : i + len(wanted) - 1] == wanted[:-1] and last(t[i + len(wanted) - 1], wanted[-1]) for i in range(len(t) - len(wanted) + 1))) for t in map(list, own)])
            yield pd.Series(out)

    read = both.join(units.select(*keys, *fields), keys).join(few(phrases.select("query_id", "item", "words", "prefix")), ["query_id", "item"])
    found = read.withColumn("at", places("words", "prefix", *(parts_of(index_fold(F.coalesce(F.col(c), F.lit("")))) for c in fields)))
    tf = sum((F.col("at")[i] * w for i, w in enumerate(fields.values())), F.lit(0.0))
    return found.select("query_id", "item", *keys, tf.alias("tf")).where("tf > 0")


def _gain() -> Column:
    """What an item adds to a unit's score.  Units that hold an item in half of all get the floor weight."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgd")))


def bm25(matched: DataFrame, length: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys, rank: smaller is better."""
    df = matched.groupBy("query_id", "item").agg(F.count("*").alias("df"))
    scored = matched.join(df, ["query_id", "item"]).join(length, keys).crossJoin(F.broadcast(totals(length)))  # totals: one row
    return scored.groupBy("query_id", *keys).agg((-F.sum(_gain())).alias("rank"))


def scored(posted: DataFrame, terms: DataFrame, length: DataFrame, keys: list[str], top: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """``bm25`` of whole words; see ``rated``."""
    whole = terms.select("query_id", "item").distinct()
    n = whole.limit(BROADCAST_TERMS + 1).count()
    return rated(nearby(posted, whole, n).withColumnRenamed("term", "item"), whole, length, keys, top, among)


def rated(found: DataFrame, asked: DataFrame, length: DataFrame, keys: list[str], top: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """query_id, keys, rank (smaller is better) of the postings ``found`` (item, keys, tf) for ``asked`` (query_id, item).

    A posting gets its gain once, however many queries ask for it; queries meet it in ``sums.added``.  ``top`` leaves the
    best of each query and a few more; ``among`` (keys) are the units to be had, which frequencies do not depend on."""
    numbers = sums.numbered(asked)
    near = found.join(few(numbers), "item").select("number", *keys, "tf")
    df = staged(near.groupBy("number").agg(F.count("*").alias("df")), "frequencies")
    held = near.join(length, keys)
    held = held if among is None else held.join(among, keys, "left_semi")
    gains = held.join(few(df), "number").crossJoin(F.broadcast(totals(length))).select(*keys, "number", _gain().alias("gain"))  # totals: one row
    total = sums.added(gains, asked, numbers, keys, top, df.agg(F.sum("df")).first()[0] or 0)
    return total.select("query_id", *keys, (-F.col("total")).alias("rank"))


def covered(found: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``coverage`` of the postings ``found`` (item, keys) for ``asked`` (query_id, item), without a row a query and posting."""
    numbers = sums.numbered(asked)
    near = found.join(few(numbers), "item").select(*keys, "number", F.lit(1.0).alias("gain"))
    return sums.added(near, asked, numbers, keys, postings=near.count()).select("query_id", *keys, F.col("total").cast("long").alias("coverage"))


def leading(found: DataFrame, asked: DataFrame, offered: DataFrame, order: list[Column], quota: int) -> DataFrame:
    """query_id, doc_id, coverage: what can be among the first ``quota`` of a source for a query.  ``offered`` has the units
    as ``sums.shortlist`` needs them; postings ``found`` (item, doc_id) are gathered by unit."""
    numbers = sums.numbered(asked)
    near = found.join(few(numbers), "item").select("doc_id", "number")
    held = staged(near.groupBy("doc_id").agg(F.collect_list("number").alias("items")), "held")
    size = held.agg(F.sum(F.size("items"))).first()[0] or 0
    return sums.shortlist(offered.join(held, "doc_id"), asked, numbers, order, quota, size)


def coverage(matched: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys, coverage: items that occur; ``matched`` has a row for each."""
    return matched.groupBy("query_id", *keys).agg(F.count("item").alias("coverage"))


def conjunctive(matched: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys of the units that hold all of a query's items."""
    wanted = terms.groupBy("query_id").agg(F.count_distinct("item").alias("wanted"))
    return coverage(matched, keys).join(wanted, "query_id").where("coverage = wanted").select("query_id", *keys)


def top(scored: DataFrame, order: list[Column | str], k: int, by: str = "query_id", offset: int = 0) -> DataFrame:
    """The k first of each query, with their place (from 1)."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return scored.withColumn("place", place.cast("long")).where((F.col("place") > offset) & (F.col("place") <= offset + k))


def diversify(ranked: DataFrame, k: int, most: int, source: str, by: str = "query_id") -> DataFrame:
    """k of each query in order of place: first up to ``most`` of a source, then those held back."""
    nth = F.row_number().over(W.partitionBy(by, source).orderBy("place"))
    turn = F.row_number().over(W.partitionBy(by).orderBy(F.col("nth") > most, "place"))
    chosen = ranked.withColumn("nth", nth).withColumn("turn", turn).where(F.col("turn") <= k)
    return chosen.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("place")).cast("long")).drop("nth", "turn")


def coverage_gaps(ready: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of units without index rows (missing) and index rows without units (orphaned)."""
    a = ready.select(*keys).distinct().withColumn("r", F.lit(1))
    b = indexed.select(*keys).distinct().withColumn("i", F.lit(1))
    return a.join(b, keys, "full").where("r is null or i is null").select(*keys, F.when(F.col("i").isNull(), "missing").otherwise("orphaned").alias("gap"))
