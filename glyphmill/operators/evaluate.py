"""Retrieval quality and timing metrics.  Ratios are kept as whole numerators and denominators until printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def ratio(n: Column, d: Column, empty: float = 0.0) -> Column:
    """n / d at six decimals, half to even; ``empty`` where d is 0."""
    exact = F.bround(n.cast("decimal(38,12)") / d.cast("decimal(38,12)"), 6).cast("double")
    return F.when(d == 0, F.lit(empty)).otherwise(exact)


def ranked_scores(selected: DataFrame, expected: DataFrame, by: str = "query_id", item: str = "item") -> DataFrame:
    """precision, recall and reciprocal rank of each query.  selected: by, item, rank; expected: by, item."""
    e = expected.select(by, item).distinct().withColumn("wanted", F.lit(1))
    hits = selected.join(e, [by, item], "left").groupBy(by).agg(F.count_distinct(item).alias("n"), F.count_distinct(F.when(F.col("wanted") == 1, F.col(item))).alias("hits"), F.min(F.when(F.col("wanted") == 1, F.col("rank"))).alias("first"))
    wants = e.groupBy(by).agg(F.count("*").alias("m"))
    j = wants.join(hits, by, "left").na.fill(0, ["n", "hits"])
    return j.select(by, ratio(F.col("hits"), F.col("n")).alias("precision"), ratio(F.col("hits"), F.col("m")).alias("recall"), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("reciprocal_rank"))


def sliced(judged: DataFrame, slices: list[tuple[str, ...]]) -> DataFrame:
    """Metrics over grouping sets.  judged: a row a query, with hits, n, wanted, full and citation flags."""
    names = sorted({c for s in slices for c in s})
    sums = [F.count("*").alias("queries"), *(F.sum(c).alias(c) for c in ("hits", "n", "wanted", "full_support"))]
    out = judged.groupingSets([[F.col(c) for c in s] for s in slices], *names).agg(*sums)
    return out.select(*names, "queries", ratio(F.col("hits"), F.col("n")).alias("precision"), ratio(F.col("hits"), F.col("wanted")).alias("recall"), ratio(F.col("full_support"), F.col("queries")).alias("full_support"))


def anchor_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Share of anchors that are right at their place: case_id, place, anchor on both sides."""
    j = expected.join(actual.select("case_id", "place", F.col("anchor").alias("got")), ["case_id", "place"], "left")
    return j.groupBy("case_id").agg(ratio(F.count_if(F.col("anchor") == F.col("got")), F.count("*")).alias("anchor_coverage"))


def budget_coverage(items: DataFrame, maximum: int) -> DataFrame:
    """case_id, coverage and byte share; nothing counts over budget.  items: case_id, required, selected, bytes."""
    g = items.groupBy("case_id").agg(F.count_if("required").alias("r"), F.count_if(F.col("required") & F.col("selected")).alias("hit"), F.sum(F.when(F.col("selected"), F.col("bytes")).otherwise(0)).alias("used"), F.sum("bytes").alias("all"))
    fits = F.col("used") <= maximum
    return g.select("case_id", F.when(fits, ratio(F.col("hit"), F.col("r"), 1.0)).otherwise(0.0).alias("coverage"), F.when(fits, ratio(F.col("used"), F.col("all"))).otherwise(0.0).alias("byte_share"))


def nearest_rank(by: list[str], df: DataFrame, value: str) -> DataFrame:
    """Count, p50 and p95 by nearest rank, floor of the median, and the median distance from it."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").cast("long").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").cast("long").alias("p95"), F.median(value).alias("m"))
    med = stats.withColumn("median_floor", F.floor("m").cast("long"))
    away = df.join(med.select(*by, "median_floor"), by).withColumn("away", F.abs(F.col(value) - F.col("median_floor")))
    mad = away.groupBy(*by).agg(F.floor(F.median("away")).cast("long").alias("mad"))
    return med.drop("m").join(mad, by)


def bootstrap(df: DataFrame, by: str, value: str, key: str, resamples: int, seed: str) -> DataFrame:
    """Median, deviation and a 95 % percentile interval of the median of each group.

    Draw i of resample r takes the value at place (first 8 bytes of sha256 of ``seed:r:i``) modulo n of the group in
    order of (value, key).  Draws are rows: they are made where their value's place number is and meet it in a join,
    so a group is never in one task.  Medians keep a count of each distinct value."""
    placed = numbered(df.select(by, key, F.col(value).cast("double").alias("x")), ["x", key], [by], "place")
    stats = placed.groupBy(by).agg(F.median("x").alias("median"), F.count("*").alias("n"))
    away = placed.join(stats.select(by, "median"), by).groupBy(by).agg(F.median(F.abs(F.col("x") - F.col("median"))).alias("mad"))
    drawn = placed.join(stats.select(by, "n"), by).select(by, "n", "place", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("r").cast("string"), F.col("place").cast("string")), 256)
    at = F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.col("n")).cast("long")
    medians = drawn.select(by, "r", at.alias("place")).join(placed.select(by, "place", "x"), [by, "place"]).groupBy(by, "r").agg(F.median("x").alias("m"))
    edge = int(0.025 * (resamples - 1))
    ends = medians.groupBy(by).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(by, F.get("ms", F.lit(edge)).alias("low"), F.get("ms", F.lit(resamples - 1 - edge)).alias("high"))
    return stats.drop("n").join(away, by).join(ends, by).select(by, "median", "mad", "low", "high")


def utility(items: DataFrame, budget: int) -> DataFrame:
    """Atoms and sources that the first ``budget`` items cover, and the item that completes the atoms.

    items: case_id, rank, atoms (array), source; wanted: all atoms of the case."""
    atoms = items.select("case_id", "rank", F.explode("atoms").alias("atom"))
    first = atoms.groupBy("case_id", "atom").agg(F.min("rank").alias("first"))
    per_atom = first.groupBy("case_id").agg(F.count_if(F.col("first") <= budget).alias("atoms"), F.count("*").alias("all_atoms"), F.max("first").alias("items_to_completion"))
    sources = items.where(F.col("rank") <= budget).groupBy("case_id").agg(F.count_distinct("source").alias("sources"))
    return per_atom.join(sources, "case_id", "left").na.fill(0, ["sources"])


def break_even(facts: DataFrame) -> DataFrame:
    """Queries after which preparing pays: null if the raw way is as fast."""
    gain = F.col("raw_p50") - F.col("engine_p50")
    return facts.withColumn("break_even", F.when(gain > 0, F.greatest(F.lit(1), F.ceil(F.col("prepare_ns") / gain))).cast("long"))


def fair_order(cases: DataFrame, treatments: list[str], repetitions: int) -> DataFrame:
    """Every case with every treatment, repetition by repetition, treatments taking turns at going first."""
    spark = cases.sparkSession
    t = spark.createDataFrame(list(enumerate(treatments)), "t int, treatment string")
    r = spark.range(repetitions).withColumnRenamed("id", "repetition")
    # both are fixed small lists
    every = cases.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(r))
    turn = F.pmod(F.col("t") + F.col("repetition") + F.col("case_id"), F.lit(len(treatments)))
    return every.select("case_id", "repetition", "treatment", turn.alias("turn"))

