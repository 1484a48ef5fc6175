"""Evidence selection: rank, dedup, quota, fair turns, classes and budgets, all by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits and orders that results must agree on.
QUOTA, PREFIX = 16, 4
SEMANTIC_QUOTA, SEMANTIC_TOP, SEMANTIC_FLOOR = 32, 128, 800_000
RELEVANCE_FLOOR = 250_000
SENSITIVITY = ["public", "internal", "confidential", "restricted", "unknown"]
# End of fixed values.


#: What each key of the order is of.
KEYS = ["high_value", "tier", "semantic", "occurrences", "relevance", "matched_weight", "matched_signals", "doc_id", "version_id", "representation_id", "source_order", "representation", "evidence_id"]


def rank_order() -> list[Column]:
    """Total order of candidates: value and tier, then what they match, then where they come from (ids as text)."""
    first = [~F.col("high_value"), F.col("tier"), F.coalesce("semantic", "coverage").desc()]
    matched = [F.desc(c) for c in ("occurrences", "relevance", "matched_weight", "matched_signals")]
    return [*first, *matched, F.col("doc_id").cast("string"), *map(F.col, ("version_id", "representation_id", "source_order", "representation", "evidence_id"))]


def short_order() -> list[Column]:
    """The order without relevance: ten keys of the thirteen."""
    named = ("relevance", "matched_weight", "matched_signals")
    return [c for c, name in zip(rank_order(), KEYS, strict=True) if name not in named]


def fixed_order() -> list[Column]:
    """The order without what a query changes."""
    return [c for c, name in zip(rank_order(), KEYS, strict=True) if name != "semantic"]


def best_copies(offered: DataFrame) -> DataFrame:
    """Of all candidates of one body those that can rank first for a query, with the coverages ``least`` to ``most`` for
    which they do: copies have one coverage, so the best with ``semantic`` and the best without are all.

    Needs ids that are there once; candidates without body all stay."""
    falling = [F.struct(F.col(c).isNull(), -F.col(c)) for c in ("occurrences", "relevance", "matched_weight", "matched_signals")]
    grade = F.struct((~F.col("high_value")).alias("low"), F.col("tier").alias("tier"))
    rest = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*falling, F.col("doc_id").cast("string"), *map(F.col, KEYS[8:])])])
    own, forever = F.col("semantic").isNull(), F.lit((1 << 62) - 1)
    best = offered.where("body_id is not null").groupBy("body_id").agg(
        F.min(F.when(own, F.struct(grade.alias("grade"), rest.alias("rest"), "doc_id"))).alias("p"),
        F.min(F.when(~own, F.struct(grade.alias("grade"), (-F.col("semantic").cast("long")).alias("minus"), rest.alias("rest"), "doc_id"))).alias("s"),
    )
    # the one with semantic is first up to this coverage
    until = F.when(F.col("s").isNull(), -1).when(F.col("p").isNull(), forever)
    until = until.when(F.col("p.grade") < F.col("s.grade"), -1).when(F.col("s.grade") < F.col("p.grade"), forever)
    until = until.otherwise(-F.col("s.minus") - F.when(F.col("s.rest") < F.col("p.rest"), 0).otherwise(1)).cast("long")
    both = best.withColumn("until", until).select(F.explode(F.array(
        F.struct(F.col("p.doc_id").alias("of"), (F.greatest("until", F.lit(0)) + F.when(F.col("until") < 0, 0).otherwise(1)).alias("least"), forever.alias("most")),
        F.struct(F.col("s.doc_id").alias("of"), F.lit(0).cast("long").alias("least"), F.col("until").alias("most")),
    )).alias("x")).select("x.*").where("of is not null and least <= most")
    alone = offered.where("body_id is null").select(F.col("doc_id").alias("of"), F.lit(0).cast("long").alias("least"), forever.alias("most"))
    found = both.unionByName(alone)
    return offered.join(found, offered["doc_id"] == found["of"]).drop("of")


def ranked(candidates: DataFrame, order: list[Column] | None = None) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*(order or rank_order()))).cast("long"))


def distinct_bodies(r: DataFrame) -> DataFrame:
    """Best-ranked of each body; candidates without body all stay."""
    nth = F.row_number().over(W.partitionBy("query_id", "body_id").orderBy("rank"))
    return r.withColumn("nth", F.when(F.col("body_id").isNull(), 1).otherwise(nth))


def within_quota(r: DataFrame, quota: int = QUOTA, source: str = "source") -> DataFrame:
    nth = F.row_number().over(W.partitionBy("query_id", source).orderBy("rank"))
    return r.withColumn("nth_of_source", nth).where(F.col("nth_of_source") <= quota).drop("nth_of_source")


def fair_turns(r: DataFrame, prefix: int = PREFIX, source: str = "source") -> DataFrame:
    """The best few as they rank; then, tier by tier, sources take turns, ordered by their best left."""
    at = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    r = r.withColumn("at", at).withColumn("late", F.col("at") > prefix)
    own = W.partitionBy("query_id", "late", "tier", source)
    r = r.withColumn("turn", F.row_number().over(own.orderBy("rank"))).withColumn("best", F.min("rank").over(own))
    lead = [F.col("late"), F.when(~F.col("late"), F.col("rank")), F.col("tier"), F.col("turn"), F.col("best")]
    return r.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*lead)).cast("long")).drop("at", "late", "turn", "best")


def allocate(candidates: DataFrame, quota: int = QUOTA, prefix: int = PREFIX) -> DataFrame:
    """rank, place (null if refused) and reason of every candidate."""
    r = distinct_bodies(ranked(candidates))
    first = r.where("nth = 1")
    nth = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))
    told = first.withColumn("n_source", nth)
    kept = fair_turns(told.where(F.col("n_source") <= quota), prefix).withColumn("reason", F.lit("selected"))
    over = told.where(F.col("n_source") > quota).withColumn("place", F.lit(None).cast("long")).withColumn("reason", F.lit("source_quota"))
    twice = r.where("nth > 1").withColumn("n_source", F.lit(None).cast("int")).withColumn("place", F.lit(None).cast("long")).withColumn("reason", F.lit("duplicate_body"))
    cols = [*candidates.columns, "rank", "place", "reason"]
    return kept.select(cols).unionByName(over.select(cols)).unionByName(twice.select(cols))


def classify(candidates: DataFrame, allowed_zones: list[str], most_sensitive: str, floor: int = RELEVANCE_FLOOR) -> DataFrame:
    """reason: the first rule that refuses a candidate; null if none does.  Unknown is the most sensitive."""
    level = F.array_position(F.array(*[F.lit(s) for s in SENSITIVITY]), F.col("sensitivity"))
    nth = F.row_number().over(W.partitionBy("query_id", "doc_id", "evidence_id").orderBy("source_order", "ordinal"))
    reason = (
        F.when(~F.col("current"), "stale").when(~F.col("trust_zone").isin(allowed_zones), "trust_zone")
        .when(level > SENSITIVITY.index(most_sensitive) + 1, "sensitivity").when(F.col("nth") > 1, "duplicate").when(F.col("relevance") < floor, "relevance")
    )
    return candidates.withColumn("nth", nth).withColumn("reason", reason).drop("nth")


def pack(ordered: DataFrame, ceiling: int, size: str = "size", keys: str = "query_id") -> DataFrame:
    """Takes each query's items in order while they fit; what is too large is passed over, and later ones still count.

    The lists are bounded by the candidate limit of a query."""
    items = F.array_sort(F.collect_list(F.struct("place", F.col(size).cast("long").alias("size"), "evidence_id")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:bigint,size:bigint,evidence_id:bigint,used:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["size"]
        took = F.struct(used.alias("used"), F.concat(acc["taken"], F.array(F.struct(x["place"].alias("place"), x["size"].alias("size"), x["evidence_id"].alias("evidence_id"), used.alias("used")))).alias("taken"))
        return F.when(used <= ceiling, took).otherwise(acc)

    packed = ordered.groupBy(keys).agg(F.aggregate(items, start, step)["taken"].alias("taken"))
    return packed.select(keys, F.explode("taken").alias("t")).select(keys, "t.place", "t.size", "t.evidence_id", "t.used")


def hybrid(lexical: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """Lexical candidates, and semantic ones that are not among them, in a tier after theirs."""
    return lexical.withColumn("tier", F.lit(0)).unionByName(semantic.join(lexical.select(*keys), keys, "left_anti").withColumn("tier", F.lit(1)))


def abstains(classified: DataFrame) -> DataFrame:
    """Queries that select nothing, and for no other reason than relevance."""
    return classified.groupBy("query_id").agg((F.count_if(F.col("reason").isNull()) == 0).alias("none"), (F.count_if(F.col("reason") != "relevance") == 0).alias("only")).select("query_id", (F.col("none") & F.col("only")).alias("abstains"))
