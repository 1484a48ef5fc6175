"""Searches with scopes and filters, many at once.

Requests are rows: query_id, document_id, version_id, history, kind, trust_zone, page, slide, max_hits, skip; a null filter
lets everything pass.  Which versions a request reaches is one of five scopes: one version, a document's head, a
document's history, all heads, all that is ready.  The last two are shared by all requests that name them, so scopes
are told by key and no request is multiplied with the corpus.  Hits meet their blocks and requests in equi joins;
filters are plain predicates of the joined row.

Tables: representations (document_id, version_id, representation_id, state), heads (the first three), blocks (entry,
the first three, ordinal, kind, trust_zone, page, slide), hits (query_id, entry, rank).

Defined results: requests that break a rule are refused with the rule's name and find nothing; a scope without ready
versions is ``scope_missing``; equal ranks are ordered by document (as text) and ordinal; a request without hits has
an answer with none available; hits of unknown blocks or of unready versions do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits and words that results must agree on.
LEAST_HITS, MOST_HITS = 1, 100
ZONES = ["external_untrusted", "internal_untrusted", "internal_trusted"]
# End of fixed values.

SCOPE = ["document_id", "version_id", "representation_id"]
#: Requests that are broadcast; beyond, the join shuffles.
BROADCAST_REQUESTS = 100_000


def refusal(zones: list[str] | None = None) -> Column:
    """The first rule that a request breaks; null if none."""
    return (
        F.when(F.col("version_id").isNotNull() & F.col("document_id").isNull(), "version_without_document").when(~F.col("trust_zone").isin(zones or ZONES), "trust_zone")
        .when((F.col("page") < 0) | (F.col("slide") < 0), "negative_place").when(~F.col("max_hits").between(LEAST_HITS, MOST_HITS) | (F.col("skip") < 0), "limit")
    )


def scope_key() -> Column:
    """Which versions a request reaches, as text; equal keys reach the same."""
    doc = F.col("document_id").cast("string")
    history = F.coalesce("history", F.lit(False))
    return (
        F.when(F.col("version_id").isNotNull(), F.concat_ws("|", F.lit("version"), doc, "version_id")).when(doc.isNotNull() & ~history, F.concat_ws("|", F.lit("head"), doc))
        .when(doc.isNotNull(), F.concat_ws("|", F.lit("history"), doc)).when(~history, "heads").otherwise("ready")
    )


def ready_scopes(representations: DataFrame, heads: DataFrame) -> DataFrame:
    """document_id, version_id, representation_id, head of all that is ready."""
    at_head = heads.select(*SCOPE, F.lit(True).alias("head")).distinct()
    return representations.where("state = 'READY'").select(*SCOPE).distinct().join(at_head, SCOPE, "left").withColumn("head", F.coalesce("head", F.lit(False)))


def resolved(requests: DataFrame, representations: DataFrame, heads: DataFrame) -> DataFrame:
    """key, document_id, version_id, representation_id: what each key that a request names reaches."""
    named = requests.where(refusal().isNull()).select(scope_key().alias("key")).distinct()
    doc, ready = F.col("document_id").cast("string"), ready_scopes(representations, heads)
    keys = F.array_compact(F.array(F.concat_ws("|", F.lit("version"), doc, "version_id"), F.when(F.col("head"), F.concat_ws("|", F.lit("head"), doc)), F.concat_ws("|", F.lit("history"), doc), F.when(F.col("head"), F.lit("heads")), F.lit("ready")))
    return ready.withColumn("key", F.explode(keys)).join(named, "key", "left_semi").select("key", *SCOPE)


def search(requests: DataFrame, hits: DataFrame, blocks: DataFrame, representations: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, page): query_id, status, available, returned, truncated of each request; and its hits with place."""
    judged = requests.withColumns({"refused": refusal(), "key": scope_key()})
    n = judged.limit(BROADCAST_REQUESTS + 1).count()
    sound = judged.where("refused is null").drop("refused")
    asked = sound.select("query_id", *(F.col(c).alias(f"q_{c}") for c in ("document_id", "version_id", "history", "kind", "trust_zone", "page", "slide", "max_hits", "skip")))
    placed = hits.join(F.broadcast(asked) if n <= BROADCAST_REQUESTS else asked, "query_id").join(blocks, "entry").join(ready_scopes(representations, heads), SCOPE)
    open_or = lambda c: F.col(f"q_{c}").isNull() | (F.col(f"q_{c}") == F.col(c))
    past = F.coalesce("q_history", F.lit(False)) | F.col("q_version_id").isNotNull()
    met = placed.where(past | F.col("head"))
    for c in ("document_id", "version_id", "kind", "trust_zone", "page", "slide"):
        met = met.where(open_or(c))
    order = W.partitionBy("query_id").orderBy("rank", F.col("document_id").cast("string"), "ordinal", "entry")
    told = met.withColumns({"place": F.row_number().over(order).cast("long"), "available": F.count("*").over(W.partitionBy("query_id"))})
    page = told.where((F.col("place") > F.col("q_skip")) & (F.col("place") <= F.col("q_skip") + F.col("q_max_hits")))
    counts = told.groupBy("query_id").agg(F.first("available").alias("available"), F.count_if((F.col("place") > F.col("q_skip")) & (F.col("place") <= F.col("q_skip") + F.col("q_max_hits"))).alias("returned"))
    reached = resolved(requests, representations, heads).select("key").distinct().withColumn("reached", F.lit(True))
    whole = judged.select("query_id", "refused", "key", "skip").join(counts, "query_id", "left").join(reached, "key", "left")
    status = F.coalesce("refused", F.when(F.col("reached").isNull(), "scope_missing").otherwise("answered"))
    available, returned = F.coalesce("available", F.lit(0)), F.coalesce("returned", F.lit(0))
    answers = whole.select("query_id", status.alias("status"), available.alias("available"), returned.alias("returned"), (available > returned).alias("truncated"))
    return answers, page.select("query_id", "place", "entry", "document_id", "version_id", "ordinal", "rank")
