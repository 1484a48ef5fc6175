"""Queries of searches with scopes and filters: benchmark texts over turns of conversations that have two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compile as C
from ..operators import scopes as S
from .compile_queries import told, words_of
from .registry import query, table

# Every third turn belongs to an older version; every fifth conversation still has it as its head, and in every eleventh it is not ready.
BLOCK = """conv_id * 1000000 + turn AS entry, conv_id AS document_id, CASE WHEN turn % 3 = 0 THEN 'v0' ELSE 'v1' END AS version_id, 'r' AS representation_id, turn AS ordinal, role AS kind,
 CASE WHEN conv_id % 4 = 0 THEN 'external_untrusted' ELSE 'internal_trusted' END AS trust_zone, CAST(floor(turn / 3) AS BIGINT) AS page, CAST(CASE WHEN turn % 2 = 0 THEN turn END AS BIGINT) AS slide"""
# A sixth of the requests each: all heads, all that is ready, a head, a history, a version, filters; some break a rule.
REQUEST = """item_id AS query_id, CASE WHEN item_id % 6 IN (2, 3, 4) THEN item_id % 40 END AS document_id, CASE WHEN item_id % 6 = 4 OR item_id % 29 = 1 THEN 'v0' END AS version_id, item_id % 6 IN (1, 3) AS history,
 CASE WHEN item_id % 6 = 5 THEN 'user' END AS kind, CASE WHEN item_id % 37 = 3 THEN 'elsewhere' WHEN item_id % 6 = 5 THEN 'internal_trusted' END AS trust_zone, CAST(CASE WHEN item_id % 12 = 5 THEN 1 END AS BIGINT) AS page,
 CAST(NULL AS BIGINT) AS slide, CASE WHEN item_id % 31 = 9 THEN 0 ELSE 1 + item_id % 7 END AS max_hits, item_id % 3 AS skip"""

SQL = f"""WITH c AS (SELECT {BLOCK}, text FROM conversations WHERE text IS NOT NULL), q AS (SELECT {REQUEST} FROM benchmark),
 rep AS (SELECT DISTINCT document_id, version_id FROM c WHERE NOT (document_id % 11 = 7 AND version_id = 'v0')), head AS (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'v0' ELSE 'v1' END AS version_id FROM (SELECT DISTINCT document_id FROM c)),
 s AS (SELECT *, (document_id, version_id) IN (FROM head) AS at_head FROM rep),
 rq AS (SELECT *, CASE WHEN version_id IS NOT NULL AND document_id IS NULL THEN 'version_without_document' WHEN trust_zone NOT IN ('external_untrusted', 'internal_untrusted', 'internal_trusted') THEN 'trust_zone' WHEN max_hits < 1 THEN 'limit' END AS refused FROM q),
 qt AS (SELECT DISTINCT item_id AS query_id, unnest({words_of('text')}) AS item FROM benchmark),
 h AS (SELECT query_id, entry, -(count(DISTINCT item) * 1000 + count(*)) AS rank FROM (SELECT entry, unnest({words_of('text')}) AS item FROM c) JOIN qt USING (item) GROUP BY 1, 2),
 m AS (SELECT h.query_id, h.entry, h.rank, c.document_id, c.version_id, c.ordinal, max_hits, skip FROM h JOIN rq ON rq.query_id = h.query_id AND refused IS NULL JOIN c USING (entry) JOIN s ON s.document_id = c.document_id AND s.version_id = c.version_id
 WHERE (at_head OR history OR rq.version_id IS NOT NULL) AND (rq.document_id IS NULL OR rq.document_id = c.document_id) AND (rq.version_id IS NULL OR rq.version_id = c.version_id) AND (rq.kind IS NULL OR rq.kind = c.kind) AND (rq.trust_zone IS NULL OR rq.trust_zone = c.trust_zone) AND (rq.page IS NULL OR rq.page = c.page)),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, document_id::VARCHAR, ordinal, entry) AS place FROM m)"""


def parts(spark, d):
    c = table(spark, d, "conversations").where("text is not null").selectExpr(*_split(BLOCK), "text")
    b = table(spark, d, "benchmark")
    terms = b.select(F.col("item_id").alias("query_id"), F.explode(told(F.col("text"))).alias("item")).distinct()
    found = C.lexical(c.select("entry", told(F.col("text")).alias("words")), terms, ["entry"])
    hits = found.select("query_id", "entry", (-(F.col("coverage") * 1000 + F.col("occurrences"))).alias("rank"))
    state = F.when((F.col("document_id") % 11 == 7) & (F.col("version_id") == "v0"), "FAILED").otherwise("READY")
    versions = c.select(*S.SCOPE, state.alias("state")).distinct()
    heads = c.select("document_id", F.when(F.col("document_id") % 5 == 0, "v0").otherwise("v1").alias("version_id"), F.lit("r").alias("representation_id")).distinct()
    return b.selectExpr(*_split(REQUEST)), hits, c.drop("text"), versions, heads


def _split(columns: str) -> list[str]:
    """Column expressions at the commas that no bracket holds."""
    out, depth, now = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


@query("f02_filtered_pages", f"{SQL} SELECT query_id, place, entry, document_id, version_id, rank FROM p WHERE place > skip AND place <= skip + max_hits")
def f02(spark, d):
    """The page of hits that each request asks for, under its scope and filters."""
    return S.search(*parts(spark, d))[1].select("query_id", "place", "entry", "document_id", "version_id", "rank")


@query("f01_search_answers", f"""{SQL}, n AS (SELECT query_id, count(*) AS available, count(*) FILTER (WHERE place > skip AND place <= skip + max_hits) AS returned FROM p GROUP BY 1),
 a AS (SELECT query_id, refused, coalesce(available, 0) AS available, coalesce(returned, 0) AS returned, CASE WHEN rq.version_id IS NOT NULL THEN EXISTS (SELECT 1 FROM s WHERE s.document_id = rq.document_id AND s.version_id = rq.version_id)
 WHEN document_id IS NOT NULL AND NOT history THEN EXISTS (SELECT 1 FROM s WHERE s.document_id = rq.document_id AND at_head) WHEN document_id IS NOT NULL THEN EXISTS (SELECT 1 FROM s WHERE s.document_id = rq.document_id) WHEN NOT history THEN EXISTS (SELECT 1 FROM s WHERE at_head) ELSE EXISTS (SELECT 1 FROM s) END AS reached FROM rq LEFT JOIN n USING (query_id))
 SELECT query_id, coalesce(refused, CASE WHEN reached THEN 'answered' ELSE 'scope_missing' END) AS status, available, returned, available > returned AS truncated FROM a""")
def f01_answers(spark, d):
    """How each request was answered: refused, without scope, or with so many hits of so many."""
    return S.search(*parts(spark, d))[0]


@query("f03_search_scopes", f"""{SQL}, k AS (SELECT DISTINCT CASE WHEN version_id IS NOT NULL THEN 'version|' || document_id || '|' || version_id WHEN document_id IS NOT NULL AND NOT history THEN 'head|' || document_id WHEN document_id IS NOT NULL THEN 'history|' || document_id WHEN NOT history THEN 'heads' ELSE 'ready' END AS key FROM rq WHERE refused IS NULL)
 SELECT key, document_id, version_id FROM s JOIN k ON key = 'ready' OR (key = 'heads' AND at_head) OR key = 'history|' || document_id OR (key = 'head|' || document_id AND at_head) OR key = 'version|' || document_id || '|' || version_id""")
def f03_scopes(spark, d):
    """The versions that each scope reaches, for all five kinds of scope."""
    requests, _, _, versions, heads = parts(spark, d)
    return S.resolved(requests, versions, heads).select("key", "document_id", "version_id")


