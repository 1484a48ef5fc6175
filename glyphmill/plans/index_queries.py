"""Queries of the segmented index, refreshed between versions of the corpus, of packages and of compact objects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compact
from ..operators.segments import SegmentIndex
from ..sources import bags
from ..sources.scratch import scratch_root
from .change_queries import V2, versions
from .registry import query, table

#: Bytes of objects to an archive, about.
BAG_BYTES = 64 << 20

# The second version refuses every 29th document; the third is the first again.
NOT_REFUSED = "doc_id % 29 <> 1"


def refreshed(spark, d):
    """An index after three refreshes, with the state after each."""
    index = SegmentIndex(spark, f"{scratch_root(spark)}/glyphmill-segments-{uuid.uuid4().hex}")
    old, new = versions(spark, d)
    steps = [old.withColumn("ok", F.lit(True)), new.withColumn("ok", F.expr(NOT_REFUSED)), old.withColumn("ok", F.lit(True))]
    return index, [index.refresh(docs, ok="ok") for docs in steps]


COUNTS = ["added", "updated", "removed", "failed", "unchanged", "indexed", "postings"]
TERMS = r"SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term"


def step(number: int, before: str, after: str, refused: str) -> str:
    """One refresh: what is in ``after`` (doc_id, text, ok) against what is indexed, ``before`` (doc_id, text)."""
    return f"""SELECT {number} AS state, count(*) FILTER (WHERE o = 'added') AS added, count(*) FILTER (WHERE o = 'updated') AS updated, count(*) FILTER (WHERE o = 'removed') AS removed, count(*) FILTER (WHERE o = 'failed') AS failed,
 count(*) FILTER (WHERE o = 'unchanged') AS unchanged, count(*) FILTER (WHERE o IN ('added', 'updated', 'unchanged')) AS indexed,
 (SELECT count(*) FROM (SELECT DISTINCT doc_id, term FROM ({TERMS} FROM {after} WHERE {refused} AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.doc_id = {after}.doc_id AND b.text = {after}.text)))) AS postings
 FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN NOT (a.{refused}) THEN 'failed' WHEN b.doc_id IS NULL THEN 'added' WHEN a.text = b.text THEN 'unchanged' ELSE 'updated' END AS o FROM {before} b FULL JOIN {after} a ON a.doc_id = b.doc_id)"""


@query("index_segments", f"WITH {V2}, none AS (SELECT doc_id, text FROM documents WHERE false), i2 AS (SELECT * FROM v2 WHERE {NOT_REFUSED}) {step(1, 'none', 'documents', 'doc_id IS NOT NULL')} UNION ALL {step(2, 'documents', 'v2', NOT_REFUSED)} UNION ALL {step(3, 'i2', 'documents', 'doc_id IS NOT NULL')}")
def index_segments(spark, d):
    """What each refresh found and wrote (K04): postings are those of changed documents only."""
    _, states = refreshed(spark, d)
    rows = [(i + 1, *(s["report"][c] for c in COUNTS)) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["state", *COUNTS]))


@query("x12_index_refresh", f"WITH t AS ({TERMS} FROM documents), p AS (SELECT doc_id, term, count(*) AS hits FROM t GROUP BY 1, 2) SELECT doc_id, CAST(sum(hits) AS BIGINT) AS tokens, count(*) AS terms, CAST(sum(hits * ('0x' || substr(md5(term), 1, 8))::BIGINT) AS BIGINT) AS digest FROM p GROUP BY 1")
def x12(spark, d):
    """The postings of every document after all refreshes, by count, sum and digest: those of an index built at once."""
    index, _ = refreshed(spark, d)
    weight = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    return index.postings().groupBy("doc_id").agg(F.sum("hits").alias("tokens"), F.count("*").alias("terms"), F.sum(F.col("hits") * weight).alias("digest"))


@query("k07_package", "SELECT DISTINCT 'sha256:' || sha256(text) AS object_id, CAST(strlen(text) AS BIGINT) AS length, true AS sound FROM documents WHERE text IS NOT NULL")
def k07(spark, d):
    """All texts as objects of a package, written, verified and read back."""
    root = f"{scratch_root(spark)}/glyphmill-package-{uuid.uuid4().hex}"
    path = root if "://" in root else f"file://{root}"
    objects = table(spark, d, "documents").select(F.col("text").cast("binary").alias("content"))
    total = objects.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    bags.export(objects, path, max(8, total // BAG_BYTES))
    read = bags.entries(spark, path).where("kind = 'payload' or fault is not null")
    return read.select(F.concat(F.lit("sha256:"), "sha256").alias("object_id"), "length", (F.col("fault").isNull() & (F.sha2("content", 256) == F.col("sha256"))).alias("sound"))


@query("k02_compact_objects", "SELECT doc_id, lang AS kind, CAST(strlen(text) AS BIGINT) AS raw_bytes, sha256(text) AS digest, true AS no_larger, CAST(NULL AS VARCHAR) AS fault FROM documents WHERE text IS NOT NULL")
def k02(spark, d):
    """Every text in its compact form and back: digests of what comes back, and whether the form is never larger."""
    objects = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("lang").alias("kind"), F.col("text").cast("binary").alias("content"))
    known = compact.dictionaries(objects)
    back = compact.restored(compact.compact(objects, known).withColumn("raw_bytes", F.octet_length("content").cast("long")).drop("content"), known)
    return back.select("doc_id", "kind", "raw_bytes", F.sha2("content", 256).alias("digest"), (F.octet_length("stored") <= F.col("raw_bytes")).alias("no_larger"), "fault")
