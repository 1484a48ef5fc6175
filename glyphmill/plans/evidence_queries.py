"""Queries of evidence records, geometry, validation and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import evidence as V
from .registry import query, table
from .text_queries import documents


@query("c17_page_region", "SELECT doc_id, least(1000000, CAST(round_even(n_chars * 1000000::DECIMAL(28,9) / 20000, 0) AS BIGINT)) AS a, least(1000000, CAST(round_even((n_chars + 9000) * 1000000::DECIMAL(28,9) / 20000, 0) AS BIGINT)) AS b, n_chars + 9000 > 20000 AS clamped FROM documents")
def c17(spark, d):
    n = F.col("n_chars")
    r = V.page_region(n, F.lit(0), n + 9000, F.lit(10), F.lit(20000), F.lit(100))
    return documents(spark, d).select("doc_id", r.alias("r")).select("doc_id", F.col("r.left").alias("a"), F.col("r.right").alias("b"), "r.clamped")


@query("c18_pixel_bounds", "SELECT doc_id, CAST(n_chars % 500000 * 640 // 1000000 AS BIGINT) AS x0, CAST(ceil((500000 + n_chars % 500000) * 640 / 1000000) AS BIGINT) AS x1 FROM documents")
def c18(spark, d):
    n = F.expr("n_chars % 500000")
    r = F.struct(n.alias("left"), F.lit(0).alias("top"), (n + 500000).alias("right"), F.lit(1000000).alias("bottom"))
    return documents(spark, d).select("doc_id", V.pixel_bounds(r, 640, 480).alias("p")).select("doc_id", "p.x0", "p.x1")


@query("c19_json_pointer", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props->>'$.k' END AS value FROM events")
def c19(spark, d):
    p = F.when(F.expr("event_id % 3 = 0"), "/missing").otherwise("/k")
    return table(spark, d, "events").select("event_id", V.pointer_column("props", p).alias("value"))


@query("f14_strict_json", "SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def f14(spark, d):
    bad = F.when(F.expr("event_id % 4 = 0"), F.col("props")).when(F.expr("event_id % 4 = 1"), '{"a":1,"a":2}').when(F.expr("event_id % 4 = 2"), '{"a":9007199254740993}').otherwise('{"a":NaN}')
    return table(spark, d, "events").select("event_id", V.strict_json_column(bad).alias("valid"))


@query("f15_portable_path", "SELECT doc_id, doc_id % 3 = 0 AS portable FROM documents")
def f15(spark, d):
    p = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("a/b-"), F.col("doc_id").cast("string"))).when(F.expr("doc_id % 3 = 1"), "a/../b").otherwise("a\\b")
    return documents(spark, d).select("doc_id", V.portable_path(p).alias("portable"))


@query("f13_trust_promotions", "SELECT doc_id FROM documents WHERE doc_id % 4 > doc_id % 3")
def f13(spark, d):
    t = F.array(*map(F.lit, V.TRUST))
    e = documents(spark, d).select("doc_id", F.element_at(t, F.expr("doc_id % 4").cast("int") + 1).alias("trust"), F.element_at(t, F.expr("doc_id % 3").cast("int") + 1).alias("origin_trust"))
    return V.promotions(e).select("doc_id")


@query("s10_text_view", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system') AS view FROM conversations GROUP BY conv_id")
def s10(spark, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(F.when(x["role"] == "system", "furniture").otherwise("text").alias("label"), x["text"].alias("text")))
    return V.text_view(table(spark, d, "conversations").groupBy("conv_id").agg(items.alias("items")), "conv_id")


@query("s09_evidence_candidates", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS ordinal, anchor_type, text FROM (SELECT conv_id, turn, 0 AS part, 'text_span' AS anchor_type, text FROM conversations UNION ALL SELECT conv_id, turn, 1, 'table_cell', role FROM conversations)")
def s09(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    native = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(rows, lambda x: x["text"]).alias("texts"), F.transform(rows, lambda x: F.struct(x["role"].alias("text"), x["turn"].cast("int").alias("row"), F.lit(0).alias("col"))).alias("cells"))
    return V.candidates(native, "conv_id").select("conv_id", "ordinal", "anchor_type", "text")


@query("s19_table_text", "SELECT n_regionkey AS region, CAST(n_nationkey % 2 AS INTEGER) AS row, '| ' || string_agg(n_name, ' | ' ORDER BY n_nationkey) || ' |' AS text FROM nation GROUP BY 1, 2")
def s19(spark, d):
    cells = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.expr("CAST(n_nationkey % 2 AS INT)").alias("row"), F.col("n_nationkey").alias("col"), F.col("n_name").alias("text"))
    return V.table_text(cells, ["region"])


@query("u09_record_faults", "SELECT source AS id, 'repeated' AS fault FROM documents GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT lang, 'no_reference' FROM documents")
def u09(spark, d):
    docs = documents(spark, d)
    return V.record_faults(docs.select(F.col("source").alias("id")), docs.select(F.col("lang").alias("id")))


@query("d20_release_gate", "SELECT lang AS release, coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 50 = 4), '') AS failed, count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 50 = 4) = 0 AS accepted FROM documents GROUP BY 1")
def d20(spark, d):
    return V.gate(documents(spark, d).select(F.col("lang").alias("release"), F.col("source").alias("name"), F.expr("doc_id % 2 = 0").alias("required"), F.expr("doc_id % 50 <> 4").alias("passed")))


@query("r33_missing_evidence", "SELECT conv_id AS query_id, CAST(turn AS VARCHAR) AS representation FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn % 5 = 3)")
def r33(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("representation"), "turn")
    return V.missing(c.drop("turn"), c.where("turn % 5 = 3"))


@query("c13_uuid7", "SELECT event_id, substr(t, 1, 8) || '-' || substr(t, 9, 4) || '-7' || substr(h, 1, 3) || '-8' || substr(h, 4, 3) || '-' || substr(h, 7, 12) AS id FROM (SELECT event_id, lpad(lower(hex(epoch_us(ts) // 1000)), 12, '0') AS t, sha256(CAST(event_id AS VARCHAR)) AS h FROM events)")
def c13(spark, d):
    return table(spark, d, "events").select("event_id", V.uuid7(F.unix_millis(F.col("ts").cast("timestamp")), F.sha2(F.col("event_id").cast("string"), 256)).alias("id"))


@query("a12_case_ratios", "SELECT source AS case_id, count(*) AS n, round(median(n_chars / (doc_id + 1)), 6) AS median FROM documents GROUP BY 1")
def a12(spark, d):
    return documents(spark, d).groupBy(F.col("source").alias("case_id")).agg(F.count("*").alias("n"), F.round(F.median(F.col("n_chars") / (F.col("doc_id") + 1)), 6).alias("median"))


@query("a16_utility_totals", "SELECT role AS treatment, count(*) AS cases, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE turn < 2 GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "conversations").where("turn < 2").groupBy(F.col("role").alias("treatment")).agg(F.count("*").alias("cases"), F.sum(F.length("text")).alias("chars"))


@query("a18_reindex_report", "SELECT source AS scope, count(*) AS entries, CASE WHEN bool_or(doc_id % 60 = 7) THEN 'REBUILT' ELSE 'CURRENT' END AS status FROM documents GROUP BY 1")
def a18(spark, d):
    docs = documents(spark, d).withColumn("indexed", F.when(F.expr("doc_id % 60 = 7"), "old").otherwise(F.sha2("text", 256)))
    return docs.groupBy(F.col("source").alias("scope")).agg(F.count("*").alias("entries"), F.when(F.bool_and(F.col("indexed") == F.sha2("text", 256)), "CURRENT").otherwise("REBUILT").alias("status"))


@query("a26_freshness_summary", "SELECT event_type AS profile, CAST(user_id % 2 AS INTEGER) AS mode, count(*) AS n, quantile_disc(CAST(floor(value) AS BIGINT), 0.5) AS p50 FROM events GROUP BY 1, 2")
def a26(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("profile"), F.expr("CAST(user_id % 2 AS INT)").alias("mode"), F.floor("value").cast("long").alias("v"))
    return E.nearest_rank(["profile", "mode"], e, "v").select("profile", "mode", "n", "p50")
