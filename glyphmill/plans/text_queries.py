"""Queries of text functions, parsers, passages and the store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import planning
from ..functions import text as T
from ..operators import blocks as B
from ..operators import passages as P
from ..operators import store as S
from .registry import query, table

SPACED = r"regexp_replace(text, '\. ', '.' || chr(10) || chr(10), 'g')"
MARKED = "'# Part ' || (doc_id % 7) || ' ##' || chr(10) || text || chr(10) || 'Sub ' || (doc_id % 5) || chr(10) || '---' || chr(10) || 'end of it'"


def documents(spark, d):
    return table(spark, d, "documents")


def spaced(spark, d):
    """Documents with a blank line after each sentence."""
    return documents(spark, d).withColumn("text", F.regexp_replace("text", r"\. ", ".\n\n"))


def marked(spark, d):
    """Documents as Markdown, with two headings."""
    head = F.concat(F.lit("# Part "), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(" ##\n"))
    tail = F.concat(F.lit("\nSub "), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit("\n---\nend of it"))
    return documents(spark, d).withColumn("text", F.concat(head, F.col("text"), tail))


@query("c06_token_estimate", "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents")
def c06(spark, d):
    return documents(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("c07_split_lines", "SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n FROM documents")
def c07(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.lines_of(F.col("text"))).cast("long").alias("n"))


@query("c08_decode_source", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c08(spark, d):
    raw = documents(spark, d).select("doc_id", F.concat(F.unhex(F.lit("EFBBBF")), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")).cast("binary")).alias("raw"))
    return raw.select("doc_id", F.sha2(T.decode_source(F.col("raw")), 256).alias("digest"))


@query("c09_snippet", """SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE substr(text, greatest(0, CASE WHEN strpos(lower(text), 'eri') = 0 THEN 0
 ELSE greatest(0, least(length(text) - 240, strpos(lower(text), 'eri') - 1 - 118)) END) + 1, 240) END AS snippet FROM documents""")
def c09(spark, d):
    return documents(spark, d).select("doc_id", T.snippet(F.col("text"), F.lit("eri")).alias("snippet"))


@query("c10_text_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS id FROM documents")
def c10(spark, d):
    return documents(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("id"))


@query("c11_canonical_id", """SELECT doc_id, 'sha256:' || sha256('{"domain":"document","payload":{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}}') AS id FROM documents""")
def c11(spark, d):
    return documents(spark, d).select("doc_id", T.canonical_id("document", source=F.col("source"), lang=F.col("lang"), n=F.col("n_chars")).alias("id"))


@query("c14_labels", "SELECT page_id, right(CAST(page_id AS VARCHAR), 8) AS short_id, string_split(url, '/')[-1] AS label FROM pages")
def c14(spark, d):
    return table(spark, d, "pages").select("page_id", T.short_id(F.col("page_id").cast("string")).alias("short_id"), T.label_of(F.col("url")).alias("label"))


@query("c15_storage_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stored FROM events")
def c15(spark, d):
    return table(spark, d, "events").select("event_id", T.storage_time(F.col("ts")).alias("stored"))


@query("c16_backoff", "SELECT event_id, CAST(least(60000, 1000 * pow(2, event_id % 9)) AS BIGINT) AS delay_ms FROM events")
def c16(spark, d):
    return table(spark, d, "events").select("event_id", T.backoff_ms(F.pmod("event_id", F.lit(9)) + 1).alias("delay_ms"))


@query("c20_normalise_markdown", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') || chr(10) AS text FROM (
 SELECT doc_id, regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g') AS text FROM documents)""")
def c20(spark, d):
    return documents(spark, d).select("doc_id", T.normalise_markdown(F.col("text")).alias("text"))


@query("c21_strip_atx", "SELECT doc_id, 'Part ' || (doc_id % 7) AS title FROM documents")
def c21(spark, d):
    t = F.concat(F.lit("Part "), F.pmod("doc_id", F.lit(7)).cast("string"), F.repeat(F.lit(" #"), F.pmod("doc_id", F.lit(2)).cast("int")), F.lit(" "))
    return documents(spark, d).select("doc_id", T.strip_atx(t).alias("title"))


@query("c22_estimators", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, (length(text) + 3) // 4 AS tokens FROM documents")
def c22(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", T.byte_size(t).alias("bytes"), F.length(t).cast("long").alias("chars"), T.token_estimate(t).alias("tokens"))


@query("c23_truncate_utf8", "SELECT doc_id, 40 - strlen(left(text, 20)) >= 0 AS fits, starts_with(text, left(text, 10)) AS whole FROM documents")
def c23(spark, d):
    cut = T.truncate_utf8(F.col("text"), 40)
    return documents(spark, d).select("doc_id", (F.octet_length(cut) <= 40).alias("fits"), F.col("text").startswith(cut).alias("whole"))


@query("c24_term_coverage", """SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['the', 'and', 'erth', 'de'])) AS DOUBLE) / 4 AS coverage FROM documents""")
def c24(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return documents(spark, d).select("doc_id", (F.size(F.array_intersect(words, F.array(*map(F.lit, ["the", "and", "erth", "de"])))) / 4).alias("coverage"))


@query("c26_line_of", "SELECT doc_id, CAST(len(string_split(left(text, 500), chr(10))) AS BIGINT) AS line FROM documents")
def c26(spark, d):
    return documents(spark, d).select("doc_id", T.line_at(F.col("text"), F.lit(500)).alias("line"))


@query("c01_fold", "SELECT doc_id, sha256(replace(lower(strip_accents(text)), 'ß', 'ss')) AS folded FROM documents")
def c01(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query("c04_words", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) AS BIGINT) AS n FROM documents")
def c04(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.words_of(F.col("text"))).cast("long").alias("n"))


@query("c05_relevance_token", "SELECT doc_id, sha256(replace(lower(nfc_normalize(text)), 'ß', 'ss')) AS token FROM documents")
def c05(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.relevance_token(F.col("text")), 256).alias("token"))


@query("f06_has_content", r"SELECT doc_id, length(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '[^\p{L}\p{N}]', '', 'g')) >= 3 AS content FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<!-- ' || text || ' --> a' ELSE text END AS t FROM documents)")
def f06(spark, d):
    """Whole texts, every third one within a comment."""
    t = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("<!-- "), "text", F.lit(" --> a"))).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", T.has_content(t).alias("content"))


@query("f07_tabular", "SELECT doc_id, starts_with(ltrim(CASE WHEN doc_id % 3 = 0 THEN ' | ' || text ELSE text END), '|') AS tabular FROM documents")
def f07(spark, d):
    t = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit(" | "), "text")).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", T.is_tabular(t, F.lit("text/plain")).alias("tabular"))


@query("f08_question", r"""SELECT item_id, ends_with(rtrim(q), '?') OR lower(regexp_extract(q, '[\p{L}\p{N}]+')) IN ('how', 'what', 'why', 'when', 'where', 'which', 'who', 'whom', 'whose', 'wie', 'was', 'warum', 'wann', 'wo', 'welche', 'welcher', 'welches', 'wer', 'wieso', 'weshalb') AS question
 FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '? ' ELSE 'Where ' || text END AS q FROM benchmark)""")
def f08(spark, d):
    t = F.col("text")
    q = F.when(F.pmod("item_id", F.lit(3)) == 0, t).when(F.pmod("item_id", F.lit(3)) == 1, F.concat(t, F.lit("? "))).otherwise(F.concat(F.lit("Where "), t))
    return table(spark, d, "benchmark").select("item_id", T.is_question(q).alias("question"))


LINES_SQL = "SELECT doc_id, CAST(i AS INTEGER) AS line, l[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


@query("s04_text_lines", LINES_SQL)
def s04(spark, d):
    return B.text_lines(documents(spark, d), ["doc_id"])


@query("s05_plain_paragraphs", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS ordinal, min(i) AS line_start, max(i) AS line_end, string_agg(s, chr(10) ORDER BY i) AS text FROM (
 SELECT *, sum(CASE WHEN trim(s) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
 SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split({SPACED}, chr(10)) AS l FROM documents))) WHERE trim(s) <> '' GROUP BY doc_id, g""")
def s05(spark, d):
    return B.paragraphs(spaced(spark, d), ["doc_id"]).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "text")


@query("s06_markdown_blocks", f"""SELECT doc_id, kind, CAST(n AS BIGINT) AS n, CAST(last AS BIGINT) AS last FROM (
 SELECT doc_id, 'heading' AS kind, 2 AS n, len(string_split(text, chr(10))) + 3 AS last FROM documents UNION ALL
 SELECT doc_id, 'paragraph', 2, len(string_split(text, chr(10))) + 4 FROM documents)""")
def s06(spark, d):
    b = B.blocks(marked(spark, d), ["doc_id"])
    return b.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("line_end").cast("long").alias("last"))


@query("s07_csv_rows", """SELECT c_custkey AS key, CAST(1 AS BIGINT) AS n, '[["key","' || c_custkey || '"],["segment","' || c_mktsegment || '"]]' AS text FROM customer""")
def s07(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("key,segment\r\n"), F.col("c_custkey").cast("string"), F.lit(',"'), "c_mktsegment", F.lit('"\r\n')).alias("text"))
    return B.blocks(c, ["key"], kind="csv").groupBy("key").agg(F.count("*").alias("n"), F.max("text").alias("text"))


@query("s17_needles", "SELECT i AS ordinal, 'needle-' || left(sha256('42:' || i), 16) AS needle FROM range((SELECT count(*) FROM documents)) t(i)")
def s17(spark, d):
    n = documents(spark, d).count()
    return spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("needle-"), F.substring(F.sha2(F.concat(F.lit("42:"), F.col("id").cast("string")), 256), 1, 16)).alias("needle"))


PASSAGES_SQL = r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r(doc_id, l, i, first, size, done) AS (SELECT doc_id, l, 1, 1, length(l[1]) + 1, len(l) = 1 FROM l UNION ALL
 SELECT doc_id, l, i + 1, CASE WHEN size + length(l[i + 1]) + 1 > 1600 THEN i + 1 ELSE first END, CASE WHEN size + length(l[i + 1]) + 1 > 1600 THEN 0 ELSE size END + length(l[i + 1]) + 1, i + 1 = len(l) FROM r WHERE NOT done),
p AS (SELECT doc_id, first, max(i) AS last, any_value(l) AS l FROM r GROUP BY doc_id, first),
q AS (SELECT doc_id, first, last, regexp_replace(array_to_string(l[first:last], chr(10)), '^\s+|\s+$', '', 'g') AS text FROM p),
passages AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS ordinal, first AS line_start, last AS line_end, text FROM q WHERE length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 3)
"""


def passages(spark, d):
    return P.passages(documents(spark, d), ["doc_id"])


@query("d02_passages", PASSAGES_SQL + "SELECT doc_id, ordinal, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, text FROM passages")
def d02(spark, d):
    return passages(spark, d).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("ordinal", "line_start", "line_end")), "text")


@query("d01_structure", f"""SELECT doc_id, CAST(2 AS BIGINT) AS headings, 'Part ' || (doc_id % 7) AS first, CAST(len(string_split({MARKED}, chr(10))) - 2 AS BIGINT) AS last_line FROM documents""")
def d01(spark, d):
    s = P.structures(marked(spark, d), ["doc_id"])
    return s.select("doc_id", F.size("headings").cast("long").alias("headings"), F.col("headings")[0]["text"].alias("first"), F.element_at("headings", -1)["line"].cast("long").alias("last_line"))


@query("j10_page_for_line", "SELECT doc_id, CASE WHEN doc_id % 100 < 10 THEN NULL WHEN doc_id % 100 < 40 THEN 1 ELSE 2 END AS page FROM documents")
def j10(spark, d):
    pages = F.array(F.struct(F.lit(1).alias("number"), F.lit(10).alias("line")), F.struct(F.lit(2).alias("number"), F.lit(40).alias("line")))
    return documents(spark, d).select("doc_id", P.page_for_line(pages, F.pmod("doc_id", F.lit(100)).cast("int")).alias("page"))


@query("j11_heading_path", "SELECT doc_id, CASE WHEN doc_id % 30 < 1 THEN '' WHEN doc_id % 30 < 5 THEN 'A' WHEN doc_id % 30 < 9 THEN 'A > B' WHEN doc_id % 30 < 15 THEN 'A > C' ELSE 'D' END AS path FROM documents")
def j11(spark, d):
    h = F.array(*[F.struct(F.lit(a).alias("line"), F.lit(v).alias("level"), F.lit(t).alias("text")) for a, v, t in ((1, 1, "A"), (5, 3, "B"), (9, 2, "C"), (15, 1, "D"))])
    return documents(spark, d).select("doc_id", P.heading_path(h, F.pmod("doc_id", F.lit(30)).cast("int")).alias("path"))


@query("r10_outline", f"""WITH m AS (SELECT doc_id, string_split({MARKED}, chr(10)) AS l FROM documents)
 SELECT doc_id, CAST(1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS level, CAST(len(l) AS BIGINT) AS section_end FROM m UNION ALL SELECT doc_id, len(l) - 2, 2, len(l) FROM m""")
def r10(spark, d):
    m = marked(spark, d).withColumn("n", F.size(F.split("text", "\n")))
    s = P.structures(m, ["doc_id"]).join(m.select("doc_id", "n"), "doc_id")
    return P.outline(s, "n", ["doc_id"]).select("doc_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), F.col("end").cast("long").alias("section_end"))


@query("w08_siblings", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS sibling_order FROM conversations")
def w08(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.col("role").alias("parent"), F.lit("turn").alias("kind"), "text")
    return B.siblings(c, ["conv_id"]).select("conv_id", F.col("ordinal").alias("turn"), F.col("sibling_order").cast("long").alias("sibling_order"))


@query("d03_agent_records", PASSAGES_SQL + "SELECT d.doc_id, len(string_split(d.text, chr(10))) AS lines, coalesce(p.n, 0) AS passages, (length(d.text) + 3) // 4 AS tokens, 'sha256:' || sha256(d.text) AS digest FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM passages GROUP BY doc_id) p USING (doc_id)")
def d03(spark, d):
    n = passages(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    t = F.col("text")
    return documents(spark, d).join(n, "doc_id", "left").select("doc_id", F.size(T.lines_of(t)).cast("long").alias("lines"), F.coalesce("n", F.lit(0)).alias("passages"), T.token_estimate(t).alias("tokens"), T.text_hash(t).alias("digest"))


@query("d04_block_ids", r"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (
 SELECT doc_id, sha256(doc_id || '|0|paragraph|' || sha256(text) || '|0') AS h FROM documents)""")
def d04(spark, d):
    return documents(spark, d).select("doc_id", B.block_id(F.col("doc_id"), F.lit("0"), F.lit("paragraph"), F.sha2("text", 256), F.lit(0)).alias("id"))


@query("d05_block_hash", """SELECT doc_id, 'sha256:' || sha256('{"domain":"block","payload":{"kind":"paragraph","text":"' || source || '"}}') AS id FROM documents""")
def d05(spark, d):
    return B.block_hash(documents(spark, d).select("doc_id", F.lit("paragraph").alias("kind"), F.col("source").alias("text"))).select("doc_id", F.col("canonical_hash").alias("id"))


def _id(name, domain, **fields):
    """An identity over columns of documents, its SQL built the same way."""
    sql = ",".join(f'"{k}":' + (f"' || {fields[k]} || '" if fields[k] in ("doc_id", "n_chars") else f"\"' || {fields[k]} || '\"") for k in sorted(fields))

    @query(name, f"""SELECT doc_id, 'sha256:' || sha256('{{"domain":"{domain}","payload":{{{sql}}}}}') AS id FROM documents""")
    def run(spark, d):
        return documents(spark, d).select("doc_id", T.canonical_id(domain, **{k: F.col(v) for k, v in fields.items()}).alias("id"))


_id("d06_representation_id", "representation", version="source", parser="lang", profile="n_chars")
_id("d14_lineage_id", "lineage", origin="doc_id")
_id("d15_relation_id", "relation", kind="lang", source="doc_id", target="n_chars")
_id("d16_derivation_id", "derivation", inputs="source", generator="lang", config="n_chars")
_id("c25_scoped_digest", "scope", scope="source", value="doc_id")


PARSED = Y.ArrayType(Y.StructType([Y.StructField("item", Y.StringType()), Y.StructField("phrase", Y.BooleanType())]))


@F.pandas_udf(PARSED)
def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Items of search queries; null if the grammar refuses one."""

    def items(q: str | None) -> list[dict] | None:
        try:
            return [{"item": t, "phrase": p} for t, p in planning.parse(q or "")]
        except planning.QueryError:
            return None

    for queries in batches:
        yield pd.Series([items(q) for q in queries], dtype=object)


@query("r01_search_grammar", r"""WITH b AS (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark), k AS (SELECT item_id, [w[1] || ' ' || w[2]] || w[3:] AS l FROM b WHERE len(w) BETWEEN 3 AND 33 AND item_id % 7 <> 0)
 SELECT item_id AS query_id, CAST(i - 1 AS INTEGER) AS item_no, l[i] AS item, i = 1 AS phrase FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM k)""")
def r01(spark, d):
    """The first two words of each text as a phrase, the others bare; every seventh query has an open quote, long ones have too many items."""
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    whole = F.concat(F.lit('"'), F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)), F.lit('" '), F.array_join(F.slice(w, F.lit(3), F.size(w)), " "), F.when(F.expr("item_id % 7 = 0"), ' "open').otherwise(""))
    asked = table(spark, d, "benchmark").where(F.size(w) >= 3).select("item_id", whole.alias("q"))
    return asked.select(F.col("item_id").alias("query_id"), F.posexplode(parsed("q")).alias("item_no", "x")).select("query_id", "item_no", "x.item", "x.phrase")


PLANNED = Y.ArrayType(Y.StructType([Y.StructField("term", Y.StringType()), Y.StructField("prefix", Y.BooleanType()), Y.StructField("phrase", Y.BooleanType())]))


@F.pandas_udf(PLANNED)
def planned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for queries in batches:
        yield pd.Series([[{"term": t.text, "prefix": t.prefix, "phrase": t.phrase} for t in planning.plan(q or "")] for q in queries])


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in sorted(planning.STOP_WORDS)) + ")"
SUFFIX_SQL = "|".join(planning.SUFFIXES)


@query("r03_query_plan", rf"""WITH w AS (SELECT item_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*'), lambda x: replace(lower(strip_accents(x)), 'ß', 'ss')) AS l FROM benchmark)),
 c AS (SELECT * FROM w WHERE w NOT IN {STOP_SQL}), k AS (SELECT * FROM c UNION ALL SELECT * FROM w WHERE item_id NOT IN (SELECT item_id FROM c)),
 t AS (SELECT item_id, i, CASE WHEN length(w) < 5 OR regexp_matches(w, '[0-9]') THEN w ELSE regexp_replace(w, '^(.{{4,}}?)({SUFFIX_SQL})$', '\1') END AS term, length(w) >= 5 AND NOT regexp_matches(w, '[0-9]') AS prefix FROM k),
 o AS (SELECT item_id, term, prefix, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) - 1 AS n FROM t GROUP BY 1, 2, 3) SELECT item_id AS query_id, CAST(n AS INTEGER) AS term_no, term, prefix, false AS phrase FROM o WHERE n < 16""")
def r03(spark, d):
    """The plan of each benchmark text."""
    plans = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(planned("text")).alias("term_no", "x"))
    return plans.select("query_id", "term_no", "x.term", "x.prefix", "x.phrase")


@query("u07_query_items", r"SELECT item_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), ' ') AS items FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark)")
def u07(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))), " ").alias("items"))


# Store ----------------------------------------------------------------------------------------------------


@query("k01_put_objects", "SELECT DISTINCT 'sha256:' || sha256(text) AS object_id, strlen(text) AS byte_length FROM documents")
def k01(spark, d):
    return S.put(documents(spark, d).select(F.col("text").alias("content"))).select("object_id", "byte_length")


@query("a23_distinct_objects", "SELECT DISTINCT 'sha256:' || sha256(text) AS object_id FROM documents WHERE lang = 'en'")
def a23(spark, d):
    return documents(spark, d).where("lang = 'en'").select(S.object_id(F.col("text")).alias("object_id")).distinct()


@query("s11_verified_read", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 0")
def s11(spark, d):
    objects = documents(spark, d).select("doc_id", S.object_id(F.col("text")).alias("object_id"), F.octet_length("text").alias("byte_length"), F.when(F.pmod("doc_id", F.lit(10)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return S.verified(objects).select("doc_id", F.sha2("content", 256).alias("digest"))


@query("a17_root_reasons", """SELECT source AS object_id, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM (
 SELECT source, 'document' AS reason FROM documents WHERE lang = 'en' UNION ALL SELECT source, 'version' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source, 'pin' FROM documents WHERE doc_id < 10) GROUP BY source""")
def a17(spark, d):
    docs = documents(spark, d)
    r = S.roots((docs.where("lang = 'en'"), "source", "document"), (docs.where("doc_id % 3 = 0"), "source", "version"), (docs.where("doc_id < 10"), "source", "pin"))
    return S.roots_as_text(r)


REACH = """r AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000 ELSE doc_id END AS object_id FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id AS object_id, doc_id % 7 <> 0 AS sound FROM documents)"""


@query("j12_reachability", f"WITH {REACH} SELECT coalesce(r.object_id, i.object_id) AS object_id, CASE WHEN i.object_id IS NULL THEN 'missing' WHEN NOT sound THEN 'corrupt' WHEN r.object_id IS NULL THEN 'candidate' ELSE 'reachable' END AS state FROM r FULL JOIN i USING (object_id)")
def j12(spark, d):
    docs = documents(spark, d)
    r = docs.where("doc_id % 3 <> 0").select(F.when(F.expr("doc_id % 5 = 0"), F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("object_id"))
    return S.reachability(r, docs.select(F.col("doc_id").alias("object_id"), F.expr("doc_id % 7 <> 0").alias("sound")))


@query("u01_reference_union", "SELECT source AS id FROM documents UNION SELECT lang FROM documents UNION SELECT role FROM conversations")
def u01(spark, d):
    docs = documents(spark, d)
    return S.roots((docs, "source", "a"), (docs, "lang", "b"), (table(spark, d, "conversations"), "role", "c")).select(F.col("object_id").alias("id"))


@query("f16_retention", """SELECT doc_id AS object_id, CASE WHEN doc_id % 11 = 0 THEN 'quarantined' WHEN doc_id % 3 = 0 THEN 'protected' WHEN doc_id % 5 = 0 THEN 'held' WHEN doc_id % 40 < 30 THEN 'recent' ELSE 'candidate' END AS state,
 CASE WHEN doc_id % 3 = 0 THEN 'head' ELSE '' END AS reasons FROM documents""")
def f16(spark, d):
    docs = documents(spark, d)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    inv = docs.select(F.col("doc_id").alias("object_id"), F.expr("doc_id % 11 = 0").alias("quarantined"), (now - F.make_dt_interval(F.pmod("doc_id", F.lit(40)).cast("int"))).alias("stored_at"))
    roots = S.roots((docs.where("doc_id % 3 = 0").withColumn("o", F.col("doc_id")), "o", "head"))
    return S.retention(inv, roots, docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("object_id")), now, 30)


@query("d18_retention_plan", "SELECT doc_id AS object_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 40 >= 30")
def d18(spark, d):
    return f16(spark, d).where("state = 'candidate'").select("object_id")


@query("a02_index_diagnostics", "SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def a02(spark, d):
    return documents(spark, d).agg(F.count("*").alias("n"), F.sum(T.byte_size(F.col("text"))).alias("bytes"))


@query("a19_token_totals", "SELECT source, count(*) AS n, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")
def a19(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("a20_storage_totals", "SELECT lang AS category, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def a20(spark, d):
    return documents(spark, d).groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.sum(T.byte_size(F.col("text"))).alias("bytes"))


@query("a21_optimisation_totals", "SELECT count(*) FILTER (WHERE n_chars > 1000) AS eligible, count(*) FILTER (WHERE n_chars > 1000 AND doc_id % 9 <> 0) AS completed, CAST(sum(n_chars // 2) FILTER (WHERE n_chars > 1000 AND doc_id % 9 <> 0) AS BIGINT) AS saved FROM documents")
def a21(spark, d):
    done = F.expr("n_chars > 1000 AND doc_id % 9 <> 0")
    return documents(spark, d).agg(F.count_if(F.col("n_chars") > 1000).alias("eligible"), F.count_if(done).alias("completed"), F.sum(F.when(done, F.expr("n_chars div 2"))).alias("saved"))


@query("d08_verify_manifest", "SELECT source, bool_and(doc_id % 97 <> 0) AS sound FROM documents GROUP BY source")
def d08(spark, d):
    checked = documents(spark, d).withColumn("stored", F.when(F.expr("doc_id % 97 <> 0"), T.text_hash(F.col("text"))).otherwise("sha256:0"))
    return checked.groupBy("source").agg(F.bool_and(F.col("stored") == T.text_hash(F.col("text"))).alias("sound"))
