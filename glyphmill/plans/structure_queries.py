"""Queries of outlines, of parsers as table functions, of native documents and of page regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence_store as E
from ..operators import outline as O
from ..operators import parsers as P
from ..operators import regions as R
from ..sources.scratch import staged
from .registry import query, table
from .text_queries import SPACED, documents, marked, spaced

# Conversations as trees: chains in every third, halves of the number elsewhere; some lose a parent, some run in a circle.
PARENT = """CASE WHEN conv_id % 17 = 5 AND turn = 3 THEN 1000000 WHEN conv_id % 19 = 3 AND turn = 1 THEN 2 WHEN conv_id % 19 = 3 AND turn = 2 THEN 1
 WHEN turn = 0 THEN NULL WHEN conv_id % 3 = 0 THEN turn - 1 ELSE turn DIV 2 END"""
KIND = "CASE WHEN turn = 0 THEN 'title' WHEN turn % 3 = 1 THEN 'heading' WHEN turn % 3 = 2 THEN 'list' WHEN turn % 4 = 3 THEN 'list_item' ELSE role END"


@query("r11_block_outline", f"""WITH RECURSIVE b AS (SELECT conv_id, turn, {PARENT.replace('turn DIV 2', 'turn // 2')} AS parent, {KIND} AS kind, text FROM conversations),
 t(conv_id, turn, depth, path) AS (SELECT conv_id, turn, 0, [turn] FROM b WHERE parent IS NULL UNION ALL SELECT b.conv_id, b.turn, depth + 1, list_append(path, b.turn) FROM t JOIN b ON b.conv_id = t.conv_id AND b.parent = t.turn WHERE depth <= 32),
 ok AS (SELECT conv_id, count(*) = (SELECT count(*) FROM t WHERE t.conv_id = b.conv_id) AND coalesce((SELECT max(depth) FROM t WHERE t.conv_id = b.conv_id), 0) <= 32 AS holds FROM b GROUP BY 1),
 s AS (SELECT conv_id, above AS turn, sum(length(text)) AS size FROM (SELECT t.conv_id, unnest(path) AS above, text FROM t JOIN b USING (conv_id, turn)) GROUP BY 1, 2)
 SELECT conv_id AS doc_id, 'consistent' AS status, turn AS block_id, parent AS parent_id, kind, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path, CAST(size AS BIGINT) AS size, left(string_split(CASE WHEN text = '' THEN kind ELSE text END, chr(10))[1], 512) AS label
 FROM b JOIN t USING (conv_id, turn) JOIN s USING (conv_id, turn) JOIN ok USING (conv_id) WHERE holds AND kind IN ('title', 'heading', 'list', 'list_item') UNION ALL SELECT conv_id, 'inconsistent', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ok WHERE NOT holds""")
def r11(spark, d):
    b = table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS block_id", f"CAST({PARENT} AS BIGINT) AS parent_id", f"{KIND} AS kind", "turn AS ordinal", "1 AS line_start", "1 AS line_end", "text")
    return O.outline(b).select("doc_id", "status", "block_id", "parent_id", "kind", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "size", "label")


@query("y01_parsers", f"""WITH l AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({SPACED}, chr(10)) AS l FROM documents WHERE doc_id % 4 = 0)),
 p AS (SELECT doc_id, i, l[i] AS s, sum(CASE WHEN trim(l[i]) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l)
 SELECT doc_id, 'paragraph' AS kind, count(DISTINCT g) AS n, CAST(max(i) AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS failed FROM p WHERE trim(s) <> '' GROUP BY 1
 UNION ALL SELECT doc_id, 'heading', 2, len(string_split(text, chr(10))) + 3, NULL FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'paragraph', 2, len(string_split(text, chr(10))) + 4, NULL FROM documents WHERE doc_id % 4 = 1
 UNION ALL SELECT doc_id, 'table_row', 1, 1 + len(string_split(text, chr(10))), NULL FROM documents WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, NULL, 1, NULL, 'unexpected end of data' FROM documents WHERE doc_id % 4 = 3""")
def y01(spark, d):
    """Documents as text, Markdown, CSV, and CSV whose last quote is missing."""
    kind = F.pmod("doc_id", F.lit(4))
    plain, md = (x.where(kind == i).select("doc_id", "text", F.lit(m).alias("media_type")) for x, i, m in ((spaced(spark, d), 0, "text/plain"), (marked(spark, d), 1, "text/markdown")))
    quoted = F.concat(F.lit('id,text\r\n1,"'), F.replace("text", F.lit('"'), F.lit('""')))
    table_ = documents(spark, d).where(kind >= 2).select("doc_id", F.when(kind == 2, F.concat(quoted, F.lit('"\r\n'))).otherwise(quoted).alias("text"), F.lit("text/csv").alias("media_type"))
    b = P.parsed(plain.unionByName(md).unionByName(table_), ["doc_id"])
    return b.groupBy("doc_id", "kind", "failed").agg(F.count("*").alias("n"), F.max("line_end").cast("long").alias("last"))


def natives(spark, d):
    """Documents as native JSON: a text a line, a table of its source and language, a name with a slash; every 31st is broken."""
    line = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.when(i == 0, "title").otherwise("line").alias("label"), t.alias("text"), F.floor(i / 20).cast("int").alias("page")))
    cells = F.array(*(F.struct(F.lit(0).alias("row"), F.lit(i).alias("col"), F.col(c).alias("text")) for i, c in enumerate(("source", "lang"))))
    whole = F.struct(line.alias("texts"), F.array(F.struct(F.lit(0).alias("page"), cells.alias("cells"))).alias("tables"), F.struct(F.col("n_chars").alias("a/b")).alias("meta"))
    json = F.to_json(whole)
    return documents(spark, d).where("text is not null").select("doc_id", F.lit("v1").alias("version_id"), F.when(F.col("doc_id") % 31 == 0, F.left(json, F.length(json) - 1)).otherwise(json).alias("native"))


def native_store(spark, d):
    return staged(E.stored(natives(spark, d)), "evidence-store")


@query("s09_native_evidence", """WITH l AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id % 31 <> 0)
 SELECT doc_id, 'text' AS kind, '/texts/' || (i - 1) AS pointer, NULL AS parent, CASE WHEN i = 1 THEN 'title' ELSE 'line' END AS label, l[i] AS text, CAST((i - 1) // 20 AS INTEGER) AS page, CAST(NULL AS INTEGER) AS col FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)
 UNION ALL SELECT doc_id, 'table_cell', '/tables/0/cells/0', '/tables/0', NULL, source, 0, 0 FROM l UNION ALL SELECT doc_id, 'table_cell', '/tables/0/cells/1', '/tables/0', NULL, lang, 0, 1 FROM l""")
def s09(spark, d):
    """Texts and cells of native documents, each with its pointer."""
    return E.listed(native_store(spark, d)).select("doc_id", "kind", "pointer", "parent", "label", "text", "page", "col")


POINTERS = ["/texts/{n}/text", "/texts/{n}/page", "/meta/a~1b", "/tables/0/cells/1/text", "/texts/-", "/texts/01/text", "texts/0", "/texts/~2", "/nothing/0"]


@query("r37_evidence_resolve", """WITH l AS (SELECT doc_id, lang, n_chars, string_split(text, chr(10)) AS l, doc_id % 7 AS n FROM documents WHERE text IS NOT NULL),
 v AS (SELECT doc_id, doc_id % 31 = 0 AS broken, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k, unnest([CASE WHEN n < len(l) THEN to_json(l[n + 1])::VARCHAR END, CASE WHEN n < len(l) THEN '0' END, n_chars::VARCHAR, to_json(lang)::VARCHAR, NULL, NULL, NULL, NULL, NULL]) AS value FROM l)
 SELECT doc_id * 10 + k AS request_id, CASE WHEN k IN (6, 7) THEN 'invalid_pointer' WHEN broken THEN 'no_document' WHEN value IS NULL THEN 'missing' ELSE 'found' END AS status, CASE WHEN NOT broken THEN value END AS value FROM v""")
def r37(spark, d):
    """Pointers into every document, right ones and wrong ones."""
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.replace(F.lit(p), F.lit("{n}"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("pointer")) for k, p in enumerate(POINTERS)))
    requests = documents(spark, d).where("text is not null").select("doc_id", F.lit("v1").alias("version_id"), F.explode(each).alias("x")).select((F.col("doc_id") * 10 + F.col("x.k")).alias("request_id"), "doc_id", "version_id", "x.pointer")
    return E.resolved(requests, native_store(spark, d))


# Line items as handles and orders as regions of pages; every tenth page is that of a customer with many.
BOXES = {
    "lineitem": ("l_orderkey * 10 + l_linenumber", "l_partkey % 1000", "CAST(l_quantity AS BIGINT) * 18000", "l_suppkey * 7919 % 900000", 60000, 90000),
    "orders": ("o_orderkey", "o_custkey % 1000", "o_orderkey * 104729 % 900000", "o_custkey * 1299709 % 950000", 120000, 45000),
}


def boxes(name: str) -> str:
    key, page, x, y, wide, tall = BOXES[name]
    return f"SELECT CAST({key} AS BIGINT) AS id, CAST({page} AS BIGINT) AS page, CAST({x} AS BIGINT) AS x0, CAST({y} AS BIGINT) AS y0, CAST({x} AS BIGINT) + {wide} AS x1, CAST({y} AS BIGINT) + {tall} AS y1 FROM {name}"


@query("j15_handle_regions", f"""WITH h AS ({boxes('lineitem')}), r AS ({boxes('orders')}), o AS (SELECT h.id AS handle_id, r.id AS region_id, (least(h.x1, r.x1, 1000000) - greatest(h.x0, r.x0)) * (least(h.y1, r.y1, 1000000) - greatest(h.y0, r.y0)) AS overlap
 FROM h JOIN r ON h.page = r.page AND h.x0 < least(r.x1, 1000000) AND r.x0 < least(h.x1, 1000000) AND h.y0 < least(r.y1, 1000000) AND r.y0 < least(h.y1, 1000000))
 SELECT handle_id, region_id, CAST(overlap AS BIGINT) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY handle_id ORDER BY overlap DESC, region_id) = 1""")
def j15(spark, d):
    """Each handle with the region of its page that it overlaps most."""
    h, r = (spark.sql(boxes(n).replace(f"FROM {n}", "FROM {t}"), t=table(spark, d, n)) for n in ("lineitem", "orders"))
    return R.resolved(h, r)
