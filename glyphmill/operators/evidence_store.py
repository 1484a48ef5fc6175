"""Native documents as VARIANT columns: listing their evidence, and resolving JSON pointers in them.

A document is parsed once, when it is stored; fields that documents share are shredded into columns of their own by
the writer.  A constant pointer becomes a path of ``variant_get``, which the scan then reads alone.  Pointers that
differ from row to row are walked token by token within the row, by position in arrays and by name in objects.  No
Python is involved.

Native documents: ``texts`` [{label, text, page}], ``tables`` [{page, cells: [{row, col, text}]}], ``pictures``
[{caption, page}]; all else is kept as it is.

Defined results: text that does not begin with a JSON value (what follows it is not looked at), or of more than MOST
characters, is refused with a status and no document; a pointer
that is neither empty nor begins with a slash, or holds a tilde not followed by 0 or 1, is ``invalid_pointer``; one that
leads nowhere is ``missing``, as is position ``-`` or one with a leading zero in an array; a JSON null is found, with value
``null``; values of more than so many bytes are ``too_large``; requests for unknown documents are ``no_document``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: characters of a native document at most.
MOST = 64 << 20
# End of fixed value.


def stored(natives: DataFrame, text: str = "native") -> DataFrame:
    """doc_id, version_id, status, native (variant) of texts."""
    parsed = F.when(F.length(text) <= MOST, F.try_parse_json(F.col(text)))
    status = F.when(F.col(text).isNull(), "absent").when(F.length(text) > MOST, "too_large").when(F.col("v").isNull(), "not_json").otherwise("stored")
    return natives.withColumn("v", parsed).select("doc_id", "version_id", status.alias("status"), F.col("v").alias("native"))


def listed(store: DataFrame) -> DataFrame:
    """doc_id, version_id, ordinal, kind, pointer, parent, label, text, page, row, col: texts, then cells of tables, then pictures."""

    def items(source: DataFrame, native: str, name: str) -> DataFrame:
        return source.sparkSession.sql(f"SELECT s.*, e.pos AS at, e.value AS item FROM {{source}} s, LATERAL variant_explode(try_variant_get(s.{native}, '$.{name}', 'variant')) e WHERE e.key IS NULL", source=source)

    get = lambda path, kind: F.try_variant_get("item", path, kind)
    none = lambda kind: F.lit(None).cast(kind)
    base = store.where("status = 'stored'").select("doc_id", "version_id", "native")
    texts = items(base, "native", "texts").select("doc_id", "version_id", F.lit(0).alias("part"), F.col("at").alias("outer"), F.lit(0).alias("inner"), F.lit("text").alias("kind"), F.concat(F.lit("/texts/"), "at").alias("pointer"), none("string").alias("parent"), get("$.label", "string").alias("label"), get("$.text", "string").alias("text"), get("$.page", "int").alias("page"), none("int").alias("row"), none("int").alias("col"))
    tables = items(base, "native", "tables").select("doc_id", "version_id", F.col("at").alias("outer"), F.col("item").alias("table"), get("$.page", "int").alias("page"))
    cells = items(tables, "table", "cells")
    cells = cells.select("doc_id", "version_id", F.lit(1).alias("part"), "outer", F.col("at").alias("inner"), F.lit("table_cell").alias("kind"), F.concat(F.lit("/tables/"), "outer", F.lit("/cells/"), "at").alias("pointer"), F.concat(F.lit("/tables/"), "outer").alias("parent"), none("string").alias("label"), get("$.text", "string").alias("text"), "page", get("$.row", "int").alias("row"), get("$.col", "int").alias("col"))
    pictures = items(base, "native", "pictures").select("doc_id", "version_id", F.lit(2).alias("part"), F.col("at").alias("outer"), F.lit(0).alias("inner"), F.lit("picture").alias("kind"), F.concat(F.lit("/pictures/"), "at").alias("pointer"), none("string").alias("parent"), none("string").alias("label"), get("$.caption", "string").alias("text"), get("$.page", "int").alias("page"), none("int").alias("row"), none("int").alias("col"))
    return texts.unionByName(cells).unionByName(pictures)


def tokens(pointer: Column) -> Column:
    """The tokens of a pointer; null if it is none."""
    ok = (pointer == "") | (pointer.startswith("/") & ~pointer.rlike("~(?![01])"))
    parts = F.transform(F.split(pointer, "/"), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(ok, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))


def at_pointer(native: Column, pointer: Column) -> Column:
    """The variant at a pointer that may differ from row to row; null where it leads nowhere."""

    def step(here: Column, token: Column) -> Column:
        place = F.when(token.rlike("^(0|[1-9][0-9]{0,8})$"), token.try_cast("int"))
        inside = F.get(F.try_variant_get(here, "$", "array<variant>"), place)
        return F.coalesce(inside, F.try_element_at(F.try_variant_get(here, "$", "map<string,variant>"), token))

    return F.aggregate(tokens(pointer), native, step)


def resolved(requests: DataFrame, store: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """request_id, status, value (JSON) of requests (request_id, doc_id, version_id, pointer)."""
    docs = store.where("status = 'stored'").select("doc_id", "version_id", "native")
    met = requests.join(docs, ["doc_id", "version_id"], "left")
    met = met.withColumns({"ok": tokens(F.col("pointer")).isNotNull(), "json": F.to_json(at_pointer(F.col("native"), F.col("pointer")))})
    large = F.octet_length("json") > most_bytes
    status = F.when(~F.coalesce("ok", F.lit(False)), "invalid_pointer").when(F.col("native").isNull(), "no_document").when(F.col("json").isNull(), "missing").when(large, "too_large").otherwise("found")
    return met.select("request_id", status.alias("status"), F.when(status == "found", F.col("json")).alias("value"))


def native_of(store: DataFrame) -> DataFrame:
    """doc_id, version_id, native (JSON, names in order) as kept."""
    return store.where("status = 'stored'").select("doc_id", "version_id", F.to_json("native").alias("native"))


def text_view(evidence: DataFrame) -> DataFrame:
    """doc_id, version_id, view: labelled texts of a document in their order, one a line."""
    line = F.struct("outer", F.concat_ws(": ", "label", "text").alias("line"))
    rows = evidence.where("kind = 'text'").groupBy("doc_id", "version_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return rows.select("doc_id", "version_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("view"))
