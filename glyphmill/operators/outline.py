"""Outlines of block trees: depth, path and section size of every block, by a recursive query over parent links.

Blocks: doc_id, block_id, parent_id, kind, ordinal, line_start, line_end, text.

Defined results: a document whose hierarchy does not hold (a parent that is missing, a cycle, a repeated or null block
id, more than DEPTH levels) has one row, with status ``inconsistent``; rows without doc_id are left out; the label of a
block without text is its kind; documents without outline blocks have no rows, as have empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged

# What counts as outline, and limits that results must agree on.
KINDS = ["title", "heading", "list", "list_item"]
DEPTH, LABEL = 32, 512
FIRST_LINE = r"^([^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*)"
# End of fixed values.

#: By default a recursive query ends with an error after a million rows.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def walked(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, depth, path (ids from the top) of blocks that the top reaches in DEPTH + 1 steps, staged."""
    spark, view = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.select("doc_id", "block_id", "parent_id").createOrReplaceTempView(view)
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return staged(spark.sql(f"""WITH RECURSIVE tree(doc_id, block_id, depth, path) AS (
            SELECT doc_id, block_id, 0, array(block_id) FROM {view} WHERE parent_id IS NULL
            UNION ALL SELECT b.doc_id, b.block_id, t.depth + 1, array_append(t.path, b.block_id) FROM tree t JOIN {view} b ON b.doc_id = t.doc_id AND b.parent_id = t.block_id WHERE t.depth <= {DEPTH})
            SELECT * FROM tree"""), "outline-tree")  # fmt: skip
    finally:
        spark.catalog.dropTempView(view)
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def outline(blocks: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """doc_id, status, block_id, parent_id, kind, ordinal, depth, path, size (characters of the block and all below it), label, line_start, line_end."""
    b = staged(blocks.where("doc_id is not null").select("doc_id", "block_id", "parent_id", "kind", "ordinal", "line_start", "line_end", F.regexp_extract(F.coalesce(F.nullif("text", F.lit("")), "kind"), FIRST_LINE, 1).alias("label"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")), "outline-blocks")
    tree = walked(b)
    whole = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("n_ids"))
    met = tree.groupBy("doc_id").agg(F.count("*").alias("met"), F.max("depth").alias("deepest"))
    holds = (F.col("n") == F.col("n_ids")) & (F.col("n") == F.coalesce("met", F.lit(0))) & (F.coalesce("deepest", F.lit(0)) <= DEPTH)
    status = staged(whole.join(met, "doc_id", "left").select("doc_id", F.when(holds, "consistent").otherwise("inconsistent").alias("status")), "outline-status")
    good = status.where("status = 'consistent'")
    sizes = tree.select("doc_id", F.explode("path").alias("above"), "block_id").join(b.select("doc_id", "block_id", "size"), ["doc_id", "block_id"])
    sizes = sizes.groupBy("doc_id", F.col("above").alias("block_id")).agg(F.sum("size").alias("size"))
    of_kind = b.where(F.col("kind").isin(kinds or KINDS)).drop("size").join(good, "doc_id").join(tree, ["doc_id", "block_id"]).join(sizes, ["doc_id", "block_id"])
    cols = ["doc_id", "status", "block_id", "parent_id", "kind", "ordinal", "depth", "path", "size", "label", "line_start", "line_end"]
    return of_kind.select(*cols[:8], "size", F.left("label", F.lit(LABEL)).alias("label"), *cols[10:]).unionByName(status.where("status = 'inconsistent'"), allowMissingColumns=True)
