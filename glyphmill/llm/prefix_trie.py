"""Conversation prefix trie by prefix-doubling naming.

Every sequence of turns that begins a conversation is a node.  Blocks of 1, 2, 4, ... turns at aligned places get
dense names: a block's name stands for the pair of names of its halves, so equal blocks have equal names, and a
logarithmic number of rounds names all of them.  A prefix of d turns is the prefix without d's lowest bit and one
block after it; again a round for each power names them all, from the largest power down.  Names of prefixes are
the nodes; no conversation is ever gathered, and every round is an aggregation and a join over a few numbers a
row.  Sums over subtrees double as well: in round k each node adds what its descendants 2**k below have summed.

Every round is written to the shared folder: lineage is cut and lost executors cost a stage.  A key with many
equal turns is counted before it is shuffled and joined where adaptive execution splits it.

Defined results: rows without conversation id are left out; null role or text is empty; turns are ordered by
turn, null first, then role, then text; equal rows are turns of their own; equality of turns is that of a SHA-256
of role and text; other columns are not read; an empty table has the root only, without members and conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import release, staged, table

#: Ids that are joined to one text before digests are taken.
RUN = 4096
#: Turns that a conversation takes over from the first of its hundred are fewer than this.
SHARED = 6


def dense_names(rows: DataFrame, by: list[str], start: int = 0) -> tuple[DataFrame, int]:
    """(by, name): numbers from ``start`` for the distinct values of ``by``, and the first number not given away.

    Distinct values are numbered within the tasks that found them; counts of these tasks, a small table, say where
    each begins."""
    once = staged(rows.select(*by).distinct().withColumn("__at", F.monotonically_increasing_id()), "trie-values")
    task = F.shiftright("__at", 33)
    counts = sorted((r["task"], r["n"]) for r in once.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # one row a task
    begins, total = [], start
    for at, n in counts:
        begins.append((at, total))
        total += n
    first = F.broadcast(rows.sparkSession.createDataFrame(begins, "__task long, __first long"))
    named = once.join(first, task == F.col("__task")).select(*by, (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("name"))
    return named, total


def with_names(rows: DataFrame, by: list[str], tag: str, start: int = 0) -> tuple[DataFrame, int]:
    """``rows``, staged, with the name of their values of ``by`` in place of these."""
    names, total = dense_names(rows, by, start)
    return staged(rows.join(names, by).drop(*by), tag), total


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, chars of every turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    placed = numbered(rows, ["turn", "role", "text"], ["conv_id"], "place")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return staged(placed.select("conv_id", "place", digest.alias("digest"), F.length("text").cast("long").alias("chars")), "trie-turns")


def rebuilt(placed: DataFrame) -> DataFrame:
    """``placed`` with the first h turns of each conversation c taken from conversation c - c % 100; h: crc32 of c, modulo 6."""
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % SHARED
    ids = placed.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = placed.where((F.col("conv_id") % 100 == 0) & (F.col("place") < SHARED - 1)).withColumnRenamed("conv_id", "base")
    taken = ids.join(heads, "base").where(F.col("place") < h("conv_id")).drop("base")
    own = placed.where(F.col("place") >= h("conv_id"))
    parts = taken.withColumn("part", F.lit(0)).unionByName(own.withColumn("part", F.lit(1))).withColumnRenamed("place", "was")
    return numbered(parts, ["part", "was"], ["conv_id"], "place").drop("part", "was")


def prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """conv_id, depth, node, chars for every prefix of one turn and more, and the number of nodes; the root is node 0.

    turns: conv_id, place (without gaps from 0), digest, chars."""
    named, _ = with_names(turns, ["digest"], "trie-block")
    blocks = [named.withColumnRenamed("place", "i")]
    while True:
        low = blocks[-1].withColumn("half", F.col("i") % 2).groupBy("conv_id", F.expr("i div 2").alias("i"))
        pairs = low.agg(F.max(F.when(F.col("half") == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("name"))).alias("b"), F.max_by("chars", "half").alias("chars")).where("a is not null and b is not null")
        pairs = staged(pairs, "trie-pairs")
        if pairs.isEmpty():
            break
        blocks.append(with_names(pairs, ["a", "b"], "trie-block")[0])
        release(turns.sparkSession, pairs)
    found: list[DataFrame] = []
    total = 1
    for k in reversed(range(len(blocks))):
        at = blocks[k].where("i % 2 = 0").select("conv_id", (F.col("i") * (1 << k)).alias("depth"), F.col("name").alias("b"), "chars")
        before = at.where("depth = 0").withColumn("a", F.lit(0).cast("long"))
        if found:
            known = reduce(DataFrame.unionByName, found).select("conv_id", "depth", F.col("node").alias("a"))
            before = before.unionByName(at.where("depth > 0").join(known, ["conv_id", "depth"]))
        out, total = with_names(before.withColumn("depth", F.col("depth") + (1 << k)), ["a", "b"], "trie-prefix", total)
        found.append(out.withColumnRenamed("name", "node"))
    return reduce(DataFrame.unionByName, found), total


def id_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: digest of the ids that end at a node, in order and joined by commas.

    Ids are joined in runs of bounded length where they lie; then a node's runs pass one after another through
    one digest, which is all that has to be done in a row."""
    runs = numbered(ends, ["conv_id"], ["node"], "at").groupBy("node", F.expr(f"at div {RUN}").alias("run"))
    joined = runs.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is None or n != node:
                    done += [(node, sha.hexdigest())] if sha else []
                    node, sha = n, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return joined.repartition("node").sortWithinPartitions("node", "run").mapInArrow(digest, "node long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (node, depth, parent, sums) with each sum taken over the node and all below it.

    After round k a sum covers what is less than 2**k below, and ``up`` is the node 2**k above.  Nodes that have
    neither such a node above nor one below are done."""
    now, done = staged(nodes.withColumnRenamed("parent", "up"), "trie-sums"), []
    while True:
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(*(F.sum(s).alias(f"__{s}") for s in sums), F.lit(True).alias("__below"))
        above = now.select(F.col("node").alias("__up"), F.col("up").alias("__further"))
        key = F.coalesce(F.col("up"), -1 - F.col("node"))  # where there is none above: a key of its own, that meets nothing
        met = now.join(below, "node", "left").withColumn("__key", key).join(above, F.col("__key") == F.col("__up"), "left")
        rest = [c for c in now.columns if c not in ("up", *sums)]
        new = staged(met.select(*rest, F.col("__further").alias("up"), *((F.col(s) + F.coalesce(f"__{s}", F.lit(0))).alias(s) for s in sums), (F.col("up").isNull() & F.col("__below").isNull()).alias("__done")), "trie-sums")
        done.append(new.where("__done").drop("__done", "up"))
        now = new.where("not __done").drop("__done")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, digest, chars) with ``members`` (conv_id: all conversations).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found, _ = prefixes(turns)
    found = staged(found, "trie-nodes-of")
    last = found.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = members.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(0)).alias("node"))
    nodes = staged(found.groupBy("node").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "trie-nodes")
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    deep = nodes.where("depth > 1").join(above, ["conv_id", "depth"]).withColumnRenamed("above", "parent")
    first = nodes.where("depth = 1").withColumn("parent", F.lit(0).cast("long"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("parent"))
    linked = staged(deep.unionByName(first).unionByName(root), "trie-linked")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    up = linked.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = known.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("chars")})
    sums = subtree_sums(own.drop("chars"), ["n_leaves", "saved_tokens"])
    of_parent = linked.where("parent is not null").select("node", "parent").join(up, "parent").drop("parent")
    out = sums.join(of_parent, "node", "left").join(id_digests(ends), "node", "left")
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark, sf_dir):
    placed = in_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(rebuilt(placed), placed.select("conv_id").distinct())


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
#: crc32 as a fold over bytes, each followed by eight shifts (-1).
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6"""
SQL = {
    "op12_prefix_trie": f"""WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
 ids AS (SELECT c, {CRC} AS h FROM (SELECT DISTINCT c FROM own)),
 parts AS (SELECT ids.c, 0 AS part, p, role, text FROM ids JOIN own ON own.c = ids.c - ids.c % 100 AND p < h UNION ALL SELECT ids.c, 1, p, role, text FROM ids JOIN own ON own.c = ids.c AND p >= h),
 whole AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY part, p) AS t FROM parts GROUP BY c),
 pre AS (SELECT c, d, list_slice(coalesce(t, []), 1, d) AS path, d = coalesce(len(t), 0) AS last FROM (SELECT ids.c, t, unnest(range(coalesce(len(t), 0) + 1)) AS d FROM ids LEFT JOIN whole USING (c))),
 nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends FROM pre GROUP BY path, d),
 of AS (SELECT c, pre.d, conv_id FROM pre JOIN nodes USING (path, d)),
 up AS (SELECT n.conv_id, n.d, o.conv_id AS parent_conv_id FROM nodes n LEFT JOIN of o ON o.c = n.conv_id AND o.d = n.d - 1),
 kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2),
 known AS (SELECT n.*, parent_conv_id, coalesce(n_children, 0) AS n_children FROM nodes n JOIN up USING (conv_id, d) LEFT JOIN kids USING (conv_id, d)),
 sums AS (SELECT o.conv_id, o.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN k.d > 0 THEN (n_convs - 1) * length(k.path[k.d].text) ELSE 0 END) AS saved FROM known k JOIN of o ON o.c = k.conv_id AND o.d <= k.d GROUP BY 1, 2)
 SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM known JOIN sums USING (conv_id, d)"""
}
