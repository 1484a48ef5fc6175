"""Embedding near-dedup: dual traversal of cover trees, with exact threshold pairs.

Vectors are points of the unit sphere; a cosine of c or more is a distance of t = sqrt(2 - 2 c) or less.  Equal
vectors of a label are one class with a weight.  Classes go to cells: those nearest to one pivot, in order of
distance, at most CELL to a cell.  A cell is the top of a cover tree: nested levels, in each of which the radius
is half of that above, a centre is its own first child, and centres of one node are more than the radius apart.
Nodes keep the true distance to their farthest row.  Two trees are walked level by level, both at once: a pair of nodes is
dropped where centres are farther apart than both radii and t, linked as a whole where centres and both radii
are within t, and opened otherwise; what is left at the rows is compared by cosine in double precision.

Pairs of cells meet by label, on centres and radii alone; rows travel only where these do not decide.  Links are
counted by weights and joined to components, so no list of pairs is made.  Pivots are a sample of PIVOTS rows at most, all
rows are in cells, and pivots decide only how cells lie, not what is found.  Where vectors of a label are in no
groups at all, as random ones of many dimensions are, no bound can drop anything before the radii are small, and
all cells of a label meet.

Defined results: ids and labels are whole numbers; one row an id; rows of one id are one vector, its smallest label and vector that take part; null
labels, vectors null, zero, or with null or non-finite components link with nothing and are kept; vectors are
compared with those of their length only; rows without id are returned once, with null component and kept; other
columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import release, staged, table
from .graph import components
from .vectors import sound

CELL, PIVOTS = 4096, 4096
#: Slack of bounds: far above rounding, so that rounding decides nothing before rows are compared.
SLACK = 1e-6
#: Cosines this near to the threshold are taken again from the vectors as given, with exact sums.
NEAR = 1e-10
BLOCK = 256
DROPPED, OPEN, LINKED = 0, 1, 2


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two vectors, each sum rounded once."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


def apart(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class Tree:
    """A cover tree over the rows of a matrix.  Rows are put in order, so that each node is a run of rows and begins
    with its centre; ``starts`` and ``radii`` have an array a level, the last level being the rows themselves."""

    def __init__(self, given: np.ndarray, starts: list[np.ndarray], radii: list[np.ndarray]):
        self.given, self.rows, self.starts, self.radii = given, unit(given.astype(float)), starts, radii

    @classmethod
    def grow(cls, given: np.ndarray, least: float) -> tuple[Tree, np.ndarray]:
        """The tree of ``given`` and the order in which it has its rows; levels end at radius ``least``."""
        rows = unit(given.astype(float))
        nodes, starts, radius = [np.arange(len(rows))], [], 2.0
        levels: list[list[np.ndarray]] = [nodes]
        while radius > least and any(len(n) > 1 for n in nodes):
            radius /= 2
            nodes = [child for n in nodes for child in (cls._split(rows, n, radius) if len(n) > 1 else [n])]
            levels.append(nodes)
        levels.append([np.array([i]) for n in nodes for i in n])
        order = np.concatenate(nodes)
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        starts = [place[[n[0] for n in level]] for level in levels]
        return cls(given[order], starts, [cls._radii(rows[order], s) for s in starts]), order

    @staticmethod
    def _split(rows: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
        """Members by the nearest of greedily chosen centres, of which the first is the node's own."""
        own, cover = rows[members], 1.0 - radius * radius / 2.0
        chosen = np.zeros(len(members), dtype=np.int64)
        centres, n, to = np.empty_like(own), 0, np.zeros(len(members), dtype=np.int64)
        for at in range(0, len(members), BLOCK):
            block = own[at : at + BLOCK]
            cos = block @ centres[:n].T if n else np.full((len(block), 1), -2.0)
            near, best = cos.argmax(axis=1), cos.max(axis=1)
            while (open_rows := np.flatnonzero(best < cover)).size:
                i = open_rows[0]
                centres[n], chosen[n] = block[i], at + i
                cos = block @ block[i]
                cos[i] = 2.0
                closer = cos > best
                near[closer], best[closer] = n, cos[closer]
                n += 1
            to[at : at + BLOCK] = near
        to[chosen[:n]] = np.arange(n)
        order = np.argsort(to, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
        return [members[np.concatenate([[c], p[p != c]])] for c, p in zip(chosen[:n], parts, strict=True)]

    @staticmethod
    def _radii(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        centre = np.repeat(starts, np.diff(np.append(starts, len(rows))))
        far = apart(np.einsum("ij,ij->i", rows, rows[centre]))
        far[starts] = 0.0
        return np.maximum.reduceat(far, starts)

    def above(self, level: int) -> np.ndarray:
        """For each node of a level, its parent's number."""
        return np.searchsorted(self.starts[level - 1], self.starts[level], side="right") - 1


def links(a: Tree, b: Tree, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of ``threshold`` or more.  Both trees go down together; one that has
    no more levels stays at its rows."""
    t = math.sqrt(2.0 - 2.0 * threshold)
    state = np.full((1, 1), OPEN, dtype=np.int8)
    depth = max(len(a.starts), len(b.starts))
    for level in range(depth):
        at = [min(level, len(x.starts) - 1) for x in (a, b)]
        if level:
            if level == at[0]:
                state = state[a.above(level)]
            if level == at[1]:
                state = state[:, b.above(level)]
        x, y = a.rows[a.starts[at[0]]], b.rows[b.starts[at[1]]]
        rx, ry = a.radii[at[0]], b.radii[at[1]]
        rows_only = level == depth - 1
        for i in range(0, len(x), BLOCK):
            part = state[i : i + BLOCK]
            open_rows, open_cols = np.flatnonzero((part == OPEN).any(axis=1)), np.flatnonzero((part == OPEN).any(axis=0))
            if not len(open_rows):
                continue
            here = np.ix_(open_rows, open_cols)
            cos, now = x[i + open_rows] @ y[open_cols].T, part[here]
            is_open = now == OPEN
            if rows_only:
                met = cos >= threshold
                for p, q in zip(*np.nonzero(is_open & (np.abs(cos - threshold) < NEAR)), strict=True):
                    met[p, q] = cosine(a.given[i + open_rows[p]].astype(float), b.given[open_cols[q]].astype(float)) >= threshold
                now[is_open] = np.where(met[is_open], LINKED, DROPPED)
            else:
                far, reach = apart(cos), rx[i + open_rows][:, None] + ry[open_cols][None, :]
                now[is_open & (far > reach + t + SLACK)] = DROPPED
                now[is_open & (far + reach < t - SLACK)] = LINKED
            part[here] = now
    return state == LINKED


def groups(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a table of links; each row and column is opened once."""
    free = linked.any(axis=1)
    seen = np.zeros(linked.shape[1], dtype=bool)
    while free.any():
        rows = front = np.array([free.argmax()])
        free[rows] = False
        cols: list[np.ndarray] = []
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[new] = True
            cols.append(new)
            front = np.flatnonzero(linked[:, new].any(axis=1) & free)
            free[front] = False
            rows = np.append(rows, front)
        yield rows, np.concatenate(cols)


TREE = "cell string, label long, dim int, weight long, centre array<double>, radius double, reps array<long>, weights array<long>, rows array<double>, starts array<array<int>>, radii array<array<double>>"


def grown(cells: DataFrame, threshold: float) -> DataFrame:
    """One row a cell with its tree.  cells: cell, label, dim, rep, w, v; at most CELL rows a cell."""
    least = math.sqrt(2.0 - 2.0 * threshold) / 8

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep").combine_chunks()
        given = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        tree, order = Tree.grow(given, least)
        weights = t["w"].to_numpy()[order]
        row = {"cell": t["cell"][0].as_py(), "label": t["label"][0].as_py(), "dim": given.shape[1], "weight": int(weights.sum()), "centre": tree.rows[0], "radius": float(tree.radii[0][0]), "reps": t["rep"].to_numpy()[order], "weights": weights, "rows": tree.given.ravel()}
        return pa.Table.from_pylist([row | {"starts": [s.astype(np.int32) for s in tree.starts], "radii": tree.radii}], schema=wanted)

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<array<int>>": pa.list_(pa.list_(pa.int32())), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    wanted = pa.schema([(c.split()[0], types[c.split()[1]]) for c in TREE.split(", ")])
    return cells.groupBy("cell").applyInArrow(grow, TREE)


def in_cells(classes: DataFrame, cell: int, pivots: int) -> DataFrame:
    """``classes`` (rep, w, label, dim, v) with the cell of each; a cell has at most ``cell`` rows of one label and length."""
    n = classes.count()
    want = min(pivots, -(-n // cell))
    hashed = classes.select("label", "dim", "v", F.xxhash64("rep").alias("h"))
    few = hashed.where(F.pmod("h", F.lit(max(1, n // (4 * want + 1)))) == 0)  # about four times as many, over all tasks
    sample = few.orderBy("h").limit(want).collect()
    by: dict[tuple, list[int]] = {}
    for i, r in enumerate(sample):
        by.setdefault((r["label"], r["dim"]), []).append(i)
    sent = classes.sparkSession.sparkContext.broadcast({k: (np.array(i), unit(np.array([sample[j]["v"] for j in i], dtype=float))) for k, i in by.items()})

    @F.pandas_udf("pivot long, far double")
    def nearest(label, dim, v):
        import pandas as pd

        pivot, far = np.full(len(v), -1), np.zeros(len(v))
        keys = list(zip(label, dim, strict=True))
        for key in set(keys):
            if key in sent.value:
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                numbers, centres = sent.value[key]
                cos = unit(np.array([v[i] for i in rows], dtype=float)) @ centres.T
                pivot[rows], far[rows] = numbers[cos.argmax(axis=1)], apart(cos.max(axis=1))
        return pd.DataFrame({"pivot": pivot, "far": far})

    near = classes.withColumn("near", nearest("label", "dim", "v")).select("*", "near.pivot", "near.far").drop("near")
    placed = numbered(near, ["far", "rep"], ["label", "dim", "pivot"], "place")
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in ("label", "dim", "pivot")), F.expr(f"place div {cell}").cast("string"))
    return placed.select(name.alias("cell"), "label", "dim", "rep", "w", "v")


def cell_pairs(trees: DataFrame, threshold: float) -> DataFrame:
    """a, b, verdict (OPEN or LINKED) of cells of one label and length, each pair once, by centres and radii."""
    t = math.sqrt(2.0 - 2.0 * threshold)
    one = trees.select("label", "dim", F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    other = trees.select("label", "dim", F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    both = one.join(other, ["label", "dim"]).where("a <= b")
    far = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y))
    met = both.select("a", "b", far.alias("far"), (F.col("ra") + F.col("rb")).alias("reach"))
    verdict = F.when(F.col("far") > F.col("reach") + t + SLACK, DROPPED).when(F.col("far") + F.col("reach") < t - SLACK, LINKED).otherwise(OPEN)
    return met.select("a", "b", verdict.alias("verdict")).where(F.col("verdict") != DROPPED)


def walked(pairs: DataFrame, trees: DataFrame, threshold: float) -> DataFrame:
    """rep, n, label of each row that has links between two cells: links counted by weight, smallest id of those joined there."""
    parts = ["dim", "reps", "weights", "rows", "starts", "radii"]
    side = lambda s: trees.select(F.col("cell").alias(s), F.struct(*parts).alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select((F.col("a") == F.col("b")).alias("same"), "ta", "tb")

    def tree(x) -> tuple[Tree, np.ndarray, np.ndarray]:
        array = lambda v: v.values.to_numpy(zero_copy_only=False)
        built = Tree(array(x["rows"]).reshape(-1, x["dim"].as_py()), [array(s) for s in x["starts"]], [array(r) for r in x["radii"]])
        return built, array(x["reps"]), array(x["weights"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, ia, wa), same = tree(batch.column(1)[i]), batch.column(0)[i].as_py()
                b, ib, wb = (a, ia, wa) if same else tree(batch.column(2)[i])
                met = links(a, b, threshold)
                la, lb = ia.copy(), ib.copy()
                for p, q in groups(met):
                    la[p] = lb[q] = min(ia[p].min(), ib[q].min())
                found = [(ia, la, met, wb)] if same else [(ia, la, met, wb), (ib, lb, met.T, wa)]
                for ids, label, table_, weights in found:
                    keep = np.flatnonzero(table_.any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(table_[keep] @ weights), pa.array(label[keep])], ["rep", "n", "label"])

    return both.mapInArrow(walk, "rep long, n long, label long")


def near_dedup(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector of ``df``; links: equal labels, cosine of ``threshold`` or more."""
    if not 0.0 < threshold <= 1.0 - 1e-9:
        raise ValueError("the threshold must be above 0 and below 1")
    spark = df.sparkSession
    v, whole = F.col(vec), F.col(label).cast("long")
    fit = sound(v) & F.exists(v, lambda x: x != 0) & whole.isNotNull() & F.col(vec_id).isNotNull()
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.when(fit, F.struct(whole.alias("label"), v.alias("v"))).alias("x"))
    once = rows.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.v")
    key = F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)))
    once = staged(once.withColumn("key", key), "near-rows")
    classes = once.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("dim", F.size("v")), "near-classes")
    trees = staged(grown(in_cells(classes.drop("key"), cell, pivots), threshold), "near-trees")
    pairs = staged(cell_pairs(trees, threshold), "near-cells")
    found = staged(walked(pairs.where(F.col("verdict") == OPEN).select("a", "b"), trees, threshold), "near-links")

    whole_cells = pairs.where(F.col("verdict") == LINKED)
    ends = whole_cells.select(F.col("a").alias("cell"), F.col("b").alias("other")).union(whole_cells.where("a <> b").select("b", "a"))
    of_cell = trees.select(F.col("cell").alias("other"), "weight", F.col("reps")[0].alias("first"))
    gained = ends.join(of_cell, "other").groupBy("cell").agg(F.sum("weight").alias("n"), F.min("first").alias("first"))
    inside = gained.join(trees.select("cell", "reps"), "cell").select(F.explode("reps").alias("rep"), "n", "first")
    inside = staged(inside, "near-whole")

    counts = found.select("rep", "n").unionByName(inside.select("rep", "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("rep").alias("a"), F.col("label").alias("b")).union(inside.select("rep", "first")).where("a <> b")
    labels = components(edges).select(F.col("node").alias("rep"), "label")
    settled = classes.select("key", "rep").join(counts, "rep", "left").join(labels.withColumnRenamed("label", "low"), "rep", "left")
    settled = settled.select("key", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("low", "rep").alias("component"))
    out = once.select("id", "key").join(settled, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), (F.coalesce("n", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op13_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_near_dedup": op13_near_dedup}
DOT = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93"
SQL = {
    "op13_near_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 fit AS (SELECT * FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE {DOT}),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
 SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
}
