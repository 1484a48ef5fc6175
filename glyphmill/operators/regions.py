"""Regions of pages: which ones overlap, and which one a handle resolves to.

Each region is listed under the cells of a grid that it touches, so that regions meet on (page, cell) and a full page is
many keys; the exact overlap is tested after it.  In ``overlaps`` a pair that shares several cells counts in the one that
holds the lower corner of their overlap, so none is told twice and nothing has to be made distinct.

``resolved`` wants one region a handle and does not list pairs, whose number grows with the square of a page.  Pages are
cut into more cells the more they hold.  In a cell the regions are taken in order of id, in runs that double; each run is
a tree of bounds, of which a handle only enters what may overlap it more than the best before.  What is as good later on
has a larger id and cannot win, so a handle is done when nothing can overlap it more.

Regions: id, page, x0, y0, x1, y1 in millionths of the page (far sides are outside).

Defined results: null sides or pages, empty and reversed regions overlap nothing; regions that only touch do not
overlap; repeated ids are regions of their own; of equal overlaps the smaller id resolves; parts outside the page are
cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = 1_000_000
#: Cells along a side of a page.
GRID = 16
#: Rows that a cell is to hold on average; a page has one cell up to there, and GRID * GRID at most.
CELL_ROWS = 1 << 18
#: Regions of the first run, children of a node, and handles and nodes that are compared at a time.
RUN, FANOUT, AT_ONCE = 64, 8, 1 << 18
SIDES = ["x0", "y0", "x1", "y1"]
#: More than the cells along a side.
GRID_KEY = 1 << 20


def in_cells(regions: DataFrame, prefix: str, grid: int | Column) -> DataFrame:
    """Each region once for every cell that it touches; columns other than page and cell get the prefix."""
    size = F.ceil(F.lit(WHOLE) / grid)
    held = {c: F.greatest(F.lit(0), F.least(F.lit(WHOLE), F.col(c))).cast("long") for c in SIDES}
    sound = regions.where("page is not null and id is not null").withColumns(held).where("x0 < x1 and y0 < y1")
    along = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))
    rows = sound.withColumn("cx", F.explode(along("x0", "x1"))).withColumn("cy", F.explode(along("y0", "y1")))
    return rows.select("page", "cx", "cy", *(F.col(c).alias(f"{prefix}{c}") for c in regions.columns if c != "page"))


def overlaps(handles: DataFrame, regions: DataFrame, grid: int = GRID) -> DataFrame:
    """page, h_*, r_*, overlap (in millionths squared) of all pairs of one page that overlap."""
    size = -(-WHOLE // grid)
    met = in_cells(handles, "h_", grid).join(in_cells(regions, "r_", grid), ["page", "cx", "cy"])
    low = {a: F.greatest(f"h_{a}", f"r_{a}") for a in ("x0", "y0")}
    high = {a: F.least(f"h_{a}", f"r_{a}") for a in ("x1", "y1")}
    wide, tall = high["x1"] - low["x0"], high["y1"] - low["y0"]

    def here(cell: str, corner: Column) -> Column:
        return F.floor(corner / size) == F.col(cell)

    once = met.where((wide > 0) & (tall > 0) & here("cx", low["x0"]) & here("cy", low["y0"]))
    return once.withColumn("overlap", wide * tall).drop("cx", "cy")


def _interleaved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places along a curve that keeps near points near."""
    out = np.zeros(len(x), dtype=np.int64)
    for bit in range(10):
        out |= ((x >> bit) & 1) << (2 * bit) | ((y >> bit) & 1) << (2 * bit + 1)
    return out


def _tree(sides: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Levels from the root down; a row holds the smallest id, x0 and y0 of its children and their largest x1, y1, width and height."""
    order = np.argsort(_interleaved((sides[:, 0] + sides[:, 2]) * 1023 // (2 * WHOLE), (sides[:, 1] + sides[:, 3]) * 1023 // (2 * WHOLE)), kind="stable")
    sides = sides[order]
    levels = [np.column_stack([ids[order], sides, sides[:, 2] - sides[:, 0], sides[:, 3] - sides[:, 1]])]
    while len(levels[-1]) > 1:
        at = np.arange(0, len(levels[-1]), FANOUT)
        levels.append(np.column_stack([np.minimum.reduceat(levels[-1][:, :3], at), np.maximum.reduceat(levels[-1][:, 3:], at)]))
    return levels[::-1]


def _most(h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """What handles overlap with regions, or at most with a region below nodes."""
    wide = np.minimum(np.minimum(h[:, 2], r[:, 3]) - np.maximum(h[:, 0], r[:, 1]), r[:, 5])
    tall = np.minimum(np.minimum(h[:, 3], r[:, 4]) - np.maximum(h[:, 1], r[:, 2]), r[:, 6])
    return np.where((wide > 0) & (tall > 0), wide * tall, 0)


def best_regions(handles: np.ndarray, regions: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest overlap, smallest id of the regions that have it) of each handle; overlap 0 where there is none."""
    by_id = np.argsort(ids, kind="stable")
    regions, ids = regions[by_id], ids[by_id]
    best, found = np.zeros(len(handles), dtype=np.int64), np.zeros(len(handles), dtype=np.int64)
    lo, size = 0, RUN
    while lo < len(ids):
        levels = _tree(regions[lo : lo + size], ids[lo : lo + size])
        before = best.copy()  # what is no better than in earlier runs has a larger id
        every = np.flatnonzero(before < (handles[:, 2] - handles[:, 0]) * (handles[:, 3] - handles[:, 1]))
        waiting = [(0, every, np.zeros(len(every), dtype=np.int64))]
        while waiting:
            depth, h, node = waiting.pop()
            if len(h) > AT_ONCE:
                half = len(h) // 2
                waiting += [(depth, h[half:], node[half:]), (depth, h[:half], node[:half])]
                continue
            most, least_id = _most(handles[h], levels[depth][node]), levels[depth][node, 0]
            keep = (most > before[h]) & ((most > best[h]) | (most == best[h]) & (least_id < found[h]))
            h, node, most, least_id = h[keep], node[keep], most[keep], least_id[keep]
            if not len(h):
                continue
            if depth < len(levels) - 1:
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = child < len(levels[depth + 1])
                waiting.append((depth + 1, np.repeat(h, FANOUT)[real], child[real]))
                continue
            order = np.lexsort((least_id, -most, h))
            one = order[np.r_[True, h[order][1:] != h[order][:-1]]]
            best[h[one]], found[h[one]] = most[one], least_id[one]
        lo, size = lo + size, size * 2
    return best, found


def _matrix(table: pa.Table, prefix: str) -> np.ndarray:
    return np.column_stack([table.column(f"{prefix}{c}").to_numpy() for c in SIDES])


def _best_of_cell(handles: pa.Table, regions: pa.Table) -> pa.Table:
    best, found = best_regions(_matrix(handles, "h_"), _matrix(regions, "r_"), regions.column("r_id").to_numpy())
    some = np.flatnonzero(best)
    own = handles.take(pa.array(some))
    area = (own.column("h_x1").to_numpy() - own.column("h_x0").to_numpy()) * (own.column("h_y1").to_numpy() - own.column("h_y0").to_numpy())
    return pa.table({"handle_id": own.column("h_id"), "region_id": found[some], "overlap": best[some], "area": area})


def _grids(handles: DataFrame, regions: DataFrame, most: int, rows: int) -> DataFrame:
    """page, grid of the pages that are cut."""
    n = handles.select("page").unionAll(regions.select("page")).where("page is not null").groupBy("page").count()
    return n.where(F.col("count") > rows).select("page", F.least(F.lit(most), F.pow(2, F.ceil(F.log2(F.col("count") / rows) / 2))).cast("int").alias("grid"))


def resolved(handles: DataFrame, regions: DataFrame, grid: int = GRID, least: float = 0.0, rows: int = CELL_ROWS) -> DataFrame:
    """handle_id, region_id, overlap: for each handle that has any, the region it overlaps most, if that is at least this share of it.

    Ids are integers.  ``rows``: what a cell is to hold on average, in a page of ``grid`` * ``grid`` cells at most."""
    handles, regions = handles.select("id", "page", *SIDES), regions.select("id", "page", *SIDES)
    cut = _grids(handles, regions, grid, rows)

    def listed(df: DataFrame, prefix: str) -> DataFrame:
        named = df.join(cut, "page", "left").withColumn("grid", F.coalesce("grid", F.lit(1)))
        cells = in_cells(named, prefix, F.col("grid"))
        return cells.select("page", (F.col("cx") * GRID_KEY + F.col("cy")).alias("cell"), *(F.col(f"{prefix}{c}").cast("long").alias(f"{prefix}{c}") for c in ("id", *SIDES)))

    met = listed(handles, "h_").groupBy("page", "cell").cogroup(listed(regions, "r_").groupBy("page", "cell"))
    found = met.applyInArrow(_best_of_cell, "handle_id long, region_id long, overlap long, area long")
    enough = found.where(F.col("overlap") >= F.lit(least) * F.col("area"))
    best = enough.groupBy("handle_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col("region_id").alias("id"))).alias("b"))
    return best.select("handle_id", F.col("b.id").alias("region_id"), (-F.col("b.o")).alias("overlap"))
