"""Overlaps of page regions against all pairs."""

import random

import numpy as np
import pytest

from glyphmill.operators import regions as R

SCHEMA = "id long, page int, x0 long, y0 long, x1 long, y1 long, cx int"


def boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(-50_000, 1_000_000), rng.randrange(0, 1_000_000)
        out.append((i, rng.choice([1, 1, 1, 2, 3]), x, y, x + rng.choice([0, 1, 62_500, 400_000, -5]), y + rng.choice([1, 62_500, 900_000]), 7))
    return [*out, (900, None, 0, 0, 9, 9, 7), (901, 1, None, 0, 9, 9, 7), (902, 1, 0, 0, 1_000_000, 1_000_000, 7), (903, 2, 62_500, 62_500, 125_000, 125_000, 7), (None, 1, 0, 0, 9, 9, 7)]


def brute(a, b):
    out = []
    for i, p, *s in a:
        for j, q, *t in b:
            if None in (i, j, p, q, *s, *t) or p != q:
                continue
            s1, t1 = ([max(0, min(1_000_000, v)) for v in x[:4]] for x in (s, t))
            if any(x[0] >= x[2] or x[1] >= x[3] for x in (s1, t1)):
                continue
            wide, tall = min(s1[2], t1[2]) - max(s1[0], t1[0]), min(s1[3], t1[3]) - max(s1[1], t1[1])
            if wide > 0 and tall > 0:
                out.append((i, j, wide * tall))
    return sorted(out)


@pytest.mark.parametrize("grid", [1, 3, 16])
def test_overlaps_and_resolution(spark, grid):
    a, b = boxes(1, 120), boxes(2, 90)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    pairs = R.overlaps(da, db, grid)
    assert sorted((r["h_id"], r["r_id"], r["overlap"]) for r in pairs.collect()) == brute(a, b)
    best = {}
    for i, j, o in brute(a, b):
        best[i] = min(best.get(i, (0, 0)), (-o, j))
    assert {r["handle_id"]: (-r["overlap"], r["region_id"]) for r in R.resolved(da, db, grid).collect()} == best
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    assert R.resolved(da.limit(0), db).count() == 0 and R.resolved(da.where("id = 902"), db, least=0.99).count() <= 1


def test_resolution_in_cut_pages(spark):
    a, b = boxes(3, 300), boxes(4, 400)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    best = {}
    for i, j, o in brute(a, b):
        best[i] = min(best.get(i, (0, 0)), (-o, j))
    for rows in (1, 40):
        assert {r["handle_id"]: (-r["overlap"], r["region_id"]) for r in R.resolved(da, db, rows=rows).collect()} == best


def test_best_regions_are_found_without_all_pairs(monkeypatch):
    """Four times the page: about four times the work, not sixteen times."""
    rng, seen = np.random.default_rng(5), []
    most = R._most
    monkeypatch.setattr(R, "_most", lambda h, r: seen.append(len(h)) or most(h, r))

    def made(n, wide, tall):
        low = rng.integers(0, 900_000, (n, 2))
        return np.column_stack([low, low + [wide, tall]])

    work = []
    for n in (2_000, 8_000):
        h, r, ids = made(n, 60_000, 90_000), made(n, 120_000, 45_000), rng.permutation(n)
        seen.clear()
        best, found = R.best_regions(h, r, ids)
        work.append(sum(seen))
        for i in range(0, n, 97):
            each = np.maximum(0, np.minimum(h[i, 2], r[:, 2]) - np.maximum(h[i, 0], r[:, 0])) * np.maximum(0, np.minimum(h[i, 3], r[:, 3]) - np.maximum(h[i, 1], r[:, 1]))
            assert best[i] == each.max() and (not best[i] or found[i] == ids[each == best[i]].min())
    assert work[1] < 6 * work[0]
