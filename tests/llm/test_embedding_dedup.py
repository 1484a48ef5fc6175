"""Embedding near-dedup against brute force."""

import itertools

import numpy as np
import pytest

from glyphmill.llm import embedding_dedup as N

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, cell int"


def brute(rows, threshold):
    ok, ids = {}, set()
    for i, v, label, *_ in rows:
        ids.add(i)
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            ok[i] = (label, np.array(v, dtype=np.float32).astype(float))
    low, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(ok), 2):
        if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and N.cosine(ok[a][1], ok[b][1]) >= threshold:
            n[a], n[b] = n[a] + 1, n[b] + 1
            x, y = sorted((top(a), top(b)))
            low[y] = x
    return sorted(((i, n[i], top(i), top(i) == i) for i in ids if i is not None))


def vectors(seed, n, dim, clusters, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    out = []
    for _ in range(n):
        c = centres[min(clusters - 1, rng.integers(0, 2 * clusters) // 2 if rng.random() < 0.6 else 0)]
        out.append((c + rng.normal(size=dim) * spread * rng.choice([0.1, 0.5, 1.0])) * rng.choice([0.01, 1, 30]))
    return np.array(out)


@pytest.mark.parametrize(("dim", "spread", "threshold"), [(3, 0.3, 0.93), (16, 0.3, 0.93), (64, 0.25, 0.93), (8, 1.0, 0.5), (2, 0.05, 0.999)])
def test_walk_finds_exactly_the_links(dim, spread, threshold):
    a, b = vectors(1, 300, dim, 6, spread), vectors(1, 190, dim, 6, spread)[40:] + 0.001
    least = np.sqrt(2 - 2 * threshold) / 8
    (ta, oa), (tb, ob) = N.Tree.grow(a, least), N.Tree.grow(b, least)
    assert sorted(oa) == list(range(len(a)))
    for x, y in ((ta, tb), (tb, ta), (ta, ta)):
        want = N.unit(x.given) @ N.unit(y.given).T >= threshold
        assert (N.links(x, y, threshold) == want).all()


def test_tree_is_nested_and_covers():
    rows = vectors(2, 500, 12, 5, 0.4)
    tree, _ = N.Tree.grow(rows, 0.05)
    for level in range(1, len(tree.starts)):
        assert set(tree.starts[level - 1]) <= set(tree.starts[level])
        if level < len(tree.starts) - 1:
            assert tree.radii[level].max() <= 2.0 / 2**level + 1e-6
    assert len(tree.starts[-1]) == 500 and tree.radii[-1].max() == 0


def test_groups():
    linked = np.zeros((5, 6), dtype=bool)
    for i, j in ((0, 1), (1, 1), (1, 2), (3, 4)):
        linked[i, j] = True
    assert [(sorted(r), sorted(c)) for r, c in N.groups(linked)] == [([0, 1], [1, 2]), ([3], [4])]


@pytest.mark.parametrize(("cell", "pivots"), [(4096, 4096), (17, 8), (5, 1)])
def test_near_dedup(spark, cell, pivots):
    v = vectors(3, 260, 10, 4, 0.3)
    rows = [(i, [float(x) for x in v[i]], int(i % 3 == 0), "r", 1) for i in range(260)]
    rows += [(300 + i, rows[4][1], rows[4][2], "r", 1) for i in range(30)]  # copies
    rows += [(400, None, 1, "r", 1), (401, rows[0][1], None, "r", 1), (402, [0.0] * 10, 0, "r", 1), (403, [float("nan")] * 10, 0, "r", 1), (404, [None] * 10, 0, "r", 1), (405, [float("inf")] + [0.0] * 9, 0, "r", 1)]
    rows += [(500, rows[1][1][:4], rows[1][2], "r", 1), (501, rows[1][1][:4], rows[1][2], "r", 1), rows[3], rows[5], (-7, rows[0][1], rows[0][2], "r", 1), (502, [], 0, "r", 1)]
    got = N.near_dedup(spark.createDataFrame(rows, SCHEMA), 0.93, cell=cell, pivots=pivots).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 0.93)


def test_null_id_empty_table_and_threshold(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, "r", 1), (None, [1.0, 0.0], 1, "r", 1), (2, [1.0, 0.0], 1, "r", 1)], SCHEMA)
    assert sorted((tuple(r) for r in N.near_dedup(df).collect()), key=str) == [(2, 0, 2, True), (None, 0, None, None)]
    assert N.near_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.near_dedup(df, 1.0)
