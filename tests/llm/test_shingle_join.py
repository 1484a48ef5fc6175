"""Near-duplicate join: what is left to compare."""

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import shingle_join as J


def sets_of(rng, n: int, m: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
    return np.sort(x[:n]), np.sort(np.r_[x[:shared], x[n : n + m - shared]])


@pytest.mark.parametrize("size", [1, 3, 8, 60, 130, 700, 1030, 5000])
def test_parity_bits_lose_no_link(size):
    rng = np.random.default_rng(size)
    for m in {size, -(-size * 3 // 4), size * 4 // 3}:
        least = -(-3 * (size + m) // 7)
        if least > min(size, m):
            continue
        a, b = sets_of(rng, size, m, least)
        bits = J._Parity([pa.array([J.parity(a)], pa.binary()), pa.array([J.parity(b)], pa.binary())])
        x, y = np.array([0, 1]), np.array([1, 0])
        assert bits.may_match(x, y, np.array([size, m]), np.array([m, size])).all()


def test_dissimilar_members_of_a_large_group_make_no_pairs():
    """300 sets share a signature; but for two copies with one change none are similar: 44,850 pairs before."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 1 << 63, 60, dtype=np.uint64)]) for _ in range(299)]
    sets.append(np.r_[sets[7][1:], np.uint64(5)])
    sig = J._packed(np.full(300, 9, np.uint64), np.ones(300, np.int64))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(300, np.int32)), pa.array(np.arange(300)), pa.array(np.full(300, 100, np.int32)), sig, pa.array([J.parity(s) for s in sets], pa.binary()), pa.array(np.arange(300))],
        names=["bucket", "doc", "n", "sigs", "bits", "comp"],
    )
    found = [(r["a"], r["b"]) for out in J._pairs(None)(iter([batch.slice(0, 100), batch.slice(100)])) for r in out.to_pylist()]
    assert (7, 299) in found and len(found) < 20
