"""The Bloom filter of the URL filter: built in tasks, of bounded size, and never the reason for a different verdict."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import url_filter as U


@pytest.mark.parametrize(("n", "most"), [(1, 1 << 20), (700, 1 << 20), (200_000, 1 << 20), (5_000, 10), (5_000, 1)])
def test_built_in_tasks_as_at_once(spark, n, most):
    hashes = spark.range(n).select(F.xxhash64("id").alias("h"))
    bloom = U.BlockedBloom.built(hashes, n, most)
    listed = np.array([r["h"] for r in hashes.collect()], dtype=np.int64)
    assert len(bloom.blocks) == max(1, min(most, -(-n * 16 // 256))) and bloom.might_hold(listed).all()
    if len(bloom.blocks) == -(-n * 16 // 256):
        assert (bloom.blocks == U.BlockedBloom.of(listed).blocks).all()


def test_many_rules_in_a_small_filter(spark, monkeypatch):
    monkeypatch.setattr(U.BlockedBloom, "built", classmethod(lambda cls, h, n, built=U.BlockedBloom.built.__func__: built(cls, h, n, 2)))
    rules = spark.range(3_000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    urls = spark.createDataFrame([(i, f"http://w.h{i}.org/x") for i in range(2_900, 3_100)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(urls, rules).collect()}
    assert got == {i: "block" if i < 3_000 else "allow" for i in range(2_900, 3_100)}
