"""Connected components of an edge table by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b: long) can reach.

    Every round each node takes the smallest label among its neighbours, then the label of its label, so
    rounds grow with the logarithm of the longest path.  Partial aggregation keeps hot nodes small."""
    spark = edges.sparkSession
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = staged(best.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "cc-labels")
        changed = new.where("old <> label").limit(1).count()
        release(spark, labels)
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    release(spark, both)
    return labels
