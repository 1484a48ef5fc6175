"""Derivation graphs: invalidation, ancestry and reactivation by joins to a fixpoint.

Each round joins the new frontier only, and writes it to the shared checkpoint folder, so plans stay short
and rounds survive lost executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged


def checkpointed(df: DataFrame) -> DataFrame:
    return staged(df, "lineage")


def closure(start: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """id: ``start`` (id) and all that its members reach over ``edges`` (a to b).  Each round is written once."""
    rounds = [checkpointed(start.select("id").distinct())]
    for _ in range(most):
        ahead = edges.join(rounds[-1], edges["a"] == rounds[-1]["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = checkpointed(ahead.join(reduce(DataFrame.union, rounds), "id", "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.union, rounds)
        rounds.append(frontier)
    raise RuntimeError("the closure did not settle")


def stale(nodes: DataFrame, dependencies: DataFrame, inactive: DataFrame) -> DataFrame:
    """Current artifacts that depend, over any number of steps, on an inactive input."""
    current = nodes.where("state = 'CURRENT'").select(F.col("artifact_id").alias("id"))
    direct = dependencies.join(inactive, "input_digest", "left_semi").select(F.col("artifact_id").alias("id"))
    edges = dependencies.where("producer_artifact_id is not null").select(F.col("producer_artifact_id").alias("a"), F.col("artifact_id").alias("b"))
    live = edges.join(current, edges["b"] == current["id"], "left_semi")
    return closure(direct.join(current, "id", "left_semi"), live)


def cyclic(new_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges (a, b) that would close a cycle: b already leads to a.  One closure for all new edges."""
    rounds = [checkpointed(new_edges.select("a", "b", F.col("b").alias("id")).distinct())]
    step = edges.select(F.col("a").alias("id"), F.col("b").alias("to"))
    while not rounds[-1].isEmpty():
        ahead = rounds[-1].join(step, "id").select("a", "b", F.col("to").alias("id")).distinct()
        rounds.append(checkpointed(ahead.join(reduce(DataFrame.union, rounds), ["a", "b", "id"], "left_anti")))
    return reduce(DataFrame.union, rounds).where("id = a").select("a", "b").distinct()


def reactivate(nodes: DataFrame, dependencies: DataFrame, active: DataFrame) -> DataFrame:
    """Stale artifacts of free slots whose inputs are all active or come from current ones, to a fixpoint."""
    current = checkpointed(nodes.where("state = 'CURRENT'").select("artifact_id", "slot"))
    waiting = nodes.where("state = 'STALE'").select("artifact_id", "slot")
    back = waiting.limit(0)
    while True:
        free = waiting.join(current, "slot", "left_anti")
        ok = dependencies.join(active.withColumn("__a", F.lit(True)), "input_digest", "left").join(current.select(F.col("artifact_id").alias("producer_artifact_id"), F.lit(True).alias("__p")), "producer_artifact_id", "left")
        whole = ok.groupBy("artifact_id").agg(F.bool_and(F.coalesce("__a", F.lit(False)) | F.coalesce("__p", F.lit(False))).alias("whole")).where("whole")
        ready = free.join(whole, "artifact_id", "left_semi").groupBy("slot").agg(F.max("artifact_id").alias("artifact_id")).select("artifact_id", "slot")
        ready = checkpointed(ready)
        if ready.isEmpty():
            return back.select("artifact_id")
        back, current = checkpointed(back.union(ready)), checkpointed(current.union(ready))


def current_dependencies(dependencies: DataFrame, heads: DataFrame, objects: DataFrame, producers: DataFrame) -> DataFrame:
    """artifact_id, current: whether every input is a head's, a verified object, or a current producer's output."""
    d = dependencies.join(heads.select("input_digest", F.lit(True).alias("h")).distinct(), "input_digest", "left")
    d = d.join(objects.select(F.col("object_id").alias("input_digest"), F.lit(True).alias("o")).distinct(), "input_digest", "left")
    p = producers.where("state = 'CURRENT'").select(F.col("artifact_id").alias("producer_artifact_id"), F.col("output").alias("input_digest"), F.lit(True).alias("p"))
    d = d.join(p, ["producer_artifact_id", "input_digest"], "left")
    holds = F.coalesce(*(F.when(F.col(x), True) for x in "hop"), F.lit(False))
    return d.groupBy("artifact_id").agg(F.bool_and(holds).alias("current"))


def latest_by_slot(published: DataFrame) -> DataFrame:
    """The newest artifact of each slot is current; the ones before are superseded."""
    newest = published.groupBy("slot").agg(F.max_by("artifact_id", F.struct("published_at", "artifact_id")).alias("newest"))
    return published.join(newest, "slot").withColumn("state", F.when(F.col("artifact_id") == F.col("newest"), "CURRENT").otherwise("SUPERSEDED")).drop("newest")
