"""Content-addressed objects: put, verify, roots, reachability, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def object_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def put(contents: DataFrame, known: DataFrame | None = None, content: str = "content") -> DataFrame:
    """object_id, byte_length, content of the distinct contents that are not known yet."""
    new = contents.where(F.col(content).isNotNull()).select(object_id(F.col(content)).alias("object_id"), F.octet_length(content).cast("long").alias("byte_length"), F.col(content).alias("content"))
    new = new.dropDuplicates(["object_id"])
    return new.join(known, "object_id", "left_anti") if known is not None else new


def verified(objects: DataFrame) -> DataFrame:
    """Objects whose content still has their id and length."""
    return objects.where((object_id(F.col("content")) == F.col("object_id")) & (F.octet_length("content") == F.col("byte_length")))


def roots(*references: tuple[DataFrame, str, str]) -> DataFrame:
    """object_id and the sorted set of reasons it is referred to for: (table, column, reason) each."""
    parts = [t.where(F.col(c).isNotNull()).select(F.col(c).alias("object_id"), F.lit(r).alias("reason")) for t, c, r in references]
    return reduce(DataFrame.union, parts).groupBy("object_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def reachability(root: DataFrame, inventory: DataFrame) -> DataFrame:
    """reachable, candidate (nothing refers to it), missing or corrupt for each object."""
    r = root.select("object_id", F.lit(True).alias("r")).distinct()
    i = inventory.select("object_id", "sound", F.lit(True).alias("i"))
    state = F.when(F.col("i").isNull(), "missing").when(~F.col("sound"), "corrupt").when(F.col("r").isNull(), "candidate").otherwise("reachable")
    return r.join(i, "object_id", "full").select("object_id", state.alias("state"))


def retention(inventory: DataFrame, root: DataFrame, holds: DataFrame, now: Column, least_age_days: int) -> DataFrame:
    """protected, held, recent, quarantined or candidate, with the reasons that protect it."""
    r = roots_as_text(root)
    h = holds.select("object_id", F.lit(True).alias("h")).distinct()
    young = F.col("stored_at") > now - F.expr(f"INTERVAL {least_age_days} DAYS")
    state = F.when(F.col("quarantined"), "quarantined").when(F.col("reasons").isNotNull(), "protected").when(F.col("h"), "held").when(young, "recent").otherwise("candidate")
    return inventory.join(r, "object_id", "left").join(h, "object_id", "left").select("object_id", state.alias("state"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def roots_as_text(root: DataFrame) -> DataFrame:
    return root.select("object_id", F.array_join("reasons", ",").alias("reasons"))
