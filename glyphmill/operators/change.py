"""Change processing in batch: file states, tombstones, renames, deltas, jobs.  streaming/ has the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_states(observations: DataFrame, stability_ms: int) -> DataFrame:
    """State of each path after each observation (path, seen_at, fingerprint; a null one: missing).

    A path is a candidate until its fingerprint has held for ``stability_ms``, then stable; missing paths
    are tombstoned.  ``since``: when its present fingerprint was first seen without a break."""
    w = W.partitionBy("path").orderBy("seen_at")
    breaks = F.when((F.row_number().over(w) > 1) & F.lag("fingerprint").over(w).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    runs = observations.withColumn("__b", breaks).withColumn("__run", F.sum("__b").over(w)).withColumn("__first", F.row_number().over(w))
    since = F.min("seen_at").over(W.partitionBy("path", "__run"))
    gone_before = F.lag("fingerprint").over(w).isNull() & (F.col("__first") > 1)
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    held = (millis("seen_at") - millis("since")) >= stability_ms
    state = F.when(F.col("fingerprint").isNull(), "TOMBSTONED").when(held, "STABLE").otherwise("CANDIDATE")
    event = (
        F.when(F.col("fingerprint").isNull() & (F.col("__b") == 1), "REMOVED").when(F.col("__first") == 1, "DISCOVERED")
        .when((F.col("__b") == 1) & F.col("__gone"), "REAPPEARED").when(F.col("__b") == 1, "CHANGED")
    )
    return runs.withColumn("since", since).withColumn("__gone", gone_before).select("path", "seen_at", "fingerprint", "since", state.alias("state"), event.alias("event"))


def tombstones(known: DataFrame, scanned: DataFrame, complete: bool) -> DataFrame:
    """Known paths that a complete scan did not meet; an incomplete scan says nothing about them."""
    return known.join(scanned.select("path"), "path", "left_anti").where(F.lit(complete)).select("path")


def scan_outcomes(known: DataFrame, scanned: DataFrame, scans: DataFrame) -> DataFrame:
    """root, outcome, tombstoned: of each scan (root, complete) how many known paths (path, root) it did not meet.

    A scan that broke off says nothing about what it did not meet: it asks for another one and buries nothing."""
    gone = known.join(scanned.select("path"), "path", "left_anti").groupBy("root").agg(F.count("*").alias("gone"))
    out = scans.join(gone, "root", "left")
    return out.select("root", F.when(F.col("complete"), "COMPLETE").otherwise("RESCAN_REQUIRED").alias("outcome"), F.when(F.col("complete"), F.coalesce("gone", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("tombstoned"))


def rename_hints(old: DataFrame, new: DataFrame) -> DataFrame:
    """(from_path, to_path): gone and new paths of one file identity, unique on both sides, with one fingerprint."""
    key = ["device", "inode"]
    once = lambda d: d.withColumn("__n", F.count("*").over(W.partitionBy(*key))).where("__n = 1").drop("__n")
    gone = once(old).join(new.select("path"), "path", "left_anti").select(*key, F.col("path").alias("from_path"), "fingerprint")
    come = once(new).join(old.select("path"), "path", "left_anti").select(*key, F.col("path").alias("to_path"), "fingerprint")
    return gone.join(come, [*key, "fingerprint"]).select("from_path", "to_path")


def schedule(stable: DataFrame, running: int, most: int) -> DataFrame:
    """One job for each stability key, oldest first, as many as there are free places."""
    once = stable.groupBy("stability_key").agg(F.min_by("path", F.struct("since", "path")).alias("path"), F.min("since").alias("since"))
    return once.orderBy("since", "path").limit(max(0, most - running))


def last_writes(delta: DataFrame, key: str = "item_key") -> DataFrame:
    """The last change of each item, by page and place in it: upserts stay, tombstones go."""
    last = delta.groupBy(key).agg(F.max_by(F.struct("kind", "revision"), F.struct("page", "ordinal")).alias("x"))
    return last.where("x.kind = 'UPSERT'").select(key, "x.revision")


def notified(notifications: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """Whether a notification may wake its scope: known, right secret, not expired."""
    b = bindings.select("scope", F.col("secret_digest").alias("__d"), F.col("expires_at").alias("__x"))
    why = F.when(F.col("__d").isNull(), "unknown_scope").when(F.col("__d") != F.sha2("secret", 256), "wrong_secret").when(F.col("__x") <= now, "expired").otherwise("accepted")
    return notifications.join(b, "scope", "left").select("notification_id", why.alias("decision"))


def next_jobs(jobs: DataFrame, now: Column, n: int = 1, kind: str | None = None) -> DataFrame:
    """The first queued jobs: available, oldest, then by id."""
    ready = jobs.where((F.col("state") == "QUEUED") & (F.col("available_at") <= now))
    return (ready.where(F.col("kind") == kind) if kind else ready).orderBy("available_at", "created_at", "job_id").limit(n)


def recover(jobs: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """Jobs whose lease ran out: cancelled if that was asked, failed after too many attempts, else queued again."""
    late = jobs.where((F.col("state") == "RUNNING") & (F.col("lease_until") <= now))
    state = F.when(F.col("cancel_requested"), "CANCELLED").when(F.col("attempts") >= most_attempts, "FAILED").otherwise("QUEUED")
    return late.select("job_id", state.alias("state"))


def numbered(events: DataFrame, last: DataFrame, owner: str = "owner") -> DataFrame:
    """New events numbered on from the last number of each owner."""
    n = F.row_number().over(W.partitionBy(owner).orderBy("occurred_at", "event_id"))
    return events.join(last, owner, "left").withColumn("sequence", (n + F.coalesce("last_sequence", F.lit(0))).cast("long"))


def freshness(known: DataFrame, observed: DataFrame) -> DataFrame:
    """CURRENT if size and time agree within a millisecond or the digest does, else CHANGED; MISSING; UNKNOWN without facts."""
    o = observed.select("path", F.col("size").alias("__s"), F.col("mtime_ms").alias("__m"), F.col("digest").alias("__d"), F.lit(True).alias("__o"))
    j = known.join(o, "path", "left")
    same = (F.col("size") == F.col("__s")) & (F.abs(F.col("mtime_ms") - F.col("__m")) <= 1)
    state = F.when(F.col("__o").isNull(), "MISSING").when(same | (F.col("digest") == F.col("__d")), "CURRENT").when(F.col("__d").isNull() | F.col("digest").isNull(), "UNKNOWN").otherwise("CHANGED")
    return j.select("path", state.alias("freshness"))
