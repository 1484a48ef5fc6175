"""Queries of versions, lineage, change processing and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change as C
from ..operators import lineage as L
from ..operators import reconcile as R
from ..operators import versions as V
from ..operators.numbering import numbered
from .registry import query, table
from .text_queries import documents

# Version 2 of the corpus: every 7th document edited, every 11th gone, every 13th new.
V2 = "v2 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 13 = 0)"


def versions(spark, d):
    docs = documents(spark, d).select("doc_id", "text")
    edited = docs.where("doc_id % 11 <> 0").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END"))
    fresh = docs.where("doc_id % 13 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "text")
    hashed = lambda x: x.withColumn("digest", F.sha2("text", 256))
    return hashed(docs), hashed(edited.union(fresh))


@query("d07_ingest_dispositions", f"WITH {V2} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'updated' END AS outcome FROM documents a FULL JOIN v2 b USING (doc_id)")
def d07(spark, d):
    old, new = versions(spark, d)
    return V.dispositions(new, old, "doc_id", "digest")


@query("u08_index_refresh", f"WITH {V2} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'updated' END AS outcome FROM documents a FULL JOIN v2 b USING (doc_id)) GROUP BY 1")
def u08(spark, d):
    return d07(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("x11_skip_current", f"WITH {V2} SELECT doc_id FROM v2 WHERE NOT EXISTS (SELECT 1 FROM documents a WHERE a.doc_id = v2.doc_id AND a.text = v2.text)")
def x11(spark, d):
    old, new = versions(spark, d)
    return new.join(old, ["doc_id", "digest"], "left_anti").select("doc_id")


@query("k05_replace_documents", f"WITH {V2} SELECT doc_id, sha256(text) AS digest FROM v2 WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v2 WHERE doc_id % 7 = 0)")
def k05(spark, d):
    old, new = versions(spark, d)
    rows = new.where("doc_id % 7 = 0")
    return old.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows).select("doc_id", "digest")


def turns(spark, d):
    """Conversations as two versions of blocks: every 5th turn has a letter more, every 9th is new in place."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("role").alias("kind"), "text")
    base = c.select("doc_id", "ordinal", "kind", "text", F.lit("root").alias("parent_id"), F.lit(None).cast("string").alias("native_id"))
    done = lambda x, v: x.withColumn("hash", F.sha2("text", 256)).withColumn("block_id", F.concat(F.lit(v), F.col("ordinal").cast("string")))
    edited = base.withColumn("text", F.expr("CASE WHEN (doc_id + ordinal) % 5 = 0 THEN text || 'x' WHEN (doc_id + ordinal) % 9 = 0 THEN sha2(text, 256) ELSE text END"))
    return done(base, "p"), done(edited, "c")


TURNS = """p AS (SELECT conv_id AS doc_id, turn, role AS kind, text, count(*) OVER (PARTITION BY conv_id, role, text) AS n FROM conversations), c AS (SELECT conv_id AS doc_id, turn, role AS kind, text, count(*) OVER (PARTITION BY conv_id, role, text) AS n FROM (
 SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 0 THEN text || 'x' WHEN (conv_id + turn) % 9 = 0 THEN sha256(text) ELSE text END AS text FROM conversations))"""


@query("j07_unique_matches", f"WITH {TURNS} SELECT p.doc_id, 'p' || p.turn AS previous_id, 'c' || c.turn AS current_id FROM p JOIN c USING (doc_id, kind, text) WHERE p.n = 1 AND c.n = 1")
def j07(spark, d):
    p, c = turns(spark, d)
    return V.unique_phase(p, c, ["doc_id", "kind", "hash"], "exact", 1_000_000).select("doc_id", "previous_id", "current_id")


@query("j09_sequence_matches", f"WITH {TURNS} SELECT p.doc_id, 'p' || p.turn AS previous_id, 'c' || c.turn AS current_id FROM p JOIN c USING (doc_id, kind, text) WHERE p.n = 1 AND c.n = 1 AND abs(p.turn - c.turn) <= 256")
def j09(spark, d):
    p, c = turns(spark, d)
    return V.sequence_phase(p, c).select("doc_id", "previous_id", "current_id")


def trees(spark, d):
    """Conversations as two versions of trees: turn t is below turn t div 2.  Some texts change a little, some in full; some blocks move to the top; every sixth has a native id, some an asset, and every fifth is a table."""
    c = table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS ordinal", "role", "text")
    base = c.selectExpr(
        "*", "CASE WHEN (doc_id + ordinal) % 6 = 0 THEN concat('n', ordinal) END AS native_id", "CASE WHEN ordinal % 7 = 3 THEN concat('a', ordinal % 2) END AS asset_id",
        "CASE WHEN ordinal % 5 = 4 THEN 'table' ELSE role END AS kind", "CASE WHEN ordinal % 5 = 4 THEN md5(left(text, 5)) END AS structured_hash")
    edited = base.withColumn("text", F.expr("CASE WHEN (doc_id + ordinal) % 5 = 0 THEN text || 'x' WHEN (doc_id + ordinal) % 9 = 0 THEN sha2(text, 256) ELSE text END"))
    moved = F.expr("(doc_id + ordinal) % 11 = 0")
    done = lambda x, v, top: x.withColumns({"hash": F.md5("text"), "block_id": F.concat(F.lit(v), F.col("ordinal").cast("string")), "parent_id": F.when((F.col("ordinal") > 0) & ~top, F.concat(F.lit(v), F.expr("ordinal div 2").cast("string")))})
    return done(base, "p", F.lit(False)), done(edited, "c", moved)


@query("d11_reconcile")
def d11(spark, d):
    return R.reconcile(*trees(spark, d)).matches


@query("a22_reconciliation_counts")
def a22(spark, d):
    return R.reconcile(*trees(spark, d)).counts


TREES = """b AS (SELECT conv_id AS doc_id, turn AS ordinal, text, CASE WHEN (conv_id + turn) % 6 = 0 THEN 'n' || turn END AS native_id, CASE WHEN turn % 7 = 3 THEN 'a' || turn % 2 END AS asset_id,
 CASE WHEN turn % 5 = 4 THEN 'table' ELSE role END AS kind, CASE WHEN turn % 5 = 4 THEN md5(left(text, 5)) END AS structured_hash FROM conversations),
 p AS (SELECT *, md5(text) AS hash, CASE WHEN ordinal > 0 THEN ordinal // 2 END AS parent FROM b),
 c AS (SELECT * EXCLUDE (text), md5(CASE WHEN (doc_id + ordinal) % 5 = 0 THEN text || 'x' WHEN (doc_id + ordinal) % 9 = 0 THEN sha256(text) ELSE text END) AS hash, CASE WHEN ordinal > 0 AND (doc_id + ordinal) % 11 <> 0 THEN ordinal // 2 END AS parent FROM b)"""


def unique_sql(name: str, key: str, before: list[str], rule: bool = True) -> str:
    """One phase: pairs by a key that occurs once on either side, down the tree from the pairs before."""
    known = " UNION ALL ".join(f"SELECT doc_id, p, c FROM {x}" for x in before) or "SELECT 0::BIGINT AS doc_id, 0::BIGINT AS p, 0::BIGINT AS c WHERE false"
    side = lambda s: f"SELECT doc_id, k, min(ordinal) AS {s}, min(parent) AS {s}p FROM (SELECT *, {key} AS k FROM {s} WHERE (doc_id, ordinal) NOT IN (SELECT doc_id, {s} FROM ({known}))) WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1"
    pairs = f"{name}_k AS (SELECT doc_id, p, c, pp, cp FROM ({side('p')}) JOIN ({side('c')}) USING (doc_id, k))"
    if not rule:
        return f"{pairs}, {name} AS (SELECT doc_id, p, c FROM {name}_k)"
    return f"""{pairs}, {name}(doc_id, p, c) AS (SELECT doc_id, p, c FROM {name}_k WHERE (pp IS NULL AND cp IS NULL) OR (doc_id, pp, cp) IN (SELECT doc_id, p, c FROM ({known}))
 UNION SELECT k.doc_id, k.p, k.c FROM {name}_k k JOIN {name} m ON k.doc_id = m.doc_id AND k.pp = m.p AND k.cp = m.c)"""


PHASES = [unique_sql("m1", "CASE WHEN native_id IS NOT NULL THEN struct_pack(a := native_id, b := kind) END", [], False), unique_sql("m2", "CASE WHEN hash IS NOT NULL THEN struct_pack(a := kind, b := hash) END", ["m1"]),
    unique_sql("m3", "CASE WHEN asset_id IS NOT NULL THEN struct_pack(a := kind, b := asset_id) WHEN kind = 'table' AND structured_hash IS NOT NULL THEN struct_pack(a := kind, b := structured_hash) END", ["m1", "m2"])]


@query("d13_parent_fixpoint", f"WITH RECURSIVE {TREES}, {', '.join(PHASES)} SELECT doc_id, 'p' || p AS previous_id, 'c' || c AS current_id, method FROM (SELECT *, 'native_id' AS method FROM m1 UNION ALL SELECT *, 'exact' FROM m2 UNION ALL SELECT *, 'asset_or_table' FROM m3)")
def d13(spark, d):
    """Pairs of the phases by keys, each carried down the tree from pair to pair."""
    return R.reconcile(*trees(spark, d)).matches.where("method IN ('native_id', 'exact', 'asset_or_table')").select("doc_id", "previous_id", "current_id", "method")


@query("j08_similarity_pairs", "SELECT a.conv_id AS doc_id, 'p' || a.turn AS previous_id, 'c' || b.turn AS current_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND abs(a.turn - b.turn) <= 8")
def j08(spark, d):
    p, c = turns(spark, d)
    return V.similar_phase(p, c)[1].select("doc_id", "previous_id", "current_id")


@query("u05_inactive_bindings", f"WITH {V2} SELECT DISTINCT sha256(text) AS digest FROM documents EXCEPT SELECT sha256(text) FROM v2")
def u05(spark, d):
    old, new = versions(spark, d)
    return old.select("digest").distinct().join(new.select("digest"), "digest", "left_anti")


# Heads from observations that arrive out of order.
OBS = "o AS (SELECT user_id AS doc_id, CAST(floor(value) AS BIGINT) AS observed_at, event_id AS ingested_at, event_type AS scope FROM events)"


def observations(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.floor("value").cast("long").alias("observed_at"), F.col("event_id").alias("ingested_at"), F.col("event_type").alias("scope"))


@query("x14_heads", f"WITH {OBS} SELECT doc_id, observed_at, min(scope) AS scope, count(DISTINCT scope) AS scopes, max(ingested_at) AS ingested_at FROM o WHERE observed_at = (SELECT max(observed_at) FROM o p WHERE p.doc_id = o.doc_id) GROUP BY 1, 2")
def x14(spark, d):
    return V.heads(observations(spark, d))


@query("w16_head_events", f"""WITH {OBS} SELECT doc_id, ingested_at, row_number() OVER w AS sequence, coalesce(observed_at > max(observed_at) OVER b OR (observed_at = max(observed_at) OVER b AND scope = max(struct_pack(a := observed_at, s := scope)) OVER b .s), true) AS head_advanced FROM o
 WINDOW w AS (PARTITION BY doc_id ORDER BY ingested_at, scope), b AS (PARTITION BY doc_id ORDER BY ingested_at, scope ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""".replace("max(struct_pack(a := observed_at, s := scope)) OVER b .s", "(max(struct_pack(a := observed_at, s := scope)) OVER b).s"))
def w16(spark, d):
    return V.head_events(observations(spark, d)).select("doc_id", "ingested_at", "sequence", "head_advanced")


# Derivations: artifact n comes from n // 2 and n // 3, the first ten from inputs.
NODES = "n AS (SELECT doc_id + 1 AS id, CASE WHEN doc_id % 17 = 16 THEN 'STALE' ELSE 'CURRENT' END AS state FROM documents), e AS (SELECT id // 2 AS a, id AS b FROM n WHERE id > 10 UNION SELECT id // 3, id FROM n WHERE id > 10)"


def derivations(spark, d):
    ids = documents(spark, d).select((F.col("doc_id") + 1).alias("artifact_id"))
    nodes = ids.select("artifact_id", F.expr("CASE WHEN (artifact_id - 1) % 17 = 16 THEN 'STALE' ELSE 'CURRENT' END AS state"), F.expr("artifact_id % 400 AS slot"))
    made = ids.where("artifact_id > 10").select("artifact_id", F.explode(F.array(F.expr("artifact_id div 2"), F.expr("artifact_id div 3"))).alias("producer_artifact_id")).distinct()
    deps = made.select("artifact_id", F.concat(F.lit("a"), F.col("producer_artifact_id").cast("string")).alias("input_digest"), "producer_artifact_id")
    roots = ids.where("artifact_id <= 10").select("artifact_id", F.concat(F.lit("in"), F.col("artifact_id").cast("string")).alias("input_digest"), F.lit(None).cast("long").alias("producer_artifact_id"))
    return nodes, deps.union(roots)


@query("u02_stale_closure", f"WITH RECURSIVE {NODES}, s(id) AS (SELECT id FROM n WHERE id IN (3, 7) AND state = 'CURRENT' UNION SELECT e.b FROM s JOIN e ON e.a = s.id JOIN n ON n.id = e.b WHERE n.state = 'CURRENT') SELECT id FROM s")
def u02(spark, d):
    nodes, deps = derivations(spark, d)
    return L.stale(nodes, deps, spark.createDataFrame([("in3",), ("in7",)], "input_digest string"))


CLOSING = "SELECT id AS a, CASE WHEN id % 100 = 1 THEN id // 4 ELSE id + 1 END AS b FROM n WHERE id % 50 = 1 AND id > 40"


@query("u03_cycle_check", f"WITH RECURSIVE {NODES}, r(a, b, id) AS (SELECT a, b, b FROM ({CLOSING}) UNION SELECT r.a, r.b, e.b FROM r JOIN e ON e.a = r.id) SELECT DISTINCT a, b FROM r WHERE id = a")
def u03(spark, d):
    """New edges from artifacts to what they come from close a cycle, others do not."""
    nodes, deps = derivations(spark, d)
    edges = deps.where("producer_artifact_id is not null").select(F.col("producer_artifact_id").alias("a"), F.col("artifact_id").alias("b"))
    new = nodes.where("artifact_id % 50 = 1 AND artifact_id > 40").select(F.col("artifact_id").alias("a"), F.expr("CASE WHEN artifact_id % 100 = 1 THEN artifact_id div 4 ELSE artifact_id + 1 END").alias("b"))
    return L.cyclic(new, edges)


@query("u04_reactivation")
def u04(spark, d):
    """Every third artifact has a slot of its own, so stale ones among them can come back."""
    nodes, deps = derivations(spark, d)
    nodes = nodes.withColumn("slot", F.expr("CASE WHEN artifact_id % 3 = 0 THEN -artifact_id ELSE artifact_id div 2 END"))
    active = spark.createDataFrame([(f"in{i}",) for i in range(1, 11)], "input_digest string")
    return L.reactivate(nodes, deps, active)


@query("j17_dependency_currency", f"WITH {NODES} SELECT id AS artifact_id, CASE WHEN id <= 10 THEN id <> 3 ELSE bool_and(p.state = 'CURRENT') END AS current FROM n LEFT JOIN e ON e.b = n.id LEFT JOIN (SELECT id AS pid, state FROM n) p ON p.pid = e.a GROUP BY id")
def j17(spark, d):
    nodes, deps = derivations(spark, d)
    heads = spark.createDataFrame([(f"in{i}",) for i in range(1, 11) if i != 3], "input_digest string")
    producers = nodes.withColumn("output", F.concat(F.lit("a"), F.col("artifact_id").cast("string")))
    return L.current_dependencies(deps, heads, spark.createDataFrame([], "object_id string"), producers)


@query("d17_publish_slots", "SELECT doc_id AS artifact_id, source AS slot, CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY source) THEN 'CURRENT' ELSE 'SUPERSEDED' END AS state FROM documents")
def d17(spark, d):
    return L.latest_by_slot(documents(spark, d).select(F.col("doc_id").alias("artifact_id"), F.col("source").alias("slot"), F.col("doc_id").alias("published_at"))).select("artifact_id", "slot", "state")


# File watching, with events as observations of paths.
SEEN = "o AS (SELECT user_id AS path, ts AS seen_at, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS fp, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1)"
STATES = f"""{SEEN}, b AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(fp) OVER w IS NOT DISTINCT FROM fp THEN 0 ELSE 1 END AS br, row_number() OVER w AS rn, lag(fp) OVER w AS before FROM o WINDOW w AS (PARTITION BY path ORDER BY seen_at)),
 r AS (SELECT *, sum(br) OVER (PARTITION BY path ORDER BY seen_at) AS run FROM b), s AS (SELECT *, min(seen_at) OVER (PARTITION BY path, run) AS since FROM r)
 SELECT CAST(path AS VARCHAR) AS path, seen_at, CASE WHEN fp IS NULL THEN 'TOMBSTONED' WHEN epoch_ms(seen_at) - epoch_ms(since) >= 600000 THEN 'STABLE' ELSE 'CANDIDATE' END AS state,
 CASE WHEN br = 0 THEN NULL WHEN fp IS NULL THEN 'REMOVED' WHEN rn = 1 THEN 'DISCOVERED' WHEN before IS NULL THEN 'REAPPEARED' ELSE 'CHANGED' END AS event FROM s"""


def seen(spark, d):
    e = table(spark, d, "events")
    once = e.groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("event_type"))
    return once.select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("seen_at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("fingerprint"))


@query("x02_file_states", f"WITH {STATES}")
def x02(spark, d):
    return C.file_states(seen(spark, d), 600_000).select("path", "seen_at", "state", "event")


@query("x04_tombstones", "SELECT DISTINCT user_id AS path FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 37 = 0)")
def x04(spark, d):
    e = table(spark, d, "events")
    return C.tombstones(e.select(F.col("user_id").alias("path")).distinct(), e.where("event_id % 37 = 0").select(F.col("user_id").alias("path")), True)


@query("x05_incomplete_scan", """SELECT root, CASE WHEN root % 2 = 0 THEN 'COMPLETE' ELSE 'RESCAN_REQUIRED' END AS outcome, CAST(count(*) FILTER (WHERE root % 2 = 0 AND NOT met) AS BIGINT) AS tombstoned FROM
 (SELECT user_id, user_id % 10 AS root, bool_or(event_id % 37 = 0) AS met FROM events GROUP BY 1, 2) GROUP BY 1""")
def x05(spark, d):
    """Scans of the odd roots broke off: they ask for another scan and bury nothing."""
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.expr("user_id % 10").alias("root"), "event_id")
    scans = e.select("root").distinct().withColumn("complete", F.expr("root % 2 = 0"))
    return C.scan_outcomes(e.select("path", "root").distinct(), e.where("event_id % 37 = 0").select("path").distinct(), scans)


@query("j13_rename_hints", "SELECT 'old/' || c_custkey AS from_path, 'new/' || c_custkey AS to_path FROM customer WHERE c_custkey % 4 = 0")
def j13(spark, d):
    c = table(spark, d, "customer").select(F.lit(1).alias("device"), F.col("c_custkey").alias("inode"), F.col("c_name").alias("fingerprint"), "c_custkey")
    moved = F.expr("c_custkey % 4 = 0")
    old = c.withColumn("path", F.concat(F.when(moved, "old/").otherwise("same/"), F.col("c_custkey").cast("string")))
    new = c.withColumn("path", F.concat(F.when(moved, "new/").otherwise("same/"), F.col("c_custkey").cast("string")))
    return C.rename_hints(old, new)


@query("x03_schedule", "SELECT stability_key, path FROM (SELECT event_type || user_id % 40 AS stability_key, min(event_id) AS path FROM events GROUP BY 1) ORDER BY path LIMIT 7")
def x03(spark, d):
    s = table(spark, d, "events").select(F.concat("event_type", F.expr("user_id % 40").cast("string")).alias("stability_key"), F.col("event_id").alias("path"), F.col("event_id").alias("since"))
    return C.schedule(s, 3, 10).select("stability_key", "path")


@query("x06_delta_sync", "SELECT user_id AS item_key, revision FROM (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(CAST(value AS VARCHAR), event_id) AS revision FROM (SELECT user_id, event_type, event_id, CAST(floor(value) AS BIGINT) AS value FROM events) GROUP BY 1) WHERE kind <> 'error'")
def x06(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("item_key"), F.expr("CASE WHEN event_type = 'error' THEN 'TOMBSTONE' ELSE 'UPSERT' END").alias("kind"), F.floor("value").cast("string").alias("revision"), F.expr("event_id div 100").alias("page"), F.expr("event_id % 100").alias("ordinal"))
    return C.last_writes(e)


@query("x07_notifications", "SELECT event_id AS notification_id, CASE WHEN user_id % 10 > 7 THEN 'unknown_scope' WHEN event_type = 'error' THEN 'wrong_secret' WHEN user_id % 10 < 2 THEN 'expired' ELSE 'accepted' END AS decision FROM events")
def x07(spark, d):
    n = table(spark, d, "events").select(F.col("event_id").alias("notification_id"), F.expr("user_id % 10").alias("scope"), F.when(F.col("event_type") == "error", "bad").otherwise("good").alias("secret"))
    b = spark.range(8).select(F.col("id").alias("scope"), F.sha2(F.lit("good"), 256).alias("secret_digest"), F.when(F.col("id") < 2, F.lit(1)).otherwise(9).alias("expires_at"))
    return C.notified(n, b, F.lit(5))


JOBS = "j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'RUNNING' ELSE 'QUEUED' END AS state, o_custkey AS available_at, o_orderkey % 100 AS created_at, o_orderkey % 5 AS attempts, o_orderkey % 50 AS lease_until, o_orderkey % 7 = 0 AS cancel FROM orders)"


def jobs(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr("o_orderkey AS job_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'RUNNING' ELSE 'QUEUED' END AS state", "o_custkey AS available_at", "o_orderkey % 100 AS created_at", "o_orderkey % 5 AS attempts", "o_orderkey % 50 AS lease_until", "o_orderkey % 7 = 0 AS cancel_requested", "o_orderstatus AS kind")


@query("t09_next_jobs", f"WITH {JOBS} SELECT job_id FROM j WHERE state = 'QUEUED' AND available_at <= 500 ORDER BY available_at, created_at, job_id LIMIT 10")
def t09(spark, d):
    return C.next_jobs(jobs(spark, d), F.lit(500), 10).select("job_id")


@query("x09_recover_jobs", f"WITH {JOBS} SELECT job_id, CASE WHEN cancel THEN 'CANCELLED' WHEN attempts >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS state FROM j WHERE state = 'RUNNING' AND lease_until <= 25")
def x09(spark, d):
    return C.recover(jobs(spark, d), F.lit(25), 3)


@query("f12_job_list", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey % 100, o_orderkey LIMIT 20")
def f12(spark, d):
    return jobs(spark, d).where("kind = 'F'").orderBy("created_at", "job_id").limit(20).select("job_id")


@query("j14_job_targets", "SELECT o_orderkey AS job_id, c_name AS target FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1")
def j14(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("target"))
    return table(spark, d, "orders").join(c, "o_custkey").orderBy("o_orderkey").limit(1).select(F.col("o_orderkey").alias("job_id"), "target")


@query("k10_event_sequences", "SELECT event_id, user_id % 20 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def k10(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("owner"), F.col("ts").alias("occurred_at"))
    return C.numbered(e, e.select("owner", F.expr("owner % 20").alias("last_sequence")).distinct()).select("event_id", "sequence")


@query("w17_surrogate_ids", "SELECT s_suppkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS id FROM supplier")
def w17(spark, d):
    """Numbers that run on from the largest there is, in order of two keys, without one task that sorts all rows."""
    s = numbered(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey", "s_suppkey"])
    base = table(spark, d, "customer").agg(F.max("c_custkey").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("s_suppkey", (F.col("base") + F.col("number") + 1).cast("long").alias("id"))  # one row


FILES = "SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'MISSING' WHEN p_partkey % 3 <> 0 THEN 'CURRENT' WHEN p_partkey % 2 = 0 THEN 'CURRENT' WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' ELSE 'CHANGED' END AS freshness FROM part"


@query("f10_freshness", FILES)
def f10(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "CAST(p_partkey AS STRING) AS path", "p_size AS size", "1000L AS mtime_ms", "p_name AS digest")
    seen_files = p.where("p_partkey % 5 <> 0").selectExpr("path", "size", "CASE WHEN p_partkey % 3 <> 0 THEN mtime_ms + 1 ELSE mtime_ms + 9 END AS mtime_ms", "CASE WHEN p_partkey % 2 = 0 THEN digest WHEN p_partkey % 7 = 0 THEN NULL ELSE digest || '!' END AS digest")
    return C.freshness(p.drop("p_partkey"), seen_files)


@query("f11_status_ladder", "SELECT freshness AS status, count(*) AS n FROM (" + FILES + ") GROUP BY 1")
def f11(spark, d):
    return f10(spark, d).groupBy(F.col("freshness").alias("status")).agg(F.count("*").alias("n"))


@query("x13_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x13(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("relational_smoke", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def smoke(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))
