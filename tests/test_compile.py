"""Context compilation against a version written by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import compile as C

CANDIDATES = "query_id long, evidence_id string, doc_id long, version_id string, source string, representation string, coverage long, occurrences long, relevance long, current boolean, trust_zone string, sensitivity string, body_id string, item_size long"


def bundle(task, items, limits, snapshot, missing=(), warnings=()):
    """The whole text, with a size in it that is its own."""
    traces = [{"evidence_id": i["evidence_id"], "final_order": n, "reason_code": "lexical_match"} for n, i in enumerate(items)]
    used = 0
    while True:
        text = json.dumps({"budget": {"actual_used": used, "ceiling": limits.ceiling, "estimated_used": used, "limit": limits.budget, "unit": "bytes"}, "items": items, "missing_evidence": list(missing), "query": task, "selection_trace": traces, "snapshot": snapshot, "warnings": list(warnings)}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        if len(text.encode()) == used:
            return text
        used = len(text.encode())


def item(evidence, doc, body):
    return {"content": {"body": body, "media_type": "text/plain"}, "document": doc, "evidence_id": evidence, "reason": "lexical_match", "representation": "text", "version": f"v{doc}"}


def greedy(task, ordered, limits, snapshot):
    """Evidence in order, with the whole bundle written anew for each try: (taken, cost of each)."""
    taken, out = [], []
    used = len(bundle(task, [], limits, snapshot).encode())
    for x in ordered:
        tried = len(bundle(task, [*taken, x], limits, snapshot).encode())
        out.append((x["evidence_id"], tried - used, tried <= limits.ceiling))
        if tried <= limits.ceiling:
            taken.append(x)
            used = tried
    return taken, out


@pytest.mark.parametrize("rest", [*range(1, 12), *range(90, 104), *range(990, 1010), *range(9980, 10020), 99_993, 10**6 - 3])
def test_size_that_counts_itself(spark, rest):
    size = C.settled(rest)
    assert size == rest + 2 * (len(str(size)) - 1) and all(s != rest + 2 * (len(str(s)) - 1) for s in range(rest, size))
    if rest % 7 == 0:
        assert spark.range(1).select(C.settled_column(F.lit(rest))).first()[0] == size


def world(spark, extra=()):
    bodies = {f"{d}:{n}": (d, f"body é😀 \"{d}\" \\ {n}\t" + "x" * (13 * d * n % 190)) for d in range(1, 7) for n in range(9)}
    rows = []
    for q in (1, 2):
        for i, (e, (d, body)) in enumerate(bodies.items()):
            size = len(json.dumps(item(e, d, body), ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode())
            rows.append((q, e, d, f"v{d}", f"s{d}", "text", 3 + (i * 7 + q) % 5, i % 4, 300_000 + i, d != 5, "outside" if d == 6 else "inside", "restricted" if e == "4:1" else "public", hashlib.md5(body.encode()).hexdigest(), size))
    df = spark.createDataFrame([*rows, *extra], CANDIDATES)
    evidence = spark.createDataFrame([(e, d, f"v{d}", "text", b) for e, (d, b) in bodies.items()], "evidence_id string, doc_id long, version_id string, representation string, body string")
    return df, evidence.withColumn("item", C.item_json(*(F.col(c) for c in ("doc_id", "evidence_id", "version_id", "representation", "body")))), bodies


@pytest.mark.parametrize("budget", [700, 1600, 1601, 1607, 2500, 12_000])
def test_packing_writes_the_bundle_it_measures(spark, budget):
    candidates, evidence, bodies = world(spark)
    limits = C.Limits(budget)
    tasks = spark.createDataFrame([(1, "first \"task\"\n"), (2, None), (3, "nothing"), (None, "lost")], "query_id long, task string")
    out = C.compile_contexts(tasks, [candidates, candidates.limit(5)], evidence, "snap", limits)
    told = out.decisions.collect()
    ledger = {r["query_id"]: r for r in out.ledger.collect()}
    texts = {r["query_id"]: r["bundle"] for r in out.bundles.collect()}
    assert set(ledger) == {1, 2, 3} and sum(r["reason"] == "duplicate" for r in told) == 5
    lack = [{"evidence_type": r, "reason_code": C.MISSING} for r in ("chat", "text")]
    for q, task in ((1, "first \"task\"\n"), (2, ""), (3, "nothing")):
        mine = sorted((r for r in told if r["query_id"] == q and r["place"] is not None), key=lambda r: r["place"])
        if ledger[q]["status"] == "base_bundle_exceeds_budget":
            assert len(bundle(task, [], limits, "snap").encode()) > limits.ceiling and q not in texts
            continue
        taken, tries = greedy(task, [item(r["evidence_id"], r["doc_id"], bodies[r["evidence_id"]][1]) for r in mine], limits, "snap")
        assert [(r["evidence_id"], r["cost"], r["outcome"] == "selected") for r in mine] == tries
        want = bundle(task, taken, limits, "snap", () if taken else lack)
        if len(want.encode()) > limits.ceiling:
            assert ledger[q]["status"] == "bundle_exceeds_budget" and q not in texts
            continue
        assert texts[q] == want and ledger[q]["used"] == ledger[q]["bundle_bytes"] == len(want.encode()) and ledger[q]["bundle_id"] == hashlib.sha256(want.encode()).hexdigest()
    counted = sum(r[f"n_{k}"] for r in ledger.values() for k in ("selected", "omitted", "rejected", "stale", "truncated", "refused"))
    assert counted == len(told) == sum(r["n_decisions"] for r in ledger.values())
    assert {r["reason"] for r in told if r["outcome"] in ("rejected", "stale")} == {"stale", "trust_zone", "sensitivity", "duplicate"}


def test_refused_bundles_are_measured(spark):
    candidates, evidence, _ = world(spark)
    tasks = spark.createDataFrame([(1, "t"), (3, "nothing")], "query_id long, task string")
    bare = len(bundle("nothing", [], C.Limits(900), "snap").encode())
    limits = C.Limits((bare + 20) * 10 // 9)  # the frame fits, what it lacks does not
    out = C.compile_contexts(tasks, [candidates], evidence, "snap", limits)
    lost = out.ledger.where("query_id = 3").first()
    want = bundle("nothing", [], limits, "snap", [{"evidence_type": r, "reason_code": C.MISSING} for r in ("chat", "text")]).encode()
    assert lost["status"] == "bundle_exceeds_budget" and lost["bundle_id"] is None and out.bundles.where("query_id = 3").count() == 0
    assert (lost["draft_used"], lost["draft_bytes"], lost["draft_id"]) == (len(want), len(want), hashlib.sha256(want).hexdigest())


def test_caps_are_told(spark):
    candidates, evidence, _ = world(spark)
    tasks = spark.createDataFrame([(1, "t"), (2, "u")], "query_id long, task string")
    out = C.compile_contexts(tasks, [candidates], evidence, "snap", C.Limits(50_000, discovered=40, evaluated=10))
    assert {r["n_decisions"] for r in out.ledger.collect()} == {40} and all(r["truncated"] for r in out.ledger.collect())
    assert out.decisions.where("outcome = 'truncated' and place > 10").count() == out.decisions.where("outcome = 'truncated'").count() > 0
    assert all("discovery_truncated" in r["bundle"] for r in out.bundles.collect())
    few = C.compile_contexts(tasks, [candidates], evidence, "snap", C.Limits(50_000, decisions=30))
    assert {r["status"] for r in few.ledger.collect()} == {"max_decisions_exceeded"} and few.bundles.count() == 0
    dull = C.compile_contexts(tasks, [candidates.where("current").withColumn("relevance", F.lit(1).cast("long"))], evidence, "snap", C.Limits(50_000), C.Policy(zones=("inside", "outside"), most_sensitive="unknown"))
    assert all(r["abstains"] and r["n_selected"] == 0 for r in dull.ledger.collect()) and all("no_relevant_evidence" in r["bundle"] for r in dull.bundles.collect())
    assert C.compile_contexts(tasks.limit(0), [candidates], evidence, "snap", C.Limits(900)).ledger.count() == 0


def test_replay(spark, tmp_path):
    candidates, evidence, _ = world(spark)
    tasks = spark.createDataFrame([(1, "t"), (2, "u")], "query_id long, task string")
    limits = C.Limits(3000)
    scopes = spark.createDataFrame([(d, f"v{d}") for d in range(1, 7)], "doc_id long, version_id string")
    snapshot = C.snapshot_digest(scopes)
    assert snapshot == C.snapshot_digest(scopes.repartition(5)) != C.snapshot_digest(scopes.limit(5))
    C.persist(C.compile_contexts(tasks, [candidates], evidence, snapshot, limits), scopes, snapshot, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/receipts/snapshot={snapshot}")
    told = lambda t, c, l=limits: {r["query_id"]: r["outcome"] for r in C.replayed(kept, C.compile_contexts(t, [c], evidence, snapshot, l)).collect()}
    assert told(tasks, candidates) == {1: "equal", 2: "equal"}
    assert told(tasks.replace("u", "other"), candidates) == {1: "equal", 2: "task_mismatch"}
    assert told(tasks.where("query_id = 1"), candidates) == {1: "equal", 2: "task_missing"}
    chosen = spark.read.parquet(f"{tmp_path}/decisions/snapshot={snapshot}").where("query_id = 1 and outcome = 'selected'").first()["evidence_id"]
    assert told(tasks, candidates.where((F.col("query_id") == 2) | (F.col("evidence_id") != chosen)))[1] == "replay_bundle_diverged"
    assert told(tasks, candidates.where("query_id = 2 or evidence_id <> '5:0'")) == {1: "replay_receipt_diverged", 2: "equal"}
    found, gone = C.pinned(spark.createDataFrame([(1, "v1"), (1, "v9"), (2, "v2")], "doc_id long, version_id string"), scopes)
    assert found.count() == 2 and gone == 4
