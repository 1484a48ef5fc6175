"""Searches with scopes and filters: rules, pages and scopes that are not there."""

from glyphmill.operators import scopes as S

REQUEST = "query_id int, document_id long, version_id string, history boolean, kind string, trust_zone string, page long, slide long, max_hits int, skip int"


def test_requests(spark):
    reps = spark.createDataFrame([(1, "a", "r", "READY"), (1, "b", "r", "READY"), (2, "a", "r", "FAILED"), (3, "a", "r", "READY")], "document_id long, version_id string, representation_id string, state string")
    heads = spark.createDataFrame([(1, "b", "r"), (2, "a", "r"), (3, "a", "r")], "document_id long, version_id string, representation_id string")
    blocks = spark.createDataFrame([(10 * d + i, d, v, "r", i, k, z, p, None) for d, v, i, k, z, p in ((1, "a", 0, "p", "internal_trusted", 1), (1, "b", 1, "p", "internal_trusted", 1), (1, "b", 2, "h", "external_untrusted", 2), (2, "a", 3, "p", "internal_trusted", 1), (3, "a", 4, "p", "external_untrusted", None))], "entry long, document_id long, version_id string, representation_id string, ordinal long, kind string, trust_zone string, page long, slide long")
    rows = {1: {}, 2: {"history": True}, 3: {"document_id": 1}, 4: {"document_id": 1, "history": True}, 5: {"document_id": 1, "version_id": "a"}, 6: {"version_id": "a"}, 7: {"trust_zone": "moon"}, 8: {"page": -1}, 9: {"max_hits": 101}, 10: {"document_id": 2}, 11: {"document_id": 9, "history": True}, 12: {"kind": "h"}, 13: {"page": 1}, 14: {"max_hits": 1, "skip": 1}, 15: {"trust_zone": "external_untrusted"}, 16: {"slide": 3}, 17: {"history": None}}
    full = {"document_id": None, "version_id": None, "history": False, "kind": None, "trust_zone": None, "page": None, "slide": None, "max_hits": 5, "skip": 0}
    requests = spark.createDataFrame([(q, *(full | r).values()) for q, r in rows.items()], REQUEST)
    entries = [10, 11, 12, 23, 34, 99]
    hits = spark.createDataFrame([(q, e, 1.0) for q in rows for e in entries], "query_id int, entry long, rank double")
    answers, page = S.search(requests, hits, blocks, reps, heads)
    got = {}
    for r in page.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["entry"])
    assert got == {1: [11, 12, 34], 2: [10, 11, 12, 34], 3: [11, 12], 4: [10, 11, 12], 5: [10], 12: [12], 13: [11], 14: [12], 15: [12, 34], 17: [11, 12, 34]}
    told = {r["query_id"]: (r["status"], r["available"], r["returned"], r["truncated"]) for r in answers.collect()}
    assert {q: t[0] for q, t in told.items() if t[0] != "answered"} == {6: "version_without_document", 7: "trust_zone", 8: "negative_place", 9: "limit", 10: "scope_missing", 11: "scope_missing"}
    assert told[14] == ("answered", 3, 1, True) and told[1] == ("answered", 3, 3, False) and told[16] == ("answered", 0, 0, False)
    scopes = S.resolved(requests, reps, heads).collect()
    assert {(r["key"], r["document_id"], r["version_id"]) for r in scopes if r["key"] in ("heads", "version|1|a", "history|1", "head|2")} == {("heads", 1, "b"), ("heads", 3, "a"), ("version|1|a", 1, "a"), ("history|1", 1, "a"), ("history|1", 1, "b")}
    assert S.search(requests.limit(0), hits, blocks, reps, heads)[0].count() == 0
