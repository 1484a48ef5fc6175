"""Reconciliation of two versions against a version written by hand, document by document."""

import collections
import difflib
import random
import re

import pytest

from glyphmill.operators import reconcile as R

NAMES = ["doc_id", "block_id", "native_id", "kind", "parent_id", "ordinal", "hash", "asset_id", "structured_hash", "text", "__key"]
SCHEMA = "doc_id long, block_id string, native_id string, kind string, parent_id string, ordinal long, hash string, asset_id string, structured_hash string, text string, __key string"


def by_hand(previous, current):
    """One document: walks the phases with dictionaries."""
    match, used, seen = {}, set(), set()
    parents = lambda a, b: a["parent_id"] is None and b["parent_id"] is None if None in (a["parent_id"], b["parent_id"]) else match.get(b["parent_id"], ("",))[0] == a["parent_id"]
    free = lambda: ([a for a in previous if a["block_id"] not in used], [b for b in current if b["block_id"] not in match])

    def accept(a, b, method, confidence=1_000_000):
        match[b["block_id"]] = (a["block_id"], method, confidence, a["hash"] == b["hash"])
        used.add(a["block_id"])

    def grouped(key_a, key_b):
        groups = collections.defaultdict(lambda: ([], []))
        for i, (blocks, key) in enumerate(zip(free(), (key_a, key_b), strict=True)):
            for x in blocks:
                if key(x) is not None:
                    groups[key(x)][i].append(x)
        return [g for g in groups.values() if g[0] and g[1]]

    def asset(x):
        if x["asset_id"] is not None:
            return x["kind"], x["asset_id"]
        return (x["kind"], x["structured_hash"]) if x["kind"] == "table" and x["structured_hash"] is not None else None

    for method, key, rule in (("native_id", lambda x: x["native_id"] and (x["native_id"], x["kind"]), False), ("exact", lambda x: (x["kind"], x["hash"]), True), ("asset_or_table", asset, True)):
        moved = True
        while moved:
            moved = False
            for a, b in grouped(key, key):
                seen |= {x["block_id"] for x in b}
                if len(a) == len(b) == 1 and (not rule or parents(a[0], b[0])):
                    accept(a[0], b[0], method)
                    moved = True
    text = lambda x: re.sub(r"\s+", " ", x["text"].casefold()).strip()[:4096]
    pairs, compared = [], 0
    old, new = free()
    for b in new:
        for a in old:
            if a["text"] is not None and b["text"] is not None and a["kind"] == b["kind"] and abs(a["ordinal"] - b["ordinal"]) <= 8 and parents(a, b):
                compared += 1
                seen.add(b["block_id"])
                score = round(difflib.SequenceMatcher(None, text(a), text(b), autojunk=False).ratio() * 1_000_000)
                if score >= 970_000:
                    pairs.append((score, a, b))
    for score, a, b in pairs:
        if sum(x is a for _, x, _ in pairs) == sum(y is b for _, _, y in pairs) == 1:  # a second one would be within the margin
            accept(a, b, "similarity", score)
    known = dict(match)
    under = lambda b: known[b["parent_id"]][0] if b["parent_id"] in known else None
    for a, b in grouped(lambda x: (x["parent_id"], x["kind"], x["hash"]), lambda x: (under(x), x["kind"], x["hash"])):
        seen |= {x["block_id"] for x in b}
        if len(a) == len(b) == 1 and abs(a[0]["ordinal"] - b[0]["ordinal"]) <= 256 and parents(a[0], b[0]):
            accept(a[0], b[0], "sequence")
    totals = (len(match), sum(m[3] for m in match.values()), len(current) - len(match), len(seen - set(match)), compared)
    return {(m[0], b, *m[1:]) for b, m in match.items()}, totals


def version(rng, doc, v, n, shift):
    rows = []
    for i in range(n):
        parent = None if i == 0 or rng.random() < 0.25 else f"{v}{rng.randrange(max(0, i - 6), i)}"
        words = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "same", "", f"text number {i % 9} of many, long enough that a letter more is a small thing only"][rng.randrange(4)]
        words += rng.choice(["", "", "", "x", " X"])
        kind = rng.choice(["p", "p", "h", "table"])
        rows.append([doc, f"{v}{i}", rng.choice([None, None, f"n{i}"]), kind, parent, i + shift, words if rng.random() < 0.9 else f"h{i}", rng.choice([None] * 5 + ["a1", "a2"]), rng.choice([None, "s1", "s2"]), rng.choice([words, words, words, None]), "k"])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reconcile_by_hand(spark, seed):
    rng = random.Random(seed)
    previous, current = [], []
    for doc in range(25):
        state = rng.getstate()
        previous += version(rng, doc, "p", rng.randrange(1, 40), 0)
        if rng.random() < 0.7:
            rng.setstate(state)  # mostly the same blocks
        current += [r if rng.random() < 0.8 else [*r[:6], f"edit{rng.random()}", *r[7:]] for r in version(rng, doc, "c", rng.randrange(1, 40), rng.choice([0, 3, 300]))]
    out = R.reconcile(*(spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3) for rows in (previous, current)))
    got, counts = collections.defaultdict(set), {r["doc_id"]: tuple(r)[1:] for r in out.counts.collect()}
    for r in out.matches.collect():
        got[r["doc_id"]].add((r["previous_id"], r["current_id"], r["method"], r["confidence"], r["reusable"]))
    methods = collections.Counter(m[2] for x in got.values() for m in x)
    assert set(methods) >= {"native_id", "exact", "asset_or_table", "similarity"}
    for doc in range(25):
        want, totals = by_hand(*([dict(zip(NAMES, r, strict=True)) for r in rows if r[0] == doc] for rows in (previous, current)))
        assert got[doc] == want, doc
        assert counts[doc] == totals, doc


def test_deep_chain_and_broken_trees(spark):
    chain = lambda v: [(1, f"{v}{i}", None, "p", f"{v}{i - 1}" if i else None, i, f"h{i}", None, None, None, "k") for i in range(12)]
    broken = lambda v: [(2, f"{v}0", None, "p", f"{v}1", 0, "a", None, None, "t", "k"), (2, f"{v}1", None, "p", f"{v}0", 1, "b", None, None, "t", "k"), (2, f"{v}2", None, "p", "gone", 2, "c", None, None, "t", "k"), (None, f"{v}3", "n", "p", None, 3, "d", None, None, "t", "k"), (2, f"{v}4", None, "p", None, 4, "e", None, None, "t", "k"), (2, f"{v}4", None, "p", None, 5, "f", None, None, "t", "k")]
    frames = [spark.createDataFrame(chain(v) + broken(v), SCHEMA) for v in "pc"]
    out = R.reconcile(*frames)
    assert sorted((r["doc_id"], r["current_id"]) for r in out.matches.collect()) == sorted((1, f"c{i}") for i in range(12))
    assert {r["doc_id"]: tuple(r)[1:] for r in out.counts.collect()}[2] == (0, 0, 5, 3, 0)
    empty = R.reconcile(*(f.limit(0) for f in frames))
    assert empty.matches.count() == empty.counts.count() == 0


def test_similarity_rounds_and_bounds_are_exact():
    assert R.similarity("abc" * 40, "abc" * 40 + "d") == round(240 / 241 * 1_000_000) == 995_851
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 80)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcd"))
        true = round(difflib.SequenceMatcher(None, a, "".join(b), autojunk=False).ratio() * 1_000_000)
        assert R.similarity(a, "".join(b)) == (true if true >= 970_000 else R.similarity(a, "".join(b))) and (R.similarity(a, "".join(b)) >= 970_000) == (true >= 970_000)
