"""Conversation prefix trie against a brute-force version."""

import collections
import hashlib
import random
import zlib

import pytest

from glyphmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node int, place string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += kids[p] == 0
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def run(spark, rows):
    placed = prefix_trie.in_order(spark.createDataFrame(rows, SCHEMA))
    out = prefix_trie.trie(prefix_trie.rebuilt(placed), placed.select("conv_id").distinct()).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *r[3:]) for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rng, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), 400, 401, 402]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 17])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None, "äö😀"]), 1, "x"))
    same = [("user", "first"), ("assistant", "second"), ("user", "third")]
    for c in range(600, 640):  # copies, and one very common first turn
        rows += [(c, i, r, t, 1, "x") for i, (r, t) in enumerate(same)] + [(c, 9, "user", str(c % 3), 1, "x")] * (c % 2)
    rows += rows[:7] + [(None, 1, "user", "lost", 1, "x")]
    assert run(spark, rows) == brute(rows)


def test_one_very_long_conversation(spark):
    rows = [(7, i, "user", f"t{i % 3}" * 20, 1, "x") for i in range(300)] + [(8, i, "user", f"t{i % 3}" * 20, 1, "x") for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "only", 1, "x") for c in (101, 102, 103, 104, 105, 201, 202)]
    assert run(spark, rows) == brute(rows)
    (root,) = run(spark, [])
    assert root == (None, 0, -1, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())
