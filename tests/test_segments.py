"""The segmented index against one built at once."""

import random

import pytest

from glyphmill.functions import text as T
from glyphmill.operators import index as I
from glyphmill.operators import segments as G

SCHEMA = "doc_id long, text string, digest string, ok boolean, segment string"


def docs(spark, texts, refused=()):
    return spark.createDataFrame([(i, t, f"{hash(t)}", i not in refused, "x") for i, t in texts.items()], SCHEMA)


def content(index):
    return sorted((r["doc_id"], r["term"], r["hits"]) for r in index.postings().collect())


def at_once(spark, texts):
    return sorted((r["doc_id"], r["term"], r["hits"]) for r in I.postings(docs(spark, texts), ["doc_id"]).collect())


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "TIER", 30)
    return G.SegmentIndex(spark, f"file://{tmp_path}/index")


def test_counted_terms(spark):
    texts = {1: "b a B, ä-a 7 7 7", 2: None, 3: "", 4: "…", 5: "x " * 5000, 6: "ΑΣ ΑΣ. ß\u0301e e\u0301\u0323 \u0301q ١٢ a_b \x1cz"}
    got = sorted((r["doc_id"], r["term"], r["hits"]) for r in G.counted_terms(docs(spark, texts), ["doc_id"]).collect())
    assert got[:4] == [(1, "7", 3), (1, "a", 3), (1, "b", 2), (5, "x", 5000)] and got == at_once(spark, texts)


def test_terms_of_all_characters():
    every = "".join(f"a{chr(c)}B " for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert G.terms_of(every) == T.index_words(every) and G.terms_of("ÀB_c") == ["ab", "c"]


def test_refreshes_equal_an_index_built_at_once(spark, index):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 9))) for i in range(60)}
    seen = []
    for _ in range(9):
        state = index.refresh(docs(spark, texts, refused={5}), ok="ok")
        want = {i: t for i, t in texts.items() if i != 5}
        assert content(index) == at_once(spark, want)
        assert state["report"]["indexed"] == index.units().count() == len(want)
        seen.append(state["report"])
        for i in rng.sample(sorted(texts), 6):
            texts[i] += " new"
        del texts[rng.choice([i for i in texts if i != 5])]
        texts[1000 + rng.randrange(9000)] = "added now"
    assert all(r["failed"] == 1 and r["removed"] == 1 and 5 <= r["updated"] <= 6 and r["postings"] < 60 for r in seen[1:])
    assert len(index.state()["segments"]) < G.FANOUT * 2 and len(index.states()) == G.KEEP
    named = {x["id"] for s in index.states() for x in s["segments"]}
    assert set(index._names("segments")) == named


def test_search_over_segments(spark, index):
    texts = {i: f"word{i % 7} word{i % 3} common" for i in range(40)}
    index.refresh(docs(spark, texts))
    texts |= {i: "word1 changed" for i in range(0, 40, 5)}
    index.refresh(docs(spark, texts))
    terms = spark.createDataFrame([(1, "word1", False), (1, "common", False), (2, "chan", True)], "query_id int, item string, prefix boolean")
    score = lambda posted, length: sorted((r["query_id"], r["doc_id"], round(r["rank"], 9)) for r in I.bm25(I.matching(posted, terms, ["doc_id"]), length, ["doc_id"]).collect())
    whole = I.postings(docs(spark, texts), ["doc_id"])
    assert score(index.postings(), index.lengths()) == score(whole, I.lengths(whole, ["doc_id"]))


def test_nothing_to_do_and_repeated_and_null_keys(spark, index):
    rows = [(1, "a b", "d1", True, "x"), (1, "a b", "d1", True, "x"), (1, "z", "d2", True, "x"), (None, "c", "d", True, "x"), (2, None, None, True, "x"), (3, "r", "d3", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert index.refresh(df, ok="ok")["report"] == {"added": 2, "updated": 0, "removed": 0, "failed": 1, "unchanged": 0, "indexed": 2, "postings": 2, "lost": 0}
    assert content(index) == [(1, "a", 1), (1, "b", 1)]
    assert index.refresh(df.where("ok"), ok="ok")["number"] == 1
    assert index.refresh(df.limit(0), ok="ok")["report"]["removed"] == 2 and content(index) == []
    assert index.refresh(df.limit(0), ok="ok")["report"]["indexed"] == 0


def test_lost_files_are_built_anew(spark, index, tmp_path):
    texts = {i: f"t{i}" for i in range(20)}
    first = index.refresh(docs(spark, texts))
    texts[3] = "other"
    index.refresh(docs(spark, texts))
    part = next((tmp_path / "index" / "segments" / first["segments"][0]["id"] / "postings").glob("*.parquet"))
    part.unlink()
    report = index.refresh(docs(spark, texts))["report"]
    assert report["lost"] == 1 and report["added"] == 19 and report["unchanged"] == 1
    assert content(index) == at_once(spark, texts)


def test_second_writer_fails_and_half_written_states_are_passed_over(spark, index, tmp_path):
    index.refresh(docs(spark, {1: "a"}))
    before = index.state()
    index.refresh(docs(spark, {1: "b"}))
    with pytest.raises(G.Conflict):
        index._commit(before, [], [], {})
    (tmp_path / "index" / "states" / f"{3:012d}").write_text('{"number": 3, "seg')
    assert content(index) == [(1, "b", 1)]
    assert index.refresh(docs(spark, {1: "c"}))["number"] == 4
    assert content(index) == [(1, "c", 1)]
