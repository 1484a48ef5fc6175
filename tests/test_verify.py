"""Closest passages against brute force."""

import difflib
import random

import __spark_entry__ as entry
from glyphmill.operators import verify as V


def brute(text, quote):
    needle = V.plain(" ".join(V.fragments(quote)), True)[0]
    hay, places = V.plain(text, True)
    if not needle or not hay:
        return 0.0, 0
    width = len(needle)
    if len(hay) <= width:
        return difflib.SequenceMatcher(None, needle, hay).ratio(), 0
    step, best, where = max(1, width // 4), 0.0, 0
    for at in range(0, len(hay) - width + step, step):
        r = difflib.SequenceMatcher(None, needle, hay[at : at + width]).ratio()
        if r > best:
            best, where = r, places[at]
    return best, where


def texts():
    rng = random.Random(4)
    words = ["été", "the", "erth", "a", "Ünd", "over.", "(x)", "line\n", "…"]
    return ["", "a", "ééé"] + [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 20, 60, 300, 700)]


def test_closest_equals_brute_force():
    rng = random.Random(5)
    for t in texts():
        for _ in range(6):
            at = rng.randrange(max(1, len(t)))
            for q in (t[at : at + 60].replace("e", "a"), "no such words", ""):
                assert V.closest(t, q) == brute(t, q)


def test_closest_query_takes_all_documents_whole(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in entry.queries()["r15_closest"](spark, str(tmp_path)).collect()}
    assert sorted(out) == [r[0] for r in rows]
    assert any(r["at"] > 400 for r in out.values())


def test_statuses_of_quotes(spark):
    """In a current text, only in an earlier one, in none: each with its places, and the closest passage for the last."""
    docs = spark.createDataFrame([(1, "The Quick brown fox. It ran; the quick brown fox."), (2, "nothing here but moss and stone"), (3, None)], "doc_id long, text string")
    earlier = spark.createDataFrame([(2, "an older text: the heron stood still, and the quick brown fox slept"), (3, "lost words of three")], "doc_id long, text string")
    quotes = spark.createDataFrame([(10, "quick brown FOX"), (11, "heron stood … fox slept"), (12, "lost words"), (13, "moss und stone"), (14, "the heron"), (15, "")], "query_id long, quote string")
    targets = spark.createDataFrame([(q, d) for q in range(10, 16) for d in (1, 2, 3) if (q, d) != (14, 2)], "query_id long, doc_id long")
    near = spark.createDataFrame([(q, p, d, 0, t) for q in (12, 13, 14) for p, (d, t) in enumerate([(1, "The Quick brown fox."), (2, "moss and stone")], 1)], "query_id long, place int, doc_id long, ordinal int, text string")
    rows = V.verify(quotes, docs, targets, near, earlier).collect()
    of = lambda q: sorted((r["status"], r["doc_id"], r["start"], r["end"]) for r in rows if r["query_id"] == q)
    assert {s for s, *_ in of(10)} == {"verified"} and {d for _, d, *_ in of(10)} == {1}
    text = earlier.where("doc_id = 2").first()["text"]
    assert of(11) == [("only_in_other_version", 2, text.index("heron"), len(text))]
    assert of(12) == [("only_in_other_version", 3, 0, 10)]
    (lost,) = [r for r in rows if r["query_id"] == 13]
    assert lost["status"] == "not_found" and lost["doc_id"] == 2 and lost["ratio"] == brute("moss and stone", "moss und stone")[0]
    (other,) = [r for r in rows if r["query_id"] == 14]  # the document that had it is not among its targets
    assert other["status"] == "not_found"


def test_plain_looks_each_character_up_once(monkeypatch):
    """r12: a text is translated by a table; only new characters are told from their definition."""
    asked = []
    real = V.plain_character
    monkeypatch.setattr(V, "TABLES", {loose: V.Plain(loose) for loose in (False, True)})
    monkeypatch.setattr(V, "plain_character", lambda c, loose: asked.append(c) or real(c, loose))
    text = "ﬁ­½  “A” …\x1c é" * 50
    for loose in (False, True):
        asked.clear()
        out, places = V.plain(text, loose)
        assert len(asked) == len(set(text))
        pieces = [(x, i) for i, c in enumerate(text) for x in real(c, loose)]
        firsts = [(x, i) for k, (x, i) in enumerate(pieces) if not (x.isspace() and k and pieces[k - 1][0].isspace())]
        assert out == " ".join("".join(x for x, _ in pieces).split()) and places.tolist() == [i for _, i in firsts][: len(out)]


def test_quotes_meet_all_documents_that_hold_them(spark):
    """find_quotes against every pair: short and long fragments, several, marks, letters that fold to more, spaces."""
    rng = random.Random(6)
    many = texts() + ["ﬁne ½ “marks” — A B", "x" * 300, "\n\nold stone, old\nstone and older stone", None, "a…b", "퟿ z"]
    whole = [t for t in many if t]
    quotes = ["a", "…", "", "“”", "stone … older", "OLD STONE", "x" * 127, "x" * 200, "x" * 301, "FINE 1/2 \"marks\" - a b", "older … old", "Ünd", "und"]
    for t in whole:
        for size in (1, 2, 5, 31, 64, 130, 400):
            at = rng.randrange(max(1, len(t) - size))
            quotes += [t[at : at + size], t[at : at + size].upper(), t[at : at + size // 2] + " … " + t[at + size : at + 2 * size]]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    asked = [(i, q) for i, q in enumerate([*quotes, quotes[0], None])]
    rows = V.find_quotes(spark.createDataFrame(asked, "query_id long, quote string"), docs).collect()
    wanted = [(i, d, *p, t.count("\n", 0, p[0]) + 1) for i, q in asked for d, t in enumerate(many) if (p := V.locate(t or "", q or ""))]
    assert len(wanted) > 300 and sorted(map(tuple, rows)) == sorted(wanted)


def test_blocks_of_quotes_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common words here and number {i} there") for i in range(30)], "doc_id long, text string")
    quotes = spark.createDataFrame([(i, f"number {i} there") for i in range(30)] + [(99, "common words")], "query_id long, quote string")
    monkeypatch.setattr(V, "SENT", 4)
    monkeypatch.setattr(V, "GIVEN", 3)
    found = sorted((r["query_id"], r["doc_id"]) for r in V.find_quotes(quotes, docs).collect())
    assert found == [(i, i) for i in range(30)] + [(99, i) for i in range(30)]


def test_r12_looks_in_every_document(spark, tmp_path):
    """r12: forty copies hold the quote; the 25 best-ranked documents are not all."""
    rng = random.Random(7)
    words = [f"w{n}" for n in range(400)]
    one = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, one if i < 40 else " ".join(rng.choice(words) for _ in range(60)), "en", "s", 1) for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["r12_verify_quotes"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out if r["query_id"] == 0 and r["status"] == "verified") == list(range(40))
    assert {r["status"] for r in out if r["query_id"] == 50} <= {"verified", "not_found"} and any(r["query_id"] == 50 for r in out)


def test_bounds_by_order_spare_most_windows(monkeypatch):
    """r12: windows are compared only while their bound is above the best; letters in any order spare few of them."""
    rng = random.Random(8)
    syllables = ["er", "an", "th", "in", "on", "ti", "he", "re", " "]
    text = "".join(rng.choice(syllables) for _ in range(900))
    quote = "".join(rng.choice(syllables) for _ in range(60))[:60]  # nowhere in the text
    wanted, compared = brute(text, quote), []
    real = difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *x: compared.append(1) or real(*x))
    assert V.closest(text, quote) == wanted
    assert 0 < len(compared) < 60  # of about 120
    for size in (1, 63, 64, 65, 200, 256, 257):
        q = "".join(rng.choice(syllables) for _ in range(size))[:size]
        assert V.closest(text, q) == brute(text, q)
