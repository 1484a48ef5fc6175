"""Scalar functions, planning, passages, blocks and quotes, on edge inputs."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import planning
from glyphmill.functions import text as T
from glyphmill.operators import blocks as B
from glyphmill.operators import passages as P
from glyphmill.operators import verify as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\n\n", ["a", "b", "c", ""]), ("\n", [""])])
def test_lines(spark, text, lines):
    assert one(spark, text, T.lines_of) == lines == P.lines_of(text)


def test_decode_strips_mark_and_refuses_bad_bytes(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbfa\r\nb",), (b"\xff\xfe",), (b"",)], "x binary")
    assert [r[0] for r in df.select(T.decode_source(F.col("x"))).collect()] == ["a\nb", None, ""]


def test_estimates_count_code_points(spark):
    assert one(spark, "😀" * 5, T.token_estimate) == 2
    assert one(spark, "😀" * 5, T.byte_size) == 20


@pytest.mark.parametrize("limit", range(1, 9))
def test_truncate_utf8(spark, limit):
    text = "aé😀ß"
    want = text.encode()[:limit].decode(errors="ignore")
    assert one(spark, text, lambda c: T.truncate_utf8(c, limit)) == want


def test_fold():
    assert T.fold_text("Straße Éa") == "strasse ea"
    assert T.index_text("Straße Éa") == "straße ea"


def test_stem():
    assert planning.stem("Testing") == ("test", True)
    assert planning.stem("cats") == ("cats", False)
    assert planning.stem("2024ing") == ("2024ing", False)
    assert planning.stem("sugar") == ("sugar", True)


def test_plan_falls_back_to_stop_words():
    assert [t.text for t in planning.plan("the of")] == ["the", "of"]
    assert planning.plan('"a b" c1')[0] == planning.Term("a b", phrase=True)
    assert len(planning.plan(" ".join(f"w{i}" for i in range(40)))) == planning.MAX_TERMS


@pytest.mark.parametrize("bad", ["", "  ", '"open', '""', " ".join("x" * 33), "x" * 300])
def test_grammar_errors(bad):
    with pytest.raises(planning.QueryError):
        planning.parse(bad)


def test_passages_respect_structure():
    text = "# One\n\nalpha beta gamma\n\n| a | b |\n| 1 | 2 |\n\n```\n# not a heading\n\nx\n```\nTwo\n---\ndelta epsilon"
    rows = P.passages_of(text, "markdown")
    assert [r[4] for r in rows][-1] == "One > Two"
    assert any(r[5].startswith("```") and r[5].endswith("```") for r in rows)
    assert [(r[1], r[2]) for r in rows] == sorted((r[1], r[2]) for r in rows)


def test_unclosed_fence_runs_to_the_end():
    assert P.passages_of("```\nabc\n\ndef", "markdown")[0][1:3] == (1, 4)


def test_passages_are_bounded():
    rng = random.Random(5)
    text = "\n".join("w" * rng.randint(1, 300) for _ in range(200))
    rows = P.passages_of(text)
    assert all(len(r[5]) <= P.LARGE for r in rows)
    assert rows[0][1] == 1 and rows[-1][2] == 200
    assert all(a[2] + 1 == b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_csv_passages():
    rows = P.passages_of("id,name\n" + "\n".join(f"{i},name{i}" for i in range(60)), "csv")
    assert [(r[1], r[2]) for r in rows] == [(2, 26), (27, 51), (52, 61)]
    assert rows[0][4] == "columns: id,name"


def test_native_heading_path_and_page(spark):
    s = P.structures(spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\n<!-- page 1 -->\nz")], "id int, text string"), ["id"])
    got = s.select(P.heading_path(F.col("headings"), F.lit(4)), P.heading_path(F.col("headings"), F.lit(5)), P.page_for_line(F.col("pages"), F.lit(7)), P.page_for_line(F.col("pages"), F.lit(2))).first()
    assert tuple(got) == ("A > B", "C", 1, None)


def test_markdown_blocks():
    kinds = [(b[1], b[7]) for b in B.markdown_blocks("# T #\npara\n\n- a\n- b\n  c\n\n> q\n\n~~~\ncode\n~~~\nSub\n===\n")]
    assert kinds == [("heading", "T"), ("paragraph", "para"), ("list", ""), ("list_item", "a"), ("list_item", "b\nc"), ("quote", "q"), ("code", "code"), ("heading", "Sub")]


def test_csv_blocks_keep_spans():
    rows = B.csv_blocks('a,b\r\n1,"x\ny"\r\n2,3,4\r\n')
    assert [(r[5], r[6]) for r in rows] == [(2, 3), (4, 4)]
    assert rows[1][7] == '[["a","2"],["b","3"],[null,"4"]]'


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n \nc\n"), (2, ""), (3, "\n\n")], "id int, text string")
    assert [tuple(r) for r in B.paragraphs(df, ["id"]).orderBy("id", "ordinal").collect()] == [(1, 0, 1, 2, "a\nb"), (1, 1, 5, 5, "c")]


@pytest.mark.parametrize(("text", "quote", "want"), [
    ("He said “yes” today", '"said "yes""', (3, 12, "exact")), ("a  b\nc d", "b c", (3, 6, "exact")), ("alpha **beta** gamma", "beta gamma", (8, 20, "normalized")),
    ("one two three four", "one … four", (0, 18, "exact")), ("one two", "two one", None), ("abc", "", None), ("ABC", "abc", (0, 3, "normalized")),
])
def test_locate(text, quote, want):
    assert V.locate(text, quote) == want


def test_closest_finds_the_window():
    ratio, at = V.closest("x" * 50 + " the quick brown fox " + "y" * 50, "the quick brawn fox")
    assert ratio > 0.8 and 40 <= at <= 60


def test_snippet_is_bounded():
    text = " ".join(["filler"] * 100 + ["needle"] + ["filler"] * 100)
    s = V.best_snippet(text, planning.plan("needle"))
    assert "needle" in s and len(s) <= 242 and s.startswith("…") and s.endswith("…")


def test_texts_with_nul_are_refused_not_lost(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a\0b"), (3, None), (4, "")], "id int, text string")
    assert sorted(tuple(r) for r in B.text_lines(df, ["id"]).collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 0, None)]


def test_structure_of_documents_with_their_own_headings(spark):
    text = "# A\n- item\n\nSub\n===\n> q\n---\n```\n# no\n```\n## B"
    s = P.structures(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).first()
    assert [(h["line"], h["level"], h["text"]) for h in s["headings"]] == [(1, 1, "A"), (4, 1, "Sub"), (11, 2, "B")]


def test_phrases_count_places(spark):
    from glyphmill.operators import index as I

    units = spark.createDataFrame([(1, "a b a b c", "a b"), (2, "b a", "x"), (3, "a bc a b", "")], "u int, text string, heading string")
    fields = {"text": 1.0, "heading": 0.5}
    post = I.postings(units, ["u"], fields)
    phrases = spark.createDataFrame([(7, "p", ["a", "b"], False), (7, "q", ["a", "b"], True)], "query_id int, item string, words array<string>, prefix boolean")
    got = {(r["item"], r["u"]): r["tf"] for r in I.phrase_hits(post, units, phrases, ["u"], fields).collect()}
    assert got == {("p", 1): 2.5, ("p", 3): 1.0, ("q", 1): 2.5, ("q", 3): 2.0}
    wanted = spark.createDataFrame([(7, "b", True), (7, "bc", True), (7, "a", False)], "query_id int, item string, prefix boolean")
    got = {(r["item"], r["u"]): r["tf"] for r in I.matching(post, wanted, ["u"]).collect()}
    assert got == {("a", 1): 2.5, ("a", 2): 1.0, ("a", 3): 2.0, ("b", 1): 2.5, ("b", 2): 1.0, ("b", 3): 2.0, ("bc", 3): 1.0}


def test_plan_scans_once(spark):
    assert [(t.text, t.prefix, t.phrase) for t in planning.plan('the "Quoted Words" testing "one" of "" testing 2024')] == [("quoted words", False, True), ("one", False, False), ("test", True, False), ("2024", False, False)]
    assert planning.plan('"..." the') == [planning.Term("the", False)] and planning.plan("") == []
    assert [planning.stem(w)[0] for w in ("nationen", "ationen", "Verwaltungen", "cities", "issues", "ings")] == ["nation", "ation", "verwalt", "citi", "issu", "ings"]


def test_refused_tasks_are_told(spark):
    from glyphmill.operators import evidence

    tasks = spark.createDataFrame([(1, "NASA's part-7 NASA 2024 and today x"), (2, " ".join(f"w{i}" for i in range(65))), (3, "y" * 129), (4, " ".join(f"w{i}" for i in range(64))), (5, None), (6, "Nasa NASA nasa'S")], "query_id int, task string")
    rows = evidence.relevance_signals(tasks).collect()
    of = lambda q: sorted((r["token"], r["class"], r["weight"]) for r in rows if r["query_id"] == q)
    assert of(1) == [("2024", "volatile_time", 4), ("nasa", "identifier", 4), ("part-7", "identifier", 4), ("today", "volatile_time", 1), ("x", "ordinary", 1)]
    assert of(2) == of(3) == [(None, "refused", None)] and len(of(4)) == 64 and of(5) == [] and of(6) == [("nasa", "ordinary", 1)]
