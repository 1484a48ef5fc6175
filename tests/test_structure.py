"""Outlines of broken and deep trees, and parsers as table functions."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import blocks as B
from glyphmill.operators import outline as O
from glyphmill.operators import parsers as P

SCHEMA = "doc_id long, block_id string, parent_id string, kind string, ordinal long, line_start int, line_end int, text string"


def tree(doc, links, kind="heading", text="a title\nmore"):
    return [(doc, b, p, kind, i, i + 1, i + 1, text) for i, (b, p) in enumerate(links)]


def test_outline_of_sound_and_broken_trees(spark):
    chain = [("n0", None), *((f"n{i}", f"n{i - 1}") for i in range(1, 33))]
    rows = tree(1, [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None)]) + tree(2, chain) + tree(3, [*chain, ("n33", "n32")])
    rows += tree(4, [("a", "gone")]) + tree(5, [("a", None), ("b", "c"), ("c", "b")]) + tree(6, [("a", None), ("b", "a"), ("b", "a")]) + tree(7, [("a", None), (None, "a")])
    rows += tree(8, [("a", None)], "paragraph") + tree(9, [("a", None)], "list", "") + tree(10, [("a", None)], "title", None) + tree(None, [("a", None)]) + tree(11, [("a", "a")])
    rows += tree(12, [("a", None)], "title", "x" * 600 + " y")
    got = O.outline(spark.createDataFrame(rows, SCHEMA)).collect()
    of = lambda doc: {r["block_id"]: r for r in got if r["doc_id"] == doc}
    assert {r["doc_id"] for r in got if r["status"] == "inconsistent"} == {3, 4, 5, 6, 7, 11} and len([r for r in got if r["doc_id"] == 6]) == 1
    assert {b: (r["depth"], r["path"], r["size"]) for b, r in of(1).items()} == {"a": (0, ["a"], 48), "b": (1, ["a", "b"], 24), "c": (2, ["a", "b", "c"], 12), "d": (1, ["a", "d"], 12), "e": (0, ["e"], 12)}
    assert of(2)["n32"]["depth"] == 32 and of(2)["n0"]["size"] == 33 * 12 and of(1)["a"]["label"] == "a title"
    assert not of(8) and of(9)["a"]["label"] == "list" and of(10)["a"]["label"] == "title" and of(12)["a"]["label"] == "x" * 512
    assert O.outline(spark.createDataFrame(rows[:0], SCHEMA)).count() == 0
    assert spark.conf.get(O.ROW_LIMIT, None) != "-1"


MARKDOWN = "# One\n\ntext\nmore\n\n- a\n  b\n- c\n\n> q\n\n```\ncode\n```\nTwo\n---\nend"


@pytest.mark.parametrize(("media", "kind", "text"), [("text/markdown", "markdown", MARKDOWN), ("text/csv", "csv", 'a,b\r\n1,"x\ny"\r\n2\r\n')])
def test_parsers_give_the_blocks_of_their_module(spark, media, kind, text):
    docs = spark.createDataFrame([(1, text, media, "x")], "doc_id long, text string, media_type string, failed string")
    got = P.parsed(docs, ["doc_id"]).orderBy("ordinal").collect()
    want = B.blocks(docs, ["doc_id"], kind=kind).orderBy("ordinal").collect()
    assert [tuple(r)[:-1] for r in got] == [tuple(r) for r in want] and all(r["failed"] is None for r in got)


def test_failures_are_rows(spark):
    P.parser("text/never")(lambda text: int(text) and [])
    try:
        docs = spark.createDataFrame([(1, 'a\n"b', "text/csv"), (2, "x", "image/png"), (3, "a\0b", "text/plain"), (4, None, "text/plain"), (5, "", "text/plain"), (6, "p\n \nq\n", "text/plain"), (7, "word", "text/never")], "doc_id long, text string, media_type string")
        got = P.parsed(docs, ["doc_id"]).collect()
    finally:
        del P.PARSERS["text/never"]
    assert {r["doc_id"]: r["failed"] for r in got if r["failed"]} == {1: "unexpected end of data", 2: "no parser for image/png", 3: "text holds a NUL", 7: "invalid literal for int() with base 10: 'word'"}
    assert [(r["text"], r["line_start"], r["line_end"]) for r in got if r["doc_id"] == 6] == [("p", 1, 1), ("q", 3, 3)] and not [r for r in got if r["doc_id"] in (4, 5)]


def test_records_have_the_schema_of_the_call(spark):
    P.register(spark)
    docs = spark.createDataFrame([(1, "n,name,x\n1,a,0.5\n,b,\n"), (2, "n,name\nword,a\n"), (3, "other\n1\n")], "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, r.* FROM {docs} d, LATERAL parse_records(d.text, 'n long, name string') r", docs=docs)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string", "string"]
    assert sorted(map(tuple, got.where("failed is null").collect()), key=str) == [(1, 1, "a", None), (1, None, "b", None)]
    assert {r["doc_id"]: r["failed"].split(":")[0] for r in got.where(F.col("failed").isNotNull()).collect()} == {2: "ValueError", 3: "KeyError"}
    wide = spark.sql("SELECT r.* FROM {docs} d, LATERAL parse_records(d.text, 'x double') r WHERE d.doc_id = 1", docs=docs)
    assert [f.dataType.simpleString() for f in wide.schema] == ["double", "string"] and sorted(r["x"] or 0 for r in wide.collect()) == [0, 0.5]
