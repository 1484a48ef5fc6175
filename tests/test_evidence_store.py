"""Native documents: pointers against a walk in Python, listing, refusals, and plans without Python."""

import json
import re

import pytest

from glyphmill.operators import evidence as V
from glyphmill.operators import evidence_store as E

NATIVE = {"texts": [{"label": "title", "text": "é\"x\"", "page": 0}, {"text": "b", "page": None}, "odd"], "tables": [{"page": 2, "cells": [{"row": 0, "col": 1, "text": "c"}]}, {}], "pictures": [{"caption": "p"}], "a/b": {"~t": [1, 2.5, None, True]}, "0": {"0": "by name"}, "": "empty", "q\"'?": 1}


def store(spark, rows):
    return E.stored(spark.createDataFrame(rows, "doc_id long, version_id string, native string, status string"))


def walk(document, pointer):
    here = document
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        if isinstance(here, list):
            if not re.fullmatch("0|[1-9][0-9]*", token) or int(token) >= len(here):
                raise KeyError(token)
            here = here[int(token)]
        elif isinstance(here, dict):
            here = here[token]
        else:
            raise KeyError(token)
    return here


POINTERS = ["", "/", "/texts", "/texts/0/text", "/texts/1/page", "/texts/2", "/texts/2/x", "/texts/3", "/texts/-", "/texts/00", "/a~1b/~0t/1", "/a~1b/~0t/2", "/a~1b/~0t/3", "/0/0", "/0/1", "/q\"'?", "/tables/0/cells/0/col", "/texts/99999999999"]


def test_pointers_like_a_walk_in_python(spark):
    s = store(spark, [(1, "v", json.dumps(NATIVE), "x")])
    asked = spark.createDataFrame([(i, 1, "v", p) for i, p in enumerate(POINTERS)], "request_id int, doc_id long, version_id string, pointer string")
    got = {r["request_id"]: (r["status"], r["value"]) for r in E.resolved(asked, s).collect()}
    for i, p in enumerate(POINTERS):
        try:
            want = ("found", walk(NATIVE, p))
        except KeyError:
            assert got[i] == ("missing", None), p
            continue
        assert got[i][0] == "found" and json.loads(got[i][1]) == want[1], p
        assert V.resolve_pointer(NATIVE, p) == want[1]


def test_refusals(spark):
    s = store(spark, [(1, "v", '{"a": "' + "x" * 90 + '"}', "x"), (2, "v", "{broken", "x"), (3, "v", None, "x")])
    assert {r["doc_id"]: r["status"] for r in s.collect()} == {1: "stored", 2: "not_json", 3: "absent"}
    asked = spark.createDataFrame([(1, 1, "v", "/a"), (2, 1, "v", "a"), (3, 1, "v", "/~"), (4, 2, "v", "/a"), (5, 1, "w", "/a"), (6, 1, "v", None), (7, 1, "v", "/b")], "request_id int, doc_id long, version_id string, pointer string")
    assert {r["request_id"]: r["status"] for r in E.resolved(asked, s, 50).collect()} == {1: "too_large", 2: "invalid_pointer", 3: "invalid_pointer", 4: "no_document", 5: "no_document", 6: "invalid_pointer", 7: "missing"}
    assert json.loads(E.native_of(s).first()["native"]) == {"a": "x" * 90} and E.resolved(asked.limit(0), s).count() == 0


def test_listing(spark):
    s = store(spark, [(1, "v", json.dumps(NATIVE), "x"), (2, "v", '{"texts": {"not": "a list"}}', "x"), (3, "v", "[]", "x")])
    rows = sorted((r["part"], r["outer"], r["inner"], r["pointer"], r["parent"], r["label"], r["text"], r["page"], r["row"], r["col"]) for r in E.listed(s).collect())
    assert [r[3] for r in rows] == ["/texts/0", "/texts/1", "/texts/2", "/tables/0/cells/0", "/pictures/0"]
    assert rows[0][4:] == (None, "title", "é\"x\"", 0, None, None) and rows[3][4:] == ("/tables/0", None, "c", 2, 0, 1) and rows[4][6] == "p"
    assert E.text_view(E.listed(s)).first()["view"] == "title: é\"x\"\nb\n"


@pytest.mark.parametrize("pointer", ["$.texts[0].text"])
def test_constant_paths_reach_the_scan(spark, tmp_path, pointer):
    store(spark, [(1, "v", json.dumps(NATIVE), "x")]).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s")).selectExpr(f"variant_get(native, '{pointer}', 'string') AS t")
    plan = df._jdf.queryExecution().toString()
    assert df.first()["t"] == "é\"x\"" and "ReadSchema: struct<native:struct<0:string>>" in plan
    listing = E.listed(spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution().toString()
    assert "Python" not in listing
