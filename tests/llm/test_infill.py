"""Fill-in-middle transformation against a brute-force version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", "one", " ", "a b c d e", "  two  words\n\n", "mark <P> in text here", "<S>", "é😀 ü\t\x0b\x0cx \x85 \xa0 y\x00z", "a<b <M c S> P>", "end<", "wörd " * 40_000, "x" * 150_000, " " * 70_000 + "y" + " " * 70_000]


def brute(doc_id, text):
    text = text or ""
    units = [m.group() for m in UNIT.finditer(text)]
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transform_and_back(spark):
    rows = [(10 * i + k, t, 1, "x", "y") for i, t in enumerate(TEXTS) for k in range(8)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, output string, __whole string").repartition(3)
    out = infill.transform(df)
    assert sorted(out.columns) == sorted([*df.columns, "form", "prefix_chars", "middle_chars"])
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["__whole"] == "y"


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert [(r["n"], r["form"], r["output"]) for r in infill.transform(df).orderBy("n").collect()] == [(brute("", t)[0], brute("", t)[1], brute("", t)[4]) for t in (None, "a b c")]
    assert infill.transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b" * 50, " " * 30, "abc  \n d " * 9, "x" * 40])
def test_pieces_end_where_units_end(text, monkeypatch):
    from tokenizers import Regex, pre_tokenizers

    monkeypatch.setattr(infill, "PIECE", 7)
    split = pre_tokenizers.Split(Regex(infill.UNIT), "isolated")
    assert "".join(infill.pieces(text)) == text
    assert infill.unit_ends(text, split) == [m.end() for m in UNIT.finditer(text)]


def test_other_sentinels(spark):
    df = spark.createDataFrame([(i, f"w{i} v <P> u") for i in range(40)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = infill.transform(df, cut=100, sentinels=marks)
    assert out.where("form = 'plain'").count() == 0
    assert out.where(infill.restored(F.col("output"), F.col("form"), marks) != F.col("text")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x"), ("aa", "x", "y")):
        with pytest.raises(ValueError):
            infill.transform(df, sentinels=bad)
