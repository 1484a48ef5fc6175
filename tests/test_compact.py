"""Compact forms: exact round trips, smaller or left alone, faults by name."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import compact as C


def test_forms_and_faults():
    rng = random.Random(1)
    words = C.dictionary([" ".join(rng.choice(["alpha", "beta", "gamma delta"]) for _ in range(9)).encode() for _ in range(50)])
    assert 0 < len(words) <= C.WINDOW
    text = b"alpha beta gamma delta alpha gamma delta beta alpha"
    form = C.encoded(text, words)
    assert C.decoded(form, words) == text and len(form) < len(text)
    assert C.encoded(b"", words) is None and C.encoded(rng.randbytes(500), words) is None
    for bad, fault in ((form[:9], "head is cut off"), (b"x" + form[1:], "not a compact form"), (form[:-3], "stream is cut off"), (form + b"z", "bytes behind the end"), (form[: C.HEAD.size] + b"\xff" * 9, "stream is broken"), (form[:13] + (9).to_bytes(8, "big") + form[21:], "length differs"), (form[:13] + (99).to_bytes(8, "big") + form[21:], "length differs")):
        with pytest.raises(ValueError, match=fault):
            C.decoded(bad, words)
    with pytest.raises(ValueError, match="another dictionary"):
        C.decoded(form, words + b"!")


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, bytearray((" ".join(rng.choice([f"{k}word", "common phrase", "x"]) for _ in range(rng.randrange(0, 60)))).encode()), "s") for k in ("a", "b") for _ in range(60)] + [("a", None, "s"), (None, bytearray(b"no kind " * 20), "s"), ("b", bytearray(rng.randbytes(80)), "s")]
    df = spark.createDataFrame(rows, "kind string, content binary, stored string")
    known = C.dictionaries(df)
    assert set(known) == {"a", "b", None} and b"aword" in known["a"] and b"aword" not in known["b"]
    small = C.compact(df, known)
    assert {r["form"] for r in small.collect()} == {"compact", "plain", None}
    assert small.where(F.octet_length("stored") > F.octet_length("content")).count() == 0
    back = C.restored(small.withColumnRenamed("content", "was"), known)
    assert back.where(~F.col("was").eqNullSafe(F.col("content")) | F.col("fault").isNotNull()).count() == 0
    other = C.restored(small.where("kind = 'a'").withColumn("kind", F.lit("b")).drop("content"), known)
    assert {r["fault"] for r in other.where("form = 'compact'").collect()} == {"made with another dictionary"}
    assert C.dictionaries(df.limit(0)) == {}
