"""Packages: equal bytes, faults by name, nothing left of a failed write."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import bags as B

CONTENT = [b"one", b"two", b"", b"one", None, b"\x00\xff" * 5000, *(f"object {i}".encode() for i in range(40))]


def objects(spark, parts=3):
    return spark.createDataFrame([(bytearray(c) if c is not None else None, "x") for c in CONTENT], "content binary, digest string").repartition(parts)


def digests(folder):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir() if not p.name.endswith(".crc")}


def test_write_verify_read_back(spark, tmp_path):
    for name, parts in (("a", 3), ("b", 7)):
        B.export(objects(spark, parts), f"file://{tmp_path}/{name}", 4)
    assert digests(tmp_path / "a") == digests(tmp_path / "b") and len(digests(tmp_path / "a")) == 5
    got = B.imported(spark, f"file://{tmp_path}/a").collect()
    assert sorted(bytes(r["content"]) for r in got) == sorted({c for c in CONTENT if c is not None})
    assert all(r["object_id"] == f"sha256:{hashlib.sha256(bytes(r['content'])).hexdigest()}" and r["length"] == len(r["content"]) for r in got)
    known = spark.createDataFrame([(got[0]["object_id"],)], "object_id string")
    assert B.imported(spark, f"file://{tmp_path}/a", known).count() == len(got) - 1
    B.export(objects(spark).limit(0), f"file://{tmp_path}/none", 4)
    assert B.imported(spark, f"file://{tmp_path}/none").count() == 0


def rewritten(path, change):
    """The archive again with ``change`` over its entries {name: bytes}."""
    with zipfile.ZipFile(path) as z:
        names = {i.filename: z.read(i) for i in z.infolist()}
    change(names)
    with zipfile.ZipFile(path, "w") as z:
        for name, data in names.items():
            z.writestr(name, data)


def test_faults_are_named(spark, tmp_path):
    at = f"file://{tmp_path}/bag"
    B.export(objects(spark), at, 1)
    bag = next((tmp_path / "bag").glob("*.zip"))
    whole, one = bag.read_bytes(), f"data/sha256/{hashlib.sha256(b'one').hexdigest()}"
    found = lambda: {(r["path"], r["fault"]) for r in B.faults(spark, at).collect()}
    assert found() == set()
    bag.write_bytes(whole.replace(b"object 17", b"object 71"))
    assert found() == {(f"data/sha256/{hashlib.sha256(b'object 17').hexdigest()}", "entry is broken")}
    with pytest.raises(ValueError, match="entry is broken"):
        B.imported(spark, at)
    for change, want in (
        (lambda n: n.update({one: b"eno"}), {(one, "digest differs")}),
        (lambda n: n.pop(one), {(one, "missing"), (None, "43 objects of 44")}),
        (lambda n: n.update({"data/sha256/extra": b"e"}), {("data/sha256/extra", "not listed"), (None, "45 objects of 44")}),
        (lambda n: n.update({"bag-info.txt": b"Payload-Oxum: 1.1\n"}), {("bag-info.txt", "digest differs")}),
    ):
        bag.write_bytes(whole)
        rewritten(bag, change)
        assert found() == want
    bag.write_bytes(whole[:100])
    assert found() == {(None, "archive is broken: BadZipFile")}
    bag.unlink()
    assert found() == {(None, "archive is broken: FileNotFoundError")}


def test_failed_write_leaves_nothing(spark, tmp_path):
    broken = objects(spark).withColumn("content", F.when(F.length("content") > 9000, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        B.export(broken, f"file://{tmp_path}/bag", 2)
    assert not (tmp_path / "bag").exists() or not any((tmp_path / "bag").iterdir())
