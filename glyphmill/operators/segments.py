"""An inverted index of immutable segments that follows its documents.

A refresh compares the documents' digests with those that are indexed and writes one new segment with the postings
of what was added or changed; rows of documents that changed or went are named in a table of deleted units.
Segments are partitioned by document: a task writes the postings of the documents that it reads, sorted by term.
Nothing is shuffled to build them, no frequent term lands in one task, and a reader of few terms skips the other
pages of every file.  Segments of about one size are merged once there are FANOUT of them, which reads postings,
not texts; one that is half deleted is written anew.

Every state of the index is one small manifest, created once under its number: readers see whole states only, and of
two writers who start from one state the second fails.  Files that the last KEEP states do not name are deleted.

Defined results: rows without key are not indexed; of rows with one key that with the smallest digest counts; a
document that is refused (``ok`` false or null) is not indexed and goes if it was; a null text has no terms but is
indexed; a segment whose files are gone or incomplete is dropped, and its documents are indexed anew.
"""

from __future__ import annotations

import json
import math
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import PART_PY
from ..sources.scratch import staged

FANOUT = 4
#: Documents of the lowest tier; each further tier holds FANOUT times as many.
TIER = 1_000
#: States whose files stay, for readers that have begun.
KEEP = 2
#: Deleted units that are broadcast to readers; beyond, the join shuffles.
BROADCAST_GONE = 200_000
#: Rows whose terms are sent at once.
ROWS = 256


class Conflict(RuntimeError):
    """Another writer has made the next state already."""


@lru_cache(maxsize=1)
def marks() -> frozenset[str]:
    """Non-spacing marks."""
    return frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn")


def terms_of(text: str) -> list[str]:
    """Index terms of a text, as ``index_words`` gives them: marks are few in a text, so each is taken out of all of it."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        for mark in marks().intersection(text):
            text = text.replace(mark, "")
    return PART_PY.findall(text.lower())


def counted_terms(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, term, hits: terms are counted within each row, so nothing is shuffled."""
    schema = StructType([*(units.schema[k] for k in keys), StructField("term", StringType()), StructField("hits", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                rows, terms, hits = [], [], []
                for value in part.column(len(keys)).to_pylist():
                    found = Counter(terms_of(value or ""))
                    rows.append(len(found))
                    terms += found
                    hits += found.values()
                at = pa.array(np.repeat(np.arange(part.num_rows), rows))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(keys))), pa.array(terms, pa.string()), pa.array(hits, pa.int64())], [*keys, "term", "hits"])

    return units.select(*keys, text).mapInArrow(count, schema)


class SegmentIndex:
    """The index at ``root``, a folder that all machines share.  ``terms`` gives (key, term, hits) of documents."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", terms: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.terms = terms or (lambda docs: counted_terms(docs, [key]))
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    # States ------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict | None:
        """A manifest; null where its writer did not finish."""
        stream = self._fs.open(self._path(f"states/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def states(self) -> list[dict]:
        """All states that are kept, oldest first."""
        return [s for s in map(self._read, self._names("states")) if s]

    def state(self) -> dict:
        for name in reversed(self._names("states")):
            if found := self._read(name):
                return found
        return {"number": 0, "segments": [], "gone": [], "report": {}}

    def _commit(self, before: dict, segments: list[dict], gone: list[dict], report: dict) -> dict:
        names = self._names("states")
        number = max([before["number"], *(int(n) for n in names if self._read(n) is None)]) + 1
        state = {"number": number, "segments": segments, "gone": gone, "report": report}
        if self.state()["number"] != before["number"]:
            raise Conflict(f"state {before['number']} is not the last any more")
        try:
            out = self._fs.create(self._path(f"states/{number:012d}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"state {number} is there already") from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._sweep()
        return state

    def _sweep(self) -> None:
        """Delete what the last states do not name."""
        names = self._names("states")
        last = names[-KEEP:]
        named = {x["id"] for n in last if (s := self._read(n)) for x in [*s["segments"], *s["gone"]]}
        for folder in ("segments", "gone"):
            for name in self._names(folder):
                if name not in named and not name.startswith("."):
                    self._fs.delete(self._path(f"{folder}/{name}"), True)
        for name in names[:-KEEP]:
            self._fs.delete(self._path(f"states/{name}"), False)

    # Reading -----------------------------------------------------------------------------------------------

    def _table(self, state: dict, part: str) -> DataFrame:
        key = self.key
        schema = {"postings": f"segment string, {key} long, term string, hits long", "units": f"segment string, {key} long, digest string, length long"}[part]
        paths = [f"{self.root}/segments/{s['id']}/{part}" for s in state["segments"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        gone = self._gone(state)
        return rows if gone is None else rows.join(gone, ["segment", key], "left_anti")

    def _gone(self, state: dict) -> DataFrame | None:
        if not state["gone"]:
            return None
        rows = self.spark.read.schema(f"segment string, {self.key} long").parquet(*(f"{self.root}/gone/{g['id']}" for g in state["gone"]))
        return F.broadcast(rows) if sum(g["rows"] for g in state["gone"]) <= BROADCAST_GONE else rows

    def postings(self, state: dict | None = None) -> DataFrame:
        """key, term, hits, tf of all documents that are indexed."""
        return self._table(state or self.state(), "postings").drop("segment").withColumn("tf", F.col("hits").cast("double"))

    def units(self, state: dict | None = None) -> DataFrame:
        """segment, key, digest, length (tokens) of all documents that are indexed."""
        return self._table(state or self.state(), "units")

    def lengths(self, state: dict | None = None) -> DataFrame:
        return self.units(state).where("length > 0").select(self.key, "length")

    # Writing -----------------------------------------------------------------------------------------------

    def _write(self, postings: DataFrame, units: Callable[[DataFrame], DataFrame]) -> dict | None:
        """A new segment: its postings, and its units, which are made from the postings as written."""
        name = f"{uuid.uuid4().hex}"
        at = f"{self.root}/segments/{name}"
        laid = postings.select(F.lit(name).alias("segment"), self.key, "term", "hits").sortWithinPartitions("term")
        laid.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{at}/postings")
        written = self.spark.read.schema(laid.schema).parquet(f"{at}/postings")
        units(written).select(F.lit(name).alias("segment"), self.key, "digest", "length").write.option("compression", "zstd").parquet(f"{at}/units")
        docs = self.spark.read.parquet(f"{at}/units").count()
        if not docs:
            return None
        return {"id": name, "docs": docs, "gone": 0, "postings": written.count()}

    def lost(self, state: dict) -> list[str]:
        """Segments whose files are not all there any more."""
        out = []
        for s in state["segments"]:
            try:
                whole = all(self.spark.read.parquet(f"{self.root}/segments/{s['id']}/{part}").count() == s[n] for part, n in (("postings", "postings"), ("units", "docs")))
            except (PySparkException, Py4JJavaError):  # what readers say of files that are gone or damaged
                whole = False
            if not whole:
                out.append(s["id"])
        return out

    def refresh(self, docs: DataFrame, text: str = "text", digest: str = "digest", ok: str | None = None) -> dict:
        """Bring the index in line with ``docs`` (key, text, digest) and return the new state, with a report."""
        before = self.state()
        lost = set(self.lost(before))
        state = before | {"segments": [s for s in before["segments"] if s["id"] not in lost]}
        key = self.key
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).alias("text"), F.col(digest).alias("digest"), (F.coalesce(F.col(ok), F.lit(False)) if ok else F.lit(True)).alias("__ok"))
        new = rows.groupBy(key).agg(F.min(F.struct("digest", "__ok")).alias("x"), F.count("*").alias("__rows")).select(key, F.col("x.digest").alias("__new"), F.col("x.__ok").alias("__ok"), "__rows")
        outcome = (
            F.when(F.col("__ok").isNull(), "removed").when(~F.col("__ok"), "failed").when(F.col("segment").isNull(), "added")
            .when(F.col("digest").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
        )
        met = self.units(state).join(new, key, "full").select(key, "segment", "__new", "__rows", outcome.alias("outcome"))
        changes = staged(met.where("outcome <> 'unchanged'"), "index-changes")
        found = changes.groupBy("outcome").agg(F.count("*").alias("n"), F.max("__rows").alias("rows")).collect()
        counts, repeated = {r["outcome"]: r["n"] for r in found}, any((r["rows"] or 0) > 1 for r in found)

        build = changes.where("outcome IN ('added', 'updated')").select(key, F.col("__new").alias("digest"))
        made = None
        if counts.get("added", 0) + counts.get("updated", 0):
            picked = rows.where("__ok")
            if state["segments"] or repeated:  # else all of them; texts keep their place where keys are few
                wanted = self._small(build, counts).withColumnRenamed("digest", "__new").withColumnRenamed(key, "__key")
                picked = picked.join(wanted, (F.col(key) == F.col("__key")) & F.col("digest").eqNullSafe(F.col("__new")), "left_semi")
            if repeated:
                picked = picked.dropDuplicates([key])
            terms = self.terms(picked.drop("__ok"))
            made = self._write(terms, lambda written: build.join(written.groupBy(key).agg(F.sum("hits").alias("length")), key, "left").withColumn("length", F.coalesce("length", F.lit(0))))
        gone = changes.where("segment IS NOT NULL").select("segment", key)
        per = {r["segment"]: r["n"] for r in gone.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a segment
        tables = list(state["gone"])
        if per:
            tables.append(self._write_gone(gone))
        segments = [s | {"gone": s["gone"] + per.get(s["id"], 0)} for s in state["segments"]] + ([made] if made else [])
        unchanged = sum(s["docs"] - s["gone"] for s in segments) - (made["docs"] if made else 0)
        report = {"added": 0, "updated": 0, "removed": 0, "failed": 0} | counts | {"unchanged": unchanged, "indexed": unchanged + (made["docs"] if made else 0), "postings": made["postings"] if made else 0, "lost": len(lost)}
        if not counts and not lost:
            return before | {"report": report}
        return self._commit(before, *self._merged(state | {"segments": segments, "gone": tables}), report)

    def _small(self, build: DataFrame, counts: dict) -> DataFrame:
        return F.broadcast(build) if counts.get("added", 0) + counts.get("updated", 0) <= BROADCAST_GONE else build

    def _write_gone(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.root}/gone/{name}")
        return {"id": name, "rows": self.spark.read.parquet(f"{self.root}/gone/{name}").count()}

    def _merged(self, state: dict) -> tuple[list[dict], list[dict]]:
        """Segments and tables of deleted units after merging what is due."""
        segments = [s for s in state["segments"] if s["docs"] > s["gone"]]
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in segments:
                tiers.setdefault(max(0, math.ceil(math.log((s["docs"] - s["gone"]) / TIER, FANOUT))), []).append(s)
            due = next((t for t in tiers.values() if len(t) >= FANOUT), None) or [s for s in segments if 2 * s["gone"] > s["docs"]]
            if not due:
                break
            part = state | {"segments": due}
            units = self._table(part, "units")
            made = self._write(self._table(part, "postings"), lambda _, units=units: units)
            segments = [s for s in segments if s not in due] + ([made] if made else [])
        ids = [s["id"] for s in segments]
        tables = state["gone"] if any(s["gone"] for s in segments) else []
        if len(tables) >= FANOUT:
            rows = self.spark.read.schema(f"segment string, {self.key} long").parquet(*(f"{self.root}/gone/{g['id']}" for g in tables))
            tables = [self._write_gone(rows.where(F.col("segment").isin(ids)))]
        return segments, tables
