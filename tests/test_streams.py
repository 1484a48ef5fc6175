"""Delta pages through crashes, throttling and resets; the watch cycle with timers."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from glyphmill.operators import change as C
from glyphmill.streaming import delta_pages as D
from glyphmill.streaming import watch as W


def pages_in(folder: Path, pages, start=0, base=""):
    for n, changes in enumerate(pages, start):
        (folder / f"{base}{n}.json").write_text(json.dumps({"changes": changes, "next": f"{base}{n + 1}"}))


def final(pages):
    out = {}
    for changes in pages:
        for key, kind, revision in changes:
            out[key] = revision if kind == "UPSERT" else None
    return {k: v for k, v in out.items() if v is not None}


PAGES = [[["a", "UPSERT", "1"], ["b", "UPSERT", "1"]], [], [["a", "UPSERT", "2"], ["a", "TOMBSTONE", "3"]], [["c", "UPSERT", "1"], ["b", "UPSERT", "2"]]]


def run(spark, tmp_path, **options):
    D.sync_pages(D.read_pages(spark, f"file://{tmp_path}/pages", **options), f"{tmp_path}/target", f"{tmp_path}/checkpoint").awaitTermination()
    return {r["item_key"]: r["revision"] for r in D.synced(spark, f"{tmp_path}/target").collect()}


def test_pages_follow_the_cursor(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    pages_in(tmp_path / "pages", PAGES)
    assert run(spark, tmp_path) == final(PAGES) == {"b": "2", "c": "1"}
    more = [[["b", "TOMBSTONE", "3"], ["d", "UPSERT", "1"]]]
    pages_in(tmp_path / "pages", more, len(PAGES))
    assert run(spark, tmp_path) == final(PAGES + more)
    assert run(spark, tmp_path) == final(PAGES + more)  # nothing new


def test_all_batches_of_a_chain(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    pages_in(tmp_path / "pages", PAGES)
    assert run(spark, tmp_path, pages="1") == {"a": "1", "b": "1"}  # one batch a run
    D.sync_all(lambda: D.read_pages(spark, f"file://{tmp_path}/pages", pages="1"), f"{tmp_path}/target", f"{tmp_path}/checkpoint")
    assert {r["item_key"]: r["revision"] for r in D.synced(spark, f"{tmp_path}/target").collect()} == final(PAGES)


def test_events_with_a_gap_are_one_chain(spark, tmp_path):
    rows = [(n, n % 7, "view", float(n)) for n in [*range(10), *range(30_000, 30_010), *range(90_000, 90_005)]]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["item_key"]: r["revision"] for r in queries()["s15_delta_pages"](spark, str(tmp_path)).collect()}
    assert got == {str(u): str(n) for n, u, _, _ in rows}


class Flaky(D.FolderClient):
    """Fails once when page 2 is fetched, and is throttled once before every cursor."""

    def fetch(self, cursor):
        once = Path(self.root) / "failed"
        if cursor == "2" and not once.exists():
            once.write_text("[]")
            raise OSError("connection lost")
        return super().fetch(cursor)

    def after(self, cursor):
        asked = Path(self.root) / f"asked-{cursor}"
        if not asked.exists():
            asked.write_text("[]")
            raise D.Throttled(0.01)
        return super().after(cursor)


def test_crash_between_pages_loses_and_repeats_nothing(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    pages_in(tmp_path / "pages", PAGES)
    with pytest.raises(Exception, match="connection lost"):
        run(spark, tmp_path, client="tests.test_streams:Flaky")
    assert (tmp_path / "pages" / "failed").exists()
    assert run(spark, tmp_path, client="tests.test_streams:Flaky") == final(PAGES)


def test_reset_begins_a_new_epoch(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    pages_in(folder, PAGES)
    assert run(spark, tmp_path, reset="restart") == final(PAGES)
    (folder / "reset").write_text(json.dumps([f"{len(PAGES)}"]))
    with pytest.raises(Exception, match="CursorReset"):
        run(spark, tmp_path)
    (folder / "initial").write_text(json.dumps({"cursor": "x0"}))
    pages_in(folder, [[["z", "UPSERT", "9"]]], base="x")
    for _ in range(3):
        got = run(spark, tmp_path, reset="restart")
    assert got == {"z": "9"}


def test_circle_is_an_error(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for n in range(3):
        (tmp_path / "pages" / f"{n}.json").write_text(json.dumps({"changes": [], "next": f"{(n + 1) % 3}"}))
    with pytest.raises(Exception, match="comes back"):
        run(spark, tmp_path)


SEEN = "path string, seen_at string, fingerprint string"


def watched(spark, tmp_path, batches, stability=60_000, forget=600_000):
    """Each batch is one file, read in order; the state goes on from file to file."""
    schema = "path string, seen_at timestamp, fingerprint string"
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SEEN).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = W.watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), stability, forget).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def at(minute):
    return f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def test_watch_equals_the_batch_operator(spark, tmp_path):
    batches = [[("a", at(1), "f"), ("b", at(1), None), ("c", at(1), "x"), (None, at(1), "x")], [("a", at(2), "f"), ("b", at(3), "g"), ("c", at(2), None)], [("a", "2026-01-01 00:05:00.123456", "h"), ("a", at(4), None), ("c", at(6), "x")]]
    got = watched(spark, tmp_path, batches).where("not timed").select("path", "seen_at", "fingerprint", "since", "state", "event")
    rows = spark.createDataFrame([r for b in batches for r in b if r[0]], SEEN).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    want = C.file_states(rows, 60_000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 9


def test_timers_tell_and_forget(spark, tmp_path):
    batches = [[("a", at(0), "f"), ("gone", at(0), "f")], [("gone", at(1), None)], [("tick", at(30), "t")], [("tick", at(60), "t")], [("gone", at(61), "f"), ("a", at(61), "f")]]
    out = watched(spark, tmp_path, batches, stability=5 * 60_000, forget=10 * 60_000).orderBy("seen_at", "path").collect()
    timed = [(r["path"], r["state"]) for r in out if r["timed"]]
    assert ("a", "STABLE") in timed and all(p != "gone" for p, _ in timed)
    assert [r["event"] for r in out if r["path"] == "gone"] == ["DISCOVERED", "REMOVED", "DISCOVERED"]  # forgotten in between
    assert [r["event"] for r in out if r["path"] == "a" and not r["timed"]] == ["DISCOVERED", None]


def test_scans_tell_missing_paths_only_when_complete(spark):
    known, met = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "f")], "path string, fingerprint string")
    rows = lambda complete: sorted((r["path"], r["fingerprint"]) for r in W.scan_rows(known, met, complete, at(1)).collect())
    assert rows(True) == [("a", "f"), ("b", None)] and rows(False) == [("a", "f")]
