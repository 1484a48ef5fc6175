"""Streaming twins, fixpoints, packing and snapshots."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import change as C
from glyphmill.operators import lineage as L
from glyphmill.operators import selection as S
from glyphmill.operators import versions as V
from glyphmill.sources import files
from glyphmill.streaming import changes


@pytest.fixture
def observations(spark):
    rng = random.Random(3)
    rows = [(f"p{i % 5}", 1_700_000_000 + i * 40, rng.choice([None, "a", "b", "b"])) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, t long, fingerprint string")
    return df.select("path", F.timestamp_seconds("t").alias("seen_at"), "fingerprint")


def test_file_states_stream_like_batch(spark, observations, tmp_path):
    observations.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(observations.schema).parquet(str(tmp_path / "in"))
    q = changes.file_states(stream, 300_000).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = C.file_states(observations, 300_000)
    cols = ["path", "seen_at", "state", "event"]
    assert sorted(map(tuple, spark.table("states").select(cols).collect()), key=repr) == sorted(map(tuple, batch.select(cols).collect()), key=repr)


def test_delta_stream_last_write_wins(spark, tmp_path):
    def page(n, rows):
        spark.createDataFrame([(*r, n, i) for i, r in enumerate(rows)], "item_key string, kind string, revision string, page int, ordinal int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)

    page(0, [("a", "UPSERT", "1"), ("b", "UPSERT", "1"), ("a", "UPSERT", "2")])
    run = lambda: changes.sync(spark.readStream.schema("item_key string, kind string, revision string, page int, ordinal int").parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    page(1, [("b", "TOMBSTONE", "2"), ("c", "UPSERT", "1")])
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "v1")).collect())) == [("a", "2"), ("c", "1")]


def test_windows_stream(spark, tmp_path):
    ev = spark.range(100).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"), F.lit(1.0).alias("value"))
    ev.write.parquet(str(tmp_path / "in"))
    out = changes.windowed(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", "10 minutes", "k")
    out.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == 100


@pytest.mark.parametrize("seed", range(3))
def test_stale_closure_like_a_walk(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(a, b) for b in range(1, n) for a in range(b) if rng.random() < 0.2]
    state = ["CURRENT" if rng.random() < 0.8 else "STALE" for _ in range(n)]
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate(state)], "artifact_id int, state string")
    deps = spark.createDataFrame([(b, f"o{a}", a) for a, b in edges] + [(0, "in", None), (1, "in", None)], "artifact_id int, input_digest string, producer_artifact_id int")
    got = {r["id"] for r in L.stale(nodes, deps, spark.createDataFrame([("in",)], "input_digest string")).collect()}
    want, todo = set(), [i for i in (0, 1) if state[i] == "CURRENT"]
    while todo:
        x = todo.pop()
        if x not in want:
            want.add(x)
            todo += [b for a, b in edges if a == x and state[b] == "CURRENT"]
    assert got == want


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    new = spark.createDataFrame([(3, 1), (1, 3), (3, 2)], "a int, b int")
    assert sorted(map(tuple, L.cyclic(new, edges).collect())) == [(3, 1), (3, 2)]


def test_reactivation_waits_for_producers(spark):
    nodes = spark.createDataFrame([(1, "STALE", 1), (2, "STALE", 2), (3, "STALE", 3), (4, "CURRENT", 3)], "artifact_id int, state string, slot int")
    deps = spark.createDataFrame([(1, "x", None), (2, "o1", 1), (3, "x", None)], "artifact_id int, input_digest string, producer_artifact_id int")
    assert sorted(r[0] for r in L.reactivate(nodes, deps, spark.createDataFrame([("x",)], "input_digest string")).collect()) == [1, 2]


def test_pack_passes_over_what_is_too_large(spark):
    items = spark.createDataFrame([(0, 1, 60, 11), (0, 2, 50, 12), (0, 3, 40, 13), (0, 4, 1, 14)], "query_id int, place long, size long, evidence_id long")
    assert [(r["evidence_id"], r["used"]) for r in S.pack(items, 100).orderBy("place").collect()] == [(11, 60), (13, 100)]


def test_late_observation_does_not_move_the_head(spark):
    o = spark.createDataFrame([(1, 10, 1, "a"), (1, 5, 2, "b"), (1, 10, 3, "a"), (1, 10, 4, "c")], "doc_id int, observed_at long, ingested_at long, scope string")
    assert [r["head_advanced"] for r in V.head_events(o).orderBy("ingested_at").collect()] == [True, False, True, False]
    assert V.heads(o).first()["scopes"] == 2


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_bytes(b"\xef\xbb\xbfhi\r\n")
    (tmp_path / "in" / ".hidden" / "b.md").write_text("no")
    (tmp_path / "in" / "c.bin").write_text("no")
    assert [r["path"].rsplit("/", 1)[1] for r in files.discover(spark, str(tmp_path / "in")).collect()] == ["a.md"]
    assert files.texts(files.snapshot(spark, str(tmp_path / "in"))).first()["text"] == "hi"
    told = {r["status"]: r["content"] for r in files.snapshot(spark, str(tmp_path / "in"), most_bytes=3).collect()}
    assert told == {"TOO_LARGE": None}
    with pytest.raises(ValueError, match="more than 0"):
        files.discover(spark, str(tmp_path / "in"), most=0)
    root = str(tmp_path / "store")
    files.replace_documents(spark, root, 0, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, t string"))
    files.replace_documents(spark, root, 1, spark.createDataFrame([(2, "c")], "doc_id int, t string"))
    assert sorted(map(tuple, files.latest(spark, root).collect())) == [(1, "a"), (2, "c")]


def test_numbers_run_over_ranges_and_groups(spark):
    from glyphmill.operators.numbering import numbered

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(300)] + [(None, None, 300)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    out = {(r["g"], r["x"], r["i"]): r["number"] for r in numbered(df, ["x", "i"], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] or 0, r[2]))
        assert [out[r] for r in own] == list(range(len(own)))


def test_tables_are_built_once_and_again_for_changed_files(spark, tmp_path):
    from glyphmill.sources.scratch import kept

    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.read.parquet(path).selectExpr("id + 1 AS id")

    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert kept(spark.read.parquet(path), "test", build).count() == 3
    assert len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert kept(spark.read.parquet(path), "test", build).count() == 5 and len(built) == 2
