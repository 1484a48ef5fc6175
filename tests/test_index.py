"""Postings, lengths and scores of the index on odd input."""

import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphmill.operators import index as I

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_weights_add_up_exactly(spark):
    units = spark.createDataFrame([(1, "a a", "a a a"), (2, None, "a a a a a a")], "u long, text string, heading string")
    got = {r["u"]: r["tf"] for r in I.postings(units, ["u"], {"text": 1.0, "heading": 0.35}).collect()}
    assert got == {1: 3.05, 2: 2.1}  # as doubles, 0.35 three times is 1.0499999999999998


def test_headings_of_nulls(spark, tmp_path):
    rows = [(1, "alpha beta", "en", None, 10), (2, None, "en", "alpha", 0), (3, "beta gamma", "en", "src", 10), (4, "delta", "en", "src", 5)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha"), (1, "gamma src")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "r05_bm25_two_fields"
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())


def test_lengths_need_no_postings(spark, tmp_path):
    rows = [(1, "a b a", "en", "s", 5), (1, "c", "en", "s", 1), (2, None, "en", "s", 0), (3, "é", "en", "s", 1)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["length"] for r in I.unit_lengths(docs, ["doc_id"]).collect()}
    assert got == {1: 4, 3: 1} == {r["doc_id"]: r["length"] for r in I.lengths(I.postings(docs, ["doc_id"]), ["doc_id"]).collect()}
    plan = entry.queries()["a24_index_statistics"](spark, str(tmp_path))
    assert plan.first().asDict() == {"n": 2, "tokens": 5} and not any("postings" in f for f in plan.inputFiles())


def test_queries_share_the_shuffle_of_postings(spark):
    """However many queries ask for a word, its postings are shuffled once, by unit."""
    units = spark.createDataFrame([(u, f"w{u % 3} w{u % 5} both") for u in range(60)], "u long, text string")
    post, length = I.postings(units, ["u"]), I.unit_lengths(units, ["u"])
    asked = spark.createDataFrame([(q, w, False) for q in range(40) for w in ("w0", "w1", "both", "none")], "query_id int, item string, prefix boolean")
    matched = I.matching(post, asked, ["u"])
    key = lambda df: sorted((r["query_id"], r["u"], round(r["rank"], 9)) for r in df.collect())
    assert key(I.scored(post, asked, length, ["u"])) == key(I.bm25(matched, length, ["u"]))
    for df in (I.scored(post, asked, length, ["u"]), I.coverage(matched, ["u"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\w+, u#", plan) and "hashpartitioning(u#" in plan
    assert {r["n"] for r in I.coverage(matched, ["u"]).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {60}


def test_heads_are_taken_before_queries_meet(spark, tmp_path, monkeypatch):
    """j02: postings of other documents than the heads meet no query."""
    from glyphmill.plans import search_queries as Q

    rows = [(i, f"word w{i} é", "en", f"s{i % 3}", 9) for i in range(1, 60)] + [(70, "other", "en", "s3", 5), (71, None, "en", "s4", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Word"), (2, "e w58"), (3, None)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, real = [], Q.I.matching
    monkeypatch.setattr(Q.I, "matching", lambda post, *a: seen.append(post.select("doc_id").distinct().count()) or real(post, *a))
    got = sorted((r["query_id"], r["doc_id"]) for r in Q.j02(spark, str(tmp_path)).collect())
    assert got == [(1, 57), (1, 58), (1, 59), (2, 57), (2, 58), (2, 59)] and seen == [4]


def test_best_leave_the_tasks(spark, monkeypatch):
    """Of all units that a query meets only the best and their ties leave a task; blocks of queries change nothing."""
    monkeypatch.setattr(I.sums, "ASKED", 20)
    monkeypatch.setattr(I.sums, "HELD", 300)
    monkeypatch.setattr(I.sums, "GIVEN", 7)
    units = spark.createDataFrame([(f"u{u:03}", u % 2, f"both w{u % 3} w{u % 7}" if u % 4 else "both w1 w1") for u in range(400)], "u string, v int, text string")
    keys = ["u", "v"]
    post, length = I.postings(units, keys), I.unit_lengths(units, keys)
    asked = spark.createDataFrame([(q, w, False) for q in (None, *range(30)) for w in ("both", f"w{(q or 0) % 7}", "w1", "none")], "query_id int, item string, prefix boolean")
    ranked = lambda df: sorted(map(tuple, I.top(df.withColumn("r9", F.round("rank", 9)), ["r9", *keys], 5).select("query_id", "place", *keys, "r9").collect()), key=repr)
    want = I.bm25(I.matching(post, asked.where("query_id is not null"), keys), length, keys)
    few = I.scored(post, asked, length, keys, 5).where("query_id is not null")
    assert ranked(few) == ranked(want) and few.count() < want.count() / 3
    some = units.where("v = 1").select(*keys)
    assert ranked(I.scored(post, asked, length, keys, 5, some).where("query_id is not null")) == ranked(want.join(some, keys, "left_semi"))
    assert I.scored(post, asked, length, keys, 5).where("query_id is null").count() >= 5


def test_reasons_are_told_without_pairs(spark, tmp_path, monkeypatch):
    """f05, r21: no rule looks at the query, so candidates are judged once and not for each query."""
    rows = [(i, f"word w{i % 5} é", "en", f"s{i % 3}", i * 37 % 900) for i in range(1, 80)] + [(92, "word", "fr", "s1", 260), (90, "rare", "en", "s2", 20), (91, None, "en", "s2", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Word w2"), (2, "rare"), (3, "e w1"), (4, None), (5, "none")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    from glyphmill.plans import search_queries as Q

    def pairs(*_):
        raise AssertionError("a row for a query and a posting")

    monkeypatch.setattr(Q.I, "matching", pairs)
    for name in ("f05_classify", "r21_abstention"):
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall(), key=repr), name


def test_items_are_looked_up_once(spark):
    """find, r12: postings of a planned term do not grow with the queries that have it."""
    from glyphmill.plans import search_queries as Q

    units = spark.createDataFrame([(u, f"alpha beta w{u}") for u in range(30)], "u long, text string")
    questions = spark.createDataFrame([(q, '"alpha beta" alphas') for q in range(20)], "query_id int, text string")
    plans = questions.select("query_id", Q.planned_column("text").alias("plan"))
    asked, found = Q.plan_hits(plans, I.postings(units, ["u"]), units, ["u"], {"text": 1.0})
    items = {r["item"]: r["n"] for r in found.groupBy("item").agg(F.count("*").alias("n")).collect()}
    assert items.get('"alpha beta"') == 30 and set(items.values()) == {30}
    assert asked.where("query_id = 3").count() == asked.count() / 20 >= 1
