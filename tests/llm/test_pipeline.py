"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from glyphmill.llm import queries
from glyphmill.llm.common import staged, table
from tests.llm.test_operators import component_of, dedup, shingle_set

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_like_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    out = con.sql(queries.SQL[name])
    at = [out.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=repr)


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), "test")
        steps.append(docs)
    accepted, lines, documents, packed = steps
    assert all(s.columns == columns for s in steps[:-1])
    labels = {r["doc_id"]: r for r in table(spark, DATA, "labels").collect()}
    kept = {r["doc_id"] for r in accepted.collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(clean - kept) <= 0.02 * len(clean)
    want = dedup([(r["doc_id"], r["text"]) for r in accepted.collect()])
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    ids = sorted(want)
    group = component_of([shingle_set(want[i]) for i in ids])
    assert {r["doc_id"] for r in documents.collect()} == {ids[g] for g in group}
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in documents.collect()}
