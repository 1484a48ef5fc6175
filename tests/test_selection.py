"""Selection from a short list: the same as from all candidates."""

import random

from pyspark.sql import functions as F

from glyphmill.operators import index as I
from glyphmill.operators import selection as S

OFFERED = (
    "doc_id long, ordinal long, evidence_id long, body_id string, source string, tier int, occurrences long, relevance long, size long, "
    "matched_weight long, matched_signals long, high_value boolean, semantic long, version_id string, representation_id string, source_order long, representation string"
)


def test_short_list_selects_what_all_candidates_do(spark):
    """Copies differ in value, tier, source and semantic, so which of them is first depends on the coverage of a query."""
    r = random.Random(3)
    words = {b: r.sample(range(12), r.randint(1, 8)) for b in range(150)}
    rows, found = [], []
    for doc in range(1200):
        body = r.randrange(150)
        rows.append((
            doc, doc % 3, doc * 10, f"b{body}", r.choice("xyz"), r.choice([0, 0, 1]), r.choice([1, 2, None]), r.randrange(3), r.randrange(900),
            r.randrange(2), 0, r.random() < 0.2, r.choice([None, 0, 1, 2, 3, 5]), "v", "en", doc % 2, "text",
        ))
        found += [(doc, f"w{w}") for w in words[body]]
    asked = spark.createDataFrame([(q, f"w{w}") for q in range(15) for w in r.sample(range(12), r.randint(1, 6))], "query_id long, item string")
    offered, found = spark.createDataFrame(rows, OFFERED), spark.createDataFrame(found, "doc_id long, item string")
    every = I.covered(found, asked, ["doc_id"]).join(offered, "doc_id")
    short = I.leading(found, asked, S.best_copies(offered), S.fixed_order(), 2)
    assert short.count() < every.count() / 10

    def picked(candidates):
        kept = S.allocate(candidates, quota=2).where("place is not null")
        return sorted(map(tuple, kept.select("query_id", "doc_id", F.col("coverage").cast("long"), "place").collect()))

    assert picked(short.join(offered, "doc_id")) == picked(every)
