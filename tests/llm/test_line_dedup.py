"""Line dedup: what plans tell the driver."""

import random

from pyspark.sql import functions as F

from glyphmill.llm import line_dedup


def test_counters_are_not_printed_in_plans(spark):
    """Descriptions of plans are kept by the driver; the table of counters (here 64 KB) must not be in them."""
    sets = spark.createDataFrame([(1, [5, 1 << 52, 7]), (2, [5, 1 << 52])], "at long, h array<long>").withColumn("bits", F.lit(0).cast("long"))
    rare, bits = line_dedup._rarity(sets, 64 << 15)
    assert bits == 16
    rows = line_dedup._neighbours(sets, rare, bits, 0).unionAll(line_dedup._neighbours(sets, rare, bits, 1))
    assert len(rows._jdf.queryExecution().executedPlan().toString()) < 20_000
    found = sorted((r["at"], r["np"] >> 32) for r in rows.collect())
    assert found and {n for at, n in found if at == 1} <= {3} and {n for at, n in found if at == 2} <= {2}


def test_long_unlike_lines_become_no_pairs(spark, monkeypatch):
    """op4: lines of a hundred words that share two rare ones only.  64 parity bits let a third of them through as pairs."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(400)]
    lines = [" ".join([*rng.choices(common, k=120), f"rare{g}", f"odd{g}"]) for g in range(60) for _ in range(5)]
    lines += [line.replace(" c7 ", " d7 ").replace(" c8 ", " d8 ") + " end" for line in lines[::25]]
    held = {}
    real = line_dedup.staged

    def kept(df, tag, **options):
        out = real(df, tag, **options)
        held[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", kept)
    docs = spark.createDataFrame([(i, line, len(line)) for i, line in enumerate(lines)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    sets = [set(line.split()) for line in lines]
    gone = {i for i, a in enumerate(sets) if any(100 * len(a & b) >= 75 * len(a | b) for b in sets[:i])}
    assert len(gone) == 12 and out == {i: "" if i in gone else line for i, line in enumerate(lines)}
    assert held["lines-more"] < 12
