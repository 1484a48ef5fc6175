"""Semantic scores: what a task holds at a time, against all products."""

import numpy as np
import pyarrow as pa

from glyphmill.operators import semantic


def test_a_task_holds_few_scores_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5000, 8)) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    tasks = []
    frame = type(df)
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a: tasks.append(f) or real(self, f, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(v.tolist())], names=["vec_id", "v"])
    x = v @ v[:400].T
    s = np.clip(np.sign(x) * np.floor(np.abs(x) * 1_000_000 + 0.5), -1_000_000, 1_000_000)
    for floor, top in ((None, None), (500_000, None), (None, 3)):
        tasks.clear()
        semantic.scores(df.where("vec_id < 400"), df, floor, top)
        made = list(tasks[0](iter([batch])))
        assert max(b.num_rows for b in made) <= semantic.HELD < x.size
        got = {(q, i): c for b in made for q, i, c in zip(*(col.to_pylist() for col in b.columns), strict=True)}
        assert len(got) == sum(b.num_rows for b in made) and all(s[i, q] == c for (q, i), c in got.items())
        if top is None:
            assert len(got) == (s.size if floor is None else int((s >= floor).sum()))
        else:
            best = np.sort(s, axis=0)[-top:].min(axis=0)
            assert all((q, i) in got for i, q in zip(*np.nonzero(s >= best), strict=True))
