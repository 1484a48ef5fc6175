"""Chat formatting: transcripts parsed to roles by a hidden Markov model, then rendered in one form.

Each row holds a piece of a transcript: its conversation, its order there, its text, and perhaps a
speaker marker.  Rows are cut into lines.  A line shows a marker (from the row, or as in ``Human: ...`` at
its start), whether it opens a row, and its shape (length, question mark, list or code).  Hidden states
are roles.  The model, transitions where a row or marker begins and within rows, and the emissions of each role, is counted from
rows whose marker is a known role, with smoothing.

Viterbi runs on segments of consecutive rows: each segment first gives the matrix of best scores from any
role before it to any role at its end; the matrices of a conversation, one for SEGMENT rows, are put
together to find the roles at the seams; then each segment recovers its own path.  So no task needs a
whole conversation's text.

A rendered row has, where a turn opens, ``<|end|>`` of the turn before and ``<|role|>``, each with a line
feed, and the lines without their markers; rows joined in order give the conversation up to its last
``<|end|>``.  Neighbouring lines of one role are one turn.

Defined results: rows are ordered by (order, marker, text), nulls first; a null text is one empty line;
unknown markers tell nothing; equal scores go to the earlier role of ROLES; a null conversation is one
of its own; repeated rows are all kept; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, shuffle_parts, staged, table

ROLES = ("system", "user", "assistant", "tool")
NAMES = {
    "system": 0, "instructions": 0, "user": 1, "human": 1, "prompter": 1, "question": 1, "q": 1, "customer": 1, "me": 1,
    "assistant": 2, "bot": 2, "ai": 2, "model": 2, "gpt": 2, "answer": 2, "a": 2, "agent": 2, "chatbot": 2, "tool": 3, "function": 3,
}
NONE = len(ROLES)
MARKER = re.compile(r"^\s*(?:[#>*<|\[]*)\s*([A-Za-z]+)\s*(?:[\]|>*]*)\s*:\s*(?:\*\*)?")
SHAPES = 12
#: Rows of a segment: those whose orders share the quotient by it.
SEGMENT = 64


def marker_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), NONE)


def read_line(line: str) -> tuple[int, str]:
    """(marker, the line without it)."""
    m = MARKER.match(line)
    mark = marker_of(m[1]) if m else NONE
    return (mark, line[m.end() :]) if mark != NONE else (NONE, line)


def shape_of(line: str) -> int:
    """One of SHAPES: three lengths, by ends with a question mark, by looks like a list or code."""
    s = line.strip()
    return (0 if len(s) < 60 else 1 if len(s) < 240 else 2) * 4 + 2 * s.endswith("?") + (s[:1] in "-*`{|#0123456789" if s else False)


def observe(text: str | None, speaker: str | None) -> tuple[list[int], list[int], list[str]]:
    """Markers, shapes and marker-free lines of a row; the row's own marker goes to its first line."""
    marks, shapes, lines = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        mark, rest = read_line(line)
        if i == 0 and mark == NONE:
            mark = marker_of(speaker)
        marks.append(mark)
        shapes.append(shape_of(rest))
        lines.append(rest)
    return marks, shapes, lines


class Hmm:
    """Log probabilities: start (S), between rows and within rows (S x S), markers (S x S+1), shapes (S x SHAPES)."""

    def __init__(self, between: np.ndarray, shapes: np.ndarray, start: np.ndarray, noise: float = 0.02, stay: float = 0.98):
        n = len(ROLES)
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        self.start, self.between, self.shapes = log(start + 0.5), log(between + 0.5), log(shapes + 1.0)
        self.within = log(np.full((n, n), (1 - stay) / (n - 1)) + np.eye(n) * (stay - (1 - stay) / (n - 1)))
        marks = np.full((n, n + 1), noise / n)
        marks[:, :n] += np.eye(n) * (0.5 - noise)
        marks[:, n] = 0.5
        self.marks = log(marks)

    def step(self, first: bool, mark: int, shape: int, opening: bool = False) -> np.ndarray:
        """S x S: score of going from one role to another and showing this line; first: it may open a turn."""
        moves = np.broadcast_to(self.start, self.between.shape) if opening else self.between if first else self.within
        return moves + (self.marks[:, mark] + self.shapes[:, shape])[None, :]

    def steps(self, rows: list[tuple[list[int], list[int]]], opening: bool) -> list[np.ndarray]:
        out = []
        for marks, shapes in rows:
            for i, (m, s) in enumerate(zip(marks, shapes, strict=True)):
                out.append(self.step(i == 0 or m != NONE, m, s, opening and not out))
        return out


def best_matrix(steps: list[np.ndarray]) -> np.ndarray:
    """Best score from each role before the steps to each role at their end."""
    out = steps[0]
    for s in steps[1:]:
        out = (out[:, :, None] + s[None, :, :]).max(axis=1)
    return out


def best_path(steps: list[np.ndarray], before: int, end: int | None = None) -> list[int]:
    """The best roles after each step, from ``before`` and, if given, to ``end``."""
    score, back = steps[0][before], []
    for s in steps[1:]:
        both = score[:, None] + s
        back.append(both.argmax(axis=0))
        score = both.max(axis=0)
    path = [int(score.argmax()) if end is None else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def seams(matrices: list[np.ndarray]) -> list[int]:
    """Roles at the end of each segment of a conversation; the first segment starts from any row alike."""
    return best_path(matrices, 0)


def fit(df: DataFrame, conversation: str, order: str, text: str, speaker: str) -> Hmm:
    """Counts of roles, shapes and moves between neighbouring orders, aggregated before they are joined."""
    name = F.lower(F.trim(F.col(speaker)))
    role = F.coalesce(*[F.when(name.isin([k for k, v in NAMES.items() if v == r]), r) for r in range(len(ROLES))])
    known = df.select(F.col(conversation).alias("c"), F.col(order).alias("o"), F.col(text).alias("t"), role.alias("r")).where("r is not null")

    @F.pandas_udf("array<int>")
    def shapes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([observe(t, None)[1] for t in texts])

    n = len(ROLES)
    seen, start, between = np.zeros((n, SHAPES)), np.zeros(n), np.zeros((n, n))
    for r, s, k in known.select("r", F.explode(shapes("t")).alias("s")).groupBy("r", "s").count().collect():
        seen[r, s] = k
    places = known.where("o is not null").groupBy("c", "o", "r").agg(F.count("*").cast("double").alias("k"))
    firsts = places.groupBy("c").agg(F.min_by("r", F.struct("o", "r")).alias("r")).groupBy("r").count()
    for r, k in firsts.collect():
        start[r] = k
    after = places.select("c", (F.col("o") - 1).alias("o"), F.col("r").alias("next"), F.col("k").alias("k2"))
    for a, b, k in places.join(after, ["c", "o"]).groupBy("r", "next").agg(F.sum(F.least("k", "k2"))).collect():
        between[a, b] = k
    return Hmm(between, seen, start)


def _segments(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """(start, stop) of the segments of sorted rows."""
    if len(pdf):
        new = (pdf["c"] != pdf["c"].shift()) | (pdf["g"] != pdf["g"].shift())
        at = [*np.flatnonzero(new.to_numpy()), len(pdf)]
        yield from zip(at, at[1:], strict=False)


def _sorted_task(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def parse(df: DataFrame, model: Hmm | None = None, conversation: str = "conv_id", order: str = "turn", text: str = "text", speaker: str = "role") -> DataFrame:
    """``df`` with roles (one a line), opens (turns that begin in the row) and rendered."""
    spark = df.sparkSession
    model = model or fit(df, conversation, order, text, speaker)
    sent = spark.sparkContext.broadcast(model)
    cid, gid = free_name(df, "c"), free_name(df, "g")
    # a null conversation or order must not meet a real one
    keys = {cid: F.to_json(F.struct(F.col(conversation).alias("k"))), gid: F.coalesce(F.floor(F.col(order) / SEGMENT).cast("long"), F.lit(-(2**62)))}
    laid = df.withColumns(keys).repartition(shuffle_parts(spark), cid, gid).sortWithinPartitions(cid, gid, order, speaker, text)
    plain = laid.select(F.col(cid).alias("c"), F.col(gid).alias("g"), F.col(text).cast("string").alias("t"), F.col(speaker).cast("string").alias("s"))

    # which segment is a conversation's first: only that one starts from ``start``
    opening = df.select(keys[cid].alias("c"), keys[gid].alias("g")).groupBy("c").agg(F.min("g").alias("g0"))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hmm, pdf = sent.value, _sorted_task(batches)
        rows = []
        for lo, hi in _segments(pdf):
            seen = [observe(t, s)[:2] for t, s in zip(pdf["t"][lo:hi], pdf["s"][lo:hi], strict=True)]
            rows.append((pdf["c"][lo], pdf["g"][lo], *(best_matrix(hmm.steps(seen, o)).ravel().tolist() for o in (False, True))))
        yield pd.DataFrame(rows, columns=["c", "g", "m", "m0"])

    pieces = staged(plain.mapInPandas(matrices, "c string, g long, m array<double>, m0 array<double>").join(opening, "c").select("c", "g", F.when(F.col("g") == F.col("g0"), F.col("m0")).otherwise(F.col("m")).alias("m")), "chat-segments")

    @F.pandas_udf("array<int>")
    def join_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = len(ROLES)
        for lists in batches:
            yield pd.Series([seams([np.asarray(m, dtype=float).reshape(n, n) for m in ms]) for ms in lists])

    ordered = pieces.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("g", "m"))).alias("x"))
    ec, eg = free_name(df, "end_c"), free_name(df, "end_g")
    ends = ordered.select("c", F.transform("x", lambda y: y["g"]).alias("gs"), join_up(F.transform("x", lambda y: y["m"])).alias("es"))
    ends = ends.select(F.col("c").alias(ec), F.posexplode("gs").alias("i", eg), "es")
    b, e, q = (free_name(df, x) for x in ("before", "end", "opening"))
    ends = ends.select(ec, eg, F.get("es", F.col("i") - 1).alias(b), F.get("es", "i").alias(e), (F.col("i") == 0).alias(q))
    joined = laid.join(ends, (F.col(cid) == F.col(ec)) & (F.col(gid) == F.col(eg))).drop(ec, eg)
    joined = joined.repartition(shuffle_parts(spark), cid, gid).sortWithinPartitions(cid, gid, order, speaker, text)
    roles, opens, rendered = "roles", "opens", "rendered"
    keep = [c for c in df.columns if c.lower() not in {roles, opens, rendered}]
    name_of = {x: free_name(df, "own_" + x) for x in "cgtsbeq"}
    carried = joined.select(*[joined[c] for c in keep], F.col(cid).alias(name_of["c"]), F.col(gid).alias(name_of["g"]), F.col(text).cast("string").alias(name_of["t"]), F.col(speaker).cast("string").alias(name_of["s"]), F.col(b).alias(name_of["b"]), F.col(e).alias(name_of["e"]), F.col(q).alias(name_of["q"]))
    schema = [*(f"`{c}` {dict(df.dtypes)[c]}" for c in keep), "roles array<string>", "opens int", "rendered string"]

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hmm, pdf = sent.value, _sorted_task(batches)
        if not len(pdf):
            return
        out_roles, out_opens, out_text = [], [], []
        view = pdf[[name_of["c"], name_of["g"]]].set_axis(["c", "g"], axis=1)
        for lo, hi in _segments(view):
            seen = [observe(t, s) for t, s in zip(pdf[name_of["t"]][lo:hi], pdf[name_of["s"]][lo:hi], strict=True)]
            first = bool(pdf[name_of["q"]][lo])
            before = 0 if first else int(pdf[name_of["b"]][lo])
            path = best_path(hmm.steps([x[:2] for x in seen], first), before, int(pdf[name_of["e"]][lo]))
            at, last = 0, None if first else before
            for _, _, lines in seen:
                own = path[at : at + len(lines)]
                at += len(lines)
                text, opened = [], 0
                for r, line in zip(own, lines, strict=True):
                    if r != last:
                        text.append(("" if last is None else "<|end|>\n") + f"<|{ROLES[r]}|>\n")
                        opened += 1
                        last = r
                    text.append(line + "\n")
                out_roles.append([ROLES[r] for r in own])
                out_opens.append(opened)
                out_text.append("".join(text))
        yield pdf[keep].assign(roles=out_roles, opens=out_opens, rendered=out_text)

    return carried.mapInPandas(render, ", ".join(schema))


def op9_transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = parse(rows)
    return out.select("conv_id", "turn", F.array_join("roles", ",").alias("roles"), "opens", F.sha2("rendered", 256).alias("rendered_sha256"))


QUERIES = {"op9_transcripts": op9_transcripts}
SQL: dict[str, str] = {}
