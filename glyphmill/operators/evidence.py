"""Evidence records: unions of anchors, geometry, pointers, validation, trust, relations, gates."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.text import composed, relevance_token

# Scales and limits that results must agree on.
PPM = 1_000_000
SAFE = 2**53 - 1
TRUST = ["untrusted", "derived", "source", "verified"]
FUNCTION_WORDS = """
a an and are as at be by das dem den der die ein eine for from how in is it mit of on or should the to und von was
welche welcher welches what when which who why wie with zu
""".split()
VOLATILE = "current heute latest live recently today".split()
RELEVANCE_PATTERN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
YEARS, NAMED_WEIGHT, MAX_SIGNALS, MAX_SIGNAL = (1900, 2200), 4, 64, 128
# End of fixed values.


def page_region(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom, clamped) in millionths of the page, half to even; outside is clamped."""

    def part(x: Column, whole: Column) -> Column:
        return F.bround(x.cast("decimal(28,9)") * PPM / whole.cast("decimal(28,9)"), 0).cast("long")

    raw = [part(x, w) for x, w in ((left, width), (top, height), (right, width), (bottom, height))]
    held = [F.greatest(F.lit(0), F.least(F.lit(PPM), r)) for r in raw]
    moved = raw[0] != held[0]
    for r, h in zip(raw[1:], held[1:], strict=True):
        moved = moved | (r != h)
    return F.struct(*(h.cast("long").alias(n) for h, n in zip(held, ("left", "top", "right", "bottom"), strict=True)), moved.alias("clamped"))


def pixel_bounds(region: Column, width: int, height: int) -> Column:
    """struct of the pixels that a region in millionths touches: floors on the near side, ceilings on the far side."""
    near = lambda x, n: F.floor(x * n / PPM).cast("long")
    far = lambda x, n: F.ceil(x * n / PPM).cast("long")
    return F.struct(near(region["left"], width).alias("x0"), near(region["top"], height).alias("y0"), far(region["right"], width).alias("x1"), far(region["bottom"], height).alias("y1"))


def aspect_error(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Millionths by which the shape of a raster differs from its page's."""
    a, b = width * page_height, height * page_width
    return F.floor(F.abs(a - b) * PPM / F.greatest(a, b)).cast("long")


def resolve_pointer(document: object, pointer: str) -> object:
    """The value at an RFC 6901 pointer; KeyError if there is none."""
    if pointer and not pointer.startswith("/"):
        raise KeyError(pointer)
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list):
            if not token.isdigit() or (token != "0" and token.startswith("0")) or int(token) >= len(document):
                raise KeyError(pointer)
            document = document[int(token)]
        elif isinstance(document, dict) and token in document:
            document = document[token]
        else:
            raise KeyError(pointer)
    return document


@F.pandas_udf(StringType())
def pointer_column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """JSON of the value at a pointer that differs from row to row; null where it leads nowhere."""
    for documents, pointers in batches:
        out = []
        for d, p in zip(documents, pointers, strict=True):
            try:
                out.append(json.dumps(resolve_pointer(json.loads(d), p), ensure_ascii=False, separators=(",", ":"), sort_keys=True))
            except (KeyError, ValueError, TypeError):
                out.append(None)
        yield pd.Series(out, dtype=object)


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def strict_json(text: str | None) -> bool:
    """Valid JSON without repeated keys, infinities, or integers that a double cannot hold."""

    def refuse(_: str) -> None:
        raise ValueError

    def whole(x: str) -> int:
        if abs(int(x)) > SAFE:
            raise ValueError
        return int(x)

    try:
        json.loads(text or "", object_pairs_hook=_pairs, parse_constant=refuse, parse_int=whole)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(BooleanType())
def strict_json_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([strict_json(t) for t in texts], dtype=bool)


def portable_path(path: Column, most_bytes: int = 240, most_depth: int = 12) -> Column:
    """Relative, forward slashes only, no empty, dot or dot-dot parts, within bytes and depth."""
    parts = F.split(path, "/")
    return (F.octet_length(path) <= most_bytes) & (F.size(parts) <= most_depth) & ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~path.rlike(r"[\\:\x00-\x1f]")


def promotions(evidence: DataFrame) -> DataFrame:
    """Rows whose trust is above that of what they come from."""
    level = lambda c: F.array_position(F.array(*map(F.lit, TRUST)), F.col(c))
    return evidence.where(level("trust") > level("origin_trust"))


def text_view(labelled: DataFrame, by: str = "doc_id") -> DataFrame:
    """Texts of a document's items in order, joined by line feeds.  items: array<struct<label, text>> of the row."""
    told = F.filter("items", lambda i: i["label"].isin("text", "title", "section_header", "list_item", "caption") & (F.trim(i["text"]) != ""))
    return labelled.select(by, F.array_join(F.transform(told, lambda i: i["text"]), "\n").alias("view"))


def candidates(native: DataFrame, by: str = "doc_id") -> DataFrame:
    """Evidence of a native document: its texts, then its table cells, numbered; anchors as one nullable union."""
    texts = native.select(by, F.posexplode("texts").alias("i", "x")).select(by, F.lit(0).alias("part"), "i", F.col("x").alias("text"), F.lit("text_span").alias("anchor_type"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
    cells = native.select(by, F.posexplode("cells").alias("i", "c")).select(by, F.lit(1).alias("part"), "i", F.col("c.text").alias("text"), F.lit("table_cell").alias("anchor_type"), F.col("c.row").alias("row"), F.col("c.col").alias("col"))
    offset = native.select(by, F.size("texts").alias("n"))
    both = texts.unionByName(cells).join(offset, by)
    return both.select(by, F.when(F.col("part") == 0, F.col("i")).otherwise(F.col("i") + F.col("n")).cast("long").alias("ordinal"), "anchor_type", "text", "row", "col")


def table_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """Markdown row of each table row: by, row, text."""
    line = F.array_sort(F.collect_list(F.struct("col", "text")))
    return cells.groupBy(*by, "row").agg(F.concat(F.lit("| "), F.array_join(F.transform(line, lambda c: c["text"]), " | "), F.lit(" |")).alias("text"))


def record_faults(references: DataFrame, projections: DataFrame) -> DataFrame:
    """Repeated ids and projections without their reference: id, fault."""
    twice = references.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("fault"))
    lone = projections.join(references, "id", "left_anti").select("id", F.lit("no_reference").alias("fault")).distinct()
    return twice.union(lone)


def gate(checks: DataFrame) -> DataFrame:
    """One row a release: passed if every required check is, and the names of those that are not."""
    failed = F.array_sort(F.collect_set(F.when(F.col("required") & ~F.col("passed"), F.col("name"))))
    return checks.groupBy("release").agg(F.array_join(failed, ",").alias("failed")).withColumn("accepted", F.col("failed") == "")


def missing(required: DataFrame, selected: DataFrame) -> DataFrame:
    """All required representations of a query if none of them is selected: query_id, representation."""
    met = required.join(selected, ["query_id", "representation"], "left_semi").select("query_id").distinct()
    return required.join(met, "query_id", "left_anti").select("query_id", "representation")


def relevance_signals(tasks: DataFrame) -> DataFrame:
    """query_id, token, class, weight of the signals of tasks (query_id, task).

    A later mention of a token decides its class.  A task with more signals or a longer one than is allowed has one
    row in their place: token null, class ``refused``."""
    each = tasks.select("query_id", F.posexplode(F.regexp_extract_all(composed(F.col("task")), F.lit(RELEVANCE_PATTERN), F.lit(0))).alias("at", "raw")).withColumn("token", relevance_token(F.col("raw")))
    owned = F.col("token").rlike(".'s$")
    bare = each.withColumns({c: F.when(owned, F.expr(f"left({c}, length({c}) - 2)")).otherwise(F.col(c)) for c in ("raw", "token")}).where(~F.col("token").isin(FUNCTION_WORDS))
    listed, year = F.col("token").isin(VOLATILE), F.col("token").rlike("^[0-9]{4}$") & F.col("token").try_cast("int").between(*YEARS)
    named = F.col("token").rlike(r"\p{Nd}") | F.regexp_replace("raw", r"[^\p{L}]", "").rlike(r"^\p{Lu}{2,}$")
    kind = F.when(listed | year, "volatile_time").when(named, "identifier").otherwise("ordinary")
    judged = bare.select("query_id", "token", "at", F.struct(kind.alias("class"), F.when(~listed & (year | named), NAMED_WEIGHT).otherwise(1).alias("weight")).alias("x"))
    once = judged.groupBy("query_id", "token").agg(F.max_by("x", "at").alias("x"))
    mine = W.partitionBy("query_id")
    over = once.withColumn("refused", (F.count("*").over(mine) > MAX_SIGNALS) | (F.max(F.length("token")).over(mine) > MAX_SIGNAL))
    kept = over.where("not refused").select("query_id", "token", "x.class", "x.weight")
    refused = over.where("refused").select("query_id", F.lit(None).cast("string").alias("token"), F.lit("refused").alias("class"), F.lit(None).cast("int").alias("weight"))
    return kept.unionByName(refused.distinct())


def body_tokens(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, token: distinct tokens that signals are compared with."""
    return units.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(relevance_token(F.col(text)), F.lit(RELEVANCE_PATTERN), F.lit(0)))).alias("token"))


def observe(signals: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys, matched_signals, matched_weight, score, volatile_time_matched of units that match a signal.

    signals: query_id, token, class, weight.  The score is in millionths of the task's weight; a volatile signal must be met."""
    signals = signals.where("class <> 'refused'")
    timely = F.count_if(F.col("class") == "volatile_time")
    whole = signals.groupBy("query_id").agg(F.sum("weight").alias("total"), timely.alias("all_timely"))
    met = tokens.join(signals, "token").groupBy("query_id", *keys).agg(F.count("*").alias("matched_signals"), F.sum("weight").alias("matched_weight"), timely.alias("timely"))
    score = F.floor(F.col("matched_weight") * PPM / F.col("total")).cast("long")
    return met.join(whole, "query_id").select("query_id", *keys, "matched_signals", "matched_weight", score.alias("score"), (F.col("timely") == F.col("all_timely")).alias("volatile_time_matched"))


def uuid7(ms: Column, entropy: Column) -> Column:
    """A UUID of version 7 of a time and a hex digest of at least 19 digits."""
    t = F.lpad(F.lower(F.hex(ms)), 12, "0")
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(entropy, 1, 3), F.lit("-8"), F.substring(entropy, 4, 3), F.lit("-"), F.substring(entropy, 7, 12))
