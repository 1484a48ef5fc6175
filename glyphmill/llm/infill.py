"""Fill-in-middle transformation: documents cut at units into prefix, middle and suffix, and put in another order.

The Split pre-tokenizer of the tokenizers library, with isolated matches of one pattern and nothing trained,
gives the code-point offsets of every unit of a text.  Their number is n; two hashes of the id rank two of the
offsets, which is where the text is cut.  Only the text goes to Python and only (n, two offsets) come back:
slices, order and digests are built-in functions.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and one whose hash says so stay
plain; a null id hashes as the empty string; rows of one id are cut alike, each by its own text; very long texts
are split into units piece by piece, at places where a unit ends anyhow; other columns stay, those named n, form,
prefix_chars, middle_chars or output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

#: White space before a word belongs to it; white space at the end of a text is a unit.  Possessive: no step back is ever of use.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: Code points that are split at once, up to the next end of a unit.
PIECE = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are cut, and of these, those with the suffix first.
CUT, SUFFIX_FIRST = 50, 80


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about PIECE code points; each ends where white space follows something else."""
    end_of_unit = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
    at = 0
    while at < len(text):
        found = end_of_unit.search(text, at + PIECE)
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


def unit_ends(text: str, split) -> list[int]:
    """Where each unit ends, in code points from the beginning of ``text``."""
    ends, base = [], 0
    for piece in pieces(text):
        ends += [base + to for _, (_, to) in split.pre_tokenize_str(piece)]
        base += len(piece)
    return ends


def draws(row_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def check_sentinels(sentinels: tuple[str, ...]) -> None:
    """An output is taken apart where sentinels stand: none may hold another or begin with another's end."""
    for a, b in [*permutations(sentinels, 2), *((s, s) for s in sentinels)]:
        if not a or len({*sentinels}) < 3 or (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
            raise ValueError(f"sentinels {a!r} and {b!r} cannot be told apart")


def transform(df: DataFrame, text: str = "text", row_id: str = "doc_id", seed: int = 42, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``df`` with n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    check_sentinels(sentinels)

    @F.pandas_udf("n long, a long, b long")
    def offsets(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(UNIT), "isolated")
        for texts, one, other in batches:
            rows = []
            for t, x, y in zip(texts, one, other, strict=True):
                ends = [0, *unit_ends(t, split)]
                rows.append((len(ends) - 1, *sorted((ends[x % len(ends)], ends[y % len(ends)]))))
            yield pd.DataFrame(rows, columns=["n", "a", "b"])

    h1, h2, h3, h4 = draws(F.col(row_id), seed)
    whole, at = free_name(df, "whole"), free_name(df, "at")
    out = df.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(at, offsets(whole, h1, h2))
    t, a, b = F.col(whole), F.col(f"{at}.a").cast("int"), F.col(f"{at}.b").cast("int")
    plain = (t == "") | (h3 % 100 >= cut)
    for s in sentinels:
        plain = plain | t.contains(s)
    p, s, m = (F.lit(x) for x in sentinels)
    prefix, middle, suffix = t.substr(F.lit(1), a), t.substr(a + 1, b - a), t.substr(b + 1, F.length(t) - b)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    out = out.withColumns({"n": F.col(f"{at}.n"), "form": form, "prefix_chars": F.when(~plain, a.cast("long")), "middle_chars": F.when(~plain, (b - a).cast("long"))})
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return out.withColumn("output", output).drop(whole, at)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output of this form was made; null where the form is unknown."""
    p, s, m = sentinels
    first = lambda x: F.length(F.lit(x)) + 1
    after = lambda col, x: col.substr(F.instr(col, x) + F.length(F.lit(x)), F.length(col))
    before = lambda col, x: col.substr(F.lit(1), F.instr(col, x) - 1)
    rest = output.substr(first(p), F.length(output))
    psm = F.concat(before(rest, s), after(rest, m), before(after(rest, s), m))
    rest = output.substr(first(s), F.length(output))
    spm = F.concat(before(after(rest, p), m), after(rest, m), before(rest, p))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op11_infill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = transform(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


UNITS = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
QUERIES = {"op11_infill": op11_infill}
SQL = {
    "op11_infill": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
 u AS (SELECT doc_id, t, {UNITS} AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
 c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 s AS (SELECT *, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS e FROM c)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
}
