"""Scalar text functions as Columns; Python only where Unicode folding has no built-in equivalent."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that results must agree on.
LINE_BREAK = r"\r\n|\r|\n"
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
PART = r"[\p{L}\p{N}]+"
COMMENT = r"(?s)<!--.*?-->"
SNIPPET_CHARACTERS = 240
WORD_PY = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
PART_PY = re.compile(r"[^\W_]+")
# End of fixed values.


def lines_of(text: Column) -> Column:
    """Lines by CRLF, CR or LF; a final break opens none; empty text has none."""
    parts = F.split(text, LINE_BREAK)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(trimmed)


def decode_source(content: Column) -> Column:
    """UTF-8 bytes to text with plain line feeds, without a leading byte-order mark; null if not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.array_join(lines_of(F.regexp_replace(text, "^﻿", "")), "\n")


def token_estimate(text: Column) -> Column:
    """One token for four characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_id(domain: str, **fields: Column) -> Column:
    """Content id: hash of compact JSON with sorted keys (strings, integers and nulls only)."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    whole = F.struct(F.lit(domain).alias("domain"), body.alias("payload"))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256))


def has_content(text: Column) -> Column:
    """Three letters or digits at least, outside comments."""
    return F.length(F.regexp_replace(F.regexp_replace(text, COMMENT, " "), r"[^\p{L}\p{N}]", "")) >= 3


def is_tabular(text: Column, media: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"^\s+", "").startswith("|"), F.lit(False)) | F.coalesce(media == "text/csv", F.lit(False))


# Words that open a question.
QUESTION_WORDS = "how what why when where which who whom whose wie was warum wann wo welche welcher welches wer wieso weshalb".split()
# End of fixed values.


def is_question(query: Column) -> Column:
    first = F.lower(F.regexp_extract(query, WORD, 0))
    return F.regexp_replace(query, r"\s+$", "").endswith("?") | first.isin(QUESTION_WORDS)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def parts_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PART), F.lit(0))


def occurrences(text: Column, item: Column) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    return F.when(F.length(item) > 0, (F.length(text) - F.length(F.replace(text, item, F.lit("")))) / F.length(item)).otherwise(0).cast("long")


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def snippet(text: Column, item: Column, limit: int = SNIPPET_CHARACTERS) -> Column:
    """A window of ``limit`` characters centred on the first match of ``item``, whatever its case."""
    n, width = F.length(text), F.length(item)
    found = F.instr(F.lower(text), F.lower(item)) - 1
    start = F.when(found < 0, 0).otherwise(F.greatest(F.lit(0), F.least(n - limit, found - F.floor((F.lit(limit) - width) / 2).cast("int"))))
    return F.when(n <= limit, text).otherwise(F.substring(text, F.greatest(start, F.lit(0)) + 1, F.lit(limit)))


def short_id(document_id: Column) -> Column:
    return F.right(document_id, F.lit(8))


def label_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_atx(title: Column) -> Column:
    """A heading without its closing marks."""
    return F.regexp_replace(F.regexp_replace(title, r"(?:^|[ \t]+)#+[ \t]*$", ""), r"^\s+|\s+$", "")


def normalise_markdown(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, no run of more than one blank line, one final line feed."""
    plain = F.regexp_replace(text, LINE_BREAK, "\n")
    plain = F.regexp_replace(plain, r"[ \t]+(?=\n|$)", "")
    plain = F.regexp_replace(plain, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(plain, r"^\n+|\n+$", ""), F.lit("\n"))


def backoff_ms(attempt: Column, base: int = 1000, cap: int = 60000) -> Column:
    return F.least(F.lit(cap).cast("long"), (F.lit(base) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(40)))).cast("long"))


def storage_time(ts: Column) -> Column:
    """Fixed-width UTC text that sorts as time does."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def truncate_utf8(text: Column, limit: int) -> Column:
    """Longest prefix of at most ``limit`` bytes that cuts no character."""
    raw = text.cast("binary")
    # a character has four bytes at most: the cut is where the byte after it begins a character
    ends = [F.when((F.octet_length(raw) <= n) | (F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80), F.substring(raw, 1, n)) for n in range(limit, max(limit - 4, -1), -1)]
    return F.coalesce(*ends).cast("string")


def quantise(x: Column) -> Column:
    """A cosine in millionths, half away from zero, within one."""
    m = F.signum(x) * F.floor(F.abs(x) * 1_000_000 + 0.5)
    return F.greatest(F.lit(-1_000_000), F.least(F.lit(1_000_000), m)).cast("int")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def stem(word: Column, suffixes: list[str], least: int) -> Column:
    """What a folded word begins with, without its longest listed suffix; null for short words and those with digits."""
    bare = F.regexp_replace(word, f"^(.{{{least},}}?)({'|'.join(suffixes)})$", "$1")
    return F.when((F.length(word) > least) & ~word.rlike("[0-9]"), bare)


def fold_text(text: str) -> str:
    """Compatibility decomposition without non-spacing marks, case-folded."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn").casefold()


def index_text(text: str) -> str:
    """As ``fold_text`` but lower-cased only, as index tokens are: a sharp s stays."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def index_words(text: str) -> list[str]:
    return PART_PY.findall(index_text(text))


def _mapped(fn):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else fn(t) for t in texts], dtype=object)

    return run


def fold(text: Column) -> Column:
    return _mapped(fold_text)(text)


def index_fold(text: Column) -> Column:
    return _mapped(index_text)(text)


def composed(text: Column) -> Column:
    """Canonical composition."""
    return _mapped(lambda t: unicodedata.normalize("NFC", t))(text)


def relevance_token(text: Column) -> Column:
    return _mapped(lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()))(text)
