"""Parsers as table functions: a document in, its blocks out, chosen by media type.

``parse_blocks(text, media_type)`` is used with a lateral join.  ``parse_records(text, columns)`` has a schema of its
own for each call: the constant ``columns`` names and types what the header of a CSV text must hold.  Other parsers
are added with ``parser``.

Defined results: a text that its parser refuses, a text with a NUL, and a media type without parser give one row, in
which ``failed`` says why and all else is null; a null text has no blocks; so has an empty one.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .blocks import csv_blocks, markdown_blocks

#: (ordinal, kind, parent, sibling, level, first line, last line, text) of each block.
Parser = Callable[[str], list[tuple]]
PARSERS: dict[str, Parser] = {}
COLUMNS = "ordinal int, kind string, parent int, sibling int, level int, line_start int, line_end int, text string, failed string"
TYPES = {"string": (StringType(), str), "long": (LongType(), int), "double": (DoubleType(), float)}


def parser(media_type: str) -> Callable[[Parser], Parser]:
    """Registers a parser, which may raise ValueError or csv.Error."""

    def register(fn: Parser) -> Parser:
        PARSERS[media_type] = fn
        return fn

    return register


@parser("text/plain")
def text_blocks(text: str) -> list[tuple]:
    """Paragraphs: runs of lines that are not blank."""
    lines = text.split("\n")
    runs = [[i for i, _ in run] for blank, run in groupby(enumerate(lines), key=lambda x: not x[1].strip()) if not blank]
    return [(n, "paragraph", -1, n, 0, run[0] + 1, run[-1] + 1, "\n".join(lines[run[0] : run[-1] + 1])) for n, run in enumerate(runs)]


parser("text/markdown")(markdown_blocks)
parser("text/csv")(csv_blocks)


def block_function(parsers: dict[str, Parser]) -> type:
    """The table function over these parsers, which go to the tasks with it: one row a block, or one that says what failed."""

    class ParseBlocks:
        def eval(self, text: str, media_type: str) -> Iterator[tuple]:
            if text is None:
                return
            try:
                if media_type not in parsers:
                    raise ValueError(f"no parser for {media_type}")
                if "\0" in text:
                    raise ValueError("text holds a NUL")
                found = parsers[media_type](text)
            except (ValueError, csv.Error) as e:
                yield (*[None] * 8, str(e))
                return
            for block in found:
                yield (*block, None)

    return ParseBlocks


class ParseRecords:
    """One row a record of a CSV text, with the columns that the call names, and what failed."""

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not columns.isConstantExpression or not columns.value:
            raise ValueError("columns must be a constant like 'name string, n long'")
        fields = [part.split() for part in columns.value.split(",")]
        return AnalyzeResult(StructType([*(StructField(name, TYPES[kind][0]) for name, kind in fields), StructField("failed", StringType())]))

    def eval(self, text: str, columns: str) -> Iterator[tuple]:
        if text is None:
            return
        wanted = [(name, TYPES[kind][1]) for name, kind in (part.split() for part in columns.split(","))]
        try:
            rows = list(csv.DictReader(io.StringIO(text, newline=""), strict=True))
            out = [(*(None if r[name] in (None, "") else kind(r[name]) for name, kind in wanted), None) for r in rows]
        except (ValueError, KeyError, csv.Error) as e:
            out = [(*[None] * len(wanted), f"{type(e).__name__}: {e}")]
        yield from out


def register(spark: SparkSession) -> None:
    """Makes both functions known to SQL."""
    spark.udtf.register("parse_blocks", F.udtf(block_function(dict(PARSERS)), returnType=COLUMNS))
    spark.udtf.register("parse_records", F.udtf(ParseRecords))


def parsed(docs: DataFrame, keys: list[str], text: str = "text", media_type: str = "media_type") -> DataFrame:
    """keys and one row a block of each document, by its media type."""
    register(docs.sparkSession)
    return docs.sparkSession.sql(f"SELECT {', '.join(f'd.{k}' for k in keys)}, b.* FROM {{docs}} d, LATERAL parse_blocks(d.{text}, d.{media_type}) b", docs=docs)
