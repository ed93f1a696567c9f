"""Page results given as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

COLUMNS = ("column_1", "column_2", "column_3", "column_4")
ROWS = "ARRAY<STRUCT<" + ", ".join(f"{c}: STRING" for c in COLUMNS) + ">>"
PAGE = f"agency STRING, page INT, rows {ROWS}"
_STRICT = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}


def parse_pages(pages: DataFrame, json: str = "js") -> DataFrame:
    """Add the parsed page as ``parsed``, NULL where the text is no JSON object; the text stays.

    JSON functions stop after the first value, so the text is checked as the only element
    of an array, where trailing text is an error. That check allows single quotes and bare
    control characters; the parse does not, and gives NULL for a malformed array.
    """
    alone = F.concat(F.lit("["), json, F.lit("]"))
    valid = (F.json_array_length(alone) == 1) & strip(F.col(json)).startswith("{")
    return pages.withColumn("parsed", F.when(valid, F.get(F.from_json(alone, f"ARRAY<STRUCT<{PAGE}>>", _STRICT), F.lit(0))))


def rejected_pages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parsed").isNull()).drop("parsed")


def flatten_pages(parsed: DataFrame, key: str) -> DataFrame:
    """Per page: the agency as a heading row, the page's rows, a blank row."""

    def row(first: Column) -> Column:
        return F.struct(first.alias(COLUMNS[0]), *[F.lit("").alias(c) for c in COLUMNS[1:]])

    agency = strip(F.coalesce(F.col("parsed.agency"), F.lit("")))
    body = F.coalesce(F.col("parsed.rows"), F.array().cast(ROWS))
    lines = F.concat(F.array(row(agency)), body, F.array(row(F.lit(""))))
    return (
        parsed.filter(F.col("parsed").isNotNull())
        .select(key, F.posexplode(lines).alias("line_no", "line"))
        .select(key, "line_no", *[F.col(f"line.{c}") for c in COLUMNS])
    )
