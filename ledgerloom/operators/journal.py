"""Cleaning of journal-entry sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .blocks import forward_fill
from .skew import counted_join, hot_salts, unbroadcast

# Rows above the heading, marks of a side, replacement of a missing account, heading of the sides.
HEADER_ROWS = 8
DEBIT_MARK, CREDIT_MARK = "Dr", "Cr"
NO_ACCOUNT = "XXXX"
SIDE_HEADING = "Debit/Credit"
_DIGITS = r"\p{Nd}+"


def with_spaced_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("_", " ") for c in df.columns])


def side(text: Column) -> Column:
    """D or C by the first mark looked for, debit before credit; anything else is ERROR."""
    return F.when(text.contains(DEBIT_MARK), "D").when(text.contains(CREDIT_MARK), "C").otherwise("ERROR")


def account_number(text: Column) -> Column:
    found = F.regexp_extract(text, f"({_DIGITS})", 1)
    return F.when(found != "", found).otherwise(NO_ACCOUNT)


def account_name(text: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(text, _DIGITS, "")), F.lit(""))


def amount_or_flipped(amount: Column, other: Column) -> Column:
    return F.coalesce(amount, -other)


def journal_rows(cells: DataFrame, header_row: int = HEADER_ROWS + 1) -> DataFrame:
    """Rows below the heading row of each sheet, with the columns the cleaning needs.

    Headings are matched by name, so sheets may order their columns differently. A sheet
    without a Debit/Credit column is no journal and gives no rows. Columns with many cells
    are spread by their counts; the counts run a job when called.
    """
    names = cells.filter(F.col("rw") == header_row).select(
        "file", "sheet", "cl", F.replace("val", F.lit("_"), F.lit(" ")).alias("name")
    )
    journals = names.filter(F.col("name") == SIDE_HEADING).select("file", "sheet").distinct()
    names = names.join(unbroadcast(journals), ["file", "sheet"], "left_semi")
    column = ["file", "sheet", "cl"]
    named = counted_join(cells.filter(F.col("rw") > header_row), unbroadcast(names), column, salts=hot_salts(cells, column))

    def cell(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("val")))

    return named.groupBy("file", "sheet", F.col("rw").alias("row_no")).agg(
        cell("JE Title").alias("je_title"),
        cell(SIDE_HEADING).alias("debit_credit"),
        cell("Amount").cast("double").alias("amount"),
        cell("11").cast("double").alias("col_11"),
    )


def clean_journal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Titles filled downwards, amounts completed, side and account split from the text.

    ``row_no`` is unique within ``keys``.
    """
    text = F.col("debit_credit")
    return forward_fill(rows, keys, ["row_no"], "je_title", "title").select(
        *keys,
        "row_no",
        F.col("title").alias("je_title"),
        amount_or_flipped(F.col("amount"), F.col("col_11")).alias("amount"),
        side(text).alias("d_c"),
        account_number(text).alias("account_number"),
        account_name(text).alias("account_name"),
    )
