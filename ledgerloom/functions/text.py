"""Text functions shared by the workbook, journal and page operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters not allowed in sheet names, and the longest name.
SHEET_NAME_FORBIDDEN = r"[:\\/?*\[\]]"
SHEET_NAME_LENGTH = 31

_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_cell(text: Column) -> Column:
    """NULL to empty, trimmed, non-breaking spaces to plain ones."""
    return F.translate(F.coalesce(strip(text), F.lit("")), "\u00a0", " ")


def safe_sheet_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, SHEET_NAME_FORBIDDEN, "_"), 1, SHEET_NAME_LENGTH)


def agency_from_file(name: Column) -> Column:
    """Last four characters of a PDF's name without its suffix."""
    return F.right(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit(4))


def contains_any_case(text: Column, part: str) -> Column:
    """NULL text is false."""
    return F.coalesce(F.lower(text).contains(part.lower()), F.lit(False))
