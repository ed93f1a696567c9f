"""Workbook checks and cataloguing.

Workbooks come as ``cells(file, sheet, sheet_no, rw, cl, val)``. Every check is one
conditional aggregate or filter over the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any_case

# The required cell, its text, and names that are not checked.
REQUIRED_ROW, REQUIRED_COLUMN = 14, 6
REQUIRED_TEXT = "Beginning Balance"
SKIPPED_FILES = ("R19", "Report 19")
SKIPPED_SHEETS = ("Diff",)

# Folder and sheet names of the lessee workbooks, separators of the catalogue path.
LESSEE_FOLDER = "\\lessee\\"
JOURNAL, LEASE, LS = "Journal", "Lease", "LS"
DEPARTMENT_NOTE = "LS-Department Note disclos"
SHEET_SEPARATOR, SHEET_SUFFIX = "|||", "$'"


def _without(name: Column, parts: tuple[str, ...]) -> Column:
    keep = F.lit(True)
    for part in parts:
        keep = keep & ~name.contains(part)
    return keep


def failing_sheets(cells: DataFrame, first_only: bool = True) -> DataFrame:
    """Sheets whose required cell is empty or lacks the text, the first one per file."""
    sheets = (
        cells.filter(
            F.col("file").endswith(".xlsx")
            & _without(F.col("file"), SKIPPED_FILES)
            & _without(F.col("sheet"), SKIPPED_SHEETS)
        )
        .groupBy("file", "sheet_no", "sheet")
        .agg(
            F.max(F.when((F.col("rw") == REQUIRED_ROW) & (F.col("cl") == REQUIRED_COLUMN), F.col("val"))).alias("val")
        )
        .filter(F.col("val").isNull() | ~F.col("val").contains(REQUIRED_TEXT))
    )
    if not first_only:
        return sheets.select("file", "sheet_no", "sheet")
    return (
        sheets.groupBy("file")
        .agg(F.min(F.struct("sheet_no", "sheet")).alias("first"))
        .select("file", "first.sheet_no", "first.sheet")
    )


def quarantine_list(failing: DataFrame) -> DataFrame:
    return failing.select("file").distinct()


def first_row_occupied(cells: DataFrame) -> DataFrame:
    """Sheets with a value in A1 or B1, and the report line for each."""
    return (
        cells.filter(
            F.col("file").rlike(r"\.xlsx?$") & (F.col("rw") == 1) & (F.col("cl") <= 2) & F.col("val").isNotNull()
        )
        .select("file", "sheet")
        .distinct()
        .withColumn("line", F.concat("file", F.lit(" - Sheet: "), "sheet"))
    )


def sheet_catalogue(sheets: DataFrame) -> DataFrame:
    """One row per file and sheet with its combined path."""
    return (
        sheets.select("sheet_name", "filename")
        .distinct()
        .withColumn("filepath", F.concat("filename", F.lit(SHEET_SEPARATOR), "sheet_name", F.lit(SHEET_SUFFIX)))
    )


def lessee_subsets(catalogue: DataFrame) -> DataFrame:
    """Lessee sheets with one flag per subset, in a single pass; subsets may overlap."""
    sheet = F.col("sheet_name")
    return catalogue.filter(contains_any_case(F.col("filename"), LESSEE_FOLDER)).withColumns(
        {
            "is_journal_ls": contains_any_case(sheet, JOURNAL) & contains_any_case(sheet, LS),
            "is_department_note": contains_any_case(sheet, DEPARTMENT_NOTE),
            "is_lease_ls": contains_any_case(sheet, LEASE) & contains_any_case(sheet, LS),
        }
    )


def combine_sheets(cells: DataFrame, columns: int = 1) -> DataFrame:
    """All header-less sheets as one table, led by the sheet name; missing cells are NULL.

    ``columns`` is the least width: the table is as wide as its rightmost cell. Runs a job when called.
    """
    width = max(columns, cells.agg(F.max("cl")).first()[0] or 0)
    return cells.groupBy("file", "sheet_no", F.col("sheet").alias("source_sheet"), "rw").agg(
        *[F.max(F.when(F.col("cl") == c, F.col("val"))).alias(f"c{c}") for c in range(1, width + 1)]
    )
