"""All-text CSV source, header inspection and the CSV integrity check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import EXPECTED_COMMAS, MAX_PREVIEW_LINES, MAX_SOURCE_FILE_LENGTH
from .ingest import LINEAGE, file_lines, source_file


def read_text_csv(spark: SparkSession, path: str, lineage: bool = False) -> DataFrame:
    """Every column as text, nothing inferred; empty fields, quoted or not, are NULL.

    ``lineage`` adds the name of each row's file.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    columns = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]
    return df.select(*columns, *([source_file().alias(LINEAGE)] if lineage else []))


def inspect_header(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number and names of a CSV's columns; only its first line is read."""
    names = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
    return len(names), names


def line_problems(
    line: Column, expected_commas: int = EXPECTED_COMMAS, max_length: int = MAX_SOURCE_FILE_LENGTH
) -> Column:
    """Reasons why a line is bad, NULL for a good one."""
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    last = F.btrim(strip(F.substring_index(line, ",", -1)), F.lit('"'))
    reasons = F.concat_ws(
        "; ",
        F.when(commas != expected_commas, F.format_string("Wrong number of columns (%d commas)", commas)),
        F.when((commas > 0) & (F.length(last) > max_length), F.format_string("source_file too long (%d chars)", F.length(last))),
    )
    return F.nullif(reasons, F.lit(""))


def bad_lines(lines: DataFrame, preview: int | None = MAX_PREVIEW_LINES, order: str = "line_no") -> DataFrame:
    """Bad lines with their reasons, the first ``preview`` of each file or all of them.

    Each task passes on at most ``preview`` lines per file, so one bad file fills no task.
    """
    found = lines.withColumn("problems", line_problems(F.col("value"))).filter("problems is not null")
    if preview is not None:
        in_file = Window.partitionBy(LINEAGE).orderBy(order)
        found = found.withColumn("n", F.row_number().over(in_file)).filter(F.col("n") <= preview).drop("n")
    return found


def check_csv(
    spark: SparkSession, path: str, pattern: str = "*.csv", preview: int | None = MAX_PREVIEW_LINES
) -> DataFrame:
    """Integrity check of CSV files below their header line: file, line number, reasons, line.

    Line numbers come from the line counts of the file's earlier splits; only bad lines
    are numbered.
    """
    lines = file_lines(spark, path, pattern)
    splits = lines.groupBy(LINEAGE, "block").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    before = Window.partitionBy(LINEAGE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("lines_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    bad = bad_lines(lines, preview=None).join(splits, [LINEAGE, "block"])
    numbered = bad.select(
        LINEAGE,
        (F.col("lines_before") + F.col("seq") - F.col("first_seq") + 1).alias("line_no"),
        "problems",
        strip(F.col("value")).alias("value"),
    ).filter("line_no > 1")
    if preview is None:
        return numbered
    in_file = Window.partitionBy(LINEAGE).orderBy("line_no")
    return numbered.withColumn("n", F.row_number().over(in_file)).filter(F.col("n") <= preview).drop("n")
