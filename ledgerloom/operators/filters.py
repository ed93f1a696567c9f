"""Ledger predicates and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ledger as L
from ..schema import EXCLUDED_AGENCIES, INTERMITTENT_TIME_BASE, UNKNOWN_TIME_BASE


def is_june(period: Column) -> Column:
    """On a ledger partitioned by ``leave_period`` this prunes partitions."""
    return L.period_month(period) == "06"


def known_time_base(time_base: Column, without_intermittent: bool = False) -> Column:
    """A NULL time base does not pass either."""
    passes = time_base != UNKNOWN_TIME_BASE
    return passes & (time_base != INTERMITTENT_TIME_BASE) if without_intermittent else passes


def reported_agency(position: Column, padded: bool = True, excluded: tuple[str, ...] = EXCLUDED_AGENCIES) -> Column:
    return ~L.agency_code(position, padded).isin(*excluded)


def in_fiscal_year(period: Column, fy: str) -> Column:
    """Equality on the fiscal year, with a period range the scan can use to skip data."""
    first = int(fy[:4])
    if fy != f"{first}-{first + 1}":
        raise ValueError(f"{fy} is no fiscal year")
    return (period >= str(first)) & (period < str(first + 2)) & (L.fiscal_year_start(period) == first)


def non_numeric_sources(ledger: DataFrame, column: str = "end_balance") -> DataFrame:
    """Source files holding text that is no number."""
    c = F.col(column)
    return ledger.filter(c.isNotNull() & L.number_or_null(c).isNull()).select("source_file").distinct()


def malformed_positions(ledger: DataFrame, limit: int | None = 100) -> DataFrame:
    """Rows whose restored position number is not 13 long, the first ``limit`` in a fixed order."""
    columns = ["leave_period", "department_name", "cbid", "position_number", "full_position_number"]
    found = (
        ledger.withColumn("full_position_number", L.full_position_number(F.col("position_number")))
        .filter(F.length("full_position_number") != 13)
        .select(*columns)
    )
    return found if limit is None else found.orderBy(*[F.col(c).asc_nulls_last() for c in columns]).limit(limit)


def distinct_periods(ledger: DataFrame, cbid: str, limit: int | None = 10) -> DataFrame:
    found = ledger.filter(F.col("cbid") == cbid).select("leave_period").distinct()
    return found if limit is None else found.orderBy(F.col("leave_period").asc_nulls_last()).limit(limit)


def row_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("row_count"))
