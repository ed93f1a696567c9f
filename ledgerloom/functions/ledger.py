"""Scalar functions of the leave ledger (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year_start(period: Column) -> Column:
    """First calendar year of the July-to-June year of a ``YYYY-MM`` period, 0 for a NULL period.

    Reports group by this number and turn it into a label once per result row.
    """
    year = F.substring(period, 1, 4).cast("int")
    return F.coalesce(year - F.when(period_month(period).cast("int") < 7, 1).otherwise(0), F.lit(0))


def fiscal_year_label(start: Column) -> Column:
    """``Y-(Y+1)``, and ``-`` for an unknown year."""
    return F.when(start == 0, "-").otherwise(
        F.concat_ws("", start.cast("string"), F.lit("-"), (start + 1).cast("string"))
    )


def fiscal_year(period: Column) -> Column:
    return fiscal_year_label(fiscal_year_start(period))


def fiscal_year_from_label(period: Column) -> Column:
    """``Y-(Y+1)`` straight from the period's year, right for July periods only."""
    year = F.left(period, F.lit(4))
    return F.concat_ws("", year, F.lit("-"), (year.try_cast("int") + 1).cast("string"))


def period_month(period: Column) -> Column:
    return F.substring(period, 6, 2)


def period_date(period: Column) -> Column:
    """First day of the period."""
    return F.to_timestamp(F.concat(period, F.lit("-01")), "yyyy-MM-dd")


def full_position_number(position: Column) -> Column:
    """Restore lost leading zeros of 10 to 12 digit positions; other lengths stay as they are."""
    return F.when(F.length(position).between(10, 12), F.lpad(position, 13, "0")).otherwise(position)


def agency_code(position: Column, padded: bool = True) -> Column:
    """First three characters of the restored (or raw) position number."""
    return F.substring(full_position_number(position) if padded else position, 1, 3)


def org_code_display(org_code: Column) -> Column:
    return F.lpad(org_code, 4, "0")


def to_quarter_hours(hours: Column) -> Column:
    return F.round(hours * 4) / 4


def to_cents(amount: Column) -> Column:
    return F.round(amount * 100) / 100


def beginning_balance(ending: Column, earned: Column, used: Column, misc: Column) -> Column:
    """Roll an ending balance back over the year's movements; missing movements count as zero."""
    return ending - F.coalesce(earned, F.lit(0.0)) + F.coalesce(used, F.lit(0.0)) - F.coalesce(misc, F.lit(0.0))


def liability(end_balance: Column, hourly_rate: Column) -> Column:
    return number(end_balance) * number(hourly_rate)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def number(text: Column) -> Column:
    """Strict: text that is no number raises under ANSI mode."""
    return text.cast("double")


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")
