"""Building blocks of the leave reports.

Each block reads the ledger once. The first ``groupBy`` combines rows inside every
task before anything is shuffled, so one employee, agency or organisation holding a
large share of the rows costs no more than its distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ledger as L
from . import filters as P

MOVEMENTS = ("total_earned", "total_used", "total_misc")


def with_report_columns(ledger: DataFrame, padded: bool = True) -> DataFrame:
    """Add the first year of the fiscal year as ``fy``, and the agency code."""
    return ledger.withColumns(
        {
            "fy": L.fiscal_year_start(F.col("leave_period")),
            "agency_code": L.agency_code(F.col("position_number"), padded),
        }
    )


def with_year_label(df: DataFrame) -> DataFrame:
    """Turn the number ``fy`` of grouped rows into its label."""
    return df.withColumn("fy", L.fiscal_year_label(F.col("fy")))


def movement_sums() -> list[Column]:
    return [
        F.sum(L.number(F.col(c))).alias(total)
        for c, total in zip(("leave_earned", "leave_used", "misc_amt"), MOVEMENTS)
    ]


def june_sums() -> list[Column]:
    """June rows, June rows with a balance, and their summed balance."""
    june, ending = P.is_june(F.col("leave_period")), L.number(F.col("end_balance"))
    return [
        F.count_if(june).alias("june_rows"),
        F.count(F.when(june, ending)).alias("june_balances"),
        F.sum(F.when(june, ending)).alias("end_balance"),
    ]


def yearly_activity(ledger_fy: DataFrame, *keys: str) -> DataFrame:
    """Earned, used and miscellaneous hours per fiscal year and ``keys``."""
    return ledger_fy.groupBy("fy", *keys).agg(*movement_sums())


def june_endings(ledger_fy: DataFrame) -> DataFrame:
    """June balances per fiscal year, agency, organisation, CBID and benefit."""
    return (
        ledger_fy.filter(P.is_june(F.col("leave_period")))
        .groupBy("fy", "agency_code", "org_code", "cbid", "benefit_id", "benefit_name")
        .agg(F.sum(L.number(F.col("end_balance"))).alias("end_balance"))
    )


def spread_totals(fine: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the movement sums of ``fine`` by their totals over ``keys``.

    This is the equi-join of a table with its own roll-up, written as a window so that
    the ledger is scanned once. Only for ``fine`` tables whose rows per key are bounded
    by code lists (agencies, organisations, benefit names). As with ``=`` in a join, a
    NULL key matches nothing and leaves NULL totals.
    """
    over = Window.partitionBy(*keys)
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(k).isNotNull()
    return fine.withColumns({c: F.when(matched, F.sum(c).over(over)) for c in MOVEMENTS})


def employee_liability(ledger_fy: DataFrame) -> DataFrame:
    """Hours and liability per employee, agency and organisation."""
    return ledger_fy.groupBy("fy", "ueid", "agency_code", "org_code").agg(
        F.sum(L.number(F.col("end_balance"))).alias("hours"),
        F.sum(L.liability(F.col("end_balance"), F.col("hourly_rate"))).alias("total_employee_liability"),
    )


def pay_bands(ledger_fy: DataFrame) -> DataFrame:
    """Movements per pay band of a position and benefit."""
    return ledger_fy.groupBy(
        "fy", "ueid", "department_name", "position_number", "benefit_name", "benefit_id", "base_pay", "hourly_rate"
    ).agg(*movement_sums())


def _month_of_year() -> Column:
    """0 for July to 11 for June; other months are an error."""
    month = L.period_month(F.col("leave_period")).cast("int")
    in_year = F.when(month.between(1, 12), (month + 5) % 12)
    invalid = F.concat(F.lit("no month in period "), F.col("leave_period"))
    return F.when(F.col("leave_period").isNull(), 0).otherwise(F.coalesce(in_year, F.raise_error(invalid).cast("int")))


def last_balance_sums() -> list[Column]:
    """Highest balance of each month of the year, and the months that have rows as bits.

    A year has twelve months, so the last period's balance needs only these numbers; the
    aggregate keeps its hash table, which it would not with a text or struct maximum.
    """
    month, ending = F.col("month_of_year"), L.number(F.col("end_balance"))
    return [
        F.bit_or(F.expr("shiftleft(1, month_of_year)")).alias("months"),
        *[F.max(F.when(month == m, ending)).alias(f"month_{m}") for m in range(12)],
    ]


def last_balance() -> Column:
    """Balance of the highest month that has rows; of several rows in it, the highest balance."""
    found = F.lit(None).cast("double")
    for m in range(12):
        found = F.when(F.col("months") >= 2**m, F.col(f"month_{m}")).otherwise(found)
    return found


def position_totals(ledger_fy: DataFrame) -> DataFrame:
    """Movements and last balance per fiscal year, employee, position and benefit."""
    return (
        ledger_fy.withColumn("month_of_year", _month_of_year())
        .groupBy("fy", "ueid", "position_number", "benefit_id")
        .agg(*movement_sums(), *last_balance_sums())
        .select("fy", "ueid", "position_number", "benefit_id", *MOVEMENTS, last_balance().alias("ending_balance"))
    )


def bands_with_balances(ledger_fy: DataFrame) -> DataFrame:
    """Movements per pay band as :func:`pay_bands` gives them, with each band's last month and the balance in it.

    ``last_month`` counts from 0 for July; of several rows in the month, the highest balance is taken.
    """
    keys = ["fy", "ueid", "department_name", "position_number", "benefit_name", "benefit_id", "base_pay", "hourly_rate"]
    months = ledger_fy.withColumn("month_of_year", _month_of_year()).groupBy(*keys).agg(*movement_sums(), *last_balance_sums())
    # The highest bit that is set.
    month = (F.length(F.bin("months")) - 1).cast("byte")
    return months.select(*keys, *MOVEMENTS, month.alias("last_month"), last_balance().alias("last_balance"))


def bands_with_boundaries(ledger_fy: DataFrame) -> DataFrame:
    """Movements per pay band, split by the balance that a July row begins with or a June row ends with.

    ``boundary`` is 7 or 6 with that row's ``balance``, and NULL for the other months.
    """
    month = L.period_month(F.col("leave_period"))
    july, june = month == "07", month == "06"
    return (
        ledger_fy.withColumns(
            {
                "boundary": F.when(july, 7).when(june, 6),
                "balance": F.when(july, F.col("begin_balance")).when(june, F.col("end_balance")),
            }
        )
        .groupBy(
            "fy",
            "ueid",
            "department_name",
            "position_number",
            "benefit_name",
            "benefit_id",
            "base_pay",
            "hourly_rate",
            "boundary",
            "balance",
        )
        .agg(*movement_sums())
    )


def rolled_up_positions(bands: DataFrame) -> DataFrame:
    """What :func:`position_totals` gives, out of :func:`bands_with_balances`."""
    month, balance = F.col("last_month"), F.col("last_balance")
    return (
        bands.groupBy("fy", "ueid", "position_number", "benefit_id")
        .agg(
            *[F.sum(c).alias(c) for c in MOVEMENTS],
            F.bit_or(F.expr("shiftleft(1, last_month)")).alias("months"),
            *[F.max(F.when(month == m, balance)).alias(f"month_{m}") for m in range(12)],
        )
        .select("fy", "ueid", "position_number", "benefit_id", *MOVEMENTS, last_balance().alias("ending_balance"))
    )


def multi_position_employees(ledger_fy: DataFrame) -> DataFrame:
    """Employees with several positions in a year, and the list of them."""
    positions = ledger_fy.select("ueid", "fy", "position_number").distinct()
    several = (
        positions.groupBy("ueid", "fy")
        .agg(
            F.count("position_number").alias("position_count"),
            F.sort_array(F.collect_set("position_number")).alias("positions"),
        )
        .filter("position_count > 1")
    )
    return several.select("ueid", "fy", "position_count", F.array_join("positions", ", ").alias("positions"))


def distinct_combinations(ledger_fy: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct tuples; tuples holding NULLs count too."""
    return ledger_fy.select(*columns).distinct().agg(F.count("*").alias("distinct_combos"))


def boundary_balances(ledger_fy: DataFrame, month: str, column: str, out: str) -> DataFrame:
    """Distinct balances found in the rows of one month."""
    return (
        ledger_fy.filter(L.period_month(F.col("leave_period")) == month)
        .select("fy", "ueid", "position_number", "benefit_id", F.col(column).alias(out))
        .distinct()
    )
