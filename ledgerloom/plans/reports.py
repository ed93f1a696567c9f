"""The eight leave reports, each a ``DataFrame -> DataFrame`` plan; all are lazy but the bands and ranges of the position reports.

All of them take the ledger with its text columns. ``ordered`` adds the report's row
order; leave it off when a sink sorts anyway.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ledger as L
from ..operators import filters as P
from ..operators import ledger as A
from ..operators.skew import counted_join, hot_salts, is_hot, unbroadcast
from ..session import stage, stage_last
from ..sources.sinks import number_rows, number_staged, with_places

LEAVE_KEYS = ["fy", "org_code", "cbid", "benefit_id", "benefit_name"]
POSITION_KEYS = ["fy", "ueid", "position_number", "benefit_id"]
BAND_KEYS = [*POSITION_KEYS, "department_name", "benefit_name", "base_pay", "hourly_rate"]
# Order of a position's bands.
_BAND_ORDER = ["benefit_name", "department_name", "base_pay", "hourly_rate"]


def _asc(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def _org_number() -> Column:
    return F.col("org_code").try_cast("int").asc_nulls_last()


# Row order of each report.
ORDER = {
    "headcount_by_agency": lambda: [F.desc_nulls_last("fy"), *_asc("agency_code")],
    "headcount": lambda: [F.desc_nulls_last("fy"), *_asc("agency_code", "org_code")],
    "leave_balance": lambda: [F.desc_nulls_last("fy"), *_asc("org_code", "cbid", "benefit_id", "benefit_name")],
    "earned_used": lambda: [F.desc_nulls_last("fy"), _org_number(), *_asc("cbid", "benefit_id", "benefit_name")],
    "liability": lambda: [F.desc_nulls_last("fy"), _org_number()],
    "rollforward_agency": lambda: [
        F.desc_nulls_last("fy"),
        *_asc("agency_code", "org_code", "cbid", "benefit_id", "benefit_name"),
    ],
    # The columns after the year only let the sort divide an employee with many rows.
    "rollforward_position": lambda: [
        *_asc("ueid"),
        F.desc_nulls_last("fy"),
        *_asc("position_number", "benefit_id", *_BAND_ORDER),
    ],
}


def _report(df: DataFrame, order: str, ordered: bool) -> DataFrame:
    df = A.with_year_label(df)
    return df.orderBy(*ORDER[order]()) if ordered else df


def headcount(ledger: DataFrame, by_org: bool = True, ordered: bool = True) -> DataFrame:
    """Employees with a June row, per fiscal year, agency and (optionally) organisation."""
    keys = ["fy", "agency_code", "org_code"] if by_org else ["fy", "agency_code"]
    june = A.with_report_columns(ledger.filter(P.is_june(F.col("leave_period"))))
    df = june.groupBy(*keys).agg(F.count_distinct("ueid").alias("employee_count"))
    return _report(df, "headcount" if by_org else "headcount_by_agency", ordered)


def non_classified_headcount(ledger: DataFrame, non_classified: DataFrame, ordered: bool = True) -> DataFrame:
    """Headcount of the employees listed as non-classified in the year.

    Employees are made distinct before the semi join, so the lookup only meets one row
    per employee, agency and organisation, and the count needs no second pass.
    """
    keys = ["fy", "agency_code", "org_code"]
    employees = (
        A.with_report_columns(ledger.filter(P.is_june(F.col("leave_period")))).select(*keys, "ueid").distinct()
    )
    df = (
        A.with_year_label(employees)
        .join(non_classified.select("ueid", "fy"), ["ueid", "fy"], "left_semi")
        .groupBy(*keys)
        .agg(F.count("ueid").alias("employee_count"))
    )
    return df.orderBy(*ORDER["headcount"]()) if ordered else df


def _reported_rows(ledger: DataFrame) -> DataFrame:
    return A.with_report_columns(
        ledger.filter(P.known_time_base(F.col("time_base")) & P.reported_agency(F.col("position_number")))
    )


def leave_balance(ledger: DataFrame, ordered: bool = True) -> DataFrame:
    """June balances per organisation, CBID and benefit.

    The year's activity takes no part in the result, so it is neither read nor joined.
    """
    df = (
        _reported_rows(ledger.filter(P.is_june(F.col("leave_period"))))
        .groupBy(*LEAVE_KEYS)
        .agg(L.to_quarter_hours(F.sum(L.number(F.col("end_balance")))).alias("ending_balance"))
        .withColumn("org_code", L.org_code_display(F.col("org_code")))
    )
    return _report(df, "leave_balance", ordered)


def earned_used(ledger: DataFrame, fan_out: bool = True, ordered: bool = True) -> DataFrame:
    """Beginning balance, movements and ending balance per organisation, CBID and benefit.

    With ``fan_out`` every agency and benefit name that has June rows carries the whole
    activity of its organisation, CBID and benefit; without it, only its own.
    """
    fine = (
        _reported_rows(ledger)
        .groupBy("fy", "agency_code", "org_code", "cbid", "benefit_id", "benefit_name")
        .agg(*A.movement_sums(), *A.june_sums())
    )
    if fan_out:
        fine = A.spread_totals(fine, ["fy", "org_code", "cbid", "benefit_id"])
    begins = L.beginning_balance(F.col("end_balance"), *[F.col(c) for c in A.MOVEMENTS])
    df = (
        fine.filter("june_rows > 0")
        .groupBy(*LEAVE_KEYS)
        .agg(
            L.to_quarter_hours(F.sum(begins)).alias("beginning_balance"),
            *[L.to_quarter_hours(F.sum(c)).alias(c) for c in A.MOVEMENTS],
            L.to_quarter_hours(F.sum("end_balance")).alias("ending_balance"),
        )
        .withColumn("org_code", L.org_code_display(F.col("org_code")))
    )
    return _report(df, "earned_used", ordered)


def liability(ledger: DataFrame, ordered: bool = True) -> DataFrame:
    """June hours and their weighted average rate per organisation.

    Sums of employee sums are sums of rows, hence one ``groupBy``.
    """
    df = (
        _reported_rows(ledger.filter(P.is_june(F.col("leave_period"))))
        .groupBy("fy", "org_code")
        .agg(
            F.sum(L.number(F.col("end_balance"))).alias("hours"),
            F.sum(L.liability(F.col("end_balance"), F.col("hourly_rate"))).alias("liability"),
        )
        .select(
            "fy",
            L.org_code_display(F.col("org_code")).alias("org_code"),
            L.to_quarter_hours(F.col("hours")).alias("total_hours"),
            L.to_cents(L.safe_ratio(F.col("liability"), F.col("hours"))).alias("weighted_avg_hourly_rate"),
        )
    )
    return _report(df, "liability", ordered)


def pay_rates(ledger: DataFrame, ordered: bool = True) -> DataFrame:
    """Average June rate per agency and organisation; each rate of an employee counts once."""
    df = (
        A.with_report_columns(
            ledger.filter(
                P.known_time_base(F.col("time_base"), without_intermittent=True) & P.is_june(F.col("leave_period"))
            )
        )
        .select("fy", "agency_code", "org_code", "ueid", "hourly_rate")
        .distinct()
        .groupBy("fy", "agency_code", "org_code")
        .agg(F.avg(L.number(F.col("hourly_rate"))).alias("avg_pay_rate"))
    )
    return _report(df, "headcount", ordered)


def rollforward_agency(ledger: DataFrame, padded: bool = False, ordered: bool = True) -> DataFrame:
    """Unrounded roll-forward per agency, organisation, CBID and benefit.

    Every June row of an employee carries the employee's whole yearly activity in the
    benefit. June rows are combined first, and the activity is multiplied by their number.
    """
    keys = ["fy", "agency_code", "org_code", "cbid", "benefit_id", "benefit_name"]
    fine = (
        A.with_report_columns(ledger.filter(P.known_time_base(F.col("time_base"))), padded)
        .groupBy("ueid", *keys)
        .agg(*A.movement_sums(), *A.june_sums())
    )
    earned, used, misc = (F.col(c) for c in A.MOVEMENTS)
    begins = L.beginning_balance(
        F.col("end_balance"), *[c * F.col("june_balances") for c in (earned, used, misc)]
    )
    df = (
        A.spread_totals(fine, ["fy", "ueid", "benefit_id"])
        .filter("june_rows > 0")
        .groupBy(*keys)
        .agg(
            F.sum(begins).alias("beginning_balance"),
            *[F.sum(F.col(c) * F.col("june_rows")).alias(c) for c in A.MOVEMENTS],
            F.sum("end_balance").alias("ending_balance"),
        )
    )
    return _report(df, "rollforward_agency", ordered)


def _position_bands(ledger: DataFrame, fy: str | None, padded: bool) -> DataFrame:
    """The pay bands of :func:`rollforward_position`, written when called."""
    rows = ledger.filter(P.reported_agency(F.col("position_number"), padded))
    if fy is not None:
        rows = rows.filter(P.in_fiscal_year(F.col("leave_period"), fy))
    return stage(A.bands_with_balances(A.with_report_columns(rows, padded)), "bands")


def _position_figures() -> list[Column]:
    """Columns of :func:`rollforward_position`, from bands with the totals of their positions."""
    ending = F.col("ending_balance")
    return [
        "fy",
        "ueid",
        "department_name",
        "position_number",
        "benefit_name",
        "benefit_id",
        "base_pay",
        "hourly_rate",
        L.beginning_balance(ending, *[F.col(f"position_{c}") for c in A.MOVEMENTS]).alias("beginning_balance"),
        *A.MOVEMENTS,
        "ending_balance",
    ]


def _position_totals(bands: DataFrame) -> DataFrame:
    return A.rolled_up_positions(bands).withColumnsRenamed({c: f"position_{c}" for c in A.MOVEMENTS})


def rollforward_position(
    ledger: DataFrame, fy: str | None = None, padded: bool = False, ordered: bool = True
) -> DataFrame:
    """Roll-forward per pay band of a position, for one fiscal year or all.

    Beginning and ending balance belong to the position and benefit and repeat on each of
    its pay bands. The ledger is read once, into bands that also keep their last month and
    its balance; they are written when called and rolled up to positions. Bands per position are
    not bounded, so the totals come in through a join that spreads positions with many.
    """
    bands = _position_bands(ledger, fy, padded)
    totals = unbroadcast(_position_totals(bands))
    df = counted_join(bands.select(*BAND_KEYS, *A.MOVEMENTS), totals, POSITION_KEYS, "left", hot_salts(bands, POSITION_KEYS))
    return _report(df.select(*_position_figures()), "rollforward_position", ordered)


def numbered_rollforward_position(ledger: DataFrame, fy: str | None = None, padded: bool = False) -> DataFrame:
    """:func:`numbered` of :func:`rollforward_position` with one exchange of the bands.

    The report's order begins with the keys of a position, so the ranges of its sort hold whole
    positions and total them where they lie. Positions with more bands than an even task holds are cut by
    the rest of the order; their totals, few rows, are looked up. The bands are deleted once the ranges are written.
    """

    def ranges() -> DataFrame:
        bands = _position_bands(ledger, fy, padded)
        salts = hot_salts(bands, POSITION_KEYS)
        hot = is_hot(POSITION_KEYS, salts)
        cut = [f"_{c}" for c in _BAND_ORDER] if salts else []
        rows = A.with_year_label(bands.withColumns({f"_{c}": F.when(hot, F.col(c)) for c in _BAND_ORDER if salts}))
        over = Window.partitionBy(*POSITION_KEYS, *cut)
        # As with = in a join, a NULL key finds no total.
        known = reduce(and_, [F.col(k).isNotNull() for k in POSITION_KEYS])
        totals = {f"position_{c}": F.sum(c).over(over) for c in A.MOVEMENTS}
        totals["ending_balance"] = F.max(F.struct("last_month", "last_balance")).over(over)["last_balance"]
        rows = rows.repartitionByRange(*ORDER["rollforward_position"]()[: len(POSITION_KEYS)], *_asc(*cut))
        rows = rows.withColumns({c: F.when(known, total) for c, total in totals.items()})
        if salts:
            found = A.with_year_label(_position_totals(bands.filter(hot)))
            found = found.select(*POSITION_KEYS, F.struct(*totals).alias("_found"))
            rows = rows.join(F.broadcast(found), POSITION_KEYS, "left")
            rows = rows.withColumns({c: F.when(F.col("_found").isNotNull(), F.col("_found")[c]).otherwise(F.col(c)) for c in totals})
        return with_places(rows.select(*_position_figures()).sortWithinPartitions(*ORDER["rollforward_position"]()))

    return number_staged(stage_last(ledger.sparkSession, ranges, "ranges"))


def july_begin_june_end(ledger: DataFrame, fy: str | None = None) -> DataFrame:
    """Pay bands with the July beginning and June ending balances found in the ledger.

    Several distinct balances of a position repeat its bands, one row for each. The ledger
    is read once, into bands split by boundary balance, which are written when called; bands
    and balances are rolled up from them and joined with positions of many bands spread.
    """
    if fy is not None:
        ledger = ledger.filter(P.in_fiscal_year(F.col("leave_period"), fy))
    split = stage(A.bands_with_boundaries(A.with_report_columns(ledger)), "boundary-bands")
    salts = hot_salts(split, POSITION_KEYS)

    def balances(boundary: int, out: str) -> DataFrame:
        found = split.filter(F.col("boundary") == boundary)
        return unbroadcast(found.select(*POSITION_KEYS, F.col("balance").alias(out)).distinct())

    bands = split.groupBy(*BAND_KEYS).agg(*[F.sum(c).alias(c) for c in A.MOVEMENTS])
    begun = counted_join(bands, balances(7, "beginning_balance"), POSITION_KEYS, "left", salts)
    return A.with_year_label(counted_join(begun, balances(6, "ending_balance"), POSITION_KEYS, "left", salts))


def numbered(report: DataFrame, order: str) -> DataFrame:
    """A report with ``row_no``, each row's place from 1 in the report's ``ORDER``.

    The places come from a range sort over all tasks, so a table or view keeps the order
    that its files cannot promise. Runs jobs when called.
    """
    return number_rows(report, ORDER[order]())
