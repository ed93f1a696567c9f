from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as A
from ledgerloom.plans import reports
from ledgerloom.schema import LEDGER, with_numeric_measures
from ledgerloom.sources.sinks import with_places
from tests.conftest import rows

DEFAULTS = {
    "ueid": "E1", "leave_period": "2024-06", "position_number": "0511234567890", "org_code": "840", "cbid": "S01",
    "time_base": "FT", "department_name": "D", "benefit_id": "HI", "benefit_name": "Vacation", "base_pay": "1000",
    "hourly_rate": "10", "leave_earned": "0", "leave_used": "0", "misc_amt": None, "begin_balance": "0",
    "end_balance": "0", "source_file": "a.csv",
}


@pytest.fixture
def ledger(spark):
    def build(*changes: dict):
        return spark.createDataFrame([tuple({**DEFAULTS, **c}[f] for f in LEDGER.fieldNames()) for c in changes], LEDGER)

    return build


def test_fan_out_counts_activity_once_per_agency(ledger):
    other = {"position_number": "0521234567890"}
    df = ledger(
        {"leave_earned": "5", "end_balance": "10"}, {"leave_earned": "3", "end_balance": "20", **other},
    )
    (faithful,) = reports.earned_used(df).collect()
    assert (faithful.total_earned, faithful.ending_balance, faithful.beginning_balance) == (16.0, 30.0, 14.0)
    (own,) = reports.earned_used(df, fan_out=False).collect()
    assert (own.total_earned, own.ending_balance, own.beginning_balance) == (8.0, 30.0, 22.0)


def test_null_cbid_matches_no_activity(ledger):
    (row,) = reports.earned_used(ledger({"cbid": None, "leave_earned": "5", "end_balance": "10"})).collect()
    assert (row.total_earned, row.beginning_balance, row.ending_balance) == (None, 10.0, 10.0)


def test_short_and_padded_org_codes_stay_separate(ledger):
    df = ledger({"org_code": "840", "end_balance": "1"}, {"org_code": "0840", "end_balance": "2"})
    found = rows(reports.leave_balance(df).select("org_code", "ending_balance"))
    assert found == [("0840", 1.0), ("0840", 2.0)]


def test_pay_rate_counts_each_rate_once(ledger):
    (row,) = reports.pay_rates(ledger({}, {"benefit_id": "SK"}, {"hourly_rate": "20"})).collect()
    assert row.avg_pay_rate == 15.0


def test_liability_rate_is_null_without_hours(ledger):
    (row,) = reports.liability(ledger({"end_balance": "0"})).collect()
    assert (row.total_hours, row.weighted_avg_hourly_rate, row.org_code) == (0.0, None, "0840")


def test_liability_weights_rates_by_hours(ledger):
    df = ledger({"end_balance": "30"}, {"ueid": "E2", "end_balance": "10", "hourly_rate": "20"})
    (row,) = reports.liability(df).collect()
    assert (row.total_hours, row.weighted_avg_hourly_rate) == (40.0, 12.5)


def test_headcount_counts_june_employees_once(ledger):
    df = ledger({}, {"benefit_id": "SK"}, {"ueid": "E2"}, {"ueid": "E3", "leave_period": "2024-05"})
    assert rows(reports.headcount(df)) == [("2023-2024", "051", "840", 2)]


def test_non_classified_headcount_ignores_repeats(ledger, frame):
    lookup = frame("ueid string, fy string", ("E1", "2023-2024"), ("E1", "2023-2024"), ("E2", "2022-2023"))
    df = ledger({}, {"ueid": "E2"})
    assert rows(reports.non_classified_headcount(df, lookup)) == [("2023-2024", "051", "840", 1)]


def test_rollforward_agency_repeats_activity_per_june_row(ledger):
    df = ledger(
        {"leave_period": "2024-01", "leave_earned": "4"},
        {"end_balance": "10"},
        {"end_balance": "20", "position_number": "0521234567890"},
        {"end_balance": None, "cbid": "S02"},
    )
    found = reports.rollforward_agency(df).select(
        "agency_code", "cbid", "beginning_balance", "total_earned", "ending_balance"
    )
    assert rows(found) == [("051", "S01", 6.0, 4.0, 10.0), ("051", "S02", None, 4.0, None), ("052", "S01", 16.0, 4.0, 20.0)]


def test_rollforward_position_repeats_balances_on_pay_bands(ledger):
    df = ledger(
        {"leave_period": "2023-12", "leave_earned": "8", "end_balance": "8"},
        {"leave_period": "2024-05", "leave_used": "3", "hourly_rate": "12", "end_balance": "5"},
    )
    found = reports.rollforward_position(df, fy="2023-2024").select(
        "hourly_rate", "beginning_balance", "total_earned", "total_used", "ending_balance"
    )
    assert rows(found) == [("10", 0.0, 8.0, 0.0, 5.0), ("12", 0.0, 0.0, 3.0, 5.0)]
    assert reports.rollforward_position(df, fy="2022-2023").count() == 0


def test_rollforward_position_last_period_wins_and_ties_break_by_balance(ledger):
    df = ledger(
        {"leave_period": "2024-05", "end_balance": "9"}, {"end_balance": "3"}, {"end_balance": "4"},
    )
    assert reports.rollforward_position(df).select("ending_balance").distinct().collect()[0][0] == 4.0


def test_null_position_matches_nothing(ledger):
    df = ledger({"ueid": None, "end_balance": "5"})
    (row,) = reports.rollforward_position(df).collect()
    assert (row.beginning_balance, row.ending_balance) == (None, None)


def test_null_period_is_its_own_year(ledger):
    df = ledger({"leave_period": None, "end_balance": "7", "leave_earned": "2"})
    (row,) = reports.rollforward_position(df).collect()
    assert (row.fy, row.beginning_balance, row.total_earned, row.ending_balance) == ("-", 5.0, 2.0, 7.0)


def test_last_period_without_balance_counts(ledger):
    df = ledger({"leave_period": "2023-07", "end_balance": "7"}, {"leave_period": "2023-12", "end_balance": None})
    assert reports.rollforward_position(df).select("ending_balance").distinct().collect()[0][0] is None


def test_impossible_month_is_an_error(ledger):
    with pytest.raises(Exception, match="no month in period 2024-13"):
        reports.rollforward_position(ledger({"leave_period": "2024-13"})).collect()


def test_multi_position_list(ledger):
    df = ledger({}, {"position_number": "0001"}, {"ueid": "E2"})
    assert rows(A.with_year_label(A.multi_position_employees(A.with_report_columns(df)))) == [("E1", "2023-2024", 2, "0001, 0511234567890")]


def test_conservation_without_fan_out(ledger):
    changes = [
        {"ueid": f"E{e}", "leave_period": p, "leave_earned": "2", "leave_used": "0.5", "misc_amt": "-0.25", "end_balance": str(e)}
        for e, p in product(range(5), ["2023-08", "2024-06"])
    ]
    (row,) = reports.earned_used(ledger(*changes), fan_out=False).collect()
    assert row.beginning_balance + row.total_earned - row.total_used + row.total_misc == row.ending_balance


def test_reports_read_only_their_columns(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    ledger({}).write.partitionBy("leave_period").parquet(path)
    plan = reports.headcount(spark.read.parquet(path), ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ueid:string,position_number:string,org_code:string>" in plan
    assert "PartitionFilters: [isnotnull(leave_period" in plan


def test_scan_counts(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    ledger({}).write.parquet(path)
    df = spark.read.parquet(path)
    for report in (reports.leave_balance, reports.earned_used, reports.rollforward_agency, reports.liability):
        plan = report(df, ordered=False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1, report.__name__
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_the_position_report_reads_the_ledger_into_bands_once(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    ledger({}).write.parquet(path)
    plan = reports.rollforward_position(spark.read.parquet(path), ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert path not in plan and plan.count("/bands-") == plan.count("FileScan") == 2


def test_boundary_balances_come_from_one_read(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    ledger({}).write.parquet(path)
    plan = reports.july_begin_june_end(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert path not in plan and plan.count("/boundary-bands-") == plan.count("FileScan") == 3


def test_boundary_balances_of_a_position_with_most_rows(spark, ledger):
    july = [{"leave_period": "2023-07", "base_pay": str(i), "leave_earned": "1", "begin_balance": str(i % 2)} for i in range(300)]
    june = [{"leave_period": "2024-06", "base_pay": "0", "leave_earned": "2", "end_balance": b} for b in ("7", None)]
    few = [{"ueid": f"F{i}", "leave_period": "2023-09", "leave_earned": "3"} for i in range(100)]
    found = reports.july_begin_june_end(ledger(*july, *june, *few))
    # 300 bands, each with two beginnings and two endings; the first band holds the June rows too.
    hot = found.where("ueid not like 'F%'")
    assert hot.count() == 1200 and found.count() == 1300
    assert {tuple(r) for r in hot.select("beginning_balance", "ending_balance").distinct().collect()} == {
        ("0", "7"), ("1", "7"), ("0", None), ("1", None),
    }
    assert {r.base_pay: r.total_earned for r in hot.collect()} == {str(i): 5.0 if i == 0 else 1.0 for i in range(300)}
    assert found.where("ueid like 'F%' and beginning_balance is null and ending_balance is null and total_earned = 3").count() == 100


def test_numbered_rows_follow_the_report_order(ledger):
    df = ledger({}, {"leave_period": "2023-06"}, {"org_code": "90"}, {"org_code": "1000"}).withColumn("end_balance", F.lit("1"))
    found = reports.numbered(reports.liability(df, ordered=False), "liability").orderBy("row_no").collect()
    assert [(r.row_no, r.fy, r.org_code) for r in found] == [
        (1, "2023-2024", "0090"), (2, "2023-2024", "0840"), (3, "2023-2024", "1000"), (4, "2022-2023", "0840"),
    ]
    assert reports.numbered(reports.liability(df.limit(0), ordered=False), "liability").count() == 0


def _hot_ledger(ledger):
    """A position with most bands, small ones in several years, and NULLs in the position's keys."""
    hot = [{"base_pay": str(i % 50), "hourly_rate": str(i), "leave_period": f"2024-0{1 + i % 6}", "leave_earned": "1", "end_balance": str(i % 7)} for i in range(400)]
    hot += [{"base_pay": None, "department_name": None, "leave_used": "2"}, {"benefit_name": "A", "leave_period": "2024-06", "end_balance": None}]
    few = [{"ueid": f"F{i % 20}", "leave_period": f"20{10 + i % 9}-0{1 + i % 9}", "base_pay": str(i % 3), "leave_earned": str(i), "misc_amt": "1", "end_balance": str(i)} for i in range(200)]
    none = [{"ueid": None, "leave_earned": "3"}, {"benefit_id": None, "end_balance": "4"}, {"leave_period": None, "leave_earned": "5"}, {"hourly_rate": None}]
    return ledger(*hot, *few, *none)


@pytest.mark.parametrize("salted", [True, False])
def test_numbered_positions_equal_the_numbered_report(ledger, monkeypatch, salted):
    df = _hot_ledger(ledger)
    expected = reports.numbered(reports.rollforward_position(df, ordered=False), "rollforward_position")
    if not salted:
        monkeypatch.setattr(reports, "hot_salts", lambda *_: {})
    found = reports.numbered_rollforward_position(df)
    assert found.columns == expected.columns
    assert rows(found, "row_no") == rows(expected, "row_no") and found.count() > 500
    assert reports.numbered_rollforward_position(df.limit(0)).count() == 0


def test_numbered_positions_move_their_bands_once(ledger, tmp_path, monkeypatch):
    """The totals are taken where the ranges of the sort lie, and the bands are deleted."""
    plans = []
    monkeypatch.setattr("ledgerloom.session.shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(reports, "hot_salts", lambda *_: {})
    monkeypatch.setattr(reports, "with_places", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or with_places(df))
    reports.numbered_rollforward_position(_hot_ledger(ledger))
    (plan,) = plans
    assert plan.count("Exchange") == plan.count("rangepartitioning") == plan.count("FileScan") == 1
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["ranges"]


def test_columns_are_named_alike(ledger):
    assert reports.earned_used(ledger({})).columns == [
        "fy", "org_code", "cbid", "benefit_id", "benefit_name", "beginning_balance", "total_earned", "total_used",
        "total_misc", "ending_balance",
    ]


@pytest.mark.parametrize("report", [reports.earned_used, reports.liability, reports.rollforward_agency, reports.rollforward_position])
def test_numeric_measures_change_no_report(ledger, report):
    df = ledger(
        {"leave_period": "2023-09", "leave_earned": "4.25", "misc_amt": "-1"}, {"end_balance": "10.5", "hourly_rate": "12.5"},
        {"ueid": "E2", "end_balance": None},
    )
    assert rows(report(with_numeric_measures(df))) == rows(report(df))


def test_order_puts_late_years_first(ledger):
    df = ledger({}, {"leave_period": "2023-06"}, {"org_code": "90"}).withColumn("end_balance", F.lit("1"))
    found = [(r.fy, r.org_code) for r in reports.earned_used(df).collect()]
    assert found == [("2023-2024", "0090"), ("2023-2024", "0840"), ("2022-2023", "0840")]
