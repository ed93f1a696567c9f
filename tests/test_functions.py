from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ledger as L
from ledgerloom.functions import text as X
from ledgerloom.operators import filters as P
from tests.conftest import rows


def values(frame, kind, column, *inputs):
    df = frame(f"i int, c {kind}", *enumerate(inputs))
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_fiscal_year(frame):
    assert values(frame, "string", L.fiscal_year, "2024-06", "2024-07", "2024-12", "2025-01", None) == [
        "2023-2024", "2024-2025", "2024-2025", "2024-2025", "-",
    ]


def test_fiscal_year_from_label_is_late_for_june(frame):
    assert values(frame, "string", L.fiscal_year_from_label, "2024-07", "2025-06") == ["2024-2025", "2025-2026"]


def test_position_padding_leaves_other_lengths(frame):
    inputs = ["1" * n for n in (9, 10, 11, 12, 13, 14)]
    assert values(frame, "string", L.full_position_number, *inputs) == [
        "1" * 9, "000" + "1" * 10, "00" + "1" * 11, "0" + "1" * 12, "1" * 13, "1" * 14,
    ]


def test_agency_code_padded_and_raw(frame):
    assert values(frame, "string", L.agency_code, "51123456789") == ["005"]
    assert values(frame, "string", lambda c: L.agency_code(c, padded=False), "51123456789") == ["511"]


def test_org_code_display(frame):
    assert values(frame, "string", L.org_code_display, "840", "0840", "8400") == ["0840", "0840", "8400"]


def test_quarter_rounding_goes_away_from_zero(frame):
    assert values(frame, "double", L.to_quarter_hours, 0.125, 0.124, -0.125) == [0.25, 0.0, -0.25]


def test_cents(frame):
    assert values(frame, "double", L.to_cents, 1.234, 2.5) == [1.23, 2.5]


def test_beginning_balance(frame):
    df = frame("i int, m double", (0, -2.0), (1, 2.0), (2, None))
    begin = L.beginning_balance(F.lit(10.0), F.lit(4.0), F.lit(3.0), F.col("m"))
    assert [r[0] for r in df.orderBy("i").select(begin).collect()] == [11.0, 7.0, 9.0]


def test_safe_ratio(frame):
    df = frame("a double, b double", (1.0, 0.0))
    assert df.select(L.safe_ratio(F.col("a"), F.col("b"))).first()[0] is None


def test_strict_number_raises_and_lenient_does_not(frame):
    assert values(frame, "string", L.number_or_null, "1.5", "x", None) == [1.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(frame, "string", L.number, "x")


def test_period_date(frame):
    (found,) = values(frame, "string", L.period_date, "2024-06")
    assert str(found) == "2024-06-01 00:00:00"


def test_time_base_filters(frame):
    df = frame("t string", ("FT",), ("??",), ("INT",), (None,), ("",))
    assert rows(df.filter(P.known_time_base(F.col("t")))) == [("",), ("FT",), ("INT",)]
    assert rows(df.filter(P.known_time_base(F.col("t"), True))) == [("",), ("FT",)]


def test_agency_exclusion(frame):
    df = frame("p string", ("0511234567890",), ("0011234567890",), ("11234567890",), ("3131234567890",), (None,))
    assert rows(df.filter(P.reported_agency(F.col("p")))) == [("0511234567890",)]
    assert rows(df.filter(P.reported_agency(F.col("p"), padded=False))) == [("0511234567890",), ("11234567890",)]


@pytest.mark.parametrize("period, inside", [("2022-06", False), ("2022-07", True), ("2023-06", True), ("2023-07", False)])
def test_in_fiscal_year(frame, period, inside):
    assert (frame("p string", (period,)).filter(P.in_fiscal_year(F.col("p"), "2022-2023")).count() == 1) is inside


def test_strip_and_clean(frame):
    assert values(frame, "string", X.clean_cell, "  a b \t", None, "\n") == ["a b", "", ""]


def test_safe_sheet_name(frame):
    assert values(frame, "string", X.safe_sheet_name, "a/b[c]:d*?\\" + "x" * 40) == ["a_b_c__d___" + "x" * 20]


def test_agency_from_file(frame):
    assert values(frame, "string", X.agency_from_file, "detail 0855.pdf") == ["0855"]
