"""Ledger columns, headings and fixed report parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Headings of the monthly ledger files -> column names used here.
HEADINGS = {
    "UEID": "ueid",
    "Leave Period": "leave_period",
    "Position Number": "position_number",
    "CFIS/ORG Code": "org_code",
    "CBID": "cbid",
    "Time Base": "time_base",
    "Department Name": "department_name",
    "Leave Benefit ID": "benefit_id",
    "Leave Benefit Name": "benefit_name",
    "Base Pay": "base_pay",
    "Hourly Rate": "hourly_rate",
    "Leave Earned": "leave_earned",
    "Leave Used": "leave_used",
    "Misc Amt": "misc_amt",
    "Begin Balance": "begin_balance",
    "End Balance": "end_balance",
    "source_file": "source_file",
}

# Sentinels of the time base.
UNKNOWN_TIME_BASE = "??"
INTERMITTENT_TIME_BASE = "INT"

# Agencies left out of the leave reports.
EXCLUDED_AGENCIES = (
    "001", "002", "003", "004", "007", "012", "019", "035", "063", "275", "276", "294",
    "298", "313", "320", "321", "323", "324", "339", "341", "345", "358", "402", "532",
    "693", "801", "815", "823",
)

# Limits of the CSV outputs and of the CSV check.
MAX_ROWS_PER_PART = 1_045_000
EXPECTED_COMMAS = 17
MAX_SOURCE_FILE_LENGTH = 255
MAX_PREVIEW_LINES = 20
HEADER_ROW = 6

LEDGER = T.StructType([T.StructField(c, T.StringType()) for c in HEADINGS.values()])
NON_CLASSIFIED = T.StructType([T.StructField("ueid", T.StringType()), T.StructField("fy", T.StringType())])


# Measures; base pay and hourly rate stay text, since reports group by them as written.
MEASURES = ("leave_earned", "leave_used", "misc_amt", "begin_balance", "end_balance")


def with_numeric_measures(ledger: DataFrame) -> DataFrame:
    """Measures as numbers, so that a saved ledger is not parsed again by every report.

    Text that is no number raises under ANSI mode.
    """
    return ledger.withColumns({c: ledger[c].cast("double") for c in MEASURES if c in ledger.columns})


def with_canonical_names(df: DataFrame) -> DataFrame:
    """Rename known headings; other columns keep their names."""
    return df.withColumnsRenamed({h: c for h, c in HEADINGS.items() if h in df.columns})
