"""Block scans against plain Python, with blocks far smaller than the groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import blocks as B

SPAN = 4


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    hot = [("hot", n, rng.choice([None, None, None, n])) for n in rng.sample(range(-60, 200), 120)]
    cold = [(f"g{g}", n, rng.choice([None, n])) for g in range(15) for n in rng.sample(range(30), 5)]
    return hot + cold + [("one", 3, None), (None, 1, 5), (None, 9, None)]


@pytest.fixture(scope="module")
def df(frame, data):
    return frame("k string, n int, v int", *data)


def groups(data):
    found = {}
    for k, n, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        found.setdefault(k, []).append((n, v))
    return found


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_forward_fill(df, data):
    expected = set()
    for k, rows in groups(data).items():
        last = None
        for n, v in rows:
            last = last if v is None else v
            expected.add((k, n, last))
    expected_null_group = {(k, n, v) for k, n, v in expected if k is not None}
    found = as_set(B.forward_fill(df, ["k"], ["n"], "v", "f", SPAN), "k", "n", "f")
    assert found == expected and expected_null_group < expected


@pytest.mark.parametrize("span", [SPAN, None])
def test_nearest_both_ways(df, data, span):
    expected = set()
    for k, rows in groups(data).items():
        for n, _ in rows:
            before = [v for m, v in rows if m <= n and v is not None]
            after = [v for m, v in rows if m >= n and v is not None]
            expected.add((k, n, before[-1] if before else None, after[0] if after else None))
    found = as_set(B.nearest_both_ways(df, ["k"], ["n"], ["v"], span), "k", "n", "before_v", "after_v")
    assert found == expected


def test_running_sum_and_row_numbers(df, data):
    sums, numbers = set(), set()
    for k, rows in groups(data).items():
        total = 0
        for i, (n, v) in enumerate(rows, 1):
            total += v or 0
            sums.add((k, n, total))
            numbers.add((k, n, i))
    amount = F.coalesce("v", F.lit(0))
    assert as_set(B.running_sum(df, ["k"], ["n"], amount, "s", SPAN), "k", "n", "s") == sums
    assert as_set(B.row_numbers(df, ["k"], ["n"], "i", SPAN), "k", "n", "i") == numbers


def test_previous_value_keeps_nulls(df, data):
    expected = {
        (k, n, rows[i - 1][1] if i else None) for k, rows in groups(data).items() for i, (n, _) in enumerate(rows)
    }
    assert as_set(B.previous_value(df, ["k"], ["n"], "v", "p", SPAN), "k", "n", "p") == expected


def test_columns_of_the_input_stay(df):
    assert B.row_numbers(df, ["k"], ["n"], "i", SPAN).columns == ["k", "n", "v", "i"]
