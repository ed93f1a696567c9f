"""Every registered query against its DuckDB text, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks import oracles
from checks import queries as registered
from checks.compare import database, difference

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(DATA)


def test_every_query_has_a_text():
    assert set(registered.queries()) == set(oracles.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_its_text(spark, con, name):
    assert difference(driver.queries()[name](spark, DATA), con, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
