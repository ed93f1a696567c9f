from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import local_session

    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("a int, b string", (1, "x"), …)``"""

    def build(schema: str, *rows: tuple):
        return spark.createDataFrame(list(rows), schema)

    return build


def rows(df, *order: str) -> list[tuple]:
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]
