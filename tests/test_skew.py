from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import journal, skew
from ledgerloom.operators import tables as T
from ledgerloom.operators import words as W
from ledgerloom.plans import page_tables
from ledgerloom.session import stage
from tests.conftest import rows


@pytest.fixture
def hot(spark):
    """Two thirds of the rows under one key."""
    return spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")


@pytest.mark.parametrize("how, expected", [("inner", 2001), ("left", 3000), ("left_semi", 2001), ("left_anti", 999)])
def test_salted_join_equals_a_plain_join(hot, frame, how, expected):
    lookup = frame("k string, v int", ("hot", 1), ("2", 2), ("none", 3))
    salted = skew.salted_join(hot, lookup, ["k"], how)
    plain = hot.join(lookup, ["k"], how)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain) and plain.count() == expected


def test_salted_join_spreads_the_hot_key(spark, hot, frame):
    lookup = frame("k string, v int", ("hot", 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = skew.salted_join(hot, lookup, ["k"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 4 and max(r["count"] for r in sizes) < 1200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookup_join_is_whole_on_both_sides_of_the_limit(hot, frame):
    lookup = stage(frame("k string, v int", ("hot", 1), ("2", 2)), "lookup")
    assert rows(skew.lookup_join(hot, lookup, ["k"], limit=1)) == rows(skew.lookup_join(hot, lookup, ["k"]))


def test_join_by_block(spark, frame):
    table_rows = spark.range(25).select(F.lit(1).alias("t"), F.col("id").alias("row_no")).union(
        spark.range(3).select(F.lit(2).alias("t"), F.col("id").alias("row_no"))
    )
    tables = frame("t int, nrows long, v string", (1, 25, "a"), (2, 3, "b"))
    found = skew.join_by_block(table_rows, tables, ["t"], 10)
    assert found.count() == 28 and found.filter("t = 1 and v = 'a'").count() == 25


def test_long_tables_keep_all_rows(spark, monkeypatch):
    """One table of many blocks between short ones, through the whole cleaning."""
    monkeypatch.setattr(T, "_ROW_SPAN", 7)
    cells = spark.range(200).select(
        F.when(F.col("id") < 180, 1).otherwise(F.col("id")).alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("grp"),
        F.lit(0).alias("cand"), F.col("id").alias("row_no"), F.lit(0).alias("col_no"), F.col("id").cast("string").alias("value"),
    )
    unified = T.unify_candidates(T.clean_tables(cells, [*T.TABLE, "cand"]))
    assert unified.count() == 200
    assert rows(unified.filter("doc = 1").select("row_no", F.col("values")[0]), "row_no") == [(i, str(i)) for i in range(180)]
    split = T.text_to_columns(cells.select("doc", "row_no", F.concat("value", F.lit("  x")).alias("value")), ["doc"])
    assert split.filter(F.size("values") == 2).count() == 200


@pytest.mark.parametrize("how, expected", [("inner", 2001), ("left", 3000), ("left_semi", 2001), ("left_anti", 999)])
def test_counted_join_equals_a_plain_join(spark, hot, frame, how, expected):
    lookup = frame("k string, v int", ("hot", 1), ("2", 2), ("none", 3))
    staged = stage(hot, "rows")
    assert set(skew.hot_salts(staged, ["k"]).values()) == {22}
    found, plain = skew.counted_join(staged, lookup, ["k"], how), hot.join(lookup, ["k"], how)
    assert found.columns == plain.columns
    assert rows(found) == rows(plain) and plain.count() == expected


def test_counted_join_without_adaptive_execution(spark):
    """One key with a third of the rows: no task above three times the median."""
    whole = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("a"), (F.col("id") % 2).alias("b")
    )
    lookup = whole.select("a", "b").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        staged = stage(whole, "rows")
        salts = skew.hot_salts(staged, ["a"])
        assert list(salts.values()) == [54]
        assert skew.hot_salts(staged.where("a >= 0"), ["a"]) == {} == skew.hot_salts(staged.limit(0), ["a"])
        sizes = skew.counted_join(staged, lookup, ["a", "b"]).groupBy(F.spark_partition_id()).count().collect()
        sizes = sorted(r["count"] for r in sizes)
        assert sum(sizes) == 60_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_counted_join_of_null_keys(spark, frame):
    left = stage(frame("k string, id int", (None, 1), ("x", 2), ("x", 3)), "rows")
    assert rows(skew.counted_join(left, frame("k string, v int", ("x", 1), (None, 2)), ["k"], "left")) == [
        ("x", 2, 1), ("x", 3, 1), (None, 1, None),
    ]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_that_grow_are_never_broadcast(spark, frame, monkeypatch):
    """Spark takes these small tables for a broadcast, as it takes large ones that are stored small."""
    monkeypatch.setattr(skew.lookup_join, "__defaults__", (None, 0))
    word = ("a string, doc long, page int, x0 double, x1 double, top double, bottom double, txt string",)
    words = stage(
        frame(*word, ("", 1, 1, 10.0, 30.0, 10.0, 20.0, "2024-25"), ("", 1, 1, 12.0, 32.0, 50.0, 60.0, "$7")), "words"
    )
    assert "BroadcastHashJoin" not in _plan(W.matched_columns(words))
    areas = W.column_areas(words)
    assert "BroadcastHashJoin" not in _plan(areas) and areas.count() == 1

    cells = frame("doc int, page int, grp int, cand int, row_no long, col_no int, value string", (1, 1, 1, 0, 0, 0, "a"))
    for df in (T.clean_tables(cells, [*T.TABLE, "cand"]), page_tables.document_tables(cells), T.review_flags(page_tables.document_tables(cells))):
        assert "BroadcastHashJoin" not in _plan(df)

    sheet = frame("file string, sheet string, rw long, cl int, val string", ("f", "s", 9, 1, "Debit/Credit"), ("f", "s", 10, 1, "Dr 1 a"))
    journals = journal.journal_rows(sheet)
    assert "BroadcastHashJoin" not in _plan(journals) and journals.count() == 1
