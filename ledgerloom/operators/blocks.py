"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into blocks of a
fixed span of its order column; a small roll-up per block gives every block the state it
starts from, and that state enters the block's own window as one extra seed row. The
rows are shuffled once, by group and block, so a huge group spreads over many tasks.

``order[0]`` must be numeric, with a bounded number of rows per ``span``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ROWS_PER_BLOCK = 1_000_000


def block_of(order: Column, span: float) -> Column:
    return F.floor(order / F.lit(span))


def _blocked(df: DataFrame, order: list[str], span: float) -> DataFrame:
    return df.withColumn("_block", block_of(F.col(order[0]), span))


def _in_block(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy("_seed", *order)


def _scan(rows: DataFrame, seeds: DataFrame, values: dict[str, Column], *helpers: str) -> DataFrame:
    """Evaluate window ``values`` over the blocks with their seed rows, then drop the seeds and helpers.

    ``_seed`` is negative for a row that leads its block and positive for one that ends it.
    """
    both = rows.withColumn("_seed", F.lit(0)).unionByName(seeds, allowMissingColumns=True)
    return both.withColumns(values).filter("_seed = 0").drop("_seed", *helpers)


def _earlier(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _later(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)


def _up_to_here(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def forward_fill(
    df: DataFrame, keys: list[str], order: list[str], column: str, out: str, span: float = ROWS_PER_BLOCK
) -> DataFrame:
    """Last non-NULL ``column`` at or before each row of its group."""
    rows = _blocked(df, order, span).withColumn("_fill", F.col(column))
    position = F.when(F.col("_fill").isNotNull(), F.struct(*order))
    seeds = (
        rows.groupBy(*keys, "_block")
        .agg(F.max_by("_fill", position).alias("_fill"))
        .withColumn("_fill", F.last("_fill", ignorenulls=True).over(_earlier(keys)))
        .filter("_fill is not null")
        .withColumn("_seed", F.lit(-1))
    )
    filled = F.last("_fill", ignorenulls=True).over(_up_to_here(_in_block(keys, order)))
    return _scan(rows, seeds, {out: filled}, "_fill", "_block")


def nearest_both_ways(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], span: float | None = ROWS_PER_BLOCK
) -> DataFrame:
    """``columns`` of the nearest filled row at or before, and at or after, each row of its group.

    They come as ``before_…`` and ``after_…``. A row is filled when the first of
    ``columns`` is not NULL; filled rows differ in ``order[0]``. Without ``span`` a group
    is one block, for groups whose length was checked.
    """
    fills = [f"_fill_{c}" for c in columns]
    if span is None:
        rows = df.withColumns({"_block": F.lit(0), "_seed": F.lit(0)})
        return rows.withColumns(_both_fills(keys, order, columns, columns)).drop("_block", "_seed")
    rows = _blocked(df, order, span).withColumns({f: F.col(c) for f, c in zip(fills, columns)})
    position = F.when(F.col(columns[0]).isNotNull(), F.col(order[0]))
    first, last = [f"first{f}" for f in fills], [f"last{f}" for f in fills]
    ends = (
        rows.groupBy(*keys, "_block")
        .agg(
            *[F.min_by(f, position).alias(n) for f, n in zip(fills, first)],
            *[F.max_by(f, position).alias(n) for f, n in zip(fills, last)],
        )
        .select(
            *keys,
            "_block",
            *[F.last(n, ignorenulls=True).over(_earlier(keys)).alias(n) for n in last],
            *[F.last(n, ignorenulls=True).over(_later(keys)).alias(n) for n in first],
        )
    )
    seeds = ends.select(
        *keys,
        "_block",
        F.inline(
            F.array(
                F.struct(F.lit(-1).alias("_seed"), *[F.col(n).alias(f) for f, n in zip(fills, last)]),
                F.struct(F.lit(1).alias("_seed"), *[F.col(n).alias(f) for f, n in zip(fills, first)]),
            )
        ),
    ).filter(F.col(fills[0]).isNotNull())
    return _scan(rows, seeds, _both_fills(keys, order, columns, fills), *fills, "_block")


def _both_fills(keys: list[str], order: list[str], columns: list[str], fills: list[str]) -> dict[str, Column]:
    """Both directions run up to the current row; a frame from there to the end is quadratic."""
    forwards = _up_to_here(_in_block(keys, order))
    backwards = _up_to_here(
        Window.partitionBy(*keys, "_block").orderBy(F.desc("_seed"), *[F.desc(c) for c in order])
    )
    values = {}
    for f, c in zip(fills, columns):
        values[f"before_{c}"] = F.last(f, ignorenulls=True).over(forwards)
        values[f"after_{c}"] = F.last(f, ignorenulls=True).over(backwards)
    return values


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    amount: Column,
    out: str,
    span: float = ROWS_PER_BLOCK,
    keep_block: bool = False,
) -> DataFrame:
    """Sum of ``amount`` up to and including each row of its group."""
    rows = _blocked(df, order, span).withColumn("_amount", amount)
    seeds = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_amount").alias("_amount"))
        .withColumn("_amount", F.sum("_amount").over(_earlier(keys)))
        .filter("_amount is not null")
        .withColumn("_seed", F.lit(-1))
    )
    values = {out: F.sum("_amount").over(_up_to_here(_in_block(keys, order)))}
    return _scan(rows, seeds, values, "_amount", *([] if keep_block else ["_block"]))


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str,
    span: float = ROWS_PER_BLOCK,
    keep_block: bool = False,
) -> DataFrame:
    """Position of each row in its group, from 1.

    With ``keep_block`` the row's block stays as ``_block``; the result is partitioned by
    ``keys`` and ``_block``, so a join on them moves no rows.
    """
    return running_sum(df, keys, order, F.lit(1), out, span, keep_block)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], column: str, out: str, span: float = ROWS_PER_BLOCK
) -> DataFrame:
    """``column`` of the row before, NULL on the first row of a group."""
    rows = _blocked(df, order, span).withColumn("_value", F.struct(F.col(column).alias("v")))
    seeds = (
        rows.groupBy(*keys, "_block")
        .agg(F.max_by("_value", F.struct(*order)).alias("_value"))
        .withColumn("_value", F.last("_value").over(_earlier(keys)))
        .filter("_value is not null")
        .withColumn("_seed", F.lit(-1))
    )
    before = F.lag("_value").over(_in_block(keys, order))["v"]
    return _scan(rows, seeds, {out: before}, "_value", "_block")
