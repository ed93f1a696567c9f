"""Sharding along a Hilbert curve, so that a shard covers little of every metadata column.

Each metadata column is quantised into cells of even row counts, the cells' places give
an index on the Hilbert curve, and the rows in the order of the index are cut into runs of
even length. Rows near on the curve are near in all columns at once, so filters on any of
them leave out most shards by their least and greatest values.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from ..sources.sinks import number_rows

SHARDS = 16
BITS = 5
# Name of the text's size among the metadata.
SIZE = "(size)"
COLUMNS = ("lang", "source", SIZE)
_POSITION_BITS = 33


def _curve(places: list[np.ndarray], bits: int) -> np.ndarray:
    """Index of each cell on the curve, by Skilling's transform of its coordinates.

    Bits are taken from the highest on: a cell's half of each column says which way its part
    of the curve is turned, and undoing the turns leaves a Gray code.
    """
    axes = [np.array(p, np.int64) for p in places]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in axes:
            upper = (axis >> bit & 1) == 1
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(upper, below, swap)
            if axis is not axes[0]:
                axis ^= swap
    for before, axis in zip(axes, axes[1:]):
        axis ^= before
    turned = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    index = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            index = index << 1 | (axis ^ turned) >> bit & 1
    return index


def hilbert_index(places: list[Column], bits: int) -> Column:
    """Place of each cell on the Hilbert curve through all cells; ``places`` are whole numbers below 2 ** ``bits``."""

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(_curve([cells[c].to_numpy() for c in cells.columns], bits))

    return curve(F.struct(*[p.cast("int").alias(f"p{i}") for i, p in enumerate(places)]))


def cell_bounds(df: DataFrame, column: str, cells: int) -> list[tuple[int, object]]:
    """Number and least value of the filled cells of ``column`` but number 0; cells hold even numbers of rows.

    Each value is counted once, over all rows; the values are sorted by range and summed up
    range by range, and at most one bound per cell reaches the driver. A value is never
    parted, so one with many rows fills its cell alone. Null takes no part.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id())
    ranged = stage(ranged, "values").withColumn("part", F.shiftright("at", _POSITION_BITS))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    total = parts.agg(F.sum("rows")).first()[0] or 0
    in_part = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # One short row per range of the sort above.
    placed = ranged.join(F.broadcast(parts), "part").withColumn("above", F.coalesce(F.sum("n").over(in_part), F.lit(0)) + F.col("before"))
    cell = F.floor(F.col("above") * cells / F.lit(max(1, total)))
    bounds = placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).where("cell > 0")
    return [(r.cell, r.value) for r in bounds.orderBy("cell").collect()]


def _place(column: str, bounds: list[tuple[int, object]]) -> Column:
    """Number of the cell; null lies in the first."""
    before = [0, *[cell for cell, _ in bounds]]
    passed = [F.when(F.col(column) >= F.lit(b), cell - last).otherwise(0) for last, (cell, b) in zip(before, bounds)]
    return F.coalesce(reduce(lambda a, b: a + b, passed, F.lit(0)), F.lit(0))


def assign_shards(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    shards: int = SHARDS,
    bits: int = BITS,
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``row`` (a struct of the columns to ``carry``), ``size, text_crc32, curve, shard, slot`` and ``meta``, the metadata.

    Shards are runs of the curve's order whose row counts differ by one at most; ``slot``
    counts from 0 inside a shard. Rows of one curve index follow each other by checksum of
    the text, then by doc_id, so equal texts with equal metadata stand together; rows alike
    in all keep an order of their own. ``size`` is the text's bytes in UTF-8 plus one and may
    be one of the ``columns``, as ``SIZE``. Null texts are empty, nulls in metadata lie in
    the first cell; a text moves only if it is carried. Runs jobs when called.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = stage(
        docs.select(
            F.struct(*carry).alias("row"),
            F.col("doc_id").alias("doc"),
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.struct(*[(size if c == SIZE else F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).alias("meta"),
        ),
        "metadata",
    )
    metadata = [f"meta.m{i}" for i in range(len(columns))]
    places = [_place(c, cell_bounds(rows, c, 1 << bits)) for c in metadata]
    rows = rows.withColumn("curve", hilbert_index(places, bits))
    total = rows.count()
    numbered = number_rows(rows, [F.asc("curve"), F.asc("text_crc32"), F.asc("doc")])
    shard = F.expr(f"(row_no - 1) * {shards} div {max(1, total)}")
    before = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return numbered.withColumn("shard", shard.cast("int")).select(
        "row", "size", "text_crc32", "curve", "shard", (F.col("row_no") - 1 - before).cast("long").alias("slot"), "meta"
    )


def write_shards(
    docs: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, shards: int = SHARDS, bits: int = BITS, file_rows: int = 0
) -> None:
    """Writes whole rows as ``<path>/rows/shard=…`` and the least and greatest metadata of each shard as ``<path>/bounds``.

    A task's rows follow each other on the curve, so it writes few shards. Files hold at
    most ``file_rows`` rows if that is not 0.
    """
    placed = assign_shards(docs, columns, shards, bits, tuple(docs.columns))
    placed = placed.select("shard", "slot", "row", "meta")
    placed.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(f"{path}/rows")
    written = docs.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    ends = [f(F.col(f"meta.m{i}")).alias(f"{n}{i}") for i in range(len(columns)) for f, n in ((F.min, "low"), (F.max, "high"))]
    nulls = [F.bool_or(F.col(f"meta.m{i}").isNull()).alias(f"null{i}") for i in range(len(columns))]
    names = F.array(*[F.lit(c) for c in columns]).alias("columns")
    bounds = written.groupBy("shard").agg(F.count("*").alias("rows"), *ends, *nulls).withColumn("columns", names)
    bounds.coalesce(1).write.parquet(f"{path}/bounds")
    docs.limit(0).coalesce(1).write.parquet(f"{path}/none")


def shards_within(spark: SparkSession, path: str, where: dict[str, tuple]) -> tuple[list[int], dict[int, tuple]]:
    """Shards that can hold rows between the given ends, and the ends by number of the column; one short row per shard is read."""
    found = spark.read.parquet(f"{path}/bounds").collect()
    wanted = {found[0]["columns"].index(c): ends for c, ends in where.items()}
    return [r.shard for r in found if all(_overlaps(r[f"low{i}"], r[f"high{i}"], ends) for i, ends in wanted.items())], wanted


def read_shards(spark: SparkSession, path: str, where: dict[str, tuple] | None = None) -> DataFrame:
    """Rows whose metadata lie between the given ends; other shards' files are not opened."""
    if spark.read.parquet(f"{path}/bounds").isEmpty():
        return spark.read.parquet(f"{path}/none")
    rows = spark.read.parquet(f"{path}/rows")
    hit, wanted = shards_within(spark, path, where or {})
    if where:
        rows = rows.where(F.col("shard").isin(hit))
    for i, (low, high) in wanted.items():
        rows = rows.where(F.col(f"meta.m{i}").between(low, high))
    return rows.select("row.*")


def _overlaps(low, high, ends: tuple) -> bool:
    return low is not None and low <= ends[1] and high >= ends[0]
