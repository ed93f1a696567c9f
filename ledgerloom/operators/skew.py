"""Joins whose left side may hold most of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16

# Rows times columns up to which a lookup is broadcast: a value of a nested row takes 70 bytes and more.
BROADCAST_VALUES = 100_000


def unbroadcast(table: DataFrame) -> DataFrame:
    """``table`` marked to be joined by a shuffle.

    Spark judges a table by the bytes of its files. A staged table is stored many times
    smaller than its rows are in memory, so one that grows with the input would be
    sent whole to the driver and to every task.
    """
    return table.hint("merge")


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with every key spread over ``salts`` tasks, however many rows share it.

    ``lookup`` is repeated per salt, so it should have one short row per key. Any salt
    finds its row: results do not depend on how rows are dealt out.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    repeated = lookup.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return dealt.join(unbroadcast(repeated), [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    rows: DataFrame,
    staged_lookup: DataFrame,
    keys: list[str],
    values: Column | None = None,
    limit: int = BROADCAST_VALUES,
) -> DataFrame:
    """Inner join with a staged lookup: broadcast up to ``limit`` counted values, beyond it spread by counts.

    ``values`` is how many values a lookup row holds, if not just one per column. Runs jobs when called.
    """
    per_row = F.lit(len(staged_lookup.columns)) if values is None else values
    counted = staged_lookup.agg(F.sum(per_row)).first()[0] or 0
    return rows.join(F.broadcast(staged_lookup), keys) if counted <= limit else counted_join(rows, unbroadcast(staged_lookup), keys)


def join_by_block(rows: DataFrame, tables: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Join the rows of tables with one record per table holding its ``nrows``.

    Rows are numbered from 0 in ``row_no``. A record is repeated once per ``span`` rows of
    its table, so a long table spreads over tasks and a short one is not repeated.
    """
    last = F.expr(f"(nrows - 1) div {span}")
    repeated = tables.withColumn("_block", F.explode(F.sequence(F.expr("0L"), last)))
    blocked = rows.withColumn("_block", F.expr(f"row_no div {span}"))
    return blocked.join(unbroadcast(repeated), [*keys, "_block"]).drop("_block")


# Keys that the heavy-hitter sketch reports, and keys that it keeps count of.
HOT_KEYS, TRACKED_KEYS = 100, 10_000
# Salts an even task's rows are cut into: they are dealt by hash, and small ones even out.
SALTS_PER_TASK = 4


def hot_salts(rows: DataFrame, keys: list[str], partitions: int | None = None) -> dict[int, int]:
    """Hash of each key with more rows than an even task holds -> number of salts, from its rows.

    The counts come from a heavy-hitter sketch, one small aggregate buffer a task, so keys
    of any number cost one scan of ``keys`` and no shuffle of them. At most ``partitions``
    keys can be hot; with more than ``HOT_KEYS`` of them none holds over a hundredth of the
    rows. Runs a job when called: ``rows`` should be a staged table.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k({_key_hash(keys)}, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"),
    ).first()
    even = max(1, found.n / partitions)
    return {t["item"]: -int(-t["count"] * SALTS_PER_TASK // even) for t in found.top or [] if t["count"] > even}


def _key_hash(keys: list[str]) -> str:
    return "xxhash64(" + ", ".join(f"`{k}`" for k in keys) + ")"


def is_hot(keys: list[str], salts: dict[int, int]) -> Column:
    """Whether a row's key is one of :func:`hot_salts`."""
    return F.expr(_key_hash(keys)).isin(list(salts)) if salts else F.lit(False)


def counted_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", salts: dict[int, int] | None = None
) -> DataFrame:
    """Join that spreads each hot key of ``rows`` over tasks by the number of its rows.

    Only the lookup rows of hot keys are repeated, once per salt; other keys join as usual.
    ``how`` may be inner, left, left_semi or left_anti. Another salt or a collision of key
    hashes costs rows in the shuffle and never changes the result.
    """
    salts = hot_salts(rows, keys) if salts is None else salts
    if not salts:
        return rows.join(lookup, keys, how)
    table = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
    width = F.coalesce(F.try_element_at(table, F.expr(_key_hash(keys))), F.lit(1))
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), width))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), width.cast("long") - 1)))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
