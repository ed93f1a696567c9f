"""Tables found on pages: cleaning, choosing, filtering, de-duplicating, assembling.

``cells(doc, page, grp, cand, row_no, col_no, value)`` is turned into table rows
``(…, row_no, values ARRAY<STRING>)``; a record is one row of a table, never a whole
table, so tables and pages may have any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_cell, strip
from ..session import stage
from .blocks import block_of, previous_value, row_numbers, running_sum
from .skew import counted_join, hot_salts, join_by_block, unbroadcast

# Limits of the table filters and of near duplicates, the reviewed cell.
MIN_ROWS, MIN_COLUMNS, MIN_CELLS = 2, 2, 2
SHORT_FIRST_COLUMN, FIRST_COLUMN_SHARE, DOLLAR_SHARE = 2, 0.2, 0.8
NEAR_DUPLICATE = 0.95
REVIEW_ROW, REVIEW_COLUMN = 5, 3

# Where single-column texts are split.
# White space and digits are Unicode's, with the four separators that Java leaves out.
COLUMN_GAP = r"(?U)[\s\x1c-\x1f]{2,}"
COLUMN_GAP_OR_NUMBER = r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f](?=\$?\d)"

TABLE = ["doc", "page", "grp"]

# Rows or pages per block of an ordered scan, and vectors compared at a time per page.
_ROW_SPAN = 100_000
_PAGE_SPAN = 1_000
_VECTOR_BLOCK = 256


def clean_tables(cells: DataFrame, keys: list[str], labels: bool = False) -> DataFrame:
    """Cleaned cells as rows; empty rows and columns are dropped and the rest renumbered from 0.

    With ``labels`` the numbers that a table's columns had before stay, as ``columns``.

    Cells meet by row and are written once; numbering the rows and listing a table's
    columns then read only what they need.
    """
    rows = stage(
        cells.withColumn("value", clean_cell(F.col("value")))
        .filter("value <> ''")
        .groupBy(*keys, "row_no")
        .agg(F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("cells")),
        "table-rows",
    )
    columns = (
        rows.select(*keys, _block(), F.explode(F.map_keys("cells")).alias("col_no"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("col_no")).alias("columns"), *_block_range())
    )
    return (
        row_numbers(rows, keys, ["row_no"], "n", _ROW_SPAN, keep_block=True)
        .join(unbroadcast(_in_every_block(columns)), [*keys, "_block"])
        .select(
            *keys,
            (F.col("n") - 1).alias("row_no"),
            F.transform("columns", lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(""))).alias("values"),
            *(["columns"] if labels else []),
        )
    )


def _block() -> Column:
    return block_of(F.col("row_no"), _ROW_SPAN).alias("_block")


def _block_range() -> list[Column]:
    return [F.min("_block").alias("first_block"), F.max("_block").alias("last_block")]


def _in_every_block(tables: DataFrame) -> DataFrame:
    """Repeat a table's record for each block of its rows, so that long tables join in many tasks."""
    blocks = F.explode(F.sequence("first_block", "last_block"))
    return tables.withColumn("_block", blocks).drop("first_block", "last_block")


def _filled(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v != ""))


def unify_candidates(rows: DataFrame) -> DataFrame:
    """Candidates with as many columns as the best one, put below each other by column label, best first.

    A candidate scores its filled cells plus two per column. ``columns`` holds the labels of
    a row's values; without it they are the places. Labels stand in the order in which the
    candidates bring them, so candidates with other labels widen the table.
    """
    if "columns" not in rows.columns:
        rows = rows.withColumn("columns", F.transform("values", lambda _, i: i))
    shape = rows.groupBy(*TABLE, "cand").agg(
        F.count("*").alias("nrows"),
        F.max(F.size("values")).alias("ncols"),
        F.sum(_filled(F.col("values"))).alias("filled"),
        F.first("columns").alias("columns"),
    )
    best_first = Window.partitionBy(*TABLE).orderBy(F.desc("score"), "cand")
    kept = (
        shape.withColumn("score", F.col("filled") + 2 * F.col("ncols"))
        .withColumn("best_ncols", F.first("ncols").over(best_first))
        .filter("ncols = best_ncols")
        .withColumn("above", F.sum("nrows").over(best_first) - F.col("nrows"))
    )
    # All labels of a table: those of its candidates one after the other, each once.
    whole = Window.partitionBy(*TABLE).orderBy(F.desc("score"), "cand").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = kept.withColumn("labels", F.array_distinct(F.flatten(F.collect_list("columns").over(whole))))
    kept = kept.select(*TABLE, "cand", "nrows", "above", "columns", "labels")
    place = F.transform("labels", lambda label: F.nullif(F.array_position("columns", label), F.lit(0)) - 1)
    kept = kept.withColumn("places", place).drop("columns", "labels")
    return join_by_block(rows.drop("columns"), kept, [*TABLE, "cand"], _ROW_SPAN).select(
        *TABLE,
        (F.col("above") + F.col("row_no")).alias("row_no"),
        F.transform("places", lambda i: F.coalesce(F.get("values", i.cast("int")), F.lit(""))).alias("values"),
    )


def table_stats(rows: DataFrame) -> DataFrame:
    """One record per table: shape, filled cells, filter figures and a content fingerprint.

    The fingerprint combines two 64-bit hashes of every numbered row; it needs no table
    in one place and no row order.
    """
    values = F.col("values")
    text = F.array_join("values", "|")

    def fingerprint(seed: int) -> Column:
        return F.bit_xor(F.xxhash64(F.lit(seed), "row_no", text))

    return rows.groupBy(*TABLE).agg(
        F.count("*").alias("nrows"),
        F.max(F.size("values")).alias("ncols"),
        F.sum(_filled(values)).alias("filled"),
        F.count_if(values[0] != "").alias("first_column_filled"),
        F.bool_or(F.exists("values", lambda v: v.rlike("[A-Za-z]"))).alias("has_letter"),
        F.sum(F.size(F.filter("values", lambda v: v.rlike(r"\$\d")))).alias("dollar_cells"),
        F.struct(F.count("*").alias("n"), fingerprint(1).alias("a"), fingerprint(2).alias("b")).alias("fingerprint"),
    )


def is_incomplete() -> Column:
    return F.expr(f"nrows < {MIN_ROWS} or ncols < {MIN_COLUMNS} or filled < {MIN_CELLS}")


def is_junk() -> Column:
    return (
        (F.col("first_column_filled") <= SHORT_FIRST_COLUMN)
        | (F.col("first_column_filled") < FIRST_COLUMN_SHARE * F.col("nrows"))
        | ~F.col("has_letter")
        | (F.col("dollar_cells") > DOLLAR_SHARE * F.col("nrows") * F.col("ncols"))
    )


def drop_exact_duplicates(stats: DataFrame) -> DataFrame:
    """First table of each content on a page."""
    others = [c for c in stats.columns if c not in ("doc", "page", "fingerprint", "grp")]
    first = F.min_by(F.struct("grp", *others), "grp")
    return (
        stats.groupBy("doc", "page", "fingerprint")
        .agg(first.alias("first"))
        .select("doc", "page", "fingerprint", "first.*")
    )


def drop_consecutive_duplicates(stats: DataFrame) -> DataFrame:
    """Drop tables equal to the one kept before in the document."""
    return (
        previous_value(stats, ["doc"], ["page", "grp"], "fingerprint", "before", _PAGE_SPAN)
        .filter(~F.col("fingerprint").eqNullSafe(F.col("before")))
        .drop("before")
    )


def _unit(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: F.try_divide(x, norm))


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _near_any(unit: Column, kept: Column, threshold: float) -> Column:
    return F.coalesce(F.exists(kept, lambda k: _cosine(k["unit"], unit) > threshold), F.lit(False))


def _greedy(block: DataFrame, keys: list[str], order: str, threshold: float) -> DataFrame:
    """Vectors of a short block that are near none accepted before them, as array ``kept``."""
    listed = block.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("ord"), "unit"))).alias("v")
    )
    entry = listed.schema["v"].dataType.elementType.simpleString()
    accepted = F.aggregate(
        "v",
        F.array().cast(f"array<{entry}>"),
        lambda kept, v: F.when(_near_any(v["unit"], kept, threshold), kept).otherwise(F.concat(kept, F.array(v))),
    )
    return listed.select(*keys, accepted.alias("kept"))


def near_duplicates_dropped(
    vectors: DataFrame,
    keys: list[str],
    order: str,
    vector: str,
    threshold: float = NEAR_DUPLICATE,
    block: int = _VECTOR_BLOCK,
) -> DataFrame:
    """Vectors of each group that are near no kept one before them; returns ``keys`` and ``order``.

    Greedy in order, so a dropped vector drops no others. Each round settles the next
    ``block`` vectors of every group in one record, then removes what is near the newly
    kept ones from the rest of the group, in parallel. Groups up to ``block`` long need
    one round. ``order`` is unique within a group.
    """
    left = vectors.select(*keys, order, _unit(F.col(vector)).alias("unit"))
    longest = left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    done = []
    while True:
        if longest <= block:
            done.append(_greedy(left, keys, order, threshold).select(*keys, F.explode("kept.ord").alias(order)))
            return reduce(DataFrame.unionByName, done)
        in_order = Window.partitionBy(*keys).orderBy(order)
        heads = left.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= block).drop("_n")
        kept = stage(
            _greedy(heads, keys, order, threshold).join(unbroadcast(heads.groupBy(*keys).agg(F.max(order).alias("_last"))), keys),
            "kept-vectors",
        )
        done.append(kept.select(*keys, F.explode("kept.ord").alias(order)))
        left = stage(
            left.join(unbroadcast(kept), keys)
            .filter((F.col(order) > F.col("_last")) & ~_near_any(F.col("unit"), F.col("kept"), threshold))
            .select(*keys, order, "unit"),
            "left-vectors",
        )
        longest = left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def assemble(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Kept tables of a document below each other, an empty row after each, padded to one width."""
    placed = running_sum(
        stats.select(*TABLE, "nrows", "ncols"), ["doc"], ["page", "grp"], F.col("nrows") + 1, "below", _PAGE_SPAN
    )
    width = stats.groupBy("doc").agg(F.max("ncols").alias("width"))
    placed = counted_join(placed, unbroadcast(width), ["doc"], salts=hot_salts(stats, ["doc"])).withColumn("above", F.col("below") - F.col("nrows") - 1)
    blank = F.array_repeat(F.lit(""), F.col("width"))
    body = join_by_block(rows, placed, TABLE, _ROW_SPAN).select(
        "doc",
        (F.col("above") + F.col("row_no")).alias("row_no"),
        F.slice(F.concat("values", blank), F.lit(1), F.col("width")).alias("values"),
    )
    separators = placed.select("doc", (F.col("below") - 1).alias("row_no"), blank.alias("values"))
    return body.unionByName(separators)


def review_flags(assembled: DataFrame) -> DataFrame:
    """Documents whose sixth row has no fourth cell, or an empty one."""
    cell = F.get("values", F.lit(REVIEW_COLUMN))
    reviewed = F.max(F.when(F.col("row_no") == REVIEW_ROW, clean_cell(cell)))
    return assembled.groupBy("doc").agg((F.coalesce(reviewed, F.lit("")) == "").alias("needs_review"))


def text_to_columns(rows: DataFrame, keys: list[str], pattern: str = COLUMN_GAP_OR_NUMBER) -> DataFrame:
    """Split single-column rows at gaps, padded to the table's widest row."""
    parts = rows.select(*keys, "row_no", _block(), F.split(strip(F.coalesce("value", F.lit(""))), pattern).alias("parts"))
    width = parts.groupBy(*keys).agg(F.max(F.size("parts")).alias("width"), *_block_range())
    return parts.join(unbroadcast(_in_every_block(width)), [*keys, "_block"]).select(
        *keys,
        "row_no",
        F.concat("parts", F.array_repeat(F.lit(""), F.col("width") - F.size("parts"))).alias("values"),
    )


def lines_to_columns(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Split text lines at wide gaps; lines without a gap are no table rows."""
    return text_to_columns(
        lines.filter(strip(F.col("value")).rlike(COLUMN_GAP)), keys, COLUMN_GAP
    )
