"""Positioned page words: year headers, numeric columns, table areas, text lines.

Input is ``words(doc, page, x0, x1, top, bottom, txt)``. Work is keyed by page, but no
step puts the words of a page into one task: words are first combined by position, and
ordered steps run over horizontal or vertical bands of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import stage
from .blocks import nearest_both_ways
from .skew import lookup_join, unbroadcast

# Year headers, the numeric pattern, and distances in points.
YEARS = ("2023-24", "2024-25", "2025-26")
NUMERIC = r"^\$?-?\p{Nd}[\p{Nd},]*(\.\p{Nd}{2})?$|^-$"
ROW_TOLERANCE = 12
VALUE_DISTANCE = 60
X_MARGIN = 10
TOP_PADDING = BOTTOM_PADDING = 6
LINE_HEIGHT = 3
POINTS_PER_SPACE = 10
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0

# The nearest-number search of a header group is spread over bands of this width.
_X_BAND = 0.5

PAGE = ["doc", "page"]
GROUP = ["doc", "page", "grp"]


def year_pattern(years: tuple[str, ...] = YEARS) -> str:
    """A year's two halves with no digit between them or after them."""
    return "|".join(r"{}\P{{Nd}}*{}\P{{Nd}}*$".format(*year.split("-")) for year in years)


def header_words(words: DataFrame, years: tuple[str, ...] = YEARS) -> DataFrame:
    """Words that are a year header, trimmed; white space around them cannot change the match."""
    return words.filter(F.col("txt").rlike(year_pattern(years))).withColumn("txt", strip(F.col("txt")))


def number_words(words: DataFrame) -> DataFrame:
    return words.filter(F.replace("txt", F.lit(","), F.lit("")).rlike(NUMERIC))


def _header_spots(headers: DataFrame, tolerance: float, *spot: str) -> DataFrame:
    """Headers combined by page, band of half the tolerance, and ``spot`` columns."""
    return headers.groupBy(*PAGE, F.floor(F.col("top") / (tolerance / 2)).alias("band"), *spot).agg(
        F.min("top").alias("first_top"),
        F.max("top").alias("last_top"),
        F.max("bottom").alias("bottom"),
        F.count("*").alias("headers"),
    )


def _numbered_bands(spots: DataFrame, tolerance: float) -> DataFrame:
    """Bands of headers, numbered by header group.

    Words in one band always belong together, so only a band's extremes matter, and a
    page has as many bands as its height allows, however many words it holds.
    """
    bands = spots.groupBy(*PAGE, "band").agg(
        F.min("first_top").alias("first_top"),
        F.max("last_top").alias("last_top"),
        F.max("bottom").alias("bottom"),
        F.sum("headers").alias("headers"),
    )
    down = Window.partitionBy(*PAGE).orderBy("band")
    starts = F.when(F.col("first_top") - F.lag("last_top").over(down) <= tolerance, 0).otherwise(1)
    return bands.withColumn("starts", starts).withColumn("grp", F.sum("starts").over(down)).drop("starts")


def _groups(bands: DataFrame, page_height: float) -> DataFrame:
    groups = bands.groupBy(*GROUP).agg(
        F.min("first_top").alias("hdr_top"), F.max("bottom").alias("hdr_bottom"), F.sum("headers").alias("headers")
    )
    below = F.lead("hdr_top", 1, page_height).over(Window.partitionBy(*PAGE).orderBy("grp"))
    return groups.withColumn("next_top", below)


def header_groups(
    words: DataFrame,
    years: tuple[str, ...] = YEARS,
    tolerance: float = ROW_TOLERANCE,
    page_height: float = PAGE_HEIGHT,
) -> DataFrame:
    """Header rows of each page: a gap above ``tolerance`` to the header before starts a new one."""
    return _groups(_numbered_bands(_header_spots(header_words(words, years), tolerance), tolerance), page_height)


def _match(
    words: DataFrame, years: tuple[str, ...], tolerance: float, distance: float, page_height: float
) -> tuple[DataFrame, DataFrame]:
    """Header groups and the column position of every header; header places are found once."""
    places = stage(_header_spots(header_words(words, years), tolerance, "x0", "x1"), "header-places")
    bands = _numbered_bands(places, tolerance)
    groups = _groups(bands, page_height)
    spots = (
        places.join(unbroadcast(bands.select(*PAGE, "band", "grp")), [*PAGE, "band"]).select(*GROUP, "x0", "x1").distinct()
    )
    # Groups of a page are at least a tolerance apart, so this array is as short as a page is high.
    bottoms = stage(
        groups.groupBy(*PAGE).agg(F.collect_list(F.struct("grp", "hdr_bottom")).alias("groups")), "header-bottoms"
    )
    numbers = number_words(words).select(*PAGE, "x0", "top")
    numbers = (
        lookup_join(numbers, bottoms, PAGE, values=2 * F.size("groups") + 2)
        .select(
            *PAGE,
            "x0",
            "top",
            F.explode(F.filter("groups", lambda g: g["hdr_bottom"] < F.col("top"))["grp"]).alias("grp"),
        )
        .groupBy(*GROUP, "x0")
        .agg(F.min("top").alias("number_top"))
        .withColumn("number_x", F.col("x0"))
    )
    merged = stage(
        numbers.withColumn("is_header", F.lit(0)).unionByName(
            spots.withColumn("is_header", F.lit(1)), allowMissingColumns=True
        ),
        "merged-columns",
    )
    both = nearest_both_ways(merged, GROUP, ["x0", "is_header"], ["number_x", "number_top"], _X_BAND)

    def candidate(side: str) -> Column:
        x, top = F.col(f"{side}_number_x"), F.col(f"{side}_number_top")
        return F.when(
            x.isNotNull(), F.struct(F.abs(x - F.col("x0")).alias("dist"), top.alias("top"), x.alias("x0"))
        )

    matched = (
        both.filter("is_header = 1")
        .withColumn("near", F.least(candidate("before"), candidate("after")))
        .filter("near is not null")
        .select(
            *GROUP,
            "x0",
            "x1",
            F.when(F.col("near.dist") <= distance, F.col("near.x0"))
            .otherwise((F.col("x0") + F.col("x1")) / 2)
            .alias("column_x"),
        )
    )
    return groups, matched


def matched_columns(
    words: DataFrame,
    years: tuple[str, ...] = YEARS,
    tolerance: float = ROW_TOLERANCE,
    distance: float = VALUE_DISTANCE,
    page_height: float = PAGE_HEIGHT,
) -> DataFrame:
    """Column position of every header: the nearest number below its group, else its own centre.

    Only the nearest number to the left and to the right can win, so headers and numbers
    are merged in x order and filled from both sides; no header meets more than two
    numbers. Among equally near numbers the first in reading order (top, then x) wins.
    Groups without any number below give no rows.
    """
    return _match(words, years, tolerance, distance, page_height)[1]


def column_areas(
    words: DataFrame,
    years: tuple[str, ...] = YEARS,
    tolerance: float = ROW_TOLERANCE,
    distance: float = VALUE_DISTANCE,
    page_width: float = PAGE_WIDTH,
    page_height: float = PAGE_HEIGHT,
) -> DataFrame:
    """Columns and bounds of each header group's table, heights measured from the page bottom."""
    groups, matched = _match(words, years, tolerance, distance, page_height)
    columns = (
        matched.select(*GROUP, F.round("column_x", 2).alias("x"))
        .groupBy(*GROUP)
        .agg(F.sort_array(F.collect_set("x")).alias("columns"))
    )
    upper = page_height - (F.col("hdr_top") - TOP_PADDING)
    lower = page_height - (F.col("next_top") - BOTTOM_PADDING)
    return groups.join(unbroadcast(columns), GROUP).select(
        *GROUP,
        "columns",
        F.greatest(F.lit(0.0), F.element_at("columns", 1) - X_MARGIN).alias("left"),
        F.least(F.lit(page_width), F.element_at("columns", -1) + X_MARGIN).alias("right"),
        F.greatest(upper, lower).alias("area_top"),
        F.least(upper, lower).alias("area_bottom"),
    )


def text_lines(words: DataFrame, line_height: float = LINE_HEIGHT) -> DataFrame:
    """Text of each line, with gaps between words turned into blanks.

    Words of one line are put together because a line is one text value.
    """
    line = (
        words.groupBy(*PAGE, F.bround(F.col("top") / line_height).cast("bigint").alias("line"))
        .agg(F.sort_array(F.collect_list(F.struct("x0", "top", "x1", "txt"))).alias("w"))
    )
    ends = F.concat(F.array(F.lit(0.0)), F.transform("w", lambda w: w["x1"]))
    pieces = F.zip_with(
        "w",
        F.slice(ends, 1, F.size("w")),
        lambda w, end: F.concat(
            F.repeat(F.lit(" "), F.greatest(((w["x0"] - end) / POINTS_PER_SPACE).cast("int"), F.lit(1))), w["txt"]
        ),
    )
    return line.select(*PAGE, "line", F.array_join(pieces, "").alias("text"))


def page_text(lines: DataFrame) -> DataFrame:
    """Lines of a page as one text; a page has as many lines as its height allows."""
    return (
        lines.groupBy(*PAGE)
        .agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines"))
        .select(*PAGE, F.array_join(F.col("lines.text"), "\n").alias("text"))
    )
