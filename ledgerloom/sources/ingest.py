"""Many monthly files into one table with lineage, and the audit of that import."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..schema import HEADER_ROW
from ..session import stage
from .records import LINEAGE, fields, records



def source_file() -> Column:
    """Name of a row's file; it comes URL-encoded, except that a plus sign stands for itself."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def file_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Lines of all matching files: ``source_file, block, seq, value``.

    ``block`` is where the file split starts and ``seq`` grows along a split, so line
    order is known without putting a file into one task. Both depend on how a scan deals
    out the files, so the lines are written once with them, by the only scan of the files;
    whatever compares tags reads that table. Runs a job when called.
    """
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path)
        .select(
            source_file().alias(LINEAGE),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            "value",
        )
    )
    return stage(lines, "lines")


def _unique_names(names: Column) -> Column:
    """Blank headings get a numbered name, repeated ones a numbered suffix."""
    named = F.transform(names, lambda n, i: F.coalesce(n, _unnamed(i)))

    def suffixed(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(named, F.lit(1), i), lambda other: other == name))
        return F.when(before == 0, name).otherwise(F.concat(name, F.lit("."), before.cast("string")))

    return F.transform(named, suffixed)


def _unnamed(place: Column) -> Column:
    return F.concat(F.lit("Unnamed: "), place.cast("string"))


def file_headers(lines: DataFrame, header_row: int = HEADER_ROW) -> DataFrame:
    """Place (``seq``) and text of every file's header record.

    Every task passes on at most ``header_row`` records per file.
    """
    in_file = Window.partitionBy(LINEAGE).orderBy("seq")
    top = lines.filter("block = 0").withColumn("n", F.row_number().over(in_file)).filter(F.col("n") == header_row)
    return top.select(LINEAGE, F.col("seq").alias("header_seq"), F.col("value").alias("header"))


def parsed_rows(lines: DataFrame, header_row: int = HEADER_ROW) -> tuple[DataFrame, DataFrame]:
    """Data rows ``source_file, filled, cells`` of all files, and each file's headings ``source_file, names``.

    ``cells`` is a map of the filled fields by heading and ``filled`` the place of the last of
    them, from 1; so a row is as wide as what it holds, and a reader pays for the columns it takes. Fields right of a file's last heading go by numbered names, as below
    blank headings. Both are staged: the text is parsed once. Runs jobs when called.
    """
    found = records(lines)
    headers = file_headers(found, header_row).select(
        LINEAGE, "header_seq", F.transform(fields(F.col("header")), lambda n: F.nullif(n, F.lit(""))).alias("names")
    )
    headers = stage(headers.withColumn("names", _unique_names(F.col("names"))), "headers")
    data = lookup_join(found, headers, [LINEAGE], F.size("names")).filter("block > 0 or seq > header_seq")

    def extra(i: Column) -> Column:
        return F.when(F.array_contains("names", _unnamed(i)), F.concat(_unnamed(i), F.lit(".1"))).otherwise(_unnamed(i))

    n = F.size("names")
    beyond = F.when(F.size("fields") > n, F.transform(F.sequence(n, F.size("fields") - 1), extra)).otherwise(F.array().cast("array<string>"))
    keys = F.slice(F.concat("names", beyond), F.lit(1), F.size("fields"))
    filled = F.transform("fields", lambda value, i: F.when(value != "", i + 1).otherwise(0))
    pairs = F.filter(F.arrays_zip(keys.alias("key"), F.col("fields").alias("value")), lambda cell: cell["value"] != "")
    rows = data.select(LINEAGE, "names", fields(F.col("value")).alias("fields")).select(
        LINEAGE, F.coalesce(F.array_max(filled), F.lit(0)).alias("filled"), F.map_from_entries(pairs).alias("cells")
    )
    return stage(rows, "rows"), headers.select(LINEAGE, "names")


def _unite(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of :func:`parsed_rows` as one table: columns in the order of the files and their headings."""
    widths = rows.groupBy(LINEAGE).agg(F.max("filled").alias("filled")).join(headers, LINEAGE, "right")
    places = F.expr("if(filled > size(names), sequence(size(names), filled - 1), cast(array() as array<int>))")
    extra = F.transform(
        places, lambda i: F.when(F.array_contains("names", _unnamed(i)), F.concat(_unnamed(i), F.lit(".1"))).otherwise(_unnamed(i))
    )
    columns = (
        widths.select(LINEAGE, F.posexplode(F.concat("names", extra)).alias("i", "name"))
        .groupBy("name")
        .agg(F.min(F.struct(LINEAGE, "i")).alias("at"))
        .orderBy("at")
        .select("name")
        .collect()
    )
    names, used = [], {LINEAGE.lower()}
    for row in columns:
        name, n = row["name"], 0
        while name.lower() in used:
            n += 1
            name = f"{row['name']}.{n}"
        used.add(name.lower())
        names.append(name)
    if not columns:
        return rows.select(LINEAGE)
    cells = [F.try_element_at("cells", F.lit(row["name"])).alias(name) for row, name in zip(columns, names)]
    return rows.select(*cells, LINEAGE)


def read_tables(lines: DataFrame, header_row: int = HEADER_ROW) -> DataFrame:
    """Data rows of all files, united by column name, with their source file.

    A column a file lacks is NULL, and so is an empty field. Headings that differ in case
    only, or are called like the source file's column, get a numbered suffix. Fully empty
    rows stay, see :func:`drop_empty_rows`. ``lines`` must give a line the same ``block`` and
    ``seq`` whenever it is read. Runs jobs when called.
    """
    return _unite(*parsed_rows(lines, header_row))


def has_value(columns: Iterable[str]) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *[F.col(f"`{c}`").cast("string") for c in columns]).isNotNull()


def _data_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != LINEAGE]


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    """Drop rows whose columns, lineage aside, are all NULL."""
    return rows.filter(has_value(_data_columns(rows)))


def import_audit(rows: DataFrame) -> DataFrame:
    """Rows per file before and after dropping empty ones, in one aggregate."""
    return rows.groupBy(F.col(LINEAGE).alias("file_name")).agg(
        F.count("*").alias("original_row_count"),
        F.count_if(has_value(_data_columns(rows))).alias("imported_row_count"),
    )


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine_frames(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of all frames, each led by the name it came under."""
    return union_by_name(df.select(F.lit(name).alias("SourceSheet"), "*") for name, df in frames.items())


def ingest(
    spark: SparkSession, path: str, pattern: str = "*.csv", header_row: int = HEADER_ROW
) -> tuple[DataFrame, DataFrame]:
    """Imported rows and their audit. Files without data rows are audited with zero rows.

    The text of the files is read and parsed once, when called; the audit counts the parsed
    rows, two narrow columns of what was written.
    """
    rows, headers = parsed_rows(file_lines(spark, path, pattern), header_row)
    counts = rows.groupBy(F.col(LINEAGE).alias("file_name")).agg(
        F.count("*").alias("original_row_count"), F.count_if(F.col("filled") > 0).alias("imported_row_count")
    )
    files = list_files(spark, path, pattern, recursive=False).select("file_name")
    audit = files.join(counts, "file_name", "left").na.fill(0)
    return _unite(rows.where("filled > 0"), headers), audit


def list_files(spark: SparkSession, path: str, pattern: str = "*.xlsx", recursive: bool = True) -> DataFrame:
    """Files below a folder by name pattern; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime")
    )
