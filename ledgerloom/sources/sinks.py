"""Tables and CSV outputs."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_ROWS_PER_PART
from ..session import stage
from .ingest import file_lines
from .part_files import NAME, PartFiles
from .records import fields, quoted_line, records

_POSITION_BITS = 33
# The same for single lines.
_LINE = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# Tasks that write parts; a task may write several.
MOST_TASKS = 10_000
_MANIFEST = "version long, folder string, schema string"
_CSV = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "maxRecordsPerFile": 0,
}


def save_table(df: DataFrame, path: str, view: str | None = None, partition_by: str | None = "leave_period") -> DataFrame:
    """Create or replace a Parquet table and, if named, the view on it.

    Every version is a folder of its own, and a one-row manifest named by the version's
    number, written last, makes it the table. So a table can be replaced from itself, a
    failed write leaves the old one, readers of the old one go on, and of two writers of the
    same version the second fails. Rows are gathered by partition value before writing;
    adaptive execution splits a large value over several files and joins small ones.
    """
    spark = df.sparkSession
    version = (_current(spark, path) or {"version": 0})["version"] + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    if partition_by:
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(f"{path}/versions/{folder}")
    else:
        df.hint("rebalance").write.parquet(f"{path}/versions/{folder}")
    manifest = spark.createDataFrame([(version, folder, df.schema.json())], _MANIFEST).coalesce(1)
    manifest.write.mode("errorifexists").json(f"{path}/manifests/{version}")
    saved = load_table(spark, path)
    if view:
        saved.createOrReplaceTempView(view)
    return saved


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's present version."""
    found = _current(spark, path)
    if found is None:
        raise ValueError(f"no table in {path}")
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/versions/{found['folder']}")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the rows of all but the last ``keep`` versions; no reader may use them any more."""
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*").orderBy(F.desc("version")).offset(keep)
    for row in rows.toLocalIterator():
        _remove(spark, f"{path}/versions/{row.folder}")


def _current(spark: SparkSession, path: str) -> dict | None:
    try:
        found = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*").orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found and found.asDict()


def number_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``row_no``, the global position from 1 in the given order; equal rows keep input order.

    The rows are sorted by range over all tasks and written once; positions are the
    counts of the earlier ranges plus the place inside the range. The input order breaks
    ties, so equal sort keys spread over ranges too. The counts, one per range, are few.
    """
    ranged = (
        df.withColumn("_seq", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_seq")
        .sortWithinPartitions(*order, "_seq")
        .drop("_seq")
    )
    return number_staged(stage(with_places(ranged), "ranges"))


def with_places(ranged: DataFrame) -> DataFrame:
    """Add ``_at``, the range of each row and its place inside it, to rows sorted by range."""
    return ranged.withColumn("_at", F.monotonically_increasing_id())


def number_staged(ranges: DataFrame) -> DataFrame:
    """Turn ``_at`` of a staged table into ``row_no``, the global position from 1."""
    staged = ranges.withColumn("_range", F.shiftright("_at", _POSITION_BITS))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        staged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        staged.join(F.broadcast(counts), "_range")
        .withColumn("row_no", F.col("_before") + place + 1)
        .drop("_range", "_before", "_at")
    )


def part_numbers(df: DataFrame, order: list[Column], max_rows: int = MAX_ROWS_PER_PART) -> DataFrame:
    """Add ``row_no`` and ``part``: parts are filled exactly, in order."""
    return number_rows(df, order).withColumn("part", F.expr(f"(row_no - 1) div {max_rows} + 1"))


def write_parts(
    df: DataFrame,
    path: str,
    order: list[Column],
    max_rows: int = MAX_ROWS_PER_PART,
    always_suffix: bool = False,
) -> list[str]:
    """Write one CSV per ``max_rows`` rows in order, named ``<name>_pt1.csv`` and so on.

    A single part keeps the plain name unless ``always_suffix``. An empty result gives a
    file with only the header, or nothing at all with ``always_suffix``. The tasks that hold
    the parts write them under these names; files of an earlier, longer result stay.
    """
    base, ext = path.rsplit(".", 1)
    numbered = part_numbers(df, order, max_rows)
    parts = numbered.agg(F.max("part")).first()[0] or 0
    if parts == 0:
        return [] if always_suffix else [_write_empty(df, path)]
    plain = parts == 1 and not always_suffix
    spark = df.sparkSession
    spark.dataSource.register(PartFiles)
    names = io.StringIO()
    csv.writer(names, lineterminator="").writerow(df.columns)
    cells = _plain_numbers(numbered.select("part", "row_no", *[F.col(f"`{c}`") for c in df.columns]))
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), _LINE)
    (
        cells.select("part", "row_no", line.alias("line"))
        .repartition(min(int(parts), MOST_TASKS), "part")
        .sortWithinPartitions("part", "row_no")
        .select("part", "line")
        .write.format(NAME)
        .mode("append")
        .option("target", path if plain else f"{base}_pt{{part}}.{ext}")
        .option("header", names.getvalue())
        .save()
    )
    return [path] if plain else [f"{base}_pt{n}.{ext}" for n in range(1, parts + 1)]


def write_report(df: DataFrame, path: str, order: list[Column]) -> list[str]:
    """Write a report as one CSV with a header; beyond the row cap of a file it is split."""
    return write_parts(df, path, order)


def requote(spark: SparkSession, source: str, target: str, pattern: str = "*") -> None:
    """Rewrite minimally quoted CSV with every field quoted; records keep their order and their number of fields.

    Fields may hold line breaks; files are read in splits all the same.
    """
    found = records(file_lines(spark, source, pattern), in_order=True)
    found.select(quoted_line(fields(F.col("value")))).write.mode("overwrite").text(target)


def _plain_numbers(df: DataFrame) -> DataFrame:
    """Doubles without exponents, as spreadsheets expect them, whatever their size.

    The shortest digits that give the number back are moved to where its exponent says.
    """

    def plain(name: str) -> Column:
        text = F.col(name).cast("string")
        sign = F.when(text.startswith("-"), "-").otherwise("")
        digits = F.replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), F.lit("."), F.lit(""))
        # Places of the point, counted from the left of the digits.
        point = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int") + 1
        padded = F.rpad(digits, F.greatest(point + 1, F.length(digits)), "0")
        tail = F.regexp_replace(padded.substr(point + 1, F.length(padded)), r"(?<=\d)0+$", "")
        large = F.concat(padded.substr(F.lit(1), point), F.lit("."), tail)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), F.regexp_replace(digits, r"(?<=\d)0+$", ""))
        return F.when(text.contains("E"), F.concat(sign, F.when(point > 0, large).otherwise(small))).otherwise(text)

    return df.withColumns({name: plain(name) for name, kind in df.dtypes if kind == "double"})


def _write_empty(df: DataFrame, path: str) -> str:
    folder = f"{path}.parts"
    empty = df.sparkSession.createDataFrame([], df.schema).repartition(1)
    empty.write.mode("overwrite").options(**_CSV).csv(folder)
    publish(df.sparkSession, folder, path)
    _remove(df.sparkSession, folder)
    return path


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, target: str) -> None:
    """Give the single data file of ``folder`` its final name."""
    source, fs = _hadoop_path(spark, folder)
    final, _ = _hadoop_path(spark, target)
    (found,) = [f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")]
    fs.delete(final, True)
    if not fs.rename(found, final):
        raise OSError(f"cannot name {target}")


def _remove(spark: SparkSession, folder: str) -> None:
    path, fs = _hadoop_path(spark, folder)
    fs.delete(path, True)
