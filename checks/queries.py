"""Registered queries: each runs one product operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ledger as L
from ledgerloom.functions.text import agency_from_file, safe_sheet_name
from ledgerloom.operators import filters, journal, page_json, tables, words, workbook
from ledgerloom.operators import ledger as A
from ledgerloom.plans import page_tables, reports
from ledgerloom.schema import with_numeric_measures
from ledgerloom.session import shared_folder, stage
from ledgerloom.sources import ingest, sinks, text_files

from .views import spark_view

Query = Callable[[SparkSession, str], DataFrame]

PART_ROWS = 4000
# The test vectors hold no near copies; a low threshold makes them near.
LOOSE_THRESHOLD = 0.2


def _on(view: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(spark_view(spark, sf_dir, view))


def _on_years(build: Callable[[DataFrame], DataFrame]) -> Query:
    """On the ledger with its fiscal years, labelled in the result."""
    return _on("ledger", lambda df: A.with_year_label(build(A.with_report_columns(df))))


def _joined(column: str, as_text: bool = False):
    """Arrays are compared as text."""
    c = F.transform(column, lambda x: x.cast("string")) if as_text else F.col(column)
    return F.array_join(c, "|").alias(column)


def _fiscal_year(ledger: DataFrame) -> DataFrame:
    period = F.col("leave_period")
    return ledger.select(
        "ueid", "leave_period", L.fiscal_year(period).alias("fy"), L.fiscal_year_from_label(period).alias("label_fy")
    )


def _full_position(ledger: DataFrame) -> DataFrame:
    position = F.col("position_number")
    return ledger.select(
        "position_number",
        L.full_position_number(position).alias("full_position_number"),
        L.agency_code(position).alias("agency_code"),
        L.agency_code(position, padded=False).alias("raw_agency_code"),
        L.org_code_display(F.col("org_code")).alias("org_code"),
        filters.reported_agency(position).alias("reported"),
    )


def _period_date(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "leave_period", F.date_format(L.period_date(F.col("leave_period")), "yyyy-MM-dd").alias("period_date")
    )


def _measures(ledger: DataFrame) -> DataFrame:
    end, earned, used, misc = (
        L.number(F.col(c)) for c in ("end_balance", "leave_earned", "leave_used", "misc_amt")
    )
    return ledger.select(
        "ueid",
        "leave_period",
        L.beginning_balance(end, earned, used, misc).alias("beginning_balance"),
        L.liability(F.col("end_balance"), F.col("hourly_rate")).alias("liability"),
        L.to_quarter_hours(end / 8).alias("quarter_hours"),
        L.to_cents(L.safe_ratio(end, misc)).alias("ratio"),
        L.number_or_null(F.col("benefit_name")).alias("not_a_number"),
    )


def _non_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.non_classified_headcount(
        spark_view(spark, sf_dir, "ledger"), spark_view(spark, sf_dir, "non_clas")
    )


def _audit_rows(ledger: DataFrame) -> DataFrame:
    """A ledger in which some rows hold nothing but their file name."""
    empty = F.col("hourly_rate").endswith("7")
    return ledger.select(
        *[F.when(~empty, F.col(c)).alias(c) for c in ledger.columns if c != "source_file"], "source_file"
    )


def _ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as the text lines of its monthly files: five title lines, a header, the rows.

    B files lack one column and order two others differently.
    """
    a = ["ueid", "leave_period", "org_code", "end_balance", "misc_amt"]
    b = ["leave_period", "ueid", "org_code", "end_balance"]
    ledger = spark_view(spark, sf_dir, "ledger")
    is_a = F.col("source_file").contains(" A.")

    def line(columns: list[str]):
        return F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in columns])

    rows = ledger.select("source_file", F.when(is_a, line(a)).otherwise(line(b)).alias("value"))
    files = ledger.select("source_file").distinct()
    heads = files.select(
        "source_file",
        F.posexplode(
            F.concat(
                F.array_repeat(F.lit("Leave activity"), 5),
                F.array(F.when(is_a, F.lit(",".join(a))).otherwise(F.lit(",".join(b)))),
            )
        ).alias("seq", "value"),
    ).select("source_file", F.col("seq").cast("bigint").alias("seq"), "value")
    return heads.unionByName(rows.withColumn("seq", F.lit(6).cast("bigint"))).withColumn(
        "block", F.lit(0).cast("bigint")
    )


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_file(ingest.drop_empty_rows(ingest.read_tables(stage(_ledger_lines(spark, sf_dir), "lines"))))


def _per_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("ueid").alias("employees"),
        F.sum(L.number(F.col("end_balance"))).alias("end_balance"),
        F.sum(L.number(F.col("misc_amt"))).alias("misc_amt"),
        F.min("leave_period").alias("leave_period"),
    )


def _ledger_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of text files with the ledger's lines, and after each file's header a row of empty fields."""
    lines = _ledger_lines(spark, sf_dir)
    empty = lines.where("seq = 5").select("source_file", F.regexp_replace("value", "[^,]", "").alias("value"), "seq", "block")
    lines = lines.unionByName(empty.withColumn("seq", F.col("seq") + 1))
    folder = f"{shared_folder(spark)}/months-{uuid.uuid4().hex}"
    (
        lines.repartition("source_file")
        .sortWithinPartitions("source_file", "seq")
        .select("source_file", "value")
        .write.option("maxRecordsPerFile", 0)
        .partitionBy("source_file")
        .text(f"{folder}/parts")
    )
    for row in lines.select("source_file").distinct().collect():
        sinks.publish(spark, f"{folder}/parts/source_file={row.source_file}", f"{folder}/{row.source_file}")
    return folder


def _ingest_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ingest.ingest(spark, _ledger_files(spark, sf_dir))
    return _per_file(rows)


RAGGED_WIDTH = 300


def _written(lines: DataFrame, name: str) -> str:
    """Folder of text files with ``value`` of each file's lines, ordered by ``seq``; a value may hold line breaks."""
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (
        lines.repartition("source_file")
        .sortWithinPartitions("source_file", "seq")
        .select("source_file", "value")
        .write.option("maxRecordsPerFile", 0)
        .partitionBy("source_file")
        .text(f"{folder}/parts")
    )
    for row in lines.select("source_file").distinct().collect():
        sinks.publish(spark, f"{folder}/parts/source_file={row.source_file}", f"{folder}/{row.source_file}")
    return folder


def _ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly files whose departments hold line breaks and quotes, with over-long lines and one of RAGGED_WIDTH fields each."""
    ledger = spark_view(spark, sf_dir, "ledger")
    department = F.concat(F.lit('"'), F.col("department_name"), F.lit('\n""unit"", '), F.col("org_code"), F.lit('"'))
    late = F.when(F.col("org_code").endswith("10"), F.concat(F.lit(",,late "), F.col("cbid"))).otherwise("")
    rows = ledger.select(
        "source_file", F.lit(3).alias("seq"), F.concat_ws(",", "ueid", department, F.concat("end_balance", late)).alias("value")
    )
    wide = F.concat(F.lit("wide,,1"), F.repeat(F.lit(",z"), RAGGED_WIDTH - 3))
    heads = ledger.select("source_file").distinct().select(
        "source_file",
        F.posexplode(F.array(F.lit('"Title, with\na break"'), F.lit("ueid,department,end_balance"), wide)).alias("seq", "value"),
    )
    return heads.unionByName(rows)


def _ingest_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ingest.ingest(spark, _written(_ragged_lines(spark, sf_dir), "ragged"), header_row=2)
    return rows.select(
        "source_file",
        "ueid",
        "department",
        "end_balance",
        F.col("`Unnamed: 4`").alias("late"),
        F.col(f"`Unnamed: {RAGGED_WIDTH - 1}`").alias("last"),
    )


def _requote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ragged files' records of ordinary width, every field in quotes, as lines of the new files."""
    lines = _ragged_lines(spark, sf_dir).where("seq <> 2")
    target = f"{shared_folder(spark)}/requoted-{uuid.uuid4().hex}"
    sinks.requote(spark, _written(lines, "ragged"), target, "*.csv")
    return spark.read.text(target)


def _ingest_audit_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, audit = ingest.ingest(spark, _ledger_files(spark, sf_dir))
    return audit


def _union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return ingest.combine_frames(
        {
            "customer": customers.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
            "supplier": suppliers.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")),
        }
    )


def _part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return sinks.part_numbers(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], PART_ROWS)


def _csv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as filled CSV parts and read back as text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_parts(orders, f"{folder}/orders.csv", [F.desc("o_orderkey")], PART_ROWS)
    return text_files.read_text_csv(spark, folder, lineage=True)


def _ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger saved as a table by month and read back for one report."""
    ledger = with_numeric_measures(spark_view(spark, sf_dir, "ledger"))
    saved = sinks.save_table(ledger, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    return reports.liability(saved)


def _replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved as a table that is then replaced by a statement on itself."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    old = sinks.save_table(orders, path, partition_by="o_orderstatus")
    sinks.save_table(old.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, partition_by=None)
    return sinks.load_table(spark, path)


def _suffixed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and large results written with a suffix always; an empty one leaves no file."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    folder = f"{shared_folder(spark)}/suffixed-{uuid.uuid4().hex}"
    for status in ("F", "P", "none"):
        part = orders.where(F.col("o_orderstatus") == status)
        sinks.write_parts(part, f"{folder}/{status}.csv", [F.asc("o_orderkey")], PART_ROWS, always_suffix=True)
    return text_files.read_text_csv(spark, folder, lineage=True)


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    lines = spark_view(spark, sf_dir, "csv_lines").select("source_file", F.col("line_no").alias("seq"), "value")
    heads = lines.select("source_file").distinct().select(
        "source_file", F.lit(0).cast("long").alias("seq"), F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.concat(F.lit("c"), i))).alias("value")
    )
    return _written(heads.unionByName(lines), "checked")


def _csv_integrity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check on text files; a line's number counts the lines before it."""
    return text_files.check_csv(spark, _csv_folder(spark, sf_dir), preview=None)


def _csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and names of the columns of each file found below a folder."""
    folder = _csv_folder(spark, sf_dir)
    parent = folder.rsplit("/", 1)[0]
    listed = ingest.list_files(spark, folder, "*.csv", recursive=True).select("path", "file_name").collect()
    found = [(r.file_name, *text_files.inspect_header(spark, f"{folder}/{r.file_name}")) for r in listed if parent in r.path]
    return spark.createDataFrame(found, "file_name string, n int, names array<string>").withColumn("names", _joined("names"))


def _in_order(report: Callable[..., DataFrame], order: str) -> Query:
    """A report with its rows' places, so that their order is part of the result."""
    return _on("ledger", lambda df: reports.numbered(report(df, ordered=False), order))


def _page_tables(cells: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    return page_tables.document_tables(cells, vectors).select("doc", "row_no", _joined("values"))


def _page_tables_by_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_tables(spark_view(spark, sf_dir, "table_cells"), spark_view(spark, sf_dir, "table_vectors"))


def _near_tables(vectors: DataFrame) -> DataFrame:
    return tables.near_duplicates_dropped(vectors, ["doc", "page"], "grp", "embedding")


def _stats(cells: DataFrame) -> DataFrame:
    return tables.table_stats(page_tables.candidate_tables(cells)).select(
        *tables.TABLE,
        "nrows",
        "ncols",
        "filled",
        tables.is_incomplete().alias("incomplete"),
        tables.is_junk().alias("junk"),
    )


def _exact(cells: DataFrame) -> DataFrame:
    return tables.drop_exact_duplicates(tables.table_stats(page_tables.candidate_tables(cells))).select(
        *tables.TABLE, "nrows", "ncols"
    )


def _accepted(cells: DataFrame) -> DataFrame:
    return page_tables.accepted_tables(page_tables.candidate_tables(cells)).select(*tables.TABLE, "nrows", "ncols")



def queries() -> dict[str, Query]:
    return {
        # Reports
        "r1_headcount": _on("ledger", reports.headcount),
        "r1_headcount_by_agency": _on("ledger", lambda df: reports.headcount(df, by_org=False)),
        "r2_nonclas_headcount": _non_classified,
        "r3_leave_balance": _on("ledger", reports.leave_balance),
        "r4_earned_used": _on("ledger", reports.earned_used),
        "r4_earned_used_no_fan_out": _on("ledger", lambda df: reports.earned_used(df, fan_out=False)),
        "r5_liability": _on("ledger", reports.liability),
        "r6_pay_rates": _on("ledger", reports.pay_rates),
        "r7_rollforward_agency": _on("ledger", reports.rollforward_agency),
        "r8_rollforward_position": _on("ledger", reports.rollforward_position),
        "r8_one_year": _on("ledger", lambda df: reports.rollforward_position(df, fy="1997-1998")),
        "r1_order": _in_order(reports.headcount, "headcount"),
        "r4_order": _in_order(reports.earned_used, "earned_used"),
        "r5_order": _in_order(reports.liability, "liability"),
        "r8_order": _on("ledger", reports.numbered_rollforward_position),
        # Functions, filters and building blocks of the ledger
        "fiscal_year": _on("ledger", _fiscal_year),
        "full_position": _on("ledger", _full_position),
        "period_date": _on("ledger", _period_date),
        "measures": _on("ledger", _measures),
        "yearly_activity": _on_years(lambda df: A.yearly_activity(df, "ueid", "benefit_id")),
        "june_endings": _on_years(A.june_endings),
        "employee_liability": _on_years(A.employee_liability),
        "position_totals": _on_years(A.position_totals),
        "nonnumeric_audit": _on("dirty_ledger", filters.non_numeric_sources),
        "malformed_positions": _on("dirty_ledger", filters.malformed_positions),
        "distinct_periods": _on("ledger", lambda df: filters.distinct_periods(df, "1-URGENT")),
        "row_count": _on("ledger", filters.row_count),
        "multi_position_employees": _on_years(A.multi_position_employees),
        "distinct_combos": _on(
            "ledger", lambda df: A.distinct_combinations(A.with_report_columns(df), "ueid", "fy", "position_number")
        ),
        "july_begin_june_end": _on("ledger", reports.july_begin_june_end),
        # Ingest and output
        "ingest_files": _ingested,
        "ingest_from_files": _ingest_from_files,
        "ingest_ragged_files": _ingest_ragged,
        "requote": _requote,
        "ingest_audit_from_files": _ingest_audit_from_files,
        "ingest_audit": _on("ledger", lambda df: ingest.import_audit(_audit_rows(df))),
        "union_by_name": _union_by_name,
        "csv_integrity": _on("csv_lines", lambda df: text_files.bad_lines(df, preview=None)),
        "csv_integrity_preview": _on("csv_lines", text_files.bad_lines),
        "part_numbers": _part_numbers,
        "csv_parts": _csv_parts,
        "ledger_table": _ledger_table,
        "replaced_table": _replaced_table,
        "suffixed_parts": _suffixed_parts,
        "csv_integrity_files": _csv_integrity_files,
        "csv_headers": _csv_headers,
        # Workbooks and journals
        "sheet_catalogue": _on("catalogue", workbook.sheet_catalogue),
        "lessee_subsets": _on("catalogue", workbook.lessee_subsets),
        "required_cell": _on("cells", workbook.failing_sheets),
        "quarantine_list": _on("cells", lambda df: workbook.quarantine_list(workbook.failing_sheets(df))),
        "first_row_occupied": _on("cells", workbook.first_row_occupied),
        "combined_sheets": _on("cells", lambda df: workbook.combine_sheets(df, 6)),
        "je_clean": _on("je", lambda df: journal.clean_journal(df, ["file_no"])),
        "je_from_cells": _on("je_cells", lambda df: journal.clean_journal(journal.journal_rows(df), ["file", "sheet"])),
        # Page words
        "header_words": _on("words", words.header_words),
        "number_words": _on("words", words.number_words),
        "header_groups": _on("dense_words", words.header_groups),
        "nearest_numeric": _on("dense_words", words.matched_columns),
        "column_areas": _on(
            "dense_words", lambda df: words.column_areas(df).withColumn("columns", _joined("columns", as_text=True))
        ),
        "text_lines": _on("dense_words", words.text_lines),
        "page_text": _on("dense_words", lambda df: words.page_text(words.text_lines(df))),
        # Page tables
        "clean_cells": _on(
            "table_cells",
            lambda df: tables.clean_tables(df, [*tables.TABLE, "cand"]).withColumn("values", _joined("values")),
        ),
        "unify_candidates": _on(
            "table_cells", lambda df: page_tables.candidate_tables(df).withColumn("values", _joined("values"))
        ),
        "junk_tables": _on("table_cells", _stats),
        "exact_dup_tables": _on("table_cells", _exact),
        "near_dup_vectors": _on("vectors", lambda df: tables.near_duplicates_dropped(df, ["page"], "ord", "embedding")),
        "near_dup_vectors_loose": _on(
            "vectors",
            lambda df: tables.near_duplicates_dropped(df, ["page"], "ord", "embedding", threshold=LOOSE_THRESHOLD),
        ),
        "near_dup_tables": _on("table_vectors", _near_tables),
        "consecutive_dup": _on("table_cells", _accepted),
        "document_tables": _on("table_cells", _page_tables),
        "review_flags": _on("table_cells", lambda df: tables.review_flags(page_tables.document_tables(df))),
        "document_tables_vectors": _page_tables_by_vectors,
        "review_outcomes": _on("review_cells", lambda df: tables.review_flags(page_tables.document_tables(df))),
        "text_to_columns": _on(
            "text_cells",
            lambda df: tables.text_to_columns(df, ["table_no"]).withColumn("values", _joined("values")),
        ),
        "lines_to_columns": _on(
            "text_cells",
            lambda df: tables.lines_to_columns(df, ["table_no"]).withColumn("values", _joined("values")),
        ),
        # Page results as JSON, names
        "page_json_rows": _on("page_json", lambda df: page_json.flatten_pages(page_json.parse_pages(df), "page_id")),
        "page_json_rejected": _on("page_json", lambda df: page_json.rejected_pages(page_json.parse_pages(df))),
        "file_names": _on(
            "catalogue",
            lambda df: df.select(
                "filename",
                safe_sheet_name(F.col("filename")).alias("safe_name"),
                agency_from_file(F.replace("filename", F.lit(".xlsx"), F.lit(".pdf"))).alias("agency"),
            ),
        ),
    }
