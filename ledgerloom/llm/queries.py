"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, license_scan, phrases
from .decontaminate import decontaminate
from .jaccard import ngram_jaccard
from .line_dedup import dedup_lines
from .mixing import mixing_rates
from .quality import quality_scores
from .sharding import assign_shards
from .spelling import spelling_variants
from .token_counts import token_counts
from .token_files import token_file_digests
from .url_filter import url_filter

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", "|"))


def _op4_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licenses_within(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", "|"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), digits=True, by_grams=True).withColumn("dropped", F.array_join("dropped", "|"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": _op1,
        "op2_ngram_jaccard": _op2,
        "op3_token_files": _op3,
        "op4_license_scan": _op4,
        "op4_license_within": _op4_within,
        "op5_decontamination": _op5,
        "op6_url_filter": _op6,
        "op7_token_counts": _op7,
        "op8_exact_dedup": _op8,
        "op9_mixing": _op9,
        "op10_line_dedup": _op10,
        "op11_phrase_collocations": _op11,
        "op12_spelling_variants": _op12,
        "op13_sharding": _op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_scan.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_phrase_collocations": phrases.ORACLE}
