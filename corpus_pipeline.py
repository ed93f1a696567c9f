"""From raw documents to token files: quality, near copies, leaks, mix, ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import keep_clean
from ledgerloom.llm.jaccard import ngram_jaccard
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.quality import keep_good
from ledgerloom.llm.token_files import token_file_digests
from ledgerloom.session import stage

TOKENIZER = "byte_bpe_50k.json"
# Learned scores, fitted rates and file offsets are beyond SQL; no brute-force version checks the rows yet.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; rows without an id stay.

    Several rows under that id stay if one of them is the group's.
    """
    classes = ngram_jaccard(docs).where("doc_id is not null")
    lost = classes.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("component_id < doc_id").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that languages reach their target shares of tokens; none is lost."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of each document."""
    return token_file_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark_leaks", leaks),
    ("mixture", mixture),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
