"""Exact duplicates by a stream with kept state (operator 8)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Without file preallocation: a store of few keys then takes kilobytes, not megabytes.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased; null is empty.

    ``lower`` is far quicker than ``translate`` and does the same for texts whose only
    characters beyond ASCII are lower-case letters.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[^\x00-\x7F&&[^\p{Ll}]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(frame: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Normalised text, its digest and where the row stands: file and row in it."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = frame.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.col("text").cast("string")).alias("plain"), at.alias("at"))
    return found.withColumn("digest", digest(F.col("plain")))


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def keyed_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Stream the files of ``path`` into state and return it: (digest, keep, n).

    The state holds, per digest and for ever, the number of rows and the row with the largest
    doc_id: its id and its locator. Rows are combined inside each task before they reach the
    state, so a digest that a third of all rows share costs one row a task. State is kept by
    RocksDB on the executors' disks and committed to the shared folder with every batch; a lost
    executor's part is loaded from there. ``files_per_batch`` splits the input into batches.
    """
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    if _is_file(spark, path):  # a stream reads folders
        path, _, name = path.rpartition("/")
        stream = stream.option("pathGlobFilter", name)
    rows = _rows(stream.parquet(path), digest)
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "at")
    state = rows.groupBy("digest").agg(F.max(order).alias("keep"), F.count("*").alias("n"))
    folder = f"{shared_folder(spark)}/dedup-state-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        running = (
            state.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder)
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
        held = spark.read.format("statestore").load(folder)
        names = held.schema["value"].dataType.names
        held = held.select("key.digest", F.col(f"value.`{names[0]}`").alias("keep"), F.col(f"value.`{names[1]}`").alias("n"))
        return stage(held, "dedup-state")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exact_dedup(
    spark: SparkSession,
    path: str,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Group rows of the Parquet files in ``path`` whose texts are equal but for the case of A-Z.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), a row per input row. Of equal
    texts the row with the largest doc_id stays; of several such rows the one that stands
    last by file and place, so exactly one row of a group is kept. A null doc_id is
    below all others. Null texts count as empty, and all empty texts are equal.

    Digests only propose groups: texts of digests with several rows are read again and
    compared with the kept row's in full; rows that differ are grouped anew by their texts.
    Runs jobs when called.
    """
    state = keyed_state(spark, path, digest, files_per_batch)
    rows = _rows(spark.read.parquet(path), digest)
    several = stage(state.where("n > 1"), "dedup-hits")
    few = several.count() <= broadcast_rows
    hits = several.select("digest", F.col("keep.at").alias("keep_at"))
    texts = rows.join(F.broadcast(hits) if few else hits, "digest").select("digest", "doc_id", "at", "plain", "keep_at")
    keepers = texts.where(F.col("at") == F.col("keep_at")).select("digest", F.col("plain").alias("keep_plain"))
    differ = texts.where(F.col("at") != F.col("keep_at")).join(keepers, "digest").where("plain <> keep_plain")
    differ = stage(differ.select("digest", "doc_id", "at", "plain"), "dedup-differ")

    sha = F.col("digest") if digest is sha256 else sha256(F.col("plain"))
    slim = rows.select("doc_id", "at", "digest", sha.alias("text_sha256"))
    moved = not differ.isEmpty()
    if moved:
        left = differ.groupBy("digest").agg(F.count("*").alias("m"))
        several = several.join(left, "digest", "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).drop("m")
    joined = slim.join(several.select("digest", "keep", "n"), "digest", "left")
    if moved:
        order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "at")
        again = differ.groupBy("digest", "plain").agg(F.max(order).alias("keep2"), F.count("*").alias("n2"))
        placed = differ.join(again, ["digest", "plain"]).select("at", "keep2", "n2")
        joined = joined.join(placed, "at", "left")
        joined = joined.withColumns({"keep": F.coalesce("keep2", "keep"), "n": F.coalesce("n2", "n")})
    keep_id = F.col("keep.doc_id")
    keep_id = F.when(F.col("keep").isNull(), F.col("doc_id")).when(keep_id != -(1 << 63), keep_id)
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("at") == F.col("keep.at"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
