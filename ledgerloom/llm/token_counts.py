"""Token counts of documents (operator 7)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache

LIMIT = 512
# Rows whose chunks are counted for the table of frequent chunks, and its entries.
SAMPLE_ROWS = 4000
FREQUENT = 40_000
_caches: dict[str, ChunkCache] = {}


def text_runs(texts: pa.Array, most: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; null is empty."""
    run, held = [], 0
    for value in texts:
        text = value.as_py() or ""
        run.append(text)
        held += len(text)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def _sampled(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counts, cache = Counter(), ChunkCache(path, len)
    for batch in batches:
        for run in text_runs(batch.column(0)):
            for keys in cache.fill(run):
                counts.update(keys)
    found = [(k, n, cache[k]) for k, n in counts.items() if n > 1 and k in cache and k[0] != "\t"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(list(zip(*found)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()))],
        ["chunk", "times", "length"],
    )


def _counted(batches: Iterator[pa.RecordBatch], path: str, known) -> Iterator[pa.RecordBatch]:
    if path not in _caches:
        _caches[path] = ChunkCache(path, len, known.value)
    cache = _caches[path]
    length = cache.__getitem__
    for batch in batches:
        sizes, tokens = [], []
        for run in text_runs(batch.column(1)):
            tokens += [sum(map(length, keys)) for keys in cache.fill(run)]
            sizes += [len(t.encode()) for t in run]
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text as the library counts them, with no shuffle at all.

    Two tiers inside each task: a broadcast table with the lengths of frequent chunks, taken
    from SAMPLE_ROWS rows and at most FREQUENT entries long, then the worker's own cache of
    chunks met since, at most ``chunks.MOST_CACHED`` entries, filled by the library. The table
    only saves time; it never changes a count. ``path``: a tokenizer file on every worker.

    Takes doc_id and text; returns (doc_id, n_bytes, n_tokens, over_limit), a row per input
    row. A null text counts as empty, with 0 tokens. Runs a job when called.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # take() reads no more partitions than it needs for the sample.
    taken = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).select("text").take(SAMPLE_ROWS)
    some = spark.createDataFrame(taken, "text string").repartition(8)
    found = some.mapInArrow(lambda b: _sampled(b, path), "chunk string, times long, length long")
    found = found.groupBy("chunk").agg(F.sum("times").alias("times"), F.max("length").alias("length"))
    top = found.orderBy(F.desc("times"), "chunk").limit(FREQUENT).collect()
    known = spark.sparkContext.broadcast({r.chunk: r.length for r in top})
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = docs.mapInArrow(lambda b: _counted(b, path, known), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
