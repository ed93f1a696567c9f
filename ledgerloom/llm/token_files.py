"""Token ids of documents as Huffman-coded block files (operator 3).

A dataset is a folder with two Parquet tables, so any store that Spark reaches can hold it:

``codes``  (id, length): the canonical code, fixed by its lengths.
``blocks`` (file, block, doc_ids, doc_tokens, n_tokens, offset, checkpoints, payload): runs of
documents in ascending doc_id order. ``file`` ascends with doc_id, ``block`` within a file;
``offset`` counts the ids before the block in its file. ``payload`` is the block's bit stream,
first bit highest, padded to 32-bit words; ``checkpoints`` are little-endian 32-bit bit
offsets, one every 128 tokens. A block is decoded without any other.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder, stage

from . import huffman
from .chunks import tokenizer
from .id_cache import IdCache
from .token_counts import text_runs

END_ID = 2
CODE_LIMIT = 18
BLOCK_TOKENS = 1 << 18
# Bytes of staged ids a file of blocks is made from.
FILE_BYTES = 128 << 20

_caches: dict[str, IdCache] = {}


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Ids of each text, two bytes each where all fit, else four."""
    wide = max(tokenizer(path).get_vocab_size(), end + 1) > 1 << 16
    dtype = "<u4" if wide else "<u2"
    if path not in _caches or _caches[path].dtype != np.dtype(dtype):
        _caches[path] = IdCache(path, dtype)
    cache, tail = _caches[path], np.array([end], dtype).tobytes()
    for batch in batches:
        at = 0
        for run in text_runs(batch.column(1)):
            raw = [x + tail for x in cache.ids(run)]
            ids = batch.column(0).slice(at, len(run))
            yield pa.RecordBatch.from_arrays([ids, pa.array([wide] * len(raw)), pa.array(raw, pa.binary())], ["doc_id", "wide", "ids"])
            at += len(run)


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for wide, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.bincount(_ids(raw.as_buffer(), wide))
            if len(found) > len(total):
                total, found = found.astype(np.int64), total
            total[: len(found)] += found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "times"])


def _blocks(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    codes = huffman.canonical_codes(lengths)
    file, block, offset = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    parts: list[np.ndarray] = []
    held = 0

    def closed() -> pa.RecordBatch:
        payload, checkpoints = huffman.encode(np.concatenate(parts).astype(np.int64), codes, lengths)
        sizes = [len(p) for p in parts]
        values = [[file], [block], [docs], [sizes], [held], [offset], [checkpoints.astype("<u4").tobytes()], [payload]]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, types)],
            ["file", "block", "doc_ids", "doc_tokens", "n_tokens", "offset", "checkpoints", "payload"],
        )

    for batch in batches:
        for doc, wide, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            docs.append(doc)
            parts.append(_ids(raw.as_buffer(), wide).copy())
            held += len(parts[-1])
            if held >= most:
                yield closed()
                block, offset = block + 1, offset + held
                docs, parts, held = [], [], 0
    if docs:
        yield closed()


BLOCKS = (
    "file int, block int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, offset long, "
    "checkpoints binary, payload binary"
)


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of every whole text, each followed by ``end``, as a dataset in ``folder``.

    Three steps: encode once and stage the raw ids; count all ids, at most one row per id of
    the vocabulary from each task; deal the staged ids by doc_id ranges, sort each and write
    its blocks. Repeated doc_ids stay as rows, in an order that their ids fix; null doc_ids come first;
    null text counts as empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = stage(docs.mapInArrow(lambda b: _tokenized(b, path, end), "doc_id long, wide boolean, ids binary"), "token-ids", "zstd")
    counted = raw.select("wide", "ids").mapInArrow(_histogram, "id long, times long")
    counted = counted.groupBy("id").agg(F.sum("times").alias("times")).collect()
    counts = np.zeros(max([r.id for r in counted], default=end) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.times
    # Codes of the limit's length suffice for 2 ** CODE_LIMIT used ids; more ids get longer ones.
    lengths = huffman.code_lengths(counts, max(CODE_LIMIT, int(np.count_nonzero(counts)).bit_length()))
    listed = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(listed, "id long, length int").coalesce(1).write.parquet(f"{folder}/codes")
    held = raw.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // FILE_BYTES + 1)
    # Rows under one doc_id spread over ranges: by a hash of their ids, equal ones by their place in the staged table.
    tagged = raw.withColumns({"_hash": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    dealt = tagged.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "wide", "ids")
    dealt.mapInArrow(lambda b: _blocks(b, lengths, block_tokens), BLOCKS).write.parquet(f"{folder}/blocks")


def _decoded(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, bases: dict[int, int], digest: bool) -> Iterator[pa.RecordBatch]:
    table = huffman.decode_table(lengths)
    names = ["file", "doc_ids", "doc_tokens", "n_tokens", "offset", "checkpoints", "payload"]
    for batch in batches:
        for i in range(len(batch)):
            file, docs, sizes, n, offset, checkpoints, payload = (batch.column(c)[i].as_py() for c in names)
            ids = huffman.decode(payload, np.frombuffer(checkpoints, "<u4"), n, table)
            cuts = np.cumsum([0, *sizes])
            own = [ids[a:b].astype("<u4") for a, b in zip(cuts[:-1], cuts[1:])]
            starts = pa.array(cuts[:-1] + (bases[file] + offset), pa.int64())
            if digest:
                last = pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())
            else:
                last = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
            columns = [pa.array(docs, pa.int64()), starts, pa.array(sizes, pa.int64()), last]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a dataset; ``digest``: ids_crc32 in place of ids.

    ``start`` is how many ids stand before the document in the whole dataset. Blocks are
    decoded side by side; only the codes and one number per file go through the driver.
    """
    listed = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max([r.id for r in listed], default=0) + 1, np.int64)
    for r in listed:
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()
    bases, before = {}, 0
    for r in totals:
        bases[r.file], before = before, before + r.n
    last = "ids_crc32 long" if digest else "ids array<long>"
    return blocks.drop("block").mapInArrow(
        lambda b: _decoded(b, lengths, bases, digest), f"doc_id long, start long, n_tokens long, {last}"
    )


def token_file_digests(docs: DataFrame, path: str, end: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new dataset in the shared folder and return what its files hold, as digests."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path, end)
    return read_token_files(spark, folder, digest=True)
