"""Greedy string tiling of documents against benchmark items (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import shingles, text_slices, word_hashes, word_spans

# Words of the shortest tile, and of a seed.
SEED = 5
COVERAGE = 0.5
# Bytes of benchmark text in one block; more text means more blocks, each met by every document.
BLOCK_BYTES = 8 << 20

# Words are runs of ASCII letters, digits and non-ASCII bytes: punctuation separates.
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


class Index:
    """Seeds of a block of items, sorted by hash, with the item and place of each."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed, self.ids, self.lengths = seed, [i for i, _ in items], []
        hashes, owners, places = [], [], []
        column = pa.array([t for _, t in items], pa.string())
        for row, data, offsets in text_slices(column):
            starts, ends = word_spans(data, offsets, _APART)
            words, cuts = word_hashes(data, starts, ends), np.searchsorted(starts, offsets)
            for i in range(len(offsets) - 1):
                own = words[cuts[i] : cuts[i + 1]]
                self.lengths.append(len(own))
                if len(own) >= seed:
                    found = shingles(own, seed)
                    hashes.append(found)
                    owners.append(np.full(len(found), row + i))
                    places.append(np.arange(len(found)))
        empty = [np.zeros(0, np.uint64)]
        hashes = np.concatenate(hashes or empty)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners = np.concatenate(owners or empty).astype(np.int64)[order]
        self.places = np.concatenate(places or empty).astype(np.int64)[order]


def tiles(at: np.ndarray, place: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(start in text, start in item, words) of greedy tiles from all seeds shared by a text and an item.

    Seeds that follow each other in both make a match. The longest match is marked first (then
    the one that starts first in the item, then in the text); what marks leave of a match is a
    match again while it is no shorter than a seed.
    """
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(at))) + seed - 1
    heap = [(-n, p, a) for n, p, a in zip(length.tolist(), place[first].tolist(), at[first].tolist())]
    heapify(heap)
    in_text, in_item, out = set(), set(), []
    while heap:
        n, p, a = heappop(heap)
        free = [k for k in range(-n) if p + k not in in_item and a + k not in in_text]
        if len(free) == -n:
            in_item.update(range(p, p - n))
            in_text.update(range(a, a - n))
            out.append((a, p, -n))
            continue
        run = 0
        for j, k in enumerate(free):
            run += 1
            if j + 1 == len(free) or free[j + 1] != k + 1:
                if run >= seed:
                    heappush(heap, (-run, p + k - run + 1, a + k - run + 1))
                run = 0
    return out


def _matches(column: pa.Array, index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Of each text: (item id, marked words, words of the item, tiles) for items that share a seed."""
    out: list[list] = [[] for _ in range(len(column))]
    if not len(index.hashes):
        return out
    for row, data, offsets in text_slices(column):
        starts, ends = word_spans(data, offsets, _APART)
        words, cuts = word_hashes(data, starts, ends), np.searchsorted(starts, offsets)
        if len(words) < index.seed:
            continue
        rolling = shingles(words, index.seed)
        place = np.minimum(np.searchsorted(index.hashes, rolling), len(index.hashes) - 1)
        hits = np.flatnonzero(index.hashes[place] == rolling)
        text = np.searchsorted(cuts, hits, "right") - 1
        whole = hits + index.seed <= cuts[text + 1]
        hits, text = hits[whole], text[whole]
        upto = np.searchsorted(index.hashes, rolling[hits], "right")
        count = upto - place[hits]
        entry = np.repeat(place[hits] - np.cumsum(count) + count, count) + np.arange(count.sum())
        at, text = np.repeat(hits, count), np.repeat(text, count)
        owner, item_place = index.owners[entry], index.places[entry]
        order = np.lexsort((owner, text))
        at, text, owner, item_place = at[order], text[order], owner[order], item_place[order]
        edges = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else []
        for lo, hi in zip(edges, [*edges[1:], len(at)]):
            found = tiles(at[lo:hi], item_place[lo:hi], index.seed)
            marked = sum(n for _, _, n in found)
            out[row + text[lo]].append((index.ids[owner[lo]], marked, index.lengths[owner[lo]], len(found)))
    return out


MATCHES = "array<struct<item_id:long,marked:long,words:long,tiles:long>>"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``matches``: the tiling of every item that shares a seed with the text.

    The benchmark is a stated query set: it is cut into blocks of about ``block_bytes`` of
    text, each is broadcast as an index of its seeds, and the documents flow through one block
    after the other in a single scan, without a shuffle. Items shorter than a seed and null or
    empty texts match nothing; items with a null id are left out. Runs a job when called.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(held // block_bytes) + 1
    part = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    plain = [c for c in docs.columns if c != "matches"]
    out = docs.select(*plain, F.array().cast(MATCHES).alias("matches"))
    for block in range(blocks):
        rows = part.where(F.col("block") == block).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], seed))

        def tiled(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _matches(batch.column("text"), index.value)
                last = batch.schema.get_field_index("matches")
                if any(found):
                    names = ("item_id", "marked", "words", "tiles")
                    before = batch.column(last).to_pylist()
                    new = [b + [dict(zip(names, m)) for m in own] for b, own in zip(before, found)]
                    batch = batch.set_column(last, "matches", pa.array(new, batch.schema.field(last).type))
                yield batch

        out = out.mapInArrow(tiled, out.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, tiles, n_items) of every whole document.

    Coverage is the share of an item's words under tiles, in whatever order and place of the
    document they stand; a document is contaminated if it reaches ``coverage`` for some item.
    The item shown has the highest coverage, then the smallest id; it is null and coverage 0 if
    no item shares a seed. ``n_items`` counts items that reach ``coverage``.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = benchmark_matches(rows, benchmark, seed, block_bytes)
    share = F.transform("matches", lambda m: F.struct((m.marked / m.words).alias("c"), (-m.item_id).alias("i"), m.tiles.alias("t")))
    found = found.select("doc_id", share.alias("m")).withColumn("best", F.array_max("m"))
    return found.select(
        "doc_id",
        F.coalesce(F.col("best.c") >= coverage, F.lit(False)).alias("contaminated"),
        (-F.col("best.i")).alias("item_id"),
        F.coalesce(F.col("best.c"), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col("best.t"), F.lit(0)).cast("long").alias("tiles"),
        F.size(F.filter("m", lambda m: m.c >= coverage)).alias("n_items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that are not contaminated, with their columns; one scan and no shuffle."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    found = benchmark_matches(inner, benchmark)
    return found.where(~F.exists("matches", lambda m: m.marked >= coverage * m.words)).select("row.*")
