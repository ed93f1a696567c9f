"""Exact Jaccard join of documents on their word shingles (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage, stage_last

from .regions import linked_components
from .words import texts_of_words

WORDS = 5
PERCENT = 75
# Shingles in this many texts of one slice may be common; so many of the commonest come last in the order.
COMMON_IN_SLICE = 2
COMMON = 1 << 17
# How far back an item's earlier buckets are kept beside each of its buckets.
BEFORE = (1, 2)
# Rows up to which a table of ids or shingles is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per text its set's size and 128-bit digest; per run of rows the shingles that repeat in it."""
    for batch in batches:
        ids, n, d1, d2 = batch.column(0), [], [], []
        seen: dict[tuple, np.ndarray] = {}
        held = 0

        def repeated():
            found, counts = np.unique(np.concatenate(list(seen.values()) or [np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= COMMON_IN_SLICE
            return found[often].view(np.int64), counts[often]

        common = []
        for _, _, own in texts_of_words(batch.column(1), size):
            n.append(len(own))
            d1.append(int(own.sum(dtype=np.uint64).view(np.int64)))
            d2.append(int(np.bitwise_xor.reduce(own * np.uint64(0x9FB21C651E98DF25)).view(np.int64)) if len(own) else 0)
            if (n[-1], d1[-1], d2[-1]) not in seen:
                seen[n[-1], d1[-1], d2[-1]] = own
                held += len(own)
            if held > 1 << 20:
                common.append(repeated())
                seen, held = {}, 0
        common.append(repeated())
        lists = [None] * len(n), [None] * len(n)
        if n:
            lists[0][0] = np.concatenate([c[0] for c in common]).tolist()
            lists[1][0] = np.concatenate([c[1] for c in common]).tolist()
        columns = [ids, n, d1, d2, pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns],
            ["doc_id", "n_shingles", "d1", "d2", "common", "times"],
        )


def prefix_length(n: int, percent: int) -> int:
    """So many of a set's first shingles, in any order common to all sets, meet every linked set's.

    A linked set shares at least ``percent`` of this one's shingles.
    """
    return n - -(-n * percent // 100) + 1 if n else 0


def bitmap(own: np.ndarray) -> np.ndarray:
    """A bit for each of at least as many hash classes as the set has shingles, in 64-bit words.

    Classes are a power of two, so a map of twice the size folds onto it by OR of its halves.
    """
    size = max(64, 1 << int(max(len(own), 1) - 1).bit_length())
    there = np.zeros(size, bool)
    there[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(there, bitorder="little").view(np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A set's first shingles: rare ones by hash, then common ones. ``common``: hashes, by hash; ranks."""
    hashes, ranks = common
    for batch in batches:
        out, sums, maps, sizes = [], [], [], []
        for _, _, own in texts_of_words(batch.column(1), size):
            sums.append(int(own.sum(dtype=np.uint64).view(np.int64)))
            maps.append(bitmap(own))
            sizes.append(len(own))
            length = prefix_length(len(own), percent)
            if len(hashes) and length:
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                known = hashes[at] == own
                last = own[known][np.argsort(ranks[at[known]], kind="stable")]
                own = np.concatenate([own[~known], last])
            out.append(own[:length])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), _lists(out), _lists(maps), pa.array(sizes, pa.int64())], ["doc_id", "d1", "prefix", "bits", "n"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _lists([own for _, _, own in texts_of_words(batch.column(1), size)])], ["id", "hashes"]
        )


def _may_be_near(percent: int) -> str:
    """Whether the bitmaps ma and mb of sets with na and nb shingles leave room for the similarity.

    Every class that only one of the sets has stands for a shingle that only this set has, and
    linked sets differ in at most (na + nb) (1 - t) / (1 + t) shingles.
    """

    def folded(x: str, y: str) -> str:
        half = f"size({y})"
        both = f"zip_with(slice({x}, 1, {half}), slice({x}, {half} + 1, {half}), (p, q) -> p | q)"
        return f"if(size({x}) = 2 * {half}, {both}, {x})"

    apart = f"zip_with({folded('ma', 'mb')}, {folded('mb', 'ma')}, (p, q) -> bit_count(p ^ q))"
    # Maps of other sizes than these would give null words.
    return f"coalesce(aggregate({apart}, 0, (s, v) -> s + v) * {100 + percent} <= (na + nb) * {100 - percent}, true)"


def _met_before() -> Column:
    """Whether two items of a bucket also share one of the buckets just before it in both their orders.

    The order is that of the sets' shingles. Such a pair is left to that earlier bucket. The first bucket that two items share never
    passes it on, and every bucket goes on until it holds one component, so no link is lost.
    """
    same = [F.coalesce(F.col(f"a_before{i}") == F.col(f"b_before{j}"), F.lit(False)) for i in BEFORE for j in BEFORE]
    return reduce(or_, same)


def _rest_suffices(percent: int) -> Column:
    """Whether two sets that share no shingle before a bucket's can still share enough.

    Both sets are in one order, so all that they share stands from the bucket's shingle on.
    The first bucket of a pair is judged rightly by this, and no other needs to be.
    """
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return rest * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent


def _any_suffices(percent: int) -> Column:
    """Whether an item may share enough, from a bucket's shingle on, with any item that the bucket holds.

    Its own rest and the smallest set that could be linked with it bound what :func:`_rest_suffices` asks of a pair.
    """
    other = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    return (F.col("n") - F.col("at")) * (100 + percent) >= (F.col("n") + other) * percent


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast only up to ``limit`` counted rows."""
    return F.broadcast(table) if table.count() <= limit else table


def _linked(docs: DataFrame, items: DataFrame, common: Broadcast, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """(id, comp) of the items with links. ``common``: as in :func:`_prefixes`."""
    named = docs.where("doc_id is not null")
    prefixes = named.mapInArrow(
        lambda b: _prefixes(b, words, percent, common.value), "doc_id long, d1 long, prefix array<long>, bits array<long>, n long"
    )
    prefixes = stage(prefixes.where("size(prefix) > 0"), "prefixes")
    # Both uses of the dealt rows read all their columns, so that one exchange serves both.
    rows = prefixes.select("doc_id", "d1", F.posexplode("prefix").alias("at", "bucket")).repartition("bucket")
    shared = rows.groupBy("bucket").agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.max(F.struct("doc_id", "at")).alias("last"))
    shared = shared.where("low <> high and last.doc_id is not null and last.at >= 0").select("bucket", "low", "high")
    members = rows.join(shared, "bucket").where("d1 between low and high").select("bucket", "doc_id", "at")
    # Equal sets meet in the same buckets: only the item's own row stays.
    own = items.select(F.col("id").alias("doc_id"), F.col("n_shingles").alias("n"))
    members = members.join(own, "doc_id").select("bucket", F.col("doc_id").alias("id"), "n", "at")
    # Dealt by id once, for the distinct rows and for the buckets before each.
    order = Window.partitionBy("id").orderBy("at", "bucket")
    members = members.repartition("id").distinct()
    members = stage(members.withColumns({f"before{i}": F.lag("bucket", i).over(order) for i in BEFORE}), "members")

    wanted = stage(members.select("id").distinct(), "wanted")
    maps = prefixes.join(small(wanted, broadcast_rows), prefixes["doc_id"] == wanted["id"], "left_semi")
    maps = stage(maps.groupBy(F.col("doc_id").alias("id")).agg(F.min("bits").alias("bits"), F.min("n").alias("n")), "bitmaps")

    def measure(pairs: DataFrame) -> DataFrame:
        a, b = maps.toDF("a", "ma", "na"), maps.toDF("b", "mb", "nb")
        near = stage(pairs.join(a, "a").join(b, "b").where(_may_be_near(percent)).select("a", "b"), "near-pairs")
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        few = F.broadcast(ids) if near.count() * 2 <= broadcast_rows else ids
        texts = named.join(few, named["doc_id"] == ids["id"], "left_semi")
        sets = stage(texts.mapInArrow(lambda t: _sets(t, words), "id long, hashes array<long>"), "sets")
        a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        both = near.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        both = both.withColumn("union", F.size("sa") + F.size("sb") - F.col("common"))
        dist = (1 - F.col("common") / F.col("union")).alias("dist")
        return both.select("a", "b", dist, (100 * F.col("common") >= percent * F.col("union")).alias("linked"))

    possible = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & _rest_suffices(percent) & ~_met_before()
    return linked_components(
        members, measure, possible, 1 - percent / 100, "regions", F.col("before1").isNull(), "before1", "at", "n", _any_suffices(percent)
    )[0]


def ngram_jaccard(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents whose shingle sets have a Jaccard similarity of ``percent`` or more, as components.

    1 - similarity is a metric, and the join works on it. Equal sets become one item. Items
    that share a rare shingle form a region: an item is put into a region for each of the
    first n - ceil(n * percent / 100) + 1 shingles of its set, in one order for all, which
    holds a region of every item within the distance. Regions elect pivots, measure exact
    distances to them, skip pairs that the triangle inequality rules out and recurse without
    the pivot (``regions.linked_components``). Common shingles come last in the order, so
    passages in many documents make no regions; what counts as common changes cost only.
    Before whole sets are fetched, a bitmap of each set rules out pairs that differ too much.

    Takes doc_id and text; returns (doc_id, n_shingles, component_id), a row per input row.
    Null and empty texts have no shingles and are alone; a null doc_id gets a row and a null
    component and links nothing. Rows that share a doc_id are judged each by its own set; two
    sets whose smallest doc_id is the same are one item. Runs jobs when called.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, common array<long>, times array<long>"
    prints = stage(docs.mapInArrow(lambda b: _fingerprints(b, words), schema), "fingerprints")

    listed = prints.where("common is not null").select(F.explode(F.arrays_zip("common", "times")).alias("x"))
    listed = listed.groupBy(F.col("x.common").alias("hash")).agg(F.sum("x.times").alias("times"))
    listed = listed.orderBy(F.desc("times"), "hash").limit(COMMON).select("hash").toArrow()
    found = listed.column("hash").to_numpy()[::-1].copy().view(np.uint64)
    by_hash = np.argsort(found)
    common = spark.sparkContext.broadcast((found[by_hash], by_hash))

    key = ["n_shingles", "d1", "d2"]
    some = prints.where("n_shingles > 0 and doc_id is not null")
    items = stage(some.groupBy(*key).agg(F.min("doc_id").alias("id")), "items")

    # Prefixes, sets and regions are as large as the texts and not read again once the components are known.
    comp = stage_last(spark, lambda: _linked(docs, items, common, words, percent, broadcast_rows), "components")
    groups = items.join(comp, "id", "left").select(*key, F.coalesce("comp", "id").alias("class"))
    result = prints.select("doc_id", *key).join(groups, key, "left")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))
