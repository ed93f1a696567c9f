"""Collocations: phrases of two and three words, mined shard by shard and counted exactly.

Documents are dealt into a few shards. A phrase with the asked support in the whole
corpus has its even share of it in one shard at least, so the phrases frequent in some
shard hold all frequent ones. A shard is mined by levels: words, pairs of its frequent
words, triples of its frequent pairs. Mining knows phrases by 64-bit hashes, which can
only add candidates. The phrases found anywhere are then counted over all texts, by
their words. What is frequent reaches the tasks as a bitmap of fixed size; its false hits
are counted and fall out at the support, so it saves work and never changes a count.

The support is a fixed number, so more shards than that would lower a shard's own to one
and prune nothing; a shard is not a task but a part of the corpus that all tasks mine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import counted_join
from ..session import stage
from .words import LOWER, mix, text_slices, word_hashes, word_spans

SUPPORT = 10
SHARDS = 3
KEEP_BELOW = 50
TOP = 2000
LONGEST = 3
SCALE = 1_000_000
# Bits of a bitmap of frequent phrases: 16 MB however many phrases there are.
FILTER_BITS = 27
# Bits of one row of the bitmap, as the built-in aggregate makes it.
_BUCKET = 1 << 15
# Bytes of text that a task works on at a time.
_SLICE = 1 << 19

# Bytes that end a piece, and those that end a word besides.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _SEPARATOR.copy()
_GAP[list(b" \t")] = True
_UNKNOWN = "und"

_STEP = np.uint64(0xD6E8FEB86659FD93)
_SHARD = 0x5BD1E9955BD1E995

_MINED = "shard int, key long, times long"
_COUNTS = "lang string, phrase string, words int, times long"


class _Words:
    """The words of some texts: where they stand, their texts' rows, and which follow the one before in a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = data
        self.starts, self.ends = word_spans(data, offsets, _GAP)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        before = np.cumsum(_SEPARATOR[data], dtype=np.int64)[self.starts] if len(data) else self.starts
        self.follows = (self.row[1:] == self.row[:-1]) & (before[1:] == before[:-1])
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.langs = langs[self.row]

    def keys(self, size: int, at: np.ndarray) -> np.ndarray:
        """Hash of language and ``size`` words from each place on."""
        with np.errstate(over="ignore"):
            total = self.langs[at] + np.uint64(size)
            for i in range(size):
                total = total * _STEP + self.hashes[at + i]
            return mix(total)

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Number of each word and the texts by number."""
        inside = LOWER[self.data][~_GAP[self.data]]
        ends = np.r_[0, np.cumsum(self.ends - self.starts)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(inside)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _of_shard(keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
    return (keys ^ (shards.astype(np.uint64) * np.uint64(_SHARD))).view(np.int64)


def _passes(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(keys), bool)
    at = keys & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[_Words, np.ndarray, pa.Array, np.ndarray]]:
    """Words, shard of each text, names of the languages and number of each text's language."""
    langs = batch.column("lang").dictionary_encode()
    names = langs.dictionary.cast(pa.large_binary())
    data = np.frombuffer(b"".join(names.to_pylist()), np.uint8)
    ends = np.cumsum([len(x) for x in names.to_pylist()], dtype=np.int64)
    sizes = np.diff(np.r_[0, ends])
    filled = sizes > 0
    hashes = np.zeros(len(names), np.uint64)
    hashes[filled] = word_hashes(data, (ends - sizes)[filled], ends[filled])
    codes = langs.indices.to_numpy().astype(np.int64)
    shards = batch.column("shard").to_numpy()
    for row, text, offsets in text_slices(batch.column("text"), _SLICE):
        own = slice(row, row + len(offsets) - 1)
        yield _Words(text, offsets, hashes[codes[own]]), shards[own], langs.dictionary, codes[own]


def _places(words: _Words, size: int, passes) -> np.ndarray:
    """Where phrases of ``size`` words stand whose parts one word shorter all pass."""
    at = np.arange(len(words.starts))
    for shorter in range(1, size):
        good = np.zeros(len(words.starts) + 1, bool)
        good[at[passes(words.keys(shorter, at), at)]] = True
        at = np.flatnonzero(good[:-1] & good[1:] & np.r_[words.follows, False])
    return at


def _mined(docs: DataFrame, level: int, bits) -> DataFrame:
    """Occurrences ``shard, key, times`` of the phrases of ``level`` words whose parts are in the bitmap."""

    def count(batches):
        bitmap = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for words, shards, _, _ in _slices(batch):
                of = shards[words.row]
                at = _places(words, level, lambda keys, at: _passes(bitmap, _of_shard(keys, of[at])))
                keys, first, times = np.unique(_of_shard(words.keys(level, at), of[at]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(of[at[first]]), pa.array(keys), pa.array(times)], names=["shard", "key", "times"])

    return docs.mapInArrow(count, _MINED).groupBy("shard", "key").agg(F.sum("times").alias("times"))


def _counted(docs: DataFrame, bits) -> DataFrame:
    """Exact counts ``lang, phrase, words, times`` of the phrases in the bitmap; the empty phrase counts all words."""

    def count(batches):
        bitmap = np.frombuffer(bits.value, np.uint8)

        def passes(keys, at=None):
            return _passes(bitmap, keys.view(np.int64))

        def rows(langs, phrases, size, times):
            columns = [langs, phrases, pa.array(np.full(len(times), size, np.int32)), pa.array(times.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "times"])

        for batch in batches:
            for words, _, langs, codes in _slices(batch):
                lang = codes[words.row]
                seen, total = np.unique(lang, return_counts=True)
                yield rows(langs.take(pa.array(seen)), pa.array([""] * len(seen)), 0, total)
                ids, names = words.ids()
                for size in range(1, LONGEST + 1):
                    at = _places(words, size, passes)
                    at = at[passes(words.keys(size, at))]
                    # A phrase as one number: that of its first words, put together with its last.
                    keys = ids[at] * len(langs) + lang[at]
                    for i in range(1, size):
                        keys = np.unique(keys, return_inverse=True)[1] << 32 | ids[at + i]
                    _, first, times = np.unique(keys, return_index=True, return_counts=True)
                    first = at[first]
                    parts = [names.take(pa.array(ids[first + i])) for i in range(size)]
                    phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.string())
                    yield rows(langs.take(pa.array(lang[first])), phrases, size, times)

    return docs.mapInArrow(count, _COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("times").alias("times"))


def _bitmap(keys: DataFrame):
    """Broadcast bitmap of the lowest bits of ``key``; its 2 ** FILTER_BITS bits are all that reaches the driver."""
    at = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = keys.select(at.alias("at")).select(F.shiftright("at", 15).alias("bucket"), (F.col("at") % _BUCKET).alias("bit"))
    whole = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        whole[row.bucket * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _replaced(old, new):
    """Executors need only one bitmap at a time; a lost one fetches it again."""
    if old is not None:
        old.unpersist()
    return new


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Exact counts ``lang, phrase, words, times`` of all phrases of one to three words with ``support``, and words per language.

    A null language counts as ``und``, a null text as empty; rows alike count each. Columns
    other than ``doc_id``, ``lang`` and ``text`` are not looked at. Texts are taken in
    slices; one text is not cut, so it must fit a task. Runs jobs when called.
    """
    local = -(-support // shards)
    texts = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_UNKNOWN)).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found, bits = [], None
    for level in range(1, LONGEST + 1):
        frequent = _mined(texts, level, bits).where(F.col("times") >= local)
        found.append(stage(frequent.select("shard", "key"), f"phrases-{level}"))
        if level < LONGEST:
            bits = _replaced(bits, _bitmap(reduce(DataFrame.unionByName, found)))
    shard = F.element_at(F.array(*[F.lit(_signed(n * _SHARD)) for n in range(shards)]), F.col("shard") + 1)
    candidates = reduce(DataFrame.unionByName, found).select(F.col("key").bitwiseXOR(shard).alias("key"))
    # No phrase with the support is missing from the bitmap, so those that it lets through by chance fall out here.
    counted = _counted(texts, _replaced(bits, _bitmap(candidates))).where((F.col("times") >= support) | (F.col("words") == 0))
    counted = stage(counted, "phrase-counts")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("times").alias("n"))


def _signed(number: int) -> int:
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)


def _score(a: Column, left: Column, right: Column) -> Column:
    """Exact quotient of numbers that may pass 64 bits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (a * a), left * right)


def collocations(
    docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, keep_below: int = KEEP_BELOW, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut.

    ``lang, rank, phrase, a, l, r, n, score``: counts of the phrase, of both parts at the
    cut and of all words of the language. A phrase inside a longer one with ``keep_below``
    percent of its count or more is left out. Counts are exact up to 10 ** 15.
    """
    frequent, totals = frequent_phrases(docs, support, shards)
    words = F.split("phrase", " ")
    longer = frequent.where("words > 2").select(
        "lang", F.explode(F.array(_join(words, 1, 2), _join(words, 2, 2))).alias("phrase"), F.col("times").alias("longer")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = (
        frequent.where("words > 1")
        .join(longer, ["lang", "phrase"], "left")
        .where(F.coalesce(F.col("longer") * 100 < F.col("times") * keep_below, F.lit(True)))
    )
    cuts = F.expr("sequence(1, words - 1)")
    cut = kept.select("lang", "phrase", "words", F.col("times").alias("a"), F.explode(cuts).alias("k"))
    length = F.col("words") - F.col("k")
    cut = cut.withColumn("first", _join(words, 1, F.col("k"))).withColumn("rest", _join(words, F.col("k") + 1, length))
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("times").alias("part_times"))
    for part, name in (("first", "l"), ("rest", "r")):
        cut = stage(cut.withColumnRenamed(part, "part"), "phrase-cuts")
        cut = counted_join(cut, parts, ["lang", "part"]).withColumnsRenamed({"part_times": name}).drop("part")
    scored = cut.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best))
    return (
        ranked.where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )


def _join(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, length), " ")


# The same rows, counted at one go.
ORACLE = r"""
with tokens as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]|[^ \x09.,;:!?\x0A-\x0D]+')) as w,
    generate_subscripts(regexp_extract_all(coalesce(text, ''), '[.,;:!?\x0A-\x0D]|[^ \x09.,;:!?\x0A-\x0D]+'), 1) as i
  from documents
),
near as (
  select lang, w as w1, lead(w) over d as w2, lead(w, 2) over d as w3 from tokens window d as (partition by doc_id, lang order by i)
),
mark as (select *, regexp_matches(w1, '^[.,;:!?\x0A-\x0D]$') as s1, regexp_matches(w2, '^[.,;:!?\x0A-\x0D]$') as s2,
  regexp_matches(w3, '^[.,;:!?\x0A-\x0D]$') as s3 from near),
f as (
  select lang, 1 as len, w1 as phrase, count(*) as f from mark where not s1 group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from mark where not s1 and not s2 group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from mark where not s1 and not s2 and not s3 group by all
),
cand as (select lang, len, phrase, f as a, string_split(phrase, ' ') as p from f where len > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.len, c.a, k.k, l.f as l, r.f as r,
    (1000000::hugeint * a * a // (l.f::hugeint * r.f))::bigint as score
  from cand c join (values (1), (2)) as k(k) on k.k < c.len
    join f l on l.lang = c.lang and l.phrase = array_to_string(p[1:k.k], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(p[k.k + 1:], ' ')
),
weak as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(p[1:2], ' ') as phrase, a from cand where len = 3
  union all select lang, array_to_string(p[2:3], ' '), a from cand where len = 3
),
kept as (
  select weak.* from weak left join (select lang, phrase, max(a) as longer from inside group by all) i using (lang, phrase)
  where coalesce(100 * longer < 50 * a, true)
),
totals as (select lang, sum(f)::bigint as n from f where len = 1 group by all),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
