"""Kernel ridge quality scores from document statistics (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

from .words import LOWER, SPACE, text_slices, word_hashes, word_spans

FEATURES = 384
RIDGE = 1e-3
SEED = 11
# Score bins that the calibration is fitted on.
BINS = 2000
FOLDS = 5
REJECT_BELOW = 0.3

_KINDS = 6
_KIND = np.zeros(256, np.uint8)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 usual punctuation, 5 space
_KIND[97:123] = 1
_KIND[128:256] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[33, 34, 39, 44, 46, 58, 59, 63, 40, 41, 45]] = 4
_KIND[SPACE] = 5
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "other", "lower", "upper", "digit", "usual", "space", "word_length",
    "word_spread", "long_words", "one_letter", "distinct_words", "top_word", "repeated_pairs", "word_per_line",
    "ends_plain", "ends_sign", "bars", "exclaims", "upper_words", "first_other", "last_other", "worst_other", "worst_upper",
    "worst_repeat",
)
_WINDOW = 64  # words of a window for the worst part of a text


def _one(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[float]:
    """The statistics of one text from its bytes, word spans and word hashes."""
    n, m = len(data), len(starts)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = _KIND[data]
    share = np.bincount(kinds, minlength=_KINDS) / n
    lines = int((data == 10).sum()) + 1
    if not m:
        return [np.log1p(n), 0.0, np.log1p(lines), *share, *[0.0] * (len(STATISTICS) - 9)]
    length = ends - starts
    last, first = kinds[ends - 1], kinds[starts]
    counted = np.unique(hashes, return_counts=True)[1]
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    pair_kinds = len(np.unique(pairs)) / len(pairs) if m > 1 else 1.0
    upper_word = (first == 2) & (last != 1) & (length > 1)
    cuts = np.arange(0, m, _WINDOW)
    width = np.diff(np.append(cuts, m))
    odd = np.add.reduceat(((last == 0) | (first == 0)).astype(np.float64), cuts) / width
    high = np.add.reduceat(upper_word.astype(np.float64), cuts) / width
    again = np.sort(hashes[: m // _WINDOW * _WINDOW].reshape(-1, _WINDOW), axis=1)
    again = (again[:, 1:] == again[:, :-1]).mean(1).max() if len(again) else 1 - len(counted) / m
    return [
        np.log1p(n), np.log1p(m), np.log1p(lines), *share, length.mean(), length.std(), (length > 12).mean(),
        (length == 1).mean(), len(counted) / m, counted.max() / m, 1 - pair_kinds, np.log1p(m / lines), (last == 1).mean(),
        (last == 0).mean(), (data == 124).mean() * 100, (data == 33).mean() * 100, upper_word.mean(), odd[0], odd[-1],
        odd.max(), high.max(), again,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, data, offsets in text_slices(batch.column(1)):
            starts, ends = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            cuts = np.searchsorted(starts, offsets)
            for i in range(len(offsets) - 1):
                lo, own = offsets[i], slice(cuts[i], cuts[i + 1])
                rows.append(_one(data[lo : offsets[i + 1]], starts[own] - lo, ends[own] - lo, hashes[own]))
        values = pa.array(np.array(rows, np.float64).reshape(-1))
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every whole text; a null text counts as empty, whose statistics are 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_statistics, "doc_id long, stats array<double>")


def fold(doc_id: Column | str, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


@dataclass(frozen=True)
class Model:
    """Standardisation, random Fourier map, ridge weights and calibration; a few hundred kB."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def fourier(x: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """cos(x W + b): inner products approach a Gaussian kernel whose width is sqrt(dimension); then 1 and x."""
    draw = np.random.default_rng(SEED)
    w = draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], features))
    b = draw.uniform(0, 2 * np.pi, features)
    x = np.clip(x, -8, 8)
    return np.hstack([np.sqrt(2 / features) * np.cos(x @ w + b), np.ones((len(x), 1)), x / 8])


def _matrix(stats: pd.Series) -> np.ndarray:
    return np.array(stats.tolist(), np.float64).reshape(-1, len(STATISTICS))


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of equally long arrays (part, values), by two rounds so that no task holds all parts."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(key[0])], "values": [np.sum(np.stack(pdf["values"].to_list()), axis=0)]})

    first = parts.select((F.col("part") % 32).alias("part"), "values").groupBy("part").applyInPandas(add, parts.schema)
    rows = first.collect()
    return np.sum([np.array(r["values"]) for r in rows], axis=0) if rows else np.zeros(width)


def _partial(make, width: int):
    """One row per task: the sum of ``make(matrix, labels)`` over its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += make(_matrix(pdf["stats"]), pdf["label"].to_numpy(np.float64))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "values": [total]})

    return run


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted scores: (score, level) of both ends of every pool."""
    pools: list[list[float]] = []  # weight, sum, lowest score, highest score
    for s, y, w in zip(scores, labels, weights):
        pools.append([w, y, s, s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, y2, _, high = pools.pop()
            pools[-1][0] += w2
            pools[-1][1] += y2
            pools[-1][3] = high
    knots = np.array([s for p in pools for s in p[2:]])
    # One good and one bad row are added to each pool's share, so that no level is 0 or 1 on little evidence.
    levels = np.array([(p[1] + 0.5) / (p[0] + 1) for p in pools for _ in range(2)])
    return knots, np.maximum.accumulate(levels)


def fit(labelled: DataFrame) -> Model:
    """Fit on staged rows (part, stats, label): ``part`` 0 for the ridge, 1 for the calibration.

    Three passes over the statistics of labelled rows: moments, normal equations of the
    Fourier features, and counts of labels in bins of the ridge score. Each task passes on one
    array of fixed size. Without any labelled row every score is 0.5.
    """
    d, n_features = len(STATISTICS), FEATURES + 1 + len(STATISTICS)
    schema = "part long, values array<double>"
    ridge = labelled.where("part = 0")

    def moments(x, y):
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = summed(ridge.mapInPandas(_partial(moments, 1 + 2 * d), schema), 1 + 2 * d)
    n = max(sums[0], 1.0)
    mean = sums[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(sums[1 + d :] / n - mean**2, 1e-12))
    model = Model(mean, np.where(scale < 1e-5, 1.0, scale), np.zeros(n_features), np.array([0.0]), np.array([0.5]))
    if not sums[0]:
        return model

    def equations(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).reshape(-1), z.T @ y])

    width = n_features * n_features + n_features
    sums = summed(ridge.mapInPandas(_partial(equations, width), schema), width)
    gram = sums[:-n_features].reshape(n_features, n_features) + RIDGE * n * np.eye(n_features) / FEATURES
    model = Model(model.mean, model.scale, np.linalg.solve(gram, sums[-n_features:]), model.knots, model.levels)

    def binned(x, y):
        at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    sums = summed(labelled.where("part = 1").mapInPandas(_partial(binned, 2 * BINS), schema), 2 * BINS)
    used = np.flatnonzero(sums[:BINS])
    if len(used):
        centres = (used + 0.5) / BINS * 2 - 0.5
        knots, levels = isotonic(centres, sums[BINS:][used], sums[:BINS][used])
        model = Model(model.mean, model.scale, model.weights, knots, levels)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_BELOW) -> DataFrame:
    """Calibrated share of good documents among those that look like this one.

    Statistics of each whole text are taken in one pass and staged (27 numbers a document).
    Rows of ``labels`` (doc_id, quality) whose fold is not 0 train the model: folds 1 to 3 the
    ridge on random Fourier features, fold 4 the isotonic calibration. Labels join on doc_id
    with the statistics, not with texts.

    Returns (doc_id, held_out, score, predicted), a row per input row. Null and empty texts
    get the score of statistics 0. Null labels and labels of unknown documents are left out;
    repeated labels count each; a null doc_id is scored and not held out. Runs jobs when called.
    """
    stats = stage(document_statistics(docs), "statistics")
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.withColumn("fold", fold("doc_id")).where("fold <> 0")
    labelled = stats.join(known, "doc_id").select(F.when(F.col("fold") == FOLDS - 1, 1).otherwise(0).alias("part"), "stats", "label")
    model = stats.sparkSession.sparkContext.broadcast(fit(stage(labelled, "labelled")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(values))], ["doc_id", "score"])

    held = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return stats.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_BELOW) -> DataFrame:
    """The documents that the classifier does not reject, with their columns. A repeated doc_id is judged by its best row."""
    scores = quality_scores(docs, labels, threshold)
    rejected = scores.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0 and doc_id is not null")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)
