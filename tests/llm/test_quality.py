from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    return rows


def test_held_out_accuracy_and_calibration(scored):
    held = [r for r in scored if r.held_out and r.quality is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == (r.score >= 0.3) for r in scored)
    good = [r.predicted for r in held if r.quality == 1]
    bad = [r.predicted for r in held if r.quality == 0]
    print(len(good), np.mean(good), len(bad), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.25
    assert abs(np.mean([r.score for r in held]) - np.mean([r.quality for r in held])) < 0.05


def test_isotonic_against_brute_force():
    draw = np.random.default_rng(4)
    y, w = draw.random(9), np.ones(9)
    knots, levels = quality.isotonic(np.arange(9.0), y, w)
    best = [max(min(np.mean(y[a : b + 1]) for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
    pools = {k: v for k, v in zip(knots, levels)}
    assert (np.diff([np.interp(i, knots, levels) for i in range(9)]) >= 0).all()
    assert len({round(b, 9) for b in best}) == len({round(v, 9) for v in pools.values()})


def test_fourier_features_approach_the_kernel():
    x = np.random.default_rng(5).normal(size=(30, 6))
    z = quality.fourier(x, 20_000)[:, :20_000]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 12)
    assert abs(z @ z.T - exact).max() < 0.05


def test_odd_rows(spark):
    rows = [(1, None, 5.0), (2, "", 5.0), (3, " \n", 5.0), (4, "word", 5.0), (5, "%%% " * 40_000, 5.0), (5, "again", 5.0), (None, "x", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (4, 1, 0), (4, 0, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns
