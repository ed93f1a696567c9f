from __future__ import annotations

import hashlib

import pytest
from brute import ASCII_LOWER
from pyspark.sql import functions as F

from ledgerloom.llm.exact_dedup import ascii_lower, exact_dedup, sha256

ROWS = [
    (1, "Same Text"), (9, "same text"), (5, "SAME TEXT"), (2, None), (3, ""), (4, "É"), (6, "é"), (7, "ΣAZ"), (8, "σaz"), (10, "x" * 100_000),
    (11, "X" * 100_000), (None, "alone"), (None, "same text"), (9, "SAME text"), (12, "Ⅰ"), (13, "ⅰ"), (14, "İ"), (15, "same texU"),
]


def _expected(rows):
    plain = [(t or "").translate(ASCII_LOWER) for _, t in rows]
    ids = {p: [d for (d, _), q in zip(rows, plain) if q == p] for p in plain}
    out = []
    for (d, _), p in zip(rows, plain):
        keep = max((x for x in ids[p] if x is not None), default=None)
        out.append((d, keep, len(ids[p]), hashlib.sha256(p.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak, per_batch, few", [(False, None, 1_000_000), (False, 1, 0), (True, 2, 1_000_000)])
def test_against_brute_force(spark, tmp_path, weak, per_batch, few):
    """With a weak digest, texts of one digest differ and are told apart by their bytes."""
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, kept int").repartition(5).write.parquet(path)
    digest = (lambda c: F.length(c).cast("string")) if weak else sha256
    found = exact_dedup(spark, path, digest, per_batch, few).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == _expected(ROWS)
    by = {}
    for r in found:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        assert [r.doc_id for r in group if r.kept] == [group[0].keep_id]


def test_one_file_and_no_rows(spark, tmp_path):
    import glob

    path = str(tmp_path / "one")
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(path)
    assert exact_dedup(spark, glob.glob(f"{path}/*.parquet")[0]).count() == len(ROWS)
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact_dedup(spark, path).collect() == []


def test_ascii_lower(spark):
    texts = [t for _, t in ROWS] + ["ÀÉabcXYZ", "ß", "Ǆ", "K", "日本A", "Ⓐ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(ascii_lower(F.col("text"))).collect()] == [(t or "").translate(ASCII_LOWER) for t in texts]
