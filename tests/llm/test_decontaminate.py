from __future__ import annotations

import random
import re

import numpy as np
from ledgerloom.llm.decontaminate import decontaminate, keep_clean, tiles

SF = "/root/testdata/sf0.01"


def _words(text):
    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text or "")


def _lower(words):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]


def naive_marks(text, item, seed):
    """Greedy string tiling by comparing every pair of unmarked positions again and again."""
    in_text, in_item = set(), set()
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for a in range(len(text)):
                n = 0
                while p + n < len(item) and a + n < len(text) and item[p + n] == text[a + n] and p + n not in in_item and a + n not in in_text:
                    n += 1
                if n > best[0]:
                    best = (n, p, a)
        if best[0] < seed:
            return len(in_item)
        in_item.update(range(best[1], best[1] + best[0]))
        in_text.update(range(best[2], best[2] + best[0]))


def test_tiles_against_naive():
    draw = random.Random(8)
    for _ in range(300):
        item, text = (draw.choices("abc", k=draw.randrange(4, 16)) for _ in range(2))
        if draw.random() < 0.5:
            text = text[:5] + item[6:] + item[:6] + text[5:]
        seeds = [(a, p) for a in range(len(text) - 2) for p in range(len(item) - 2) if text[a : a + 3] == item[p : p + 3]]
        at, place = (np.array(x, np.int64) for x in zip(*seeds)) if seeds else (np.zeros(0, np.int64),) * 2
        assert sum(n for *_, n in tiles(at, place, 3)) == naive_marks(text, item, 3)


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: _lower(_words(r.text)) for r in benchmark.collect()}
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        w = _lower(_words(r.text))
        grams = {tuple(w[i : i + 5]): i for i in range(len(w) - 4)}
        shared = [i for i, x in items.items() if any(tuple(x[k : k + 5]) in grams for k in range(len(x) - 4))]
        scores = sorted((-naive_marks(w, items[i], 5) / len(items[i]), i) for i in shared)
        expected[r.doc_id] = (bool(scores) and scores[0][0] <= -0.5, scores[0][1] if scores else None, -scores[0][0] if scores else 0.0)
    for size in (8 << 20, 4000):
        found = {r.doc_id: (r.contaminated, r.item_id, r.coverage) for r in decontaminate(docs, benchmark, block_bytes=size).collect()}
        assert found == expected
    assert sum(x[0] for x in expected.values()) > 5
    assert keep_clean(docs, benchmark).count() == sum(not x[0] for x in expected.values())


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "eta THETA, iota kappa lambda mu! other words here alpha beta gamma delta epsilon zeta"
    rows = [(1, item, 0), (2, moved, 0), (3, None, 0), (4, "", 0), (5, "alpha beta gamma delta", 0), (None, item, 0), (6, "x " * 60_000 + item, 0), (6, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (None, item, 1), (9, "alpha", 1), (3, item + " x y", 1)], "item_id long, text string, doc_id int")
    found = sorted(map(tuple, decontaminate(docs, bench).collect()), key=repr)
    hit = (True, 7, 1.0)
    assert [(r[0], *r[1:4]) for r in found if r[0] in (1, 2, None) or (r[0] == 6 and r[1])] == sorted([(1, *hit), (2, *hit), (6, *hit), (None, *hit)], key=repr)
    assert [r[1:] for r in found if r[0] in (3, 4, 5)] == [(False, None, 0.0, 0, 0)] * 3
    assert {r[4] for r in found if r[0] == 2} == {2}
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate(docs.limit(0), bench).collect() == [] and not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())
