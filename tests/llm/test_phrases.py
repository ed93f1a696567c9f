from __future__ import annotations

import random
import re
from collections import Counter

from ledgerloom.llm import phrases
from ledgerloom.llm.phrases import collocations

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, support=10, keep_below=50, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII_LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    kept = []
    for (lang, p), a in candidates.items():
        inside = [
            f for (other, q), f in candidates.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        ]
        if any(100 * f >= keep_below * a for f in inside):
            continue
        score, k = min(
            (1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))
        )
        kept.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    found = []
    for lang in {r[0] for r in kept}:
        own = sorted((r for r in kept if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        found += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(found)


def found(df, **kwargs):
    return sorted(tuple(r) for r in collocations(df, **kwargs).collect())


def drawn(n, seed):
    draw = random.Random(seed)
    words = ["the", "The", "new", "york", "City", "é", "É", "a", "a\xa0b", "\x1c", "日本", "x'y"]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]
    return [
        (draw.choice(["en", "de", None]), "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(60))))
        for _ in range(n)
    ]


def test_equals_brute_force(spark, monkeypatch):
    docs = drawn(150, 1) + [(None, None), ("en", ""), ("", "new york " * 12), ("en", "the new york city " * 30 + "the new")] * 2
    df = spark.createDataFrame([(i // 2, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, shard int, phrase string")
    expected = brute(docs)
    assert len(expected) > 40 and found(df) == expected
    assert found(df, support=4, shards=5, keep_below=80, top=7) == brute(docs, 4, 80, 7)
    # A small filter lets more through by chance.
    monkeypatch.setattr(phrases, "FILTER_BITS", 15)
    assert found(df) == expected


def test_counts_of_all_lengths(spark):
    frequent, totals = phrases.frequent_phrases(spark.createDataFrame([(None, "a b a b c", "x")] * 10, "doc_id long, text string, lang string"))
    assert {(r.phrase, r.times) for r in frequent.collect()} == {
        ("a", 20), ("b", 20), ("c", 10), ("a b", 20), ("b a", 10), ("b c", 10), ("a b a", 10), ("b a b", 10), ("a b c", 10),
    }
    assert [tuple(r) for r in totals.collect()] == [("x", 50)]


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**14, 10**14 + 1, 10**14 + 7)], "a long, l long, r long")
    (score,) = df.select(phrases._score(df.a, df.l, df.r)).first()
    assert score == 1_000_000 * 10**28 // ((10**14 + 1) * (10**14 + 7))


def test_empty_table_and_one_long_text(spark):
    schema = "doc_id long, text string, lang string"
    assert found(spark.createDataFrame([], schema)) == []
    text = "to be or not to be. " * 60_000
    assert found(spark.createDataFrame([(1, text, None)], schema)) == brute([(None, text)])
