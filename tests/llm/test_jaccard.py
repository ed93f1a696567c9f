from __future__ import annotations

import random

from brute import jaccard_components

from ledgerloom.llm.jaccard import ngram_jaccard
from ledgerloom.llm.regions import components

SF = "/root/testdata/sf0.01"


def _check(df, texts, **options):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(df, **options).collect()}
    assert found == jaccard_components(texts)


def test_whole_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    _check(df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()})


def test_chains_and_dense_groups(spark):
    """Mutated copies at many distances, chains of links, copies of copies, joins without broadcasts."""
    draw = random.Random(5)
    texts, n = {}, 0
    for group in range(6):
        base = [f"w{draw.randrange(900)}" for _ in range(draw.choice([5, 9, 40, 120]))]
        for _ in range(40):
            text = base[:]
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9000)}"
            texts[n] = " ".join(text)
            n += 1
            if draw.random() < 0.5:
                base = text
            if draw.random() < 0.2:
                texts[n] = " ".join(text).upper()
                n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _check(df, texts)
    _check(df, texts, broadcast_rows=0)


def test_shared_passages_with_and_without_links(spark):
    """Passages in many texts, early or late in them, beside groups of near copies of other lengths."""
    draw = random.Random(8)
    passages = [[f"p{i}x{j}" for j in range(60)] for i in range(3)]
    texts = {}
    for n in range(240):
        own = [f"o{draw.randrange(10**6)}" for _ in range(draw.choice([4, 12, 20, 60]))]
        passage = draw.choice(passages)
        at = draw.randrange(60) if draw.random() < 0.3 else 0
        texts[n] = " ".join(draw.choice([own + passage[at:], passage[at:] + own, own[:2] + passage + own[2:]]))
        if draw.random() < 0.3:
            texts[n] = texts[draw.randrange(n + 1)] + f" e{n}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _check(df, texts)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "one two", 0), (5, "ONE\ttwo ", 0), (6, "one two three", 0)]
    rows += [(7, long, 0), (8, long + " end", 0), (None, "one two", 0), (9, "ÀB \x0b c", 0), (10, "àB c", 0), (11, "one two", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    found = sorted(map(tuple, ngram_jaccard(df).collect()), key=repr)
    assert found == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29996, 7), (8, 29997, 7), (None, 1, None)]
        + [(9, 1, 9), (10, 1, 10), (11, 1, 4)],
        key=repr,
    )
    assert ngram_jaccard(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long"))
    found = {r.id: r.comp for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_passing_tables_are_deleted(spark, tmp_path, monkeypatch):
    """Sets, prefixes and regions do not outlive the join; its result still reads what it needs."""
    monkeypatch.setattr("ledgerloom.session.shared_folder", lambda _: str(tmp_path))
    texts = {i: " ".join(f"w{i // 3}x{k}" for k in range(60)) + f" end{i}" for i in range(30)}
    found = ngram_jaccard(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"fingerprints", "items", "components"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_components(texts)
