"""Pairs that the Jaccard join measures in a large group of near copies, and tables that it stages for them."""

from __future__ import annotations

import random

from brute import jaccard_components

from ledgerloom.llm import jaccard, regions


def test_few_pairs_around_a_center(spark, monkeypatch):
    """Copies of one text at many distances: what links to the text needs no pair of its own with every other copy."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {500: " ".join(base)}
    for n in range(300):
        text = base[:]
        for at in draw.sample(range(150), draw.choice([1, 1, 2, 2, 3, 4, 5, 6, 8])):
            text[at] = f"x{n}y{at}"
        texts[n] = " ".join(text)
    measured, linked_components = [], jaccard.linked_components

    def counted(members, measure, *args):
        def also(pairs):
            found = measure(pairs)
            measured.append(found.count())
            return found

        return linked_components(members, also, *args)

    staged, stage = [], jaccard.stage

    def named(df, name):
        staged.append(name)
        return stage(df, name)

    monkeypatch.setattr(jaccard, "linked_components", counted)
    for module in (jaccard, regions):
        monkeypatch.setattr(module, "stage", named)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(df).collect()}
    assert found == jaccard_components(texts)
    assert sum(measured) < 5 * len(texts), measured
    assert len(staged) < 32, staged
