from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import spelling
from ledgerloom.llm.spelling import near_words, spelling_variants
from ledgerloom.session import stage

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(docs, changed=31, shortest=7, least=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % changed == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}


def brute_near(words):
    """Words meet at what is left when a letter is taken out of one or both, at one place."""
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= set(same) - {w}
    return near


def brute(docs, ratio=10, **kwargs):
    words = brute_words(docs, **kwargs)
    near, form = brute_near(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    found = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(found, key=repr)


def found(df, **kwargs):
    return sorted((tuple(r) for r in spelling_variants(df, **kwargs).collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, n long, word string")


def test_equals_brute_force(spark):
    draw = random.Random(4)
    known = ["".join(draw.choices("abcdeéÿ×", k=draw.randrange(6, 11))) for _ in range(60)]
    docs = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = known[int(len(known) * draw.random() ** 3)]
            if draw.random() < 0.2:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "a", "é", w[at] + "b"]) + w[at + 1 :]
            words.append(w.upper() if draw.random() < 0.1 else w)
        docs.append((i // 2, draw.choice(["-", " ", "1", "Ā", "\n"]).join(words)))
    docs += [(None, None), (None, known[0] * 2), (3, ""), (4, "z" * 5000 + " " + "z" * 5001 + " " + "z" * 5000 + " " + "z" * 5001)]
    expected = brute(docs)
    assert sum(r[1] is not None for r in expected) > 50 and any(r[2] not in (r[0], r[1]) for r in expected)
    df = frame(spark, docs)
    assert found(df) == expected
    assert found(df, ratio=2, changed=5, shortest=6, least=3, box_words=15) == brute(docs, 2, changed=5, shortest=6, least=3)


@pytest.mark.parametrize("letters, length, box_words", [("ab", (7, 13), 60), ("abcdefghijklmnopqrstuvwxyzàéÿ", (7, 9), 200)])
def test_near_words_in_small_boxes(spark, letters, length, box_words):
    """Two letters give many words of the same counts: such boxes are dealt over tasks."""
    draw = random.Random(len(letters))
    words = {"".join(draw.choices(letters, k=draw.randrange(*length))): draw.randrange(2, 9) for _ in range(3000)}
    for w in list(words)[::3]:
        words[w[:2] + w[3:]] = 2
        words[w[:4] + draw.choice(letters) + w[5:]] = 3
    words = {w: n for w, n in words.items() if len(w) >= 7}
    near = brute_near(words)
    expected = sorted(
        (w, len(x), words[best], best) for w, x in near.items() if x for best in [min(x, key=lambda y: (-words[y], y))]
    )
    table = stage(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    assert len(expected) > 800
    assert sorted(tuple(r) for r in near_words(table, box_words).collect()) == expected


def test_boxes_hold_every_word_once_and_all_in_reach():
    draw = random.Random(8)
    words = ["".join(draw.choices("aabcdefghé", k=9)) for _ in range(1000)]
    words += [w[:5] + draw.choice("xyzé") + w[6:] for w in words]
    letters = spelling._letters(words, 9)
    vectors = spelling._vectors(letters, 9)
    top = spelling._Top(vectors[:500], 16)
    home = top.home(vectors)
    assert top.boxes == 16 and np.bincount(home, minlength=16).min() > 40
    (q, p), (none, _) = spelling._near_pairs(letters, letters, letters[:0, :8])
    assert len(q) > 1500 and not len(none)
    reached = set(zip(*(x.tolist() for x in top.reached(vectors, False))))
    assert all((int(i), int(home[j])) in reached for i, j in zip(q, p))
    assert len(reached) < 0.9 * 16 * len(words)


def test_empty_table(spark):
    assert found(frame(spark, [])) == [] == found(frame(spark, [(1, "short words only")]))
