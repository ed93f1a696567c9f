from __future__ import annotations

import random

import pytest

from ledgerloom.operators import words as W
from tests.conftest import rows

WORDS = "doc int, page int, x0 double, x1 double, top double, bottom double, txt string"


def word(x0, top, txt, page=1, width=20.0, height=10.0):
    return (1, page, float(x0), float(x0) + width, float(top), float(top) + height, txt)


@pytest.mark.parametrize(
    "text, found",
    [("2023-24*", True), ("2023 / 24", True), (" 2025-26 ", True), ("2023-25", False), ("2023-24 5", False), ("2024", False)],
)
def test_header_pattern(frame, text, found):
    assert (W.header_words(frame(WORDS, word(0, 0, text))).count() == 1) is found


@pytest.mark.parametrize(
    "text, found",
    [("$1,234", True), ("-12", True), ("$-5.25", True), ("-", True), ("1.5", False), ("a1", False), ("1,2,3", True), ("", False)],
)
def test_number_pattern(frame, text, found):
    assert (W.number_words(frame(WORDS, word(0, 0, text))).count() == 1) is found


def test_header_groups_are_chained(frame):
    df = frame(WORDS, *[word(0, t, "2023-24") for t in (0, 10, 20, 40, 52, 64.5)], word(0, 5, "2023-24", page=2))
    found = W.header_groups(df).select("page", "grp", "hdr_top", "hdr_bottom", "next_top", "headers")
    assert rows(found) == [
        (1, 1, 0.0, 30.0, 40.0, 3), (1, 2, 40.0, 62.0, 64.5, 2), (1, 3, 64.5, 74.5, 792.0, 1), (2, 1, 5.0, 15.0, 792.0, 1),
    ]


def test_header_groups_against_brute_force(frame):
    rng = random.Random(3)
    tops = {p: [rng.uniform(0, 780) for _ in range(60)] for p in (1, 2, 3)}
    expected = set()
    for p, ts in tops.items():
        groups = []
        for t in sorted(ts):
            if groups and t - groups[-1][-1] <= 12:
                groups[-1].append(t)
            else:
                groups.append([t])
        expected |= {(p, i, g[0], len(g)) for i, g in enumerate(groups, 1)}
    df = frame(WORDS, *[word(0, t, "2024-25", page=p) for p, ts in tops.items() for t in ts])
    assert {tuple(r) for r in W.header_groups(df).select("page", "grp", "hdr_top", "headers").collect()} == expected


def test_matched_columns_by_hand(frame):
    df = frame(
        WORDS,
        word(100, 10, "2023-24"), word(300, 10, "2024-25"), word(500, 10, "2025-26"),
        word(90, 50, "$5"), word(110, 40, "$6"), word(380, 50, "7"), word(500, 5, "8"), word(440, 60, "-"),
    )
    found = {r.x0: r.column_x for r in W.matched_columns(df).collect()}
    # Equally near: the higher word wins. Farther than 60: the header's centre. At most 60: the number.
    assert found == {100.0: 110.0, 300.0: 310.0, 500.0: 440.0}


def test_matched_columns_need_a_number_below(frame):
    assert W.matched_columns(frame(WORDS, word(0, 10, "2023-24"), word(0, 15, "1"))).count() == 0


def test_digits_of_any_script(frame):
    df = frame(WORDS, word(0, 0, "$١٢٣.٤٥"), word(9, 0, "٧"), word(20, 0, "2023٩24"), word(30, 0, "2023-24"))
    assert {r.x0 for r in W.number_words(df).collect()} == {0.0, 9.0, 20.0}
    assert [r.x0 for r in W.header_words(df).collect()] == [30.0]


def test_matched_columns_against_brute_force_on_one_hot_page(frame):
    rng = random.Random(5)
    page = [word(rng.randrange(0, 6000) / 10, rng.choice([10, 14, 200, 400]), "2024-25") for _ in range(60)]
    page += [word(rng.randrange(0, 6000) / 10, rng.randrange(0, 780), "$1") for _ in range(150)]
    page += [word(rng.randrange(0, 60) * 10, 760, "2") for _ in range(200)]
    df = frame(WORDS, *page)
    groups = {r.grp: r for r in W.header_groups(df).collect()}
    numbers = [w for w in page if not w[6].startswith("2024")]
    expected = set()
    for w in page:
        if w[6] != "2024-25":
            continue
        (g,) = [g for g, r in groups.items() if r.hdr_top <= w[4] and w[5] <= r.hdr_bottom]
        below = [n for n in numbers if n[4] > groups[g].hdr_bottom]
        near = min(below, key=lambda n: (abs(n[2] - w[2]), n[4], n[2]))
        expected.add((g, w[2], near[2] if abs(near[2] - w[2]) <= 60 else (w[2] + w[3]) / 2))
    assert {tuple(r) for r in W.matched_columns(df).select("grp", "x0", "column_x").collect()} == expected


def test_column_areas(frame):
    df = frame(WORDS, word(5, 100, "2023-24"), word(600, 100, "2024-25"), word(8, 150, "1"), word(605, 150, "2"), word(0, 300, "2025-26"))
    first = W.column_areas(df).filter("grp = 1").first()
    assert (first.columns, first.left, first.right) == ([8.0, 605.0], 0.0, 612.0)
    assert (first.area_top, first.area_bottom) == (698.0, 498.0)


def test_text_lines(frame):
    df = frame(WORDS, word(5, 0, "a", width=5.0), word(45, 0.4, "b"), word(66, 0, "c"), word(0, 4.5, "d"), word(0, 7.5, "e"))
    lines = W.text_lines(df)
    # 4.5 and 7.5 are 1.5 and 2.5 lines down: both round to the even 2.
    assert rows(lines.select("line", "text")) == [(0, " a   b c"), (2, " d e")]
    assert rows(W.page_text(lines).select("text")) == [(" a   b c\n d e",)]


def test_no_pairs_of_words(frame):
    plan = W.matched_columns(frame(WORDS, word(0, 0, "2023-24")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the merged input is staged; the search itself joins nothing
