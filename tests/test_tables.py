from __future__ import annotations

import random

import pytest

from ledgerloom.operators import tables as T
from ledgerloom.plans import page_tables
from tests.conftest import rows

CELLS = "doc int, page int, grp int, cand int, row_no int, col_no int, value string"
ROWS = "doc int, page int, grp int, row_no long, values array<string>"


def cells(frame, *tables):
    """Tables as ``(doc, page, grp, cand, grid)``."""
    return frame(
        CELLS, *[(*t[:4], r, c, v) for t in tables for r, line in enumerate(t[4]) for c, v in enumerate(line)]
    )


def grid_rows(frame, *tables):
    return frame(ROWS, *[(*t[:3], r, line) for t in tables for r, line in enumerate(t[3])])


GOOD = [["Fund a", "1"], ["Fund b", "2"], ["Fund c", "3"]]


def test_clean_drops_empty_rows_and_columns(frame):
    df = cells(frame, (1, 1, 1, 0, [[None, " ", " "], [" a b ", None, "x"], ["", "", ""], [None, "", "y"]]))
    found = T.clean_tables(df, [*T.TABLE, "cand"])
    assert rows(found.select("row_no", "values")) == [(0, ["a b", "x"]), (1, ["", "y"])]


def test_clean_numbers_rows_across_blocks(frame, monkeypatch):
    monkeypatch.setattr(T, "_ROW_SPAN", 3)
    df = cells(frame, (1, 1, 1, 0, [["v" if r % 2 else ""] for r in range(25)]))
    found = T.clean_tables(df, [*T.TABLE, "cand"])
    assert sorted(r.row_no for r in found.collect()) == list(range(12))


def test_unify_puts_best_first_and_keeps_its_width(frame):
    small, best, other = [["a", "b"]], [["c", "d"], ["e", "f"]], [["g", "h", "i"]]
    df = cells(frame, (1, 1, 1, 0, small), (1, 1, 1, 1, best), (1, 1, 1, 2, best), (1, 1, 1, 3, [["z"]]), (1, 1, 2, 0, small), (1, 1, 2, 1, other))
    found = page_tables.candidate_tables(df).select("grp", "row_no", "values")
    assert rows(found, "grp", "row_no") == [
        (1, 0, ["c", "d"]), (1, 1, ["e", "f"]), (1, 2, ["c", "d"]), (1, 3, ["e", "f"]), (1, 4, ["a", "b"]), (2, 0, ["g", "h", "i"]),
    ]


def test_unify_joins_columns_by_label(frame):
    """Columns 0, 1, 2 and 0, 1, 3 make four."""
    first, second = [["a", "b", "c"], ["d", "e", "f"]], [["g", "h", "", "i"]]
    df = cells(frame, (1, 1, 1, 0, first), (1, 1, 1, 1, second), (1, 1, 1, 2, [["", "j", "k", "l"]]))
    found = page_tables.candidate_tables(df).select("row_no", "values")
    assert rows(found, "row_no") == [
        (0, ["a", "b", "c", ""]), (1, ["d", "e", "f", ""]), (2, ["g", "h", "", "i"]), (3, ["", "j", "k", "l"]),
    ]


@pytest.mark.parametrize(
    "grid, incomplete, junk",
    [
        (GOOD, False, False),
        ([["a", "1"]], True, True),
        ([["a"], ["b"], ["c"]], True, False),
        ([["a", "1"], ["", "2"], ["b", "3"]], False, True),
        ([["1", "2"], ["3", "4"], ["5", "6"]], False, True),
        ([["$1 a", "$2"], ["$3", "$4"], ["$5", "$6"]], False, True),
        ([["a", "$2"], ["b", "$4"], ["c", "$6"]], False, False),
        ([["a", "1"]] * 3 + [["", "1"]] * 12, False, False),
        ([["a", "1"]] * 3 + [["", "1"]] * 13, False, True),
    ],
)
def test_filters(frame, grid, incomplete, junk):
    stats = T.table_stats(grid_rows(frame, (1, 1, 1, grid)))
    assert rows(stats.select(T.is_incomplete(), T.is_junk())) == [(incomplete, junk)]


def test_exact_duplicates_are_per_page_and_order_matters(frame):
    df = grid_rows(frame, (1, 1, 1, GOOD), (1, 1, 2, GOOD), (1, 1, 3, GOOD[::-1]), (1, 2, 1, GOOD), (2, 1, 9, GOOD))
    found = T.drop_exact_duplicates(T.table_stats(df)).select(*T.TABLE)
    assert rows(found) == [(1, 1, 1), (1, 1, 3), (1, 2, 1), (2, 1, 9)]


def test_consecutive_duplicates_span_pages_of_a_document(frame, monkeypatch):
    monkeypatch.setattr(T, "_PAGE_SPAN", 2)
    other = [["Other", "1"], *GOOD]
    df = grid_rows(frame, (1, 1, 1, GOOD), (1, 3, 1, GOOD), (1, 7, 1, GOOD), (1, 7, 2, other), (1, 8, 1, GOOD), (2, 1, 1, GOOD))
    found = T.drop_consecutive_duplicates(T.table_stats(df)).select(*T.TABLE)
    assert rows(found) == [(1, 1, 1), (1, 7, 2), (1, 8, 1), (2, 1, 1)]


def near(v, w):
    dot = sum(a * b for a, b in zip(v, w))
    return dot / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5)


def test_near_duplicates_by_hand(frame):
    df = frame("p int, n int, v array<float>", (1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.25]), (1, 3, [1.0, 0.5]), (2, 1, [1.0, 0.25]))
    assert rows(T.near_duplicates_dropped(df, ["p"], "n", "v")) == [(1, 1), (1, 3), (2, 1)]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_near_duplicates_against_brute_force_with_one_long_page(frame, block):
    rng = random.Random(11)
    data = [(p, n, [rng.gauss(0, 1) for _ in range(3)]) for p, size in ((1, 40), (2, 5), (3, 1)) for n in range(size)]
    expected = []
    for p in (1, 2, 3):
        kept = []
        for q, n, v in data:
            if q == p and not any(near(v, k) > 0.7 for k in kept):
                kept.append(v)
                expected.append((p, n))
    df = frame("p int, n int, v array<double>", *data)
    assert rows(T.near_duplicates_dropped(df, ["p"], "n", "v", threshold=0.7, block=block)) == sorted(expected, key=repr)


def test_near_duplicates_of_nothing(frame):
    df = frame("p int, n int, v array<double>", (1, 1, [1.0])).filter("n > 1")
    assert T.near_duplicates_dropped(df, ["p"], "n", "v").count() == 0


def test_document_with_vectors(frame):
    wide = [["Fund x", "1", "2"], ["Fund y", "3", "4"], ["Fund z", "5", "6"]]
    third = [["Fund k", "7"], *GOOD]
    df = cells(frame, (1, 1, 1, 0, GOOD), (1, 1, 2, 0, wide), (1, 2, 1, 0, third), (1, 2, 2, 0, [["1", "2"]]))
    vectors = frame(
        "doc int, page int, grp int, embedding array<float>", (1, 1, 1, [1.0, 0.0]), (1, 1, 2, [1.0, 0.01]), (1, 2, 2, [0.0, 1.0])
    )
    found = page_tables.document_tables(df, vectors)
    assert rows(found.select("row_no", "values"), "row_no") == [
        (0, GOOD[0]), (1, GOOD[1]), (2, GOOD[2]), (3, ["", ""]), (4, third[0]), (5, third[1]), (6, third[2]), (7, third[3]), (8, ["", ""]),
    ]
    assert rows(T.review_flags(found)) == [(1, True)]
    assert page_tables.document_tables(df).count() == 4 + 4 + 5


def test_narrow_tables_are_padded_to_the_document(frame):
    wide = [["a", "1", "2", "v"], ["b", "3", "4", "w"], ["c", "5", "6", "x"]]
    df = cells(frame, (1, 1, 1, 0, GOOD), (1, 2, 1, 0, wide))
    found = page_tables.document_tables(df)
    assert rows(found.select("row_no", "values"), "row_no")[3:6] == [
        (3, ["", "", "", ""]), (4, wide[0]), (5, wide[1]),
    ]
    assert rows(T.review_flags(found)) == [(1, False)]


def test_text_to_columns(frame):
    df = frame("t int, row_no int, value string", (1, 0, " Total  fund $5 6"), (1, 1, "a b"), (2, 0, "x   y 1"), (2, 1, None))
    assert rows(T.text_to_columns(df, ["t"])) == [
        (1, 0, ["Total", "fund", "$5", "6"]), (1, 1, ["a b", "", "", ""]), (2, 0, ["x", "y", "1"]), (2, 1, ["", "", ""]),
    ]
    assert rows(T.lines_to_columns(df, ["t"])) == [(1, 0, ["Total", "fund $5 6"]), (2, 0, ["x", "y 1"])]


def test_gaps_of_other_white_space(frame):
    """Non-breaking spaces and information separators part columns, as blanks do."""
    lines = frame("page int, row_no long, value string", (1, 0, "a\u00a0\u00a0b"), (1, 1, "c\x1c\u2003d"), (1, 2, "e f"))
    found = T.lines_to_columns(lines, ["page"]).select("row_no", "values")
    assert rows(found) == [(0, ["a", "b"]), (1, ["c", "d"])]
    texts = T.text_to_columns(frame("page int, row_no long, value string", (1, 0, "pay\u00a0$5")), ["page"])
    assert texts.first()["values"] == ["pay", "$5"]
