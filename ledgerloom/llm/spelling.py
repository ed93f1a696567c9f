"""Spelling variants: k-d trees over letter counts find words one edit apart.

Words of one length form a tree over vectors of letter counts: of the whole word and of
its first half. An inserted or deleted letter changes the whole word's counts by one
letter, a replaced one by one up and one down, and either changes those of the first half
by at most one up and one down. So a search needs only the boxes that lie that near, and
only the lengths alike and one above. The top of a large length's tree is cut on a bounded
sample of its words; every word lies in one of its boxes and is searched for in every box
in reach. Inside a box the tree goes on in numpy, and what it leaves is compared letter by
letter. Box sizes are counted: a box with too many words of too few different counts is
dealt over several tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import counted_join
from ..session import stage

SHORTEST = 7
LEAST = 2
RATIO = 10
CHANGED = 31

# Words that a box should hold, and sampled words per box that choose the cuts of a tree's top.
BOX_WORDS = 4000
SAMPLE_PER_BOX, SAMPLE = 40, 40_000
# What a word is in a box: one to be found, one searched for, the last three by where it belongs.
_POINT, _AT_HOME, _FROM_OUTSIDE, _SHORTER = range(4)
# Words that a task counts before it passes them on.
_MOST_WORDS = 200_000
# Points that a search compares without a cut, and pairs or bytes compared at a time.
_LEAF = 16
_COMPARED = 1 << 21

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# Letters beyond a-z share these many counts.
_OTHERS = 6
_SLOT = np.array([i % _OTHERS + 26 if not 97 <= i <= 122 else i - 97 for i in range(256)])
_DIMS = 26 + _OTHERS
# A higher count counts as this one, which brings no two words farther apart.
_MOST = 100


def spelled_words(docs: DataFrame, changed: int = CHANGED, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``: letter runs of all texts, lower-cased in A-Z, with their occurrences.

    In one of ``changed`` documents, by a checksum of document and run, the run loses one
    letter. Null texts have no runs; a null ``doc_id`` counts as empty. Repeated rows count each.
    """

    def rows(found):
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(list(found), pa.string()), "times": pa.array(list(found.values()), pa.int64())}
        )

    def count(batches):
        found: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for run, times in Counter(_RUN.findall(text.translate(_LOWER) if not text.isascii() else text.lower())).items():
                    if len(run) < shortest:
                        continue
                    h = zlib.crc32(run.encode(), start)
                    if h % changed == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    found[run] += times
                if len(found) > _MOST_WORDS:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    counted = texts.mapInArrow(count, "word string, times long").groupBy("word").agg(F.sum("times").alias("n"))
    return counted.where(F.col("n") >= least)


def _letters(words: list[str], length: int) -> np.ndarray:
    """Bytes of words of ``length``, one row each; every letter here has one."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _vectors(letters: np.ndarray, length: int) -> np.ndarray:
    """Letter counts of words and of their first halves, as a tree of words of ``length`` takes them."""
    slots = _SLOT[letters]
    half = slots[:, : length // 2] + _DIMS
    at = 2 * _DIMS * np.arange(len(letters))[:, None]
    return np.bincount(np.hstack([slots + at, half + at]).ravel(), minlength=2 * _DIMS * len(letters)).reshape(-1, 2 * _DIMS).clip(0, _MOST).astype(np.int8)


class _Reach:
    """Which searched words come as near to a box as one edit allows, on the way down a tree.

    Kept are the words' rows and how much their counts lie below and above the box, for the
    whole word and its first half; a cut changes one count only. A searched word may miss
    one letter of the box's words (``longer``) or have another one in place of one of them.
    """

    def __init__(self, counts: np.ndarray, longer: bool):
        self.counts, self.longer = counts, longer

    def start(self) -> tuple[np.ndarray, np.ndarray, dict, dict]:
        n = self.counts.shape[1]
        return np.arange(n), np.zeros((4, n), np.int8), {}, {}

    def cut(self, state, d: int, value: int) -> tuple[tuple, tuple]:
        """States of the words near the left box, with counts below ``value``, and near the right one."""
        rows, off, low, high = state
        c = self.counts[d, rows]
        half = 2 * (d >= _DIMS)
        above, below = (c - np.int8(value - 1)).clip(0, 2), (np.int8(value) - c).clip(0, 2)
        if d in high:
            above -= (c - np.int8(high[d])).clip(0, 2)
        if d in low:
            below -= (np.int8(low[d]) - c).clip(0, 2)
        most_above = 0 if self.longer and not half else 1
        left = off[half + 1] + above <= most_above
        right = off[half] + below <= 1
        left_off, right_off = off[:, left], off[:, right]
        left_off[half + 1] += above[left]
        right_off[half] += below[right]
        return (rows[left], left_off, low, {**high, d: value - 1}), (rows[right], right_off, {**low, d: value}, high)


def _cut(vectors: np.ndarray) -> tuple[int, int] | None:
    """Dimension and value that cut points most evenly: counts below the value go left."""
    best = None
    middle = np.median(vectors, axis=0)
    n = len(vectors)
    for value in (np.floor(middle).astype(np.int64), np.floor(middle).astype(np.int64) + 1):
        left = (vectors < value).sum(0)
        gap = np.abs(2 * left - n)
        d = int(gap.argmin())
        if gap[d] < n and (best is None or gap[d] < best[0]):
            best = (int(gap[d]), d, int(value[d]))
    return best and best[1:]


class _Top:
    """Cuts of the top of one length's tree."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # dimension, value, left, right; dimension -1: a box
        self.boxes = 0
        self._grow(sample, boxes)

    def _grow(self, points: np.ndarray, boxes: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, self.boxes, 0, 0))
        cut = _cut(points) if boxes > 1 and len(points) > 1 else None
        if cut is None:
            self.boxes += 1
            return at
        d, value = cut
        is_left = points[:, d] < value
        share = min(boxes - 1, max(1, round(boxes * is_left.mean())))
        left = self._grow(points[is_left], share)
        right = self._grow(points[~is_left], boxes - share)
        self.nodes[at] = (d, value, left, right)
        return at

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """Box of each word."""
        found = np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            d, value, left, right = self.nodes[at]
            if d < 0:
                found[rows] = value
            elif len(rows):
                is_left = vectors[rows, d] < value
                todo += [(left, rows[is_left]), (right, rows[~is_left])]
        return found

    def reached(self, vectors: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(word, box) for all boxes in reach."""
        reach, rows, boxes = _Reach(np.ascontiguousarray(vectors.T), longer), [], []
        todo = [(0, reach.start())]
        while todo:
            at, state = todo.pop()
            d, value, left, right = self.nodes[at]
            near = state[0]
            if not len(near):
                continue
            if d < 0:
                rows.append(near)
                boxes.append(np.full(len(near), value))
                continue
            todo += zip((left, right), reach.cut(state, d, value))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(rows), np.concatenate(boxes).astype(np.int32)


class _Search:
    """Words searched for among the points of a box."""

    def __init__(self, queries: np.ndarray, points: np.ndarray, longer: bool):
        self.queries, self.points, self.longer, length = queries, points, longer, points.shape[1]
        self.reach = _Reach(np.ascontiguousarray(_vectors(queries, length).T), longer)
        # An edit leaves one half of the letters alone, counted from its end: most pairs in reach differ there.
        half = length // 2
        self.first = _packed(queries[:, :half]), _packed(points[:, :half])
        self.last = _packed(queries[:, half:]), _packed(points[:, half + longer :])
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(self, q: np.ndarray, p: np.ndarray) -> None:
        for lo in range(0, len(q), max(1, _COMPARED // len(p))):
            a = q[lo : lo + max(1, _COMPARED // len(p))]
            same = [mine[a][:, None] == theirs[p] for mine, theirs in (self.first, self.last)]
            i, j = np.nonzero(same[0] | same[1])
            i, j = a[i], p[j]
            step = max(1, _COMPARED // self.points.shape[1])
            for first in range(0, len(i), step):
                part = slice(first, first + step)
                good = _one_edit(self.queries[i[part]], self.points[j[part]], self.longer)
                self.found.append((i[part][good], j[part][good]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *[f[k] for f in self.found]]) for k in (0, 1))


def _near_pairs(points: np.ndarray, same: np.ndarray, shorter: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the searched words and of ``points`` exactly one edit apart, for words as long and words one letter shorter.

    One k-d tree of the points serves both.
    """
    vectors = _vectors(points, points.shape[1])
    searches = [_Search(same, points, False), _Search(shorter, points, True)]
    todo = [(np.arange(len(points)), [s.reach.start() for s in searches])]
    while todo:
        p, states = todo.pop()
        if not any(len(state[0]) for state in states):
            continue
        cut = _cut(vectors[p]) if len(p) > _LEAF else None
        if cut is None:
            for s, state in zip(searches, states):
                s.compare(state[0], p)
            continue
        is_left = vectors[p, cut[0]] < cut[1]
        sides = [s.reach.cut(state, *cut) for s, state in zip(searches, states)]
        todo += [(p[is_left], [side[0] for side in sides]), (p[~is_left], [side[1] for side in sides])]
    return [s.pairs() for s in searches]


def _packed(letters: np.ndarray) -> np.ndarray:
    """Rows of letters as one number each; letters are compared after it."""
    total = np.zeros(len(letters), np.int64)
    with np.errstate(over="ignore"):
        for i in range(letters.shape[1]):
            total = total * 0x100000001B3 + letters[:, i]
    return total


def _one_edit(a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
    """Whether ``b`` is ``a`` with one letter replaced, or inserted if ``longer``, row by row."""
    if not longer:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    same = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return same + tail >= n


def _tops(words: DataFrame, box_words: int) -> dict[int, _Top]:
    """Tree tops of the lengths with more words than a box holds; a sample bounded by SAMPLE words reaches the driver."""
    sizes = words.groupBy("length").count().where(F.col("count") > box_words)
    counts = {r.length: r["count"] for r in sizes.orderBy(F.desc("count")).limit(SAMPLE // SAMPLE_PER_BOX).collect()}
    if not counts:
        return {}
    boxes = {length: -(-n // box_words) for length, n in counts.items()}
    scale = min(1.0, SAMPLE / (SAMPLE_PER_BOX * sum(boxes.values())))
    share = {length: min(1.0, SAMPLE_PER_BOX * boxes[length] * scale / n) for length, n in counts.items()}
    table = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(table, "length"), F.lit(0.0)) * (1 << 20)
    sample: dict[int, list[str]] = {}
    for row in words.where(drawn).select("length", "word").limit(2 * SAMPLE).toLocalIterator():
        sample.setdefault(row.length, []).append(row.word)
    return {length: _Top(_vectors(_letters(sorted(found), length), length), boxes[length]) for length, found in sample.items()}


def near_words(words: DataFrame, box_words: int = BOX_WORDS) -> DataFrame:
    """``word, n_near, near_n, near``: number of words one edit away, and the most frequent of them with its count.

    ``words`` is a staged table of distinct ``word, n``; letters are those up to U+00FF. Words
    without a near one have no row. Ties go to the smallest word. Runs jobs when called.
    """
    spark = words.sparkSession
    words = words.select("word", "n", F.length("word").alias("length"))
    tops = spark.sparkContext.broadcast(_tops(words, box_words))

    def deal(batches):
        """Each word once as a point and once for every box that it is searched for in."""
        for batch in batches:
            df = batch.to_pandas()
            for length, own in df.groupby("length"):
                letters = _letters(own["word"].tolist(), length)
                out = []
                for target in (length, length + 1):
                    top = tops.value.get(target)
                    everyone, lowest = np.arange(len(own)), np.zeros(len(own), np.int32)
                    at, box, home = everyone, lowest, lowest
                    if top is not None:
                        vectors = _vectors(letters, target)
                        home = top.home(vectors) if target == length else home
                        at, box = top.reached(vectors, target != length)
                    if target != length:
                        out.append((target, at, box, np.full(len(at), _SHORTER)))
                        continue
                    # Two words as long as each other are compared in the later one's box only.
                    at, box = at[box >= home[at]], box[box >= home[at]]
                    out.append((target, everyone, home, np.full(len(own), _POINT)))
                    out.append((target, at, box, np.where(box == home[at], _AT_HOME, _FROM_OUTSIDE)))
                for target, at, box, role in out:
                    if len(at):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "tree": pa.array(np.full(len(at), target, np.int32)),
                                "box": pa.array(box.astype(np.int32)),
                                "role": pa.array(role.astype(np.int32)),
                                "word": pa.array(own["word"].to_numpy()[at], pa.string()),
                                "n": pa.array(own["n"].to_numpy()[at], pa.int64()),
                            }
                        )

    dealt = stage(words.mapInArrow(deal, "tree int, box int, role int, word string, n long"), "spelled-boxes")
    is_point = F.col("role") == _POINT
    # Boxes whose words the cuts could not part are dealt over several tasks, by points and by searched words.
    sizes = dealt.groupBy("tree", "box").agg(F.count_if(is_point).alias("points"), F.count_if(~is_point).alias("queries"))
    sizes = sizes.where("points > 0 and queries > 0").select(
        "tree", "box", *[F.ceil(F.col(c) / (w * box_words)).cast("int").alias(c) for c, w in (("points", 2), ("queries", 8))]
    )
    parts = counted_join(dealt, sizes, ["tree", "box"])
    spread = F.pmod(F.xxhash64("word"), F.when(is_point, F.col("points")).otherwise(F.col("queries"))).cast("int")
    others = F.when(is_point, F.col("queries")).otherwise(F.col("points"))
    parts = parts.withColumn("own", spread).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    parts = parts.select(
        "tree",
        "box",
        F.when(is_point, F.col("own")).otherwise(F.col("other")).alias("points"),
        F.when(is_point, F.col("other")).otherwise(F.col("own")).alias("queries"),
        "role",
        "word",
        "n",
    )

    def search(part: pd.DataFrame) -> pd.DataFrame:
        role = part["role"].to_numpy()
        points, same, shorter = (
            part[kind].reset_index(drop=True)
            for kind in (role == _POINT, (role == _AT_HOME) | (role == _FROM_OUTSIDE), role == _SHORTER)
        )
        none = pd.DataFrame({"word": [], "n_near": [], "near_n": [], "near": []}, dtype=object)
        if not len(points):
            return none
        length = int(part["tree"].iloc[0])
        letters = [_letters(df["word"].tolist(), n) for df, n in ((points, length), (same, length), (shorter, length - 1))]
        pairs = []
        for queries, (q, p) in zip((same, shorter), _near_pairs(*letters)):
            # At home a pair is found from both its words.
            once = (queries["role"].to_numpy()[q] != _AT_HOME) | (queries["word"].to_numpy()[q] < points["word"].to_numpy()[p])
            for a, i, b, j in ((queries, q[once], points, p[once]), (points, p[once], queries, q[once])):
                pairs.append(
                    pd.DataFrame({"word": a["word"].to_numpy()[i], "near": b["word"].to_numpy()[j], "near_n": b["n"].to_numpy()[j]})
                )
        if not any(len(x) for x in pairs):
            return none
        pairs = pd.concat(pairs).sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
        best = pairs.drop_duplicates("word").set_index("word")
        best["n_near"] = pairs.groupby("word").size()
        return best.reset_index()[["word", "n_near", "near_n", "near"]]

    near = parts.groupBy("tree", "box", "points", "queries").applyInPandas(
        search, "word string, n_near long, near_n long, near string"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def spelling_variants(
    docs: DataFrame,
    ratio: int = RATIO,
    changed: int = CHANGED,
    shortest: int = SHORTEST,
    least: int = LEAST,
    box_words: int = BOX_WORDS,
) -> DataFrame:
    """Each word with its more usual form and the last of the forms from there.

    ``word, form, root, n, n_near, form_n``. A form is the most frequent word one edit away
    if it is ``ratio`` times as frequent; without one the word is its own root. Runs jobs when called.
    """
    words = stage(spelled_words(docs, changed, shortest, least), "words")
    found = words.join(near_words(words, box_words), "word", "left")
    has_form = F.coalesce(F.col("near_n") >= F.col("n") * ratio, F.lit(False))
    found = stage(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, F.col("near")).alias("form"),
            F.when(has_form, F.col("near_n")).alias("form_n"),
        ),
        "word-forms",
    )
    # Every step multiplies n, so a chain is short, and each round doubles the steps taken.
    steps = stage(found.where("form is not null").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if counted_join(steps, onward, ["root"], "left_semi").isEmpty():
            break
        further = counted_join(steps, onward, ["root"], "left")
        steps = stage(further.select("word", F.coalesce("next", "root").alias("root")), "word-roots")
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
