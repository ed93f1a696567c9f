from __future__ import annotations

import random
import re

import pytest
from brute import components

from ledgerloom.llm.line_dedup import block_choice, dedup_lines, without_lines
from ledgerloom.llm.mixing import TARGETS, mix, mixing_rates

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("keep_all", [True, False])
def test_mix_meets_targets(spark, keep_all):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing_rates(docs, labels, keep_all=keep_all).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    names = sorted(TARGETS)
    sums = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in names}
    total = sum(sums.values())
    assert all(abs(sums[d] / total - TARGETS[d]) < (0.01 if keep_all else 1e-4) for d in names), (sums, total)
    assert all(r.rate >= keep_all and abs(sum(r[f"p_{d}"] for d in names) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    right = [max(names, key=lambda d: r[f"p_{d}"]) == r.lang for r in rows if r.n_tokens > 20]
    assert sum(right) > 0.97 * len(right)
    real = {d: sum(r.copies * r.n_tokens for r in rows if r.lang == d) for d in names}
    assert all(abs(real[d] / sum(real.values()) - TARGETS[d]) < 0.03 for d in names)
    copies = {r.doc_id: r.copies for r in rows if r.copies}
    mixed = mix(docs, labels, keep_all=keep_all)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_absent_domains_stay_bounded(spark):
    """Without a document of three domains nothing is repeated for them, and the residual says so."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    english = docs.where("lang = 'en'")
    rows = mixing_rates(english, labels, steps=3).collect()
    assert max(r.rate for r in rows) == 1.0 and {r.copies for r in rows} == {1}
    assert abs(rows[0].residual - 0.18) < 1e-9
    few = english.unionByName(docs.where("lang = 'de'").orderBy("doc_id").limit(3))
    rows = mixing_rates(few, labels, most=5.0).collect()
    assert 1.0 <= min(r.rate for r in rows) and max(r.rate for r in rows) <= 5.0 and rows[0].residual > 0.05


def test_mix_odd_rows(spark):
    rows = [(1, None, "en", 9), (2, "", None, 9), (3, "the of and " * 50_000, "en", 9), (3, "und die der mit ß", "de", 9), (None, "que los el", "xx", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate int")
    labels = spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    found = mixing_rates(docs, labels).collect()
    assert len(found) == 5 and all(r.rate >= 1 for r in found) and sorted(r.n_tokens for r in found)[:2] == [0, 0]
    assert mix(docs, labels).columns == docs.columns and mix(docs, labels).count() >= 5
    assert mixing_rates(docs.limit(0), labels).collect() == [] and {r.rate for r in mixing_rates(docs.limit(2), labels).collect()} == {1.0}
    assert mixing_rates(docs, labels.limit(0)).count() == 5


def test_mix_stages_no_text(spark, tmp_path, monkeypatch):
    """What is left in the shared folder does not grow with the texts."""
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)), draw.choice(sorted(TARGETS))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr("ledgerloom.session.shared_folder", lambda _: str(tmp_path))
    mixed = mix(docs, docs.select("doc_id"))
    assert {r.text for r in mixed.collect()} == {t for _, t, _ in rows}
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 200_000


def _norm(line):
    return re.sub(r"[\x00-\x09\x0b-\x60\x7b-\x7f]+", " ", line.lower()).strip(" ")


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _fingerprints(spark, norms):
    from pyspark.sql import functions as F

    words = sorted({w for n in norms for w in n.split(" ")})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    hashed = {r.w: r.h & (1 << 64) - 1 for r in df.select("w", F.xxhash64("w").alias("h")).collect()}
    out = {}
    for n in norms:
        own = [hashed[w] for w in n.split(" ")]
        out[n] = sum((2 * sum(h >> b & 1 for h in own) > len(own)) << b for b in range(60))
    return out


def _dropped(spark, rows):
    """Brute force: all pairs of fingerprints, edit distances, groups."""
    lines = [(d is None, d or 0, i, _norm(x), k) for k, (d, t) in enumerate(rows) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[3]]
    norms = sorted({x[3] for x in lines})
    prints = _fingerprints(spark, norms)
    links = [
        (a, b) for i, a in enumerate(norms) for b in norms[:i]
        if bin(prints[a] ^ prints[b]).count("1") <= 3 and abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and _edits(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)
    ]
    comp = components(norms, links)
    first = {}
    for x in sorted(lines):
        first.setdefault(comp[x[3]], x)
    out = {k: [] for k in range(len(rows))}
    for x in lines:
        if first[comp[x[3]]][:3] != x[:3]:
            out[x[4]].append(x[2])
    return [tuple(out[k]) for k in range(len(rows))], len(links)


def test_lines_against_brute_force(spark):
    draw = random.Random(2)
    base = [" ".join(draw.choices([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)], k=draw.randrange(1, 60))) for _ in range(60)]
    rows = []
    for d in range(80):
        own = []
        for _ in range(draw.randrange(1, 7)):
            line = draw.choice(base)
            if draw.random() < 0.5:
                at = draw.randrange(len(line))
                line = line[:at] + draw.choice("abcxyz ") + line[at + draw.randrange(2) :]
            own.append(draw.choice([line, line.upper(), f"12. {line}!", "", "---", "42"]))
        rows.append((d, "\n".join(own)))
    long = " ".join(draw.choices([f"v{chr(97 + i)}" for i in range(20)], k=2500))
    rows += [(900, long), (901, long.replace("va", "vb", 1)), (902, "x\n" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected, links = _dropped(spark, rows)
    found = {r.doc_id: (r.n_lines, r.n_kept, tuple(r.dropped)) for r in dedup_lines(df).collect()}
    assert found == {d: (len(t.split("\n")), len(t.split("\n")) - len(e), e) for (d, t), e in zip(rows, expected)}
    assert links > 20
    kept = {r.doc_id: r.text for r in without_lines(df).collect()}
    assert kept == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in e) for (d, t), e in zip(rows, expected)}


def test_line_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Same line here", 0), (2, "other\nsame LINE here!", 0), (None, "same line here", 0), (4, "\n\n1\n1\n", 0), (3, "Same line here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    found = sorted(((r.doc_id, r.n_lines, r.n_kept, list(r.dropped)) for r in dedup_lines(df).collect()), key=repr)
    assert found == sorted([(1, 1, 1, []), (2, 1, 1, []), (3, 1, 1, []), (3, 1, 1, []), (2, 2, 1, [1]), (None, 1, 0, [0]), (4, 5, 5, [])], key=repr) or found == sorted(
        [(1, 1, 1, []), (2, 1, 1, []), (3, 1, 0, [0]), (3, 1, 0, [0]), (2, 2, 2, []), (None, 1, 0, [0]), (4, 5, 5, [])], key=repr
    )
    assert dedup_lines(df.limit(0)).collect() == []
    assert without_lines(df).columns == df.columns


def test_block_choice():
    assert block_choice(1000) == (5, 2) and block_choice(10**9) == (6, 3)
