from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.queries import queries
from ledgerloom.llm.sharding import SIZE, assign_shards, cell_bounds, hilbert_index, read_shards, shards_within, write_shards

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, shard int, size string"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (1, 3), (3, 1)])
def test_the_curve_visits_every_cell_and_moves_to_neighbours(spark, dims, bits):
    """What defines the curve: one step in one column at a time, and each half-size block is left only when it is full."""
    names = [f"c{i}" for i in range(dims)]
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"{n} int" for n in names))
    found = sorted((r["curve"], tuple(r[n] for n in names)) for r in cells.withColumn("curve", hilbert_index([F.col(n) for n in names], bits)).collect())
    assert [c for c, _ in found] == list(range(1 << dims * bits))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(found, found[1:]))
    for level in range(1, bits + 1):
        blocks = [tuple(x >> level for x in cell) for _, cell in found]
        assert sum(a != b for a, b in zip(blocks, blocks[1:])) == len(set(blocks)) - 1


def test_cells_hold_even_numbers_of_rows(spark):
    draw = random.Random(2)
    values = [int(draw.paretovariate(1) * 50) for _ in range(3000)] + [77] * 1500 + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "v long")
    known = sorted(v for v in values if v is not None)
    counts, above, expected = Counter(known), 0, {}
    for v in sorted(counts):
        expected.setdefault(above * 8 // len(known), v)
        above += counts[v]
    assert cell_bounds(df, "v", 8) == [(c, v) for c, v in sorted(expected.items()) if c]
    assert cell_bounds(df.where("v is null"), "v", 8) == []


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries()["op13_sharding"](spark, SF).collect()}
    assert len(found) == len(docs)
    for d in docs:
        r, text = found[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    slots = Counter()
    for r in sorted(found.values(), key=lambda r: (r.shard, r.slot)):
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
    assert sorted(slots) == list(range(16)) and max(slots.values()) - min(slots.values()) <= 1
    # The order of shards and slots is that of the curve.
    order = [(r.curve, r.text_crc32, r.doc_id) for r in sorted(found.values(), key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_odd_rows_and_empty_table(spark):
    rows = [(i % 4 if i % 3 else None, [None, "", "x" * 9000, "é"][i % 4], [None, "en"][i % 2], None, 1, "s") for i in range(37)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    found = assign_shards(df).collect()
    assert Counter(r.row.doc_id for r in found) == Counter(r[0] for r in rows)
    sizes = Counter(r.shard for r in found)
    assert sorted(sizes) == list(range(16)) and sorted(sizes.values()) == [4] * 6 + [5] * 10
    assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    assert {r.row.doc_id for r in assign_shards(df.limit(3)).collect()} == {r[0] for r in rows[:3]}
    assert assign_shards(df.limit(0)).collect() == []


def test_filters_read_few_shards(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, "w" * draw.randrange(3000), draw.choice("abcdefgh"), f"s{draw.randrange(40):02}", i, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "shards")
    write_shards(df, path, shards=64, file_rows=40)
    back = read_shards(spark, path)
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    for where, keep in (
        ({"lang": ("c", "c")}, lambda r: r[2] == "c"),
        ({"source": ("s10", "s13")}, lambda r: "s10" <= r[3] <= "s13"),
        ({SIZE: (1, 200)}, lambda r: len(r[1]) < 200),
        ({SIZE: (1, 900), "lang": ("a", "b")}, lambda r: len(r[1]) < 900 and r[2] in "ab"),
    ):
        some = read_shards(spark, path, where)
        assert sorted(r.doc_id for r in some.collect()) == [r[0] for r in rows if keep(r)]
        hit, _ = shards_within(spark, path, where)
        assert len(hit) <= 40 and "PartitionFilters: [shard" in some._jdf.queryExecution().toString()
    write_shards(df.limit(0), str(tmp_path / "none"))
    assert read_shards(spark, str(tmp_path / "none")).count() == 0
