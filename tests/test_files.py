"""Real files: ingest, integrity check, tables and CSV outputs."""

from __future__ import annotations

import csv
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.schema import with_canonical_names
from ledgerloom.sources import ingest, part_files, records, sinks, text_files
from ledgerloom.session import stage
from tests.conftest import rows

TITLE = ["Leave Activity", "", "Run on,2024", "", "x"]


@pytest.fixture
def months(tmp_path):
    """Two monthly files with different columns, and one file that does not match."""
    (tmp_path / "2024-01 A.csv").write_text(
        "\n".join([*TITLE, "UEID,Leave Period,CBID", "E1,2024-01,S01", ",,", 'E2,2024-01,"a, b"', '"",,""', ""])
    )
    (tmp_path / "2024-01 B.csv").write_text("\n".join([*TITLE, "Leave Period,UEID,End Balance", "2024-01,E3,5", ""]))
    (tmp_path / "2024-02 A.csv").write_text("\n".join([*TITLE, "UEID,Leave Period", ""]))
    (tmp_path / "notes.txt").write_text("\n".join([*TITLE, "UEID", "E9", ""]))
    return str(tmp_path)


def test_ingest_unites_by_name_with_lineage_and_audit(spark, months):
    imported, audit = ingest.ingest(spark, months)
    assert imported.columns == ["UEID", "Leave Period", "CBID", "End Balance", "source_file"]
    assert rows(imported) == [
        ("E1", "2024-01", "S01", None, "2024-01 A.csv"),
        ("E2", "2024-01", "a, b", None, "2024-01 A.csv"),
        ("E3", "2024-01", None, "5", "2024-01 B.csv"),
    ]
    assert rows(audit) == [("2024-01 A.csv", 4, 2), ("2024-01 B.csv", 1, 1), ("2024-02 A.csv", 0, 0)]
    assert with_canonical_names(imported).columns == ["ueid", "leave_period", "cbid", "end_balance", "source_file"]


def test_ingest_of_split_files(spark, tmp_path):
    """Only a file's first split holds titles and header; later splits are all data."""
    for f in range(3):
        body = [f"E{i},{'x' * 50},{f}" for i in range(400 + f)]
        (tmp_path / f"m{f}.csv").write_text("\n".join([*TITLE, "UEID,Text,File", *body]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        imported, audit = ingest.ingest(spark, str(tmp_path))
        assert imported.select("source_file", "UEID").distinct().count() == imported.count() == 1203
        assert rows(audit) == [(f"m{f}.csv", 400 + f, 400 + f) for f in range(3)]
        assert ingest.file_lines(spark, str(tmp_path)).filter("block > 0").count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ingest_survives_another_split_layout(spark, tmp_path):
    """Splits dealt out another way between planning and running change nothing; the text is scanned once."""
    for f in range(6):
        body = [f"E{i},{'x' * 50}" for i in range(300)]
        (tmp_path / f"m{f}.csv").write_text("\n".join([*TITLE, "UEID,Text", *body]) + "\n")
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for name, value in zip(names, ("2", "1m", "1")):
            spark.conf.set(name, value)
        imported, audit = ingest.ingest(spark, str(tmp_path))
        checked = text_files.check_csv(spark, str(tmp_path), preview=None)
        for name, value in zip(names, ("40", "4096", "1")):
            spark.conf.set(name, value)
        assert imported.count() == imported.where("UEID rlike '^E[0-9]+$'").count() == 1800
        assert rows(audit) == [(f"m{f}.csv", 300, 300) for f in range(6)]
        assert checked.groupBy("source_file").agg(F.max("line_no")).distinct().count() == 6
        for df in (imported, audit):
            assert "FileScan text" not in df._jdf.queryExecution().toString()
    finally:
        for name in names:
            spark.conf.unset(name)


def test_blank_and_repeated_headings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([*TITLE, 'A,,A,"b, c",', "1,2,3,4,5", ""]))
    imported, _ = ingest.ingest(spark, str(tmp_path))
    assert imported.columns == ["A", "Unnamed: 1", "A.1", "b, c", "Unnamed: 4", "source_file"]
    assert rows(imported) == [("1", "2", "3", "4", "5", "a.csv")]


def test_lines_wider_than_their_header_keep_all_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([*TITLE, "A,B", "1,2,3,4", '5,"6,6",,', ",,,,7", 'x"y,z"w,8', ""]))
    (tmp_path / "b.csv").write_text("\n".join([*TITLE, "B,Unnamed: 2,C", "1,2,3", '"4","5","6,""6",,', ""]))
    imported, audit = ingest.ingest(spark, str(tmp_path))
    assert imported.columns == ["A", "B", "Unnamed: 2", "Unnamed: 3", "Unnamed: 4", "C", "source_file"]
    assert rows(imported) == sorted([
        ("1", "2", "3", "4", None, None, "a.csv"), ("5", "6,6", None, None, None, None, "a.csv"),
        (None, None, None, None, "7", None, "a.csv"), ('x"y', 'z"w', "8", None, None, None, "a.csv"),
        (None, "1", "2", None, None, "3", "b.csv"), (None, "4", "5", None, None, '6,"6', "b.csv"),
    ], key=repr)
    assert rows(audit) == [("a.csv", 4, 4), ("b.csv", 2, 2)]


def test_fields_are_those_of_the_csv_module(spark):
    draw = random.Random(5)
    lines = ["".join(draw.choices('"",,ab ', k=draw.randrange(1, 14))) for _ in range(4000)]
    lines += ["," * 6000, ",".join(f'"{i}"' for i in range(6000)), '"' + '""' * 20000 + '"', "x" * 100_000]
    expected = []
    for x in lines:
        (row,) = csv.reader([x + "\n"])
        open_at_end = row[-1].endswith("\n")
        expected.append((open_at_end, None if open_at_end else row))
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    found = df.select("i", F.col("value").rlike(records.OPENS).alias("opens"), records.fields(F.col("value")).alias("f"))
    for r in found.collect():
        opens, row = expected[r.i]
        assert (r.opens, None if opens else r.f) == (opens, row), lines[r.i][:50]


def _drawn_csv(draw, n):
    cells = ["a", "", 'say "hi"', "x,y", "two\nlines", 'a\n\n"b",\nc', "é" * 40, '"', "\n", 'in"side']
    out = []
    for _ in range(n):
        row = [draw.choice(cells) for _ in range(draw.randrange(1, 6))]
        out.append(row if row != [""] else ["a"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_records_go_on_over_lines_and_splits(spark, tmp_path, seed):
    draw, expected = random.Random(seed), []
    for name in ("m1.csv", "m2.csv", "plain.csv"):
        rows_of_file = [["a", "b"]] * 50 if name == "plain.csv" else _drawn_csv(draw, 400)
        if name == "m2.csv":  # one field over several splits, with quotes that look like starts
            rows_of_file[200] = ["k", '\n,"x' * 800, "end"]
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows_of_file)
        expected += [(name, r) for r in rows_of_file]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = ingest.file_lines(spark, str(tmp_path))
        assert lines.where("source_file = 'm2.csv'").select("block").distinct().count() > 10
        found = records.records(lines).select("source_file", "block", "seq", records.fields(F.col("value")).alias("f"))
        assert [(r.source_file, r.f) for r in found.orderBy("source_file", "block", "seq").collect()] == expected
        sinks.requote(spark, str(tmp_path), str(tmp_path / "out"), "*.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert list(csv.reader(text.splitlines(keepends=True))) == [r for _, r in expected]


def test_unclosed_quote_names_its_file(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"open\n2,3\n')
    (tmp_path / "good.csv").write_text('a,b\n1,"x\ny"\n')
    with pytest.raises(ValueError, match="bad.csv"):
        records.records(ingest.file_lines(spark, str(tmp_path)))


def test_one_very_wide_line_and_breaks_in_fields(spark, tmp_path):
    """The plan does not grow with the width."""
    wide = ",".join(str(i) for i in range(5000))
    (tmp_path / "a.csv").write_text("\n".join([*TITLE, "A,B", "1,2", wide, '"two\nlines",", "', ""]))
    (tmp_path / "b.csv").write_text("\n".join([*TITLE, "b,source_file,A,^A", "1,2,3,4", ""]))
    imported, audit = ingest.ingest(spark, str(tmp_path))
    assert rows(audit) == [("a.csv", 3, 3), ("b.csv", 1, 1)]
    assert imported.columns[:3] == ["A", "B", "Unnamed: 2"] and imported.columns[-5:] == ["Unnamed: 4999", "b.1", "source_file.1", "^A", "source_file"]
    found = {r["A"]: r for r in imported.collect()}
    assert set(found) == {"0", "1", "two\nlines", "3"}
    assert list(found["0"])[:5000] == [str(i) for i in range(5000)] and found["two\nlines"]["B"] == ", "
    assert (found["3"]["b.1"], found["3"]["source_file.1"], found["3"]["^A"], found["3"]["source_file"]) == ("1", "2", "4", "b.csv")
    (tmp_path / "narrow").mkdir()
    (tmp_path / "narrow" / "a.csv").write_text("\n".join([*TITLE, "A,B", "1,2", ""]))
    narrow, _ = ingest.ingest(spark, str(tmp_path / "narrow"))
    steps = [df._jdf.queryExecution().optimizedPlan().treeString().count("\n") for df in (imported, narrow)]
    assert steps[0] == steps[1] < 10


def test_ingest_of_no_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text("\n".join([*TITLE, "A", "1", ""]))
    imported, audit = ingest.ingest(spark, str(tmp_path))
    assert imported.count() == audit.count() == 0


def test_combine_frames(frame):
    united = ingest.combine_frames({"s1": frame("a int", (1,)), "s2": frame("b int, a int", (2, 3))})
    assert united.columns == ["SourceSheet", "a", "b"]
    assert rows(united) == [("s1", 1, None), ("s2", 3, 2)]


def test_list_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.xlsx", "b.txt", "sub/c.xlsx"):
        (tmp_path / name).write_text("x")
    listed = ingest.list_files(spark, str(tmp_path))
    assert sorted(r.file_name for r in listed.collect()) == ["a.xlsx", "c.xlsx"]
    assert [r.file_name for r in ingest.list_files(spark, str(tmp_path), recursive=False).collect()] == ["a.xlsx"]


def test_text_csv_infers_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c.d\n01,"",x\n,"say ""hi""",y\n')
    df = text_files.read_text_csv(spark, str(tmp_path / "a.csv"))
    assert {kind for _, kind in df.dtypes} == {"string"}
    assert rows(df) == [("01", None, "x"), (None, 'say "hi"', "y")]
    assert text_files.inspect_header(spark, str(tmp_path / "a.csv")) == (3, ["a", "b", "c.d"])


def test_check_csv_numbers_lines_across_splits(spark, tmp_path):
    good, bad, long = "," * 17 + "f", "," * 16, "," * 17 + '"' + "f" * 256 + '" '
    lines = [bad] + [good] * 500
    for n in (2, 77, 300, 501):
        lines[n - 1] = long if n == 300 else bad
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([good, bad, "none"]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        found = text_files.check_csv(spark, str(tmp_path), preview=None)
        assert rows(found.select("source_file", "line_no", "problems"), "source_file", "line_no") == [
            ("a.csv", 2, "Wrong number of columns (16 commas)"),
            ("a.csv", 77, "Wrong number of columns (16 commas)"),
            ("a.csv", 300, "source_file too long (256 chars)"),
            ("a.csv", 501, "Wrong number of columns (16 commas)"),
            ("b.csv", 2, "Wrong number of columns (16 commas)"),
            ("b.csv", 3, "Wrong number of columns (0 commas)"),
        ]
        first = text_files.check_csv(spark, str(tmp_path), preview=2).select("source_file", "line_no")
        assert rows(first) == [("a.csv", 2), ("a.csv", 77), ("b.csv", 2), ("b.csv", 3)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_both_problems_on_one_line(frame):
    line = "," * 3 + "f" * 300
    (found,) = text_files.bad_lines(frame("source_file string, line_no int, value string", ("a", 2, line))).collect()
    assert found.problems == "Wrong number of columns (3 commas); source_file too long (300 chars)"


def test_save_table_partitions_and_replaces(spark, frame, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.save_table(frame("leave_period string, v int", ("2024-01", 1)), path)
    saved = sinks.save_table(frame("leave_period string, v int", ("2024-06", 2), ("2024-07", 3)), path, view="led")
    assert rows(spark.table("led").select("leave_period", "v")) == [("2024-06", 2), ("2024-07", 3)]
    assert saved.filter("leave_period = '2024-06'").inputFiles() and len(saved.columns) == 2


def test_a_table_is_replaced_from_itself_and_survives_a_failed_write(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        sinks.load_table(spark, path)
    old = sinks.save_table(frame("leave_period string, v int", ("2024-01", 1), ("2024-02", 2)), path)
    with pytest.raises(Exception, match="broken"):
        sinks.save_table(old.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v"))), path)
    assert rows(sinks.load_table(spark, path).select("v")) == [(1,), (2,)]
    new = sinks.save_table(old.withColumn("v", F.col("v") * 10).withColumn("w", F.lit("x")), path)
    assert rows(new.select("v", "w")) == [(10, "x"), (20, "x")]
    # Whoever still reads the old version goes on.
    assert rows(old.select("v")) == [(1,), (2,)] and old.columns == ["v", "leave_period"] or old.columns == ["leave_period", "v"]
    (tmp_path / "t" / "manifests" / "3" / "_temporary").mkdir(parents=True)  # a writer that died
    assert rows(sinks.load_table(spark, path).select("v")) == [(10,), (20,)]
    third = sinks.save_table(new.where("v = 10"), str(tmp_path / "other"), partition_by=None)
    sinks.save_table(third.union(third), str(tmp_path / "other"), partition_by=None)
    sinks.drop_old_versions(spark, str(tmp_path / "other"), keep=1)
    assert sinks.load_table(spark, str(tmp_path / "other")).count() == 2
    assert len(list((tmp_path / "other" / "versions").iterdir())) == 1


def read_parts(paths):
    found = []
    for path in paths:
        with open(path, newline="") as f:
            found.append(list(csv.reader(f)))
    return found


@pytest.fixture
def numbers(spark):
    return spark.range(2500).select((F.col("id") * 7919 % 2500).alias("n"), F.lit(" t,\"q\"").alias("t"))


def test_parts_are_filled_in_order(numbers, tmp_path):
    paths = sinks.write_parts(numbers, str(tmp_path / "out.csv"), [F.asc("n")], max_rows=1000)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out_pt1.csv", "out_pt2.csv", "out_pt3.csv"]
    parts = read_parts(paths)
    assert [len(p) - 1 for p in parts] == [1000, 1000, 500]
    assert all(p[0] == ["n", "t"] for p in parts)
    assert [int(r[0]) for p in parts for r in p[1:]] == list(range(2500))
    assert parts[0][1][1] == ' t,"q"'
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [
        "out_pt1.csv", "out_pt2.csv", "out_pt3.csv",
    ]


def test_many_parts_without_a_step_per_part(spark, tmp_path, monkeypatch):
    """Parts that share a task, and a result written again over itself."""
    monkeypatch.setattr(sinks, "MOST_TASKS", 3)
    df = spark.range(1000).select("id", F.lit("x\ny").alias("t"))
    for _ in range(2):
        paths = sinks.write_parts(df, str(tmp_path / "out" / "many.csv"), [F.desc("id")], max_rows=7)
    assert len(paths) == 143 and len([p for p in (tmp_path / "out").iterdir()]) == 143
    parts = read_parts(paths)
    assert [int(r[0]) for p in parts for r in p[1:]] == list(range(999, -1, -1)) and parts[5][1][1] == "x\ny"
    assert [len(p) for p in parts] == [8] * 142 + [7]


def test_a_failed_task_leaves_no_half_part(tmp_path):
    def broken():
        yield pa.RecordBatch.from_pydict({"part": [1, 1, 2], "line": ["a", "b", "c"]})
        raise RuntimeError("lost")

    writer = part_files._Writer(str(tmp_path / "o_pt{part}.csv"), "h")
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert [p.name for p in tmp_path.iterdir()] == ["o_pt1.csv"]
    writer.write(iter([pa.RecordBatch.from_pydict({"part": [1, 1, 2], "line": ["a", "b", "c"]})]))
    assert sorted((p.name, p.read_text()) for p in tmp_path.iterdir()) == [("o_pt1.csv", "h\na\nb\n"), ("o_pt2.csv", "h\nc\n")]


def test_single_part_names(numbers, tmp_path):
    assert sinks.write_report(numbers, str(tmp_path / "a.csv"), [F.asc("n")]) == [str(tmp_path / "a.csv")]
    found = sinks.write_parts(numbers, str(tmp_path / "b.csv"), [F.asc("n")], always_suffix=True)
    assert found == [str(tmp_path / "b_pt1.csv")]


def test_empty_results(numbers, tmp_path):
    empty = numbers.filter("n < 0")
    (path,) = sinks.write_parts(empty, str(tmp_path / "a.csv"), [F.asc("n")])
    assert read_parts([path]) == [[["n", "t"]]]
    assert sinks.write_parts(empty, str(tmp_path / "b.csv"), [F.asc("n")], always_suffix=True) == []
    assert not (tmp_path / "b.csv").exists()


def test_equal_sort_keys_keep_input_order(spark):
    """One key on every row still spreads over the ranges, and ties keep their order."""
    df = spark.range(5000, numPartitions=4).select("id", F.lit(1).alias("k"))
    found = sinks.number_rows(df, [F.asc("k")]).orderBy("row_no").collect()
    assert [r.id for r in found] == list(range(5000))
    assert [r.row_no for r in found] == list(range(1, 5001))


def test_large_numbers_and_nulls_are_plain(frame, tmp_path):
    df = frame("i int, d double, s string", (1, 12345678.25, None), (2, 1e7, ""), (3, None, "x"), (4, 0.5, "y"))
    (path,) = sinks.write_report(df, str(tmp_path / "a.csv"), [F.asc("i")])
    assert read_parts([path])[0][1:] == [["1", "12345678.25", ""], ["2", "10000000.0", ""], ["3", "", "x"], ["4", "0.5", "y"]]


def test_numbers_of_any_size_are_plain(spark):
    draw = random.Random(9)
    values = [0.0005, -5e-10, 1e7, 123456789.5, 1e16, -1.5e20, 1.7976931348623157e308, 5e-324, 0.0, 1.25, float("nan"), float("inf")]
    values += [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-30, 30) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = sinks._plain_numbers(df.withColumn("t", F.col("v").cast("string"))).select("v", F.col("t").cast("double").alias("was")).collect()
    for r in found:
        if r.was == r.was and abs(r.was) != float("inf"):
            assert "E" not in r.v and float(r.v) == r.was and r.v.split(".")[1]
    assert [r.v for r in found[:6]] == ["0.0005", "-0.0000000005", "10000000.0", "123456789.5", "10000000000000000.0", "-150000000000000000000.0"]


def test_requote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b, c",\n"say ""hi""",, d\n')
    sinks.requote(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == '"a","b, c",""\n"say ""hi""",""," d"\n'


def test_records_in_order_over_splits(frame):
    """Records that go on over several splits, next to a file without any, come in order from one exchange."""
    lines = stage(
        frame(
            "source_file string, block long, seq long, value string",
            ("b", 0, 1, "x,y"), ("a", 0, 5, 'h,"1'), ("a", 10, 9, "mid"), ("a", 20, 12, 'end",2'), ("a", 20, 13, 'n,"o'), ("a", 30, 17, 'p"'), ("a", 30, 18, "q"),
        ),
        "lines",
    )
    expected = [("a", 0, 5, 'h,"1\nmid\nend",2'), ("a", 20, 13, 'n,"o\np"'), ("a", 30, 18, "q"), ("b", 0, 1, "x,y")]
    found = records.records(lines, in_order=True)
    assert [tuple(r) for r in found.select("source_file", "block", "seq", "value").collect()] == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert sorted(tuple(r) for r in records.records(lines).select("source_file", "block", "seq", "value").collect()) == expected


def test_a_column_is_read_without_the_others(frame):
    lines = stage(frame("source_file string, block long, seq long, value string", ("a", 0, 0, "x,Y,y"), ("a", 0, 1, "1,2,3,4")), "lines")
    table = ingest.read_tables(lines, header_row=1)
    assert [tuple(r) for r in table.collect()] == [("1", "2", "3", "4", "a")]
    one = table.select(table.columns[1])
    assert one.first()[0] == "2" and "from_json" not in one._jdf.queryExecution().optimizedPlan().toString()
