"""CSV records and fields out of text lines, whatever the splits, the width and the line breaks in quotes.

A line break inside a quoted field makes a record go on in the next line, and a file split
may start inside such a field. So each line says how it ends when it starts outside a quoted
field and how when it starts inside one. Every split works out both states of each of its
lines, a scan over the few splits of a file tells which holds, and only lines of records
that really go on are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

LINEAGE = "source_file"

# A quote opens a field only where the field starts, two quotes inside it are one, and what
# follows the closing quote belongs to the field. All repeats are possessive: no recursion.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_QUOTED = rf'"{_INSIDE}"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|[^",][^,]*+|)'
_TO_OPEN = rf'(?:{_FIELD},)*+"{_INSIDE}\z'
OPENS = rf"\A{_TO_OPEN}"
STAYS_OPEN = rf'\A{_INSIDE}(?:\z|"[^,]*+,{_TO_OPEN})'


def fields(record: Column) -> Column:
    """Fields of a record as an array, however many; quotes are taken off, nothing is trimmed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({_QUOTED}|[^,]*+)"), F.lit(1))

    def unquoted(field: Column) -> Column:
        inner = F.regexp_extract(field, rf'\A"({_INSIDE})"', 1)
        rest = F.regexp_replace(field, rf'\A"{_INSIDE}"', "")
        closed = field.startswith('"') & field.rlike(rf'\A"{_INSIDE}"')
        return F.when(closed, F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field)

    return F.when(record.contains('"'), F.transform(raw, unquoted)).otherwise(F.split(record, ","))


def quoted_line(values: Column) -> Column:
    """A record with every field in quotes."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))), ",")


def _states(steps: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds ``if_outside`` and ``if_inside``: whether a step starts inside a quoted field, by where its group starts.

    ``opens`` and ``stays`` say whether a step ends inside after starting outside or inside.
    A step that ends alike from both forgets what was before; one that opens from outside and
    closes from inside turns the state round; so the last of the former and the number of
    the latter since then are enough.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    forgets = F.col("opens") == F.col("stays")
    turns = (F.col("opens") & ~F.col("stays")).cast("long")
    steps = steps.withColumn("_turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    known = F.last(F.when(forgets, F.struct(F.col("opens").alias("inside"), F.col("_turns").alias("turns"))), ignorenulls=True)
    steps = steps.withColumn("_known", known.over(before))
    odd = (F.col("_turns") - F.coalesce(F.col("_known.turns"), F.lit(0))) % 2 == 1
    return steps.withColumns(
        {
            "if_outside": F.coalesce(F.col("_known.inside"), F.lit(False)) != odd,
            "if_inside": F.coalesce(F.col("_known.inside"), F.lit(True)) != odd,
        }
    ).drop("_turns", "_known")


def records(lines: DataFrame, in_order: bool = False) -> DataFrame:
    """Lines ``source_file, block, seq, value`` put together to records, under the place of their first line.

    ``block`` orders the splits of a file and ``seq`` the lines of a split. Lines of a record
    are joined by a line feed. Files without a line that opens a quoted field for the next
    one pass untouched. A quoted field still open where its file ends raises ``ValueError``.
    ``lines`` must be a staged table. The text is moved once: a line is dealt out with the
    split in which its record starts. With ``in_order`` all lines are dealt by ranges of
    files and splits, and the result, which is then not staged, has its records in order
    from partition to partition and in each. Runs jobs when called.
    """
    value, quote = F.col("value"), F.col("value").contains('"')
    opens = F.when(quote, value.rlike(OPENS)).otherwise(False)
    stays = F.when(quote, value.rlike(STAYS_OPEN)).otherwise(True)
    place = [LINEAGE, "block"]
    steps = lines.select(*place, "seq", opens.alias("opens"), stays.alias("stays"))
    forgets = F.when(F.col("opens") == F.col("stays"), F.col("seq"))
    splits = stage(
        steps.groupBy(*place).agg(
            F.bool_or("opens").alias("any"),
            F.max(forgets).alias("last"),
            F.max_by("opens", forgets).alias("known"),
            # Where a record that goes on from the split before ends.
            F.min(F.when(~F.col("stays"), F.col("seq"))).alias("closes"),
        ),
        "splits",
    )
    opened = splits.where("any").select(LINEAGE).distinct()
    if opened.isEmpty():
        return _in_order(lines, "block") if in_order else lines
    later = steps.where("opens and not stays").join(splits.select(*place, "last"), place).where("last is null or seq > last")
    ends = splits.join(opened, LINEAGE, "left_semi").join(later.groupBy(*place).agg(F.count("*").alias("n")), place, "left")
    odd = F.coalesce(F.col("n"), F.lit(0)) % 2 == 1
    ends = ends.withColumns({"opens": F.coalesce("known", F.lit(False)) != odd, "stays": F.coalesce("known", F.lit(True)) != odd})
    # The lines up to ``until`` belong to a record of an earlier split, the last one in which a record starts.
    through = F.col("if_outside") & F.col("closes").isNull()
    before = Window.partitionBy(LINEAGE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = _states(ends, [LINEAGE], "block").select(
        *place,
        F.when(F.col("if_outside"), F.col("stays")).otherwise(F.col("opens")).alias("open"),
        F.when(F.col("if_outside"), F.coalesce("closes", F.lit(2**63 - 1))).otherwise(-1).alias("until"),
        F.last(F.when(~through, F.col("block")), ignorenulls=True).over(before).alias("earlier"),
    )
    ends = stage(ends, "split-states")
    last = ends.groupBy(LINEAGE).agg(F.max_by("open", "block").alias("open")).where("open")
    if unclosed := [r[LINEAGE] for r in last.limit(10).collect()]:
        raise ValueError(f"a quoted field is not closed in {', '.join(sorted(unclosed))}")

    dealt = lines.join(ends.select(*place, "until", "earlier"), place, "left" if in_order else "inner")
    home = F.when(F.col("seq") <= F.col("until"), F.col("earlier")).otherwise(F.col("block"))
    dealt = dealt.select(*place, "seq", "value", home.alias("home"))
    dealt = _in_order(dealt, "home") if in_order else dealt
    whole = Window.partitionBy(LINEAGE, "home").orderBy("block", "seq")
    known = _states(dealt.withColumns({"opens": opens, "stays": stays}), [LINEAGE, "home"], "block", "seq")
    start = F.when(~F.col("if_outside"), F.struct("block", "seq"))
    up_to = whole.rowsBetween(Window.unboundedPreceding, 0)
    known = known.select(*place, "seq", "value", "home", F.last(start, ignorenulls=True).over(up_to).alias("record"))
    joined = (
        known.groupBy(LINEAGE, "home", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
        .select(LINEAGE, "record.block", "record.seq", F.array_join(F.col("parts.value"), "\n").alias("value"))
    )
    if in_order:
        return joined.sortWithinPartitions(*place, "seq")
    untouched = lines.join(opened, LINEAGE, "left_anti").select(*place, "seq", "value")
    return stage(untouched.unionByName(joined), "records")


def _in_order(lines: DataFrame, block: str) -> DataFrame:
    return lines.repartitionByRange(LINEAGE, block).sortWithinPartitions(LINEAGE, "block", "seq")
