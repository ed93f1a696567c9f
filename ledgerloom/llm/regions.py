"""Groups of linked items, found from buckets without comparing all pairs of a bucket.

Items that may be linked share a bucket. Each round elects a few pivots per bucket, measures
them against the bucket's other items and merges what is linked. Items whose component is
known to be the same are not compared again; a pivot that has met its whole bucket leaves it.
The distance to the leading pivot stays with each item, so a later round skips pairs that the
triangle inequality rules out. Rounds go on until every bucket holds one component: the
components are exact, however large a bucket is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

# Passes whose parents are looked up in one plan.
PASSES = 4
# Pivots of a bucket in the first round with several, and so many times more in each round after it.
PIVOTS, MORE = 16, 16

Measure = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp) of every item in ``edges`` (a, b); comp is the smallest id that it reaches.

    Each pass hangs an item under the smallest item two edges away, so a star is done at once, jumps
    to the parent's parent and keeps only edges between different parents, so passes are few even for long chains.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    found, passes = None, 0
    while not left.isEmpty():
        both = left.select(F.col("a").alias("id"), F.col("b").alias("to")).union(left.select("b", "a"))
        near = both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("least"))
        parent = both.join(near.toDF("to", "least"), "to").groupBy("id").agg(F.min("least").alias("up"))
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        parent = stage(parent.join(above, "up").select("id", F.col("up2").alias("up")), name)
        ends = parent.select(F.col("id").alias("a"), F.col("up").alias("ua"))
        other = parent.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        moved = left.join(ends, "a").join(other, "b").where("ua <> ub")
        left = stage(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), name)
        if found is None:
            found = parent.select("id", F.col("up").alias("comp"))
        else:
            again = parent.select(F.col("id").alias("comp"), "up")
            found = found.join(again, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        passes += 1
        if passes % PASSES == 0:
            found = stage(found, name)
    return found if found is not None else left.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def merged(comp: DataFrame | None, edges: DataFrame, name: str) -> DataFrame:
    """Components after more ``edges``, from those known before."""
    if comp is None:
        return components(edges, name)
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(comp.toDF(end, "_c"), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    more = components(ends, name)
    old = comp.join(more.toDF("comp", "up"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
    return stage(old.union(more.join(comp.select("id"), "id", "left_anti")), name)


def linked_components(
    members: DataFrame,
    measure: Measure,
    possible: Column | None = None,
    slack: float | None = None,
    name: str = "regions",
    start: Column | None = None,
    earlier: str | None = None,
    central: str | None = None,
    least: str | None = None,
    alive: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Components of the items in ``members`` (bucket, id, …) and the links measured for them.

    ``measure`` takes pairs (a, b), a < b, and returns (a, b, dist, linked). ``possible`` may
    rule out pairs from further columns of members, named with the prefixes ``a_`` and ``b_``.
    ``slack``: two items whose distances to one pivot differ by more are not linked (only for
    a metric). ``start`` marks rows, one per item, on which a round with one pivot a bucket runs
    before all others; it merges most copies, and buckets that hold one component from then on
    cost no pairs. ``earlier``: a column with another bucket of the item, or null; buckets whose
    items all name the same one are left to it. ``central``: a column that is low in items with many
    links; the lowest leads its bucket, whatever its component, and has a round of its own, so that what lies around it is joined
    before other pivots are measured. ``alive`` may rule out rows of a bucket, from
    their columns and ``least``, the bucket's lowest value of that column; like ``possible`` it spares the round on marked rows.
    ``measure`` may leave out pairs that are not linked. Returns (id, comp) of items with links and (a, b, dist). Runs jobs when called.
    """
    extra = [c for c in members.columns if c not in ("bucket", "id")]
    whole = members.withColumns({"ring": F.lit(None).cast("double"), "hub": F.lit(None).cast("long")})
    comp = done = links = None
    rows, most = whole if start is None else whole.where(start), 1
    while True:
        now = rows if comp is None else rows.join(comp, "id", "left")
        now = now.withColumn("comp", F.col("id") if comp is None else F.coalesce("comp", "id"))
        known = F.lit(None).cast("long") if earlier is None else F.col(earlier)
        sizes = now.groupBy("bucket", "comp").agg(
            F.count("*").alias("c"), F.count(known).alias("known"), F.min(known).alias("low"), F.max(known).alias("high"),
            F.min(least or F.lit(None).cast("long")).alias("least"),
        )
        live = sizes.groupBy("bucket").agg(
            F.sum("c").alias("filled"),
            F.max(F.struct("c", "comp")).alias("top"),
            F.count("*").alias("comps"),
            F.min("least").alias("least"),
            ((F.sum("known") == F.sum("c")) & (F.min("low") == F.max("high"))).alias("elsewhere"),
        )
        live = live.where("comps > 1 and not coalesce(elsewhere, false)").select("bucket", "filled", "top", "least")
        now = now.join(live, "bucket")
        rows = stage(now if alive is None or start is not None else now.where(alive), name)
        if rows.isEmpty():
            if start is None:
                break
            rows, most, start = whole, PIVOTS if central is None else 1, None
            continue
        # All but the largest component's items are electable; their order is the same in all buckets.
        order = F.xxhash64("id") if central is None else F.struct(central, F.xxhash64("id"))
        free = rows.where("comp <> top.comp").withColumn("order", order)
        pool = free if central is None else rows.withColumn("order", order)
        lead = pool.groupBy("bucket").agg(F.min(F.struct("order", "id")).alias("lead"))
        share = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(most)), 1) / F.lit(float(1 << 63))
        elected = pool.join(lead, "bucket").withColumn("leads", F.col("id") == F.col("lead.id"))
        drawn = (F.col("comp") != F.col("top.comp")) & (share < F.lit(float(most)) / (F.col("filled") - F.col("top.c")))
        elected = elected.where(F.col("leads") | drawn if most > 1 else "leads")
        pivots = stage(
            elected.select("bucket", "leads", *[F.col(c).alias(f"a_{c}") for c in ("id", "comp", "ring", "hub", *extra)]), name
        )
        others = rows.select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("id", "comp", "ring", "hub", *extra)])
        fits = (pivots["bucket"] == others["bucket"]) & (F.col("a_comp") != F.col("b_comp"))
        if possible is not None and start is None:
            fits &= possible
        if slack is not None:
            apart = (F.col("a_hub") == F.col("b_hub")) & (F.abs(F.col("a_ring") - F.col("b_ring")) > slack + 1e-9)
            fits &= ~F.coalesce(apart, F.lit(False))
        pairs = pivots.join(others, fits).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        met = stage(measure(pairs), name)
        done = met if done is None else done.unionByName(met)
        fresh = met.where("linked").select("a", "b", "dist")
        links = fresh if links is None else links.union(fresh)
        comp = merged(comp, fresh, name)
        if start is not None:
            rows, most, start = whole, PIVOTS if central is None else 1, None
            continue
        leads = pivots.where("leads").select("bucket", F.col("a_id").alias("lead_id"))
        measured = done.select("a", "b", "dist").union(done.select("b", "a", "dist")).toDF("lead_id", "id", "to_lead")
        gone = pivots.select("bucket", F.col("a_id").alias("id"))
        rows = rows.join(gone, ["bucket", "id"], "left_anti")
        if slack is not None:
            rows = rows.join(leads, "bucket").join(measured, ["lead_id", "id"], "left")
            rows = rows.withColumns(
                {"hub": F.when(F.col("to_lead").isNull(), F.col("hub")).otherwise(F.col("lead_id")), "ring": F.coalesce("to_lead", "ring")}
            )
        rows = rows.select("bucket", "id", "ring", "hub", *extra)
        most = most * MORE if most > 1 else PIVOTS * 4
    if links is None:
        empty = members.sparkSession.createDataFrame([], "a long, b long, dist double")
        return empty.selectExpr("a as id", "b as comp"), empty
    return comp, links
