"""Interval sets, the two clocks they span, and joins by time.

Intervals are rows with start and end in seconds; the columns named in by say which set (a plan) a row belongs to.
Every operator partitions by them. The reverse of two bounds is repaired, missing bounds drop the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as the same time, the shortest stretch that is kept, and the shortest fragment of a frame grid.
EPS, MIN_KEEP, MIN_FRAGMENT = 1e-9, 0.05, 0.15


def _before(by: list[str], *order: str | Column):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _until(by: list[str], *order: str | Column):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def exact(x: Column) -> Column:
    """x in millionths, as a decimal, or null if it has more than six digits behind the point or nine before it. Sums of decimals are the same in whatever order rows come."""
    x = x.cast("double")
    millionths = F.when(F.abs(x) < 1e9, F.rint(x * 1e6).cast("long"))
    return F.when(millionths / 1e6 == x, millionths.cast("decimal(18,0)"))


def cleaned(cuts: DataFrame, plans: DataFrame, by: list[str]) -> DataFrame:
    """The enabled cuts inside [0, duration], with bounds in order; empty ones and those with bounds that aren't finite go."""
    rows = cuts.where(F.coalesce("enabled", F.lit(True)) & finite(F.col("start").cast("double")) & finite(F.col("end").cast("double")))
    rows = rows.join(plans.select(*by, "duration"), by)
    low, high = F.least("start", "end"), F.greatest("start", "end")
    return rows.select(*by, F.greatest(low, F.lit(0.0)).alias("start"), F.least(high, F.col("duration")).alias("end"), "duration").where("end > start")


def merged(intervals: DataFrame, by: list[str], eps: float = EPS) -> DataFrame:
    """Unions of the intervals that overlap or touch: by, start, end and n, the number of intervals in each."""
    reach = F.max("end").over(_before(by, "start", "end"))
    rows = intervals.withColumn("_new", F.when(F.col("start") <= reach + eps, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(_until(by, "start", "end")))
    return rows.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def keeps(cuts: DataFrame, plans: DataFrame, by: list[str], shortest: float = MIN_KEEP) -> DataFrame:
    """What is left of [0, duration] without the cuts: by, a, b, i and offset, where a lands when the cuts are taken out.

    Stretches of shortest seconds or less are dropped. A plan without cuts is one stretch; one that is cut altogether has no row.
    """
    rows = cleaned(cuts, plans, by).select(*by, "start", "end")
    tails = plans.select(*by, F.col("duration").alias("start"), F.col("duration").alias("end"))
    both = rows.unionByName(tails)
    reach = F.coalesce(F.max("end").over(_before(by, "start", "end")), F.lit(0.0))
    gaps = both.select(*by, reach.alias("a"), F.col("start").alias("b")).where(F.col("b") - F.col("a") > shortest)
    before = _before(by, "a")
    return gaps.select(
        *by, "a", "b", (F.row_number().over(Window.partitionBy(*by).orderBy("a")) - 1).alias("i"), F.coalesce(F.sum(F.col("b") - F.col("a")).over(before), F.lit(0.0)).alias("offset")
    )


def kept_seconds(kept: DataFrame, plans: DataFrame, by: list[str]) -> DataFrame:
    """by, duration, kept and removed seconds of each plan; plans that are cut altogether count."""
    total = kept.groupBy(*by).agg(F.sum(F.col("b") - F.col("a")).alias("kept"))
    rows = plans.join(total, by, "left").withColumn("kept", F.coalesce("kept", F.lit(0.0)))
    return rows.select(*by, "duration", "kept", (F.col("duration") - F.col("kept")).alias("removed"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, forward: bool = False, eps: float = 0.0) -> DataFrame:
    """left with the struct _hit: the row of right (its columns but by) with the latest time up to left's, or null.

    With forward the earliest time from left's on. One sort of both sides by time, no range join: the work is linear in
    the rows, whatever the times. Of rows at the same time the last wins, by all its columns.
    """
    others = [c for c in right.columns if c not in by]
    hit = F.struct(*others)
    a = left.select("*", F.col(left_time).cast("double").alias("_t"), F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("_own"), F.lit(1).alias("_side"))
    b = right.select(*by, (F.col(right_time).cast("double") + (eps if forward else -eps)).alias("_t"), hit.alias("_own"), F.lit(0).alias("_side"))
    both = b.unionByName(a, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(*by).orderBy(F.desc("_t"), "_side", "_own").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*by).orderBy("_t", "_side", "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_own", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, "_hit")


def remapped(times: DataFrame, kept: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """times with final, the time without the cuts (null inside one), and clamped, which is the end of the stretch before there (0 before the first)."""
    found = asof(times, kept.select(*by, "a", "b", "offset"), by, t, "a", eps=EPS)
    inside = F.col("_hit.offset") + F.greatest(F.lit(0.0), F.col(t) - F.col("_hit.a"))
    end = F.col("_hit.offset") + F.col("_hit.b") - F.col("_hit.a")
    return found.select(
        *times.columns, F.when(F.col(t) <= F.col("_hit.b") + EPS, F.least(inside, end)).alias("final"), F.coalesce(F.least(inside, end), F.lit(0.0)).alias("clamped")
    )


def inverted(times: DataFrame, kept: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """times with original: the time before the cuts were taken out; where two stretches meet, the later one's."""
    found = asof(times, kept.select(*by, "a", "b", "offset"), by, t, "offset", eps=EPS)
    return found.select(*times.columns, F.least(F.col("_hit.a") + F.col(t) - F.col("_hit.offset"), F.col("_hit.b")).alias("original"))


def range_remapped(ranges: DataFrame, kept: DataFrame, by: list[str], shortest: float = 1e-6) -> DataFrame:
    """ranges with final_start and final_end; those of which nothing is left go."""
    first = remapped(ranges, kept, by, "start").withColumnRenamed("clamped", "final_start").drop("final")
    both = remapped(first, kept, by, "end").withColumnRenamed("clamped", "final_end").drop("final")
    return both.where(F.col("final_end") - F.col("final_start") > shortest)


def joins(kept: DataFrame, by: list[str]) -> DataFrame:
    """The places where two stretches meet: by, i, t (final time), before, after and gap."""
    prev = F.lag("b").over(Window.partitionBy(*by).orderBy("a"))
    return kept.select(*by, "i", F.col("offset").alias("t"), prev.alias("before"), F.col("a").alias("after"), (F.col("a") - prev).alias("gap")).where("i > 0")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: float, prefix: str = "r_") -> DataFrame:
    """Pairs of rows of left and right whose intervals overlap: l.end > r.start and l.start < r.end. right's columns get the prefix.

    Both are dealt into buckets of time, and a pair counts in the first bucket they share: an equi join, which no long
    plan turns into a product.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        low, high = F.floor(F.col("start") / width), F.floor(F.col("end") / width)
        return rows.withColumn("_first", low).withColumn("_bucket", F.explode(F.sequence(low, F.greatest(low, high))))

    a = dealt(left.where("end >= start"))
    b = dealt(right.where("end >= start"))
    b = b.select(*by, "_bucket", *(F.col(c).alias(f"{prefix}{c}") for c in b.columns if c not in [*by, "_bucket"]))
    both = a.join(b, [*by, "_bucket"])
    meets = (F.col("end") > F.col(f"{prefix}start")) & (F.col("start") < F.col(f"{prefix}end"))
    return both.where(meets & (F.col("_bucket") == F.greatest("_first", f"{prefix}_first"))).drop("_bucket", "_first", f"{prefix}_first")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """left with near: the time of right nearest to its own, of two as near the earlier, or null beyond the tolerance."""
    times = right.select(*by, F.col(right_time).alias("_near"))
    a = asof(left, times, by, left_time, "_near").withColumn("_low", F.col("_hit._near")).drop("_hit")
    both = asof(a, times, by, left_time, "_near", forward=True).withColumn("_high", F.col("_hit._near"))
    t = F.col(left_time)
    pick = F.when(F.col("_high").isNull() | (t - F.col("_low") <= F.col("_high") - t), F.col("_low")).otherwise(F.col("_high"))
    return both.withColumn("near", F.when(F.abs(pick - t) <= tolerance, pick)).select(*left.columns, "near")


def gridded(kept: DataFrame, by: list[str], fps: float, shortest: float = MIN_FRAGMENT) -> DataFrame:
    """Stretches widened to whole frames, merged where they meet; fragments shorter than shortest go, but the longest stays if all are."""
    rows = kept.where(F.col("b") - F.col("a") >= shortest)
    none = kept.join(rows.select(*by).distinct(), by, "left_anti")
    longest = Window.partitionBy(*by).orderBy(F.desc(F.col("b") - F.col("a")), "a")
    rows = rows.select(*by, "a", "b").unionByName(none.withColumn("_n", F.row_number().over(longest)).where("_n = 1").select(*by, "a", "b"))
    frames = rows.select(*by, F.floor(F.col("a") * fps + 1e-6).cast("double").alias("start"), F.ceil(F.col("b") * fps - 1e-6).cast("double").alias("end"))
    return merged(frames, by, 0.0).select(*by, F.col("start").cast("long").alias("first_frame"), F.col("end").cast("long").alias("end_frame"))


def apart(times: DataFrame, by: list[str], t: str, least: float) -> DataFrame:
    """The times that are at least so far from the last one kept, in order of time. The fold runs over one plan's times at once."""
    step = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x - F.element_at(acc, -1) >= least, F.concat(acc, F.array(x))).otherwise(acc)
    rows = times.groupBy(*by).agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("_all"))
    return rows.select(*by, F.explode(F.aggregate("_all", F.array().cast("array<double>"), step)).alias(t))
