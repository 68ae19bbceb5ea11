"""Sweeps and matches over sections of a plan: means over time that belongs to one interval alone, quiet runs, repeats at a distance of bars, and segments of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import asof
from .sequences import islands

#: Distances in bars at which a repeat is looked for, in this order, with what each adds to the score.
LAGS = {16: 0.12, 8: 0.08, 4: 0.0, 2: -0.15, 1: -0.3}
#: A score above which shorter distances aren't looked at, and the weights of the bar before, of differences in energy (here, before), and the most that energy adds.
ENOUGH, BEFORE, DIFFERS, DIFFERED, MOST = 1.2, 0.5, 0.08, 0.05, 0.8


def exclusive_stretches(intervals: DataFrame, by: list[str], id_column: str) -> DataFrame:
    """by, id, start and end of the stretches of time in which that interval alone is open.

    One sweep over the bounds: a running count tells how many are open, and a running sum of ids, where it is one, which. Ids are whole numbers, one for an interval; empty intervals count for nothing.
    """
    rows = intervals.where("end > start").select(*by, F.col(id_column).cast("decimal(38,0)").alias("_id"), "start", "end")
    bounds = rows.select(*by, "_id", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("_b"))
    changes = bounds.groupBy(*by, F.col("_b.t").alias("t")).agg(F.sum("_b.d").alias("_n"), F.sum(F.col("_id") * F.col("_b.d")).alias("_ids"))
    w = Window.partitionBy(*by).orderBy("t")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = changes.select(*by, F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.sum("_n").over(sofar).alias("_open"), F.sum("_ids").over(sofar).alias("_owner"))
    return swept.where("_open = 1").select(*by, F.col("_owner").cast("long").alias(id_column), "start", "end")


def exclusive_means(intervals: DataFrame, series: DataFrame, by: list[str], id_column: str) -> DataFrame:
    """by, id, seconds in which the interval alone is open, and the mean over them of a series (start, value) whose values hold until the next; null where it has none yet for some of the time."""
    w = Window.partitionBy(*by).orderBy("start")
    last = series.groupBy(*by, "start").agg(F.max_by("value", "idx").alias("value"))
    area = F.coalesce(F.sum(F.col("value") * F.col("_for")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    signal = last.withColumn("_for", F.lead("start").over(w) - F.col("start")).select(*by, F.col("start").alias("_s"), "value", area.alias("_area"))
    stretches = exclusive_stretches(intervals, by, id_column)
    ends = stretches.select(*by, id_column, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(-1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(1).alias("d")))).alias("_b"))
    met = asof(ends.select(*by, id_column, F.col("_b.t").alias("t"), F.col("_b.d").alias("d")), signal, by, "t", "_s")
    upto = F.col("_hit._area") + F.col("_hit.value") * (F.col("t") - F.col("_hit._s"))
    told = met.groupBy(*by, id_column).agg(F.sum(F.col("t") * F.col("d")).alias("seconds"), F.sum(upto * F.col("d")).alias("_sum"), F.count(upto).alias("_known"), F.count("*").alias("_all"))
    return told.select(*by, id_column, "seconds", F.when(F.col("_known") == F.col("_all"), F.col("_sum") / F.col("seconds")).alias("mean"))


def quiet_bars(bars: DataFrame, by: list[str], level: float, least: int = 2) -> DataFrame:
    """by, quiet and runs: how many bars (bar, level) lie in runs of least bars or more below level, and in how many; plans without any have zeros."""
    runs = islands(bars.where(F.col("level") < level).select(*by, "bar"), by, "bar").where(F.col("n") >= least)
    counted = runs.groupBy(*by).agg(F.sum("n").alias("quiet"), F.count("*").alias("runs"))
    return bars.select(*by).distinct().join(counted, by, "left").select(*by, F.coalesce("quiet", F.lit(0)).cast("long").alias("quiet"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def repeats(bars: DataFrame, by: list[str], gates: tuple[float, ...] = (0.35, 0.0), energy: float = 0.2) -> DataFrame:
    """The best pair of bars to repeat between: by, gate, first, second, lag and score; plans without any have no row.

    bars has bar (from 0), start, feature (an array), energy, level (energy from 0 to 1) and last (the time by which the second bar must start). A pair is a bar and the one lag bars on. It scores by the
    likeness of the two and of the bars before them, by differences in energy, by the lag and by the level in between. Pairs start at the first bar with a level of gate or more; of the lags, in order,
    none is looked at after the best so far passes ENOUGH; the next gate counts where one gives no pair. A banded equi join on the bar: pairs are lags times the bars.
    """
    w = Window.partitionBy(*by).orderBy("bar")
    rows = bars.select(*by, "bar", "start", "feature", "energy", "last", "level", F.coalesce(F.sum("level").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_sum"))
    lags = F.array(*(F.struct(F.lit(lag).alias("lag"), F.lit(i).alias("rank"), F.lit(bonus).alias("bonus")) for i, (lag, bonus) in enumerate(LAGS.items())))
    a = rows.select(*by, "bar", "start", "feature", "energy", "last", "_sum", F.explode(lags).alias("_l")).select("*", (F.col("bar") + F.col("_l.lag")).alias("_other"))
    b = rows.select(*by, F.col("bar").alias("_other"), F.col("start").alias("_start"), F.col("feature").alias("_feature"), F.col("energy").alias("_energy"), F.col("_sum").alias("_upto"))
    met = a.join(b, [*by, "_other"]).select(
        *by, "bar", "start", "_start", "last", F.col("_l.lag").alias("lag"), F.col("_l.rank").alias("_rank"), F.col("_l.bonus").alias("_bonus"), cosine(F.col("feature"), F.col("_feature")).alias("_like"),
        F.abs(F.col("energy") - F.col("_energy")).alias("_differs"), ((F.col("_upto") - F.col("_sum")) / F.col("_l.lag")).alias("_level"),
    )
    along = Window.partitionBy(*by, "lag").orderBy("bar")
    before, differed = F.coalesce(F.lag("_like").over(along), F.col("_like")), F.coalesce(F.lag("_differs").over(along), F.lit(0.0))
    score = F.col("_like") + BEFORE * before - DIFFERS * F.col("_differs") - DIFFERED * differed + F.col("_bonus") + energy * F.least("_level", F.lit(MOST))
    scored = met.withColumn("score", score).where(F.col("_start") <= F.col("last") - 0.05)
    opens = [F.struct(F.lit(i).alias("gate"), F.min(F.when(F.col("level") >= g, F.col("bar"))).alias("_open")) for i, g in enumerate(gates)]
    first = rows.groupBy(*by).agg(F.array(*opens).alias("_g")).select(*by, F.explode("_g").alias("_g")).select(*by, "_g.gate", "_g._open")
    pairs = scored.join(first, by).where(F.col("bar") >= F.col("_open"))
    best = pairs.groupBy(*by, "gate", "_rank").agg(F.max(F.struct("score", (-F.col("bar")).alias("bar"), "lag", "start", "_start")).alias("_b"))
    order = Window.partitionBy(*by, "gate").orderBy("_rank")
    running = best.select(*by, "gate", "_rank", F.max(F.struct("_b.score", (-F.col("_rank")).alias("r"), "_b")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_x"))
    stop = F.coalesce(F.min(F.when(F.col("_x.score") > ENOUGH, F.col("_rank"))).over(Window.partitionBy(*by, "gate")), F.max("_rank").over(Window.partitionBy(*by, "gate")))
    chosen = running.withColumn("_stop", stop).where("_rank = _stop").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("gate"))).where("_n = 1")
    return chosen.select(*by, F.col("gate").cast("long").alias("gate"), F.col("_x._b.start").alias("first"), F.col("_x._b._start").alias("second"), F.col("_x._b.lag").cast("long").alias("lag"), F.col("_x.score").alias("score"))


def segments(samples: DataFrame, cuts: DataFrame, by: list[str], most: int) -> DataFrame:
    """samples (idx, frame, cx, cy, w; null where nothing was found) with segment, for those found.

    A segment ends where more than most samples are missing, where the place jumps by more than 0.1 and 1.2 widths, where the size changes by more than 1.6 times, and where a cut (frame) lies in between.
    """
    found = samples.where("cx IS NOT NULL AND cy IS NOT NULL AND w IS NOT NULL")
    last = asof(found, cuts.select(*by, F.col("frame").alias("_cut")).distinct(), by, "frame", "_cut").withColumn("_cut", F.col("_hit._cut")).drop("_hit")
    w = Window.partitionBy(*by).orderBy("idx")
    before = lambda c: F.lag(c).over(w)
    jump = F.sqrt((F.col("cx") - before("cx")) ** 2 + (F.col("cy") - before("cy")) ** 2) > F.greatest(F.lit(0.1), 1.2 * before("w"))
    size = F.greatest("w", before("w")) / F.greatest(F.lit(1e-6), F.least(F.col("w"), before("w"))) > 1.6
    new = before("idx").isNull() | (F.col("idx") - before("idx") > most) | jump | size | F.coalesce(F.col("_cut") > before("frame"), F.lit(False))
    return last.withColumn("_new", new.cast("int")).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new", "_cut")


def reached_frames(segmented: DataFrame, cuts: DataFrame, plans: DataFrame, by: list[str], step: float, most: int) -> DataFrame:
    """by, frame and segment for the frames of plans (by, frames) that a segment reaches, inside it or as the nearest.

    Towards a neighbour a segment reaches half the gap, to a cut in between as far as the cut, and most steps' half at the utmost; the first and the last reach half a step outwards. Two segments as near: the earlier one.
    """
    reach = most * step * 0.5
    hold = step * 0.5 + 0.5
    spans = segmented.groupBy(*by, "segment").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    marks = cuts.select(*by, F.col("frame").alias("_cut")).distinct()
    spans = asof(spans, marks, by, "lo", "_cut").withColumn("_left", F.col("_hit._cut")).drop("_hit")
    spans = asof(spans.withColumn("_after", F.col("hi") + 0.5), marks, by, "_after", "_cut", forward=True).withColumn("_right", F.col("_hit._cut")).drop("_hit", "_after")
    w = Window.partitionBy(*by).orderBy("segment")
    prev, nxt = F.lag("hi").over(w), F.lead("lo").over(w)
    left = F.when(prev.isNull(), F.col("lo") - hold).when(F.col("_left") > prev, F.col("lo") - F.least(F.lit(reach), F.col("lo") - F.col("_left"))).otherwise(F.col("lo") - F.least(F.lit(reach), (F.col("lo") - prev) / 2))
    right = F.when(nxt.isNull(), F.col("hi") + hold).when(F.col("_right") <= nxt, F.col("hi") + F.least(F.lit(reach), F.col("_right") - 1 - F.col("hi"))).otherwise(F.col("hi") + F.least(F.lit(reach), (nxt - F.col("hi")) / 2))
    spans = spans.select(*by, "segment", "lo", "hi", F.greatest(left, F.coalesce("_left", left)).alias("_from"), F.least(right, F.coalesce(F.col("_right") - 1, right)).alias("_to"))
    low, high = F.greatest(F.lit(0), F.ceil("_from")), F.least(F.floor("_to"), F.col("frames") - 1)
    frames = spans.join(plans.select(*by, "frames"), by).where(low <= high).select(*by, "segment", "lo", "hi", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("frame"))
    far = F.when(F.col("frame") < F.col("lo"), F.col("lo") - F.col("frame")).when(F.col("frame") > F.col("hi"), F.col("frame") - F.col("hi")).otherwise(F.lit(0))
    return frames.groupBy(*by, "frame").agg(F.min(F.struct(far.alias("d"), F.col("segment"))).alias("_n")).select(*by, "frame", F.col("_n.segment").alias("segment"))
