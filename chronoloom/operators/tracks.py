"""Items on a plan's tracks: what is active, what stands near what, and picks along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import asof, exact, overlapping


def active_at(items: DataFrame, t: float, tolerance: float = 0.0) -> DataFrame:
    """Range items (start, end) with start <= t < end, and events (at) within the tolerance of t."""
    return items.where(F.when(F.col("at").isNull(), (F.col("start") <= t) & (F.lit(t) < F.col("end"))).otherwise(F.abs(F.col("at") - t) <= tolerance))


def in_bars(samples: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """samples (t) with bar, the number of the bar (start, end, bar) that they lie in, or null."""
    found = asof(samples, bars.select(*by, "start", "end", "bar"), by, "t", "start")
    return found.select(*samples.columns, F.when(F.col("t") < F.col("_hit.end"), F.col("_hit.bar")).alias("bar"))


def first_match(times: DataFrame, ranges: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """times (t, id) with the value of the range first in its list (ord) that holds t, both ends included."""
    points = times.withColumn("start", F.col("t") - 1e-9).withColumn("end", F.col("t") + 1e-9)
    hits = overlapping(points, ranges, by, width).groupBy(*by, "id").agg(F.min_by(f"r_{value}", "r_ord").alias(value))
    return times.join(hits, [*by, "id"], "left")


def spans_with_margin(items: DataFrame, words: DataFrame, by: list[str], margin: float, width: float) -> DataFrame:
    """by, id and text: the words that overlap each item widened by margin seconds, in order."""
    wide = items.select(*by, "id", (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    hits = overlapping(wide, words, by, width)
    rows = hits.groupBy(*by, "id").agg(F.sort_array(F.collect_list(F.struct("r_start", "r_word_i", "r_text"))).alias("_w"))
    return rows.select(*by, "id", F.array_join(F.transform("_w", lambda x: x["r_text"]), " ").alias("text"))


def companions(events: DataFrame, others: DataFrame, by: list[str], within: float) -> DataFrame:
    """Pairs of ids of events (at) and others (at) that are at most within seconds apart."""
    points = events.select(*by, "id", (F.col("at") - within).alias("start"), (F.col("at") + within + 1e-9).alias("end"), "at")
    marks = others.select(*by, "id", F.col("at").alias("start"), (F.col("at") + 1e-9).alias("end"), "at")
    return overlapping(points, marks, by, 4 * within + 1).where(F.abs(F.col("at") - F.col("r_at")) <= within).select(*by, "id", "r_id")


def scale_at(items: DataFrame, times: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, t and scale: the product of the scales (over 0) of the items active at t, 1 for none."""
    points = times.withColumn("start", F.col("t")).withColumn("end", F.col("t") + 1e-9)
    hits = overlapping(points, items, by, width).where((F.col("r_start") <= F.col("t")) & (F.col("t") < F.col("r_end")))
    product = hits.groupBy(*by, "t").agg(F.exp(F.sum(F.ln("r_scale"))).alias("scale"))
    return times.join(product, [*by, "t"], "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def median_if_enough(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by and the median of the values that are there, null where less than the share of the rows has one."""
    valid = F.avg(F.col(value).isNotNull().cast("double"))
    return rows.groupBy(*by).agg(F.when(valid >= share, F.median(value)).alias("median"), valid.alias("valid"))


def weighted_quality(rows: DataFrame, by: list[str], value: str, weight: str, least: float) -> DataFrame:
    """by, quality (the weighted mean), worst and whether the quality is under least.

    Sums are exact where all numbers of a group have at most six digits behind the point, and the mean has then no digits that only the order of adding gave it: half a digit is
    rounded up, and what equals least isn't under it, however the rows are dealt out.
    """
    v, w = exact(F.col(value)), exact(F.col(weight))
    product = F.when(F.col(value).isNotNull() & F.col(weight).isNotNull(), v.isNotNull() & w.isNotNull())  # null: counts in neither sum
    whole = F.coalesce(F.bool_and(product), F.lit(False)) & F.coalesce(F.bool_and(F.when(F.col(weight).isNotNull(), w.isNotNull())), F.lit(False))
    sums = rows.groupBy(*by).agg(
        F.min(value).alias("worst"), F.sum(F.col(value) * F.col(weight)).alias("_a"), F.sum(weight).alias("_b"), F.when(whole, F.try_sum(v * w)).alias("_x"), F.when(whole, F.try_sum(w)).alias("_y"),
    )
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    quality = F.when(known, F.round(F.try_divide(F.col("_x").cast("double"), F.col("_y").cast("double") * 1e6), 13)).otherwise(F.try_divide(F.col("_a"), F.col("_b")))
    return sums.withColumn("quality", quality).withColumn("warn", F.col("quality") < least).select(*by, "quality", "worst", "warn")


def histogram_distance(rows: DataFrame, by: list[str], frame: str, code: str) -> DataFrame:
    """by, frame and distance: how much the shares of the codes differ from those of the frame before, 0 to 2."""
    n = rows.groupBy(*by, frame, code).agg(F.count("*").alias("_n"))
    shares = n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by, frame)))
    frames = shares.select(*by, frame).distinct()
    before = frames.withColumn("_prev", F.lag(frame).over(Window.partitionBy(*by).orderBy(frame))).where("_prev is not null")
    now = before.join(shares, [*by, frame]).select(*by, frame, code, F.col("_p"))
    then = before.join(shares.withColumnRenamed(frame, "_prev"), [*by, "_prev"]).select(*by, frame, code, (-F.col("_p")).alias("_p"))
    each = now.union(then).groupBy(*by, frame, code).agg(F.abs(F.sum("_p")).alias("_d"))
    return each.groupBy(*by, frame).agg(F.sum("_d").alias("distance"))


def folded(rows: DataFrame, by: list[str], order: list[str], columns: list[str], start: Column, step) -> DataFrame:
    """by and the state after a fold over the group's rows in order; step takes the state and a row's struct."""
    all_rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return rows.groupBy(*by).agg(all_rows.alias("_all")).select(*by, F.aggregate("_all", start, step).alias("state"))


def greedy_spans(spans: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """The spans (id, start, end) that overlap none taken before them, best rank first."""
    kind = "array<struct<id:bigint,start:double,end:double>>"
    item = lambda x: F.struct(x["id"].cast("long").alias("id"), x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end"))
    step = lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])), acc).otherwise(F.concat(acc, F.array(item(x))))
    done = folded(spans, by, [rank, "id"], ["start", "end"], F.array().cast(kind), step)
    return done.select(*by, F.explode("state").alias("_x")).select(*by, "_x.*")


def crossfaded(clips: DataFrame, by: list[str], fade: float) -> DataFrame:
    """by, i and at: where each clip (i, duration) begins when neighbours overlap by fade, or by less if either is too short."""
    step = lambda s, x: F.struct((s["end"] + x["duration"] - overlap(s, x)).alias("end"), F.concat(s["out"], F.array(F.struct(x["i"].cast("long").alias("i"), (s["end"] - overlap(s, x)).alias("at")))).alias("out"))
    overlap = lambda s, x: F.when(F.size(s["out"]) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(fade), x["duration"] - 0.05, s["end"] - 0.05)))
    start = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<struct<i:bigint,at:double>>").alias("out"))
    done = folded(clips, by, ["i"], ["duration"], start, step)
    return done.select(*by, F.explode("state.out").alias("_x")).select(*by, "_x.i", "_x.at")


def alternating(rows: DataFrame, by: list[str], order: str, wanted: str) -> DataFrame:
    """by and the order of each row that is wanted, unless the row before was taken."""
    step = lambda s, x: F.when(x[wanted] & (x[order] - F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(-2)) > 1), F.concat(s, F.array(x[order].cast("long")))).otherwise(s)
    done = folded(rows, by, [order], [wanted], F.array().cast("array<bigint>"), step)
    return done.select(*by, F.explode("state").alias(order))


def evenly_spaced(ranges: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, part, start and end: each range (start, end) in n equal parts."""
    width = (F.col("end") - F.col("start")) / n
    rows = ranges.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(*by, "part", (F.col("start") + width * F.col("part")).alias("start"), (F.col("start") + width * (F.col("part") + 1)).alias("end"))


def anchors(plans: DataFrame, words: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, k, t and word_i: the words that start last before n anchors spread evenly over each plan."""
    grid = plans.select(*by, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"), "duration").select(*by, "k", (F.col("duration") * F.col("k") / (n + 1)).alias("t"))
    return asof(grid, words.select(*by, "start", "word_i"), by, "t", "start").select(*by, "k", "t", F.col("_hit.word_i").alias("word_i"))
