"""Words, samples and other rows in order: sessions, runs, windows, smoothing and picks. by names the series, order the columns that sort it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import exact


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _all_before(by: list[str], order: list[str]):
    return _w(by, order).rowsBetween(Window.unboundedPreceding, 0)


def phrases(words: DataFrame, by: list[str], gap: float, size: int, ends: str = r"[.!?]$") -> DataFrame:
    """words with phrase: a new one after a pause longer than gap, after a word that ends a sentence, and after size words."""
    w = _w(by, ["start", "word_i"])
    hard = F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > gap) | F.lag("text").over(w).rlike(ends)
    rows = words.withColumn("_island", F.sum(hard.cast("int")).over(_all_before(by, ["start", "word_i"])))
    place = F.row_number().over(_w([*by, "_island"], ["start", "word_i"])) - 1
    fresh = (place % size == 0).cast("int")
    return rows.withColumn("_fresh", fresh).withColumn("phrase", F.sum("_fresh").over(_all_before(by, ["start", "word_i"])) - 1).drop("_island", "_fresh")


def grouped_text(words: DataFrame, by: list[str]) -> DataFrame:
    """The first start, last end, number and text of each group of words."""
    rows = words.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("start", "word_i", "text"))).alias("_w"))
    return rows.select(*by, "start", "end", "n", F.array_join(F.transform("_w", lambda x: x["text"]), " ").alias("text"))


def gapless(words: DataFrame, by: list[str]) -> DataFrame:
    """words that end where the next one in the group starts."""
    return words.withColumn("end", F.coalesce(F.lead("start").over(_w(by, ["start", "word_i"])), F.col("end")))


def bounded(words: DataFrame, by: list[str], hold: float) -> DataFrame:
    """words that end by the next one's start, and at most hold seconds after their own end."""
    after = F.lead("start").over(_w(by, ["start", "word_i"]))
    return words.withColumn("end", F.least(F.col("end") + hold, F.coalesce(after, F.col("end") + hold)))


def monotone(words: DataFrame, by: list[str], shortest: float = 0.05) -> DataFrame:
    """words that start no earlier than any before and last shortest seconds at least."""
    start = F.max("start").over(_all_before(by, ["word_i"]))
    return words.withColumn("_s", start).withColumn("end", F.greatest("end", F.col("_s") + shortest)).withColumn("start", F.col("_s")).drop("_s")


def by_characters(words: DataFrame, by: list[str]) -> DataFrame:
    """words timed anew: each gets the share of its group's span that its characters have of the group's."""
    w, whole = _w(by, ["word_i"]), Window.partitionBy(*by)
    n = F.greatest(F.length("text"), F.lit(1))
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, span, total = F.min("start").over(whole), F.max("end").over(whole) - F.min("start").over(whole), F.sum(n).over(whole)
    return words.select(*[c for c in words.columns if c not in ("start", "end")], (first + span * before / total).alias("start"), (first + span * (before + n) / total).alias("end"))


def islands(rows: DataFrame, by: list[str], index: str) -> DataFrame:
    """Runs of consecutive values of index: by, first, last and n."""
    run = F.col(index) - F.row_number().over(_w(by, [index]))
    return rows.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("_run")


def quiet_runs(series: DataFrame, by: list[str], level: float, below: float, least: int) -> DataFrame:
    """Runs of at least so many samples under the level-percentile of their series less below: by, first, last and n."""
    limits = series.groupBy(*by).agg((F.percentile("value", level) - below).alias("_limit"))
    quiet = series.join(limits, by).where("value < _limit").select(*by, "idx")
    return islands(quiet, by, "idx").where(F.col("n") >= least)


def tumbling_peaks(series: DataFrame, by: list[str], width: float, first: float = 0.0) -> DataFrame:
    """The largest sample in each window of width seconds from first on, the earliest of equal ones: by, bucket, idx, start and value."""
    rows = series.where(F.col("start") >= first).withColumn("bucket", F.floor((F.col("start") - first) / width))
    best = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(F.desc("value"), "start", "idx"))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def blocks(series: DataFrame, by: list[str], size: int) -> DataFrame:
    """The mean of each block of size samples; the last is left out if it isn't full."""
    return series.groupBy(*by, F.floor(F.col("idx") / size).alias("block")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")


def sliding(series: DataFrame, by: list[str], what: Column, before: int, after: int, name: str, full: bool = False) -> DataFrame:
    """series with what over the rows from before ahead to after behind; with full only where all of them exist."""
    w = _w(by, ["idx"]).rowsBetween(-before, after)
    out = series.withColumn(name, what.over(w))
    return out.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == before + after + 1).drop("_n") if full else out


def centred_median(series: DataFrame, by: list[str]) -> DataFrame:
    """series with median: of each sample and its two neighbours, or of itself at the ends."""
    w = _w(by, ["idx"])
    three = F.sort_array(F.array(F.lag("value").over(w), F.col("value"), F.lead("value").over(w)))
    ends = F.lag("value").over(w).isNull() | F.lead("value").over(w).isNull()
    return series.withColumn("median", F.when(ends, F.col("value")).otherwise(F.element_at(three, 2)))


def weighted(series: DataFrame, by: list[str], weights: list[float], name: str) -> DataFrame:
    """series with the weighted mean of each sample and its neighbours; at the ends the weights that are left count."""
    w, half = _w(by, ["idx"]), len(weights) // 2
    total, norm = F.lit(0.0), F.lit(0.0)
    for i, x in enumerate(weights):
        at = F.lag("value", half - i).over(w)
        total, norm = total + F.coalesce(at * x, F.lit(0.0)), norm + F.when(at.isNotNull(), x).otherwise(0.0)
    return series.withColumn(name, total / norm)


def filled(series: DataFrame, by: list[str], value: str, first: float) -> DataFrame:
    """series with missing values replaced by the last one known, or by first."""
    return series.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(_all_before(by, ["idx"])), F.lit(first)))


def interpolated(series: DataFrame, by: list[str], step: float) -> DataFrame:
    """by, t and value on the grid of multiples of step between the first and the last sample, straight lines between samples."""
    ends = series.groupBy(*by).agg(F.min("start").alias("_a"), F.max("start").alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence(F.ceil(F.col("_a") / step), F.floor(F.col("_b") / step))).alias("_k")).select(*by, (F.col("_k") * step).alias("t"))
    from .intervals import asof

    known = series.groupBy(*by, F.col("start").alias("_x")).agg(F.max_by("value", "idx").alias("_y"))
    low = asof(grid, known, by, "t", "_x").withColumnRenamed("_hit", "_low")
    both = asof(low, known, by, "t", "_x", forward=True)
    x0, y0, x1, y1 = (F.col(c) for c in ("_low._x", "_low._y", "_hit._x", "_hit._y"))
    return both.select(*by, "t", F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col("t") - x0) / F.nullif(x1 - x0, F.lit(0.0))).alias("value"))


def peaks(series: DataFrame, by: list[str], reach: int, factor: float) -> DataFrame:
    """Samples over factor times the median of their neighbours within reach, and no smaller than any of them: by, idx, value."""
    w = _w(by, ["idx"])
    near = F.sort_array(F.concat(F.collect_list("value").over(w.rowsBetween(-reach, -1)), F.collect_list("value").over(w.rowsBetween(1, reach))))
    n = F.size("_near")
    middle = F.when(n % 2 == 1, F.get("_near", F.floor(n / 2).cast("int"))).otherwise((F.get("_near", (F.floor(n / 2) - 1).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))) / 2)
    rows = series.withColumn("_near", near).where(n > 0)
    return rows.where((F.col("value") > factor * middle) & (F.col("value") >= F.array_max("_near"))).select(*by, "idx", "value")


def suppressed(picks: DataFrame, by: list[str], distance: int) -> DataFrame:
    """picks (idx, value) left when each that is closer than distance to the last kept one replaces it if larger, else goes."""
    kind = "array<struct<idx:bigint,value:double>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, 1, F.size(acc) - 1)
        return F.when(F.size(acc) == 0, F.array(x)).when(x["idx"] - last["idx"] >= distance, F.concat(acc, F.array(x))).when(x["value"] > last["value"], F.concat(rest, F.array(x))).otherwise(acc)

    rows = picks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")))).alias("_all"))
    kept = rows.select(*by, F.explode(F.aggregate("_all", F.array().cast(kind), step)).alias("_x"))
    return kept.select(*by, "_x.idx", "_x.value")


def jumps(series: DataFrame, by: list[str]) -> DataFrame:
    """The sample of each series that rises most over the larger of the two before it: by, idx, jump."""
    w = _w(by, ["idx"])
    rows = series.withColumn("_two", F.lag("value", 2).over(w)).withColumn("jump", F.col("value") - F.greatest(F.lag("value", 1).over(w), "_two")).where("_two is not null")
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("jump"), "idx"))
    return rows.withColumn("_n", best).where("_n = 1").select(*by, "idx", "jump")


def shares(rows: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    """rows with a and b: the part of 0 to 100 that their weight has."""
    w = _w(by, order)
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(weight).over(Window.partitionBy(*by))
    return rows.withColumn("a", before / total * 100).withColumn("b", (before + F.col(weight)) / total * 100)


def normalised(series: DataFrame, by: list[str], low: float, high: float, least: float) -> DataFrame:
    """series with level: 0 at its low percentile, 1 at its high one, with a span of least at the least; held within 0 and 1."""
    ends = series.groupBy(*by).agg(F.percentile("value", low).alias("_low"), F.percentile("value", high).alias("_high"))
    x = (F.col("value") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(least))
    return series.join(ends, by).withColumn("level", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).drop("_low", "_high")


def gated(series: DataFrame, by: list[str], floor: float, under: float) -> DataFrame:
    """The samples over floor that are less than under below the mean of all over floor.

    Where all of a group have at most six digits behind the point they are summed exactly: one that is just so far below the mean goes, however the rows are dealt out.
    """
    x = exact(F.col("value"))
    over = series.where(F.col("value") > floor)
    first = over.groupBy(*by).agg(F.avg("value").alias("_mean"), F.count("*").alias("_n"), F.when(F.bool_and(x.isNotNull()), F.try_sum(x)).alias("_sum"))
    near = F.when(F.col("_sum").isNotNull(), (x + exact(F.lit(under))) * F.col("_n") > F.col("_sum")).otherwise(F.col("value") > F.col("_mean") - under)
    return over.join(first, by).where(near).drop("_mean", "_n", "_sum")


def first_of(rows: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group with rank, in an order that leaves no ties to chance."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
