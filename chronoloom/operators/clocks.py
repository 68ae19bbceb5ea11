"""Whole tracks of a plan moved to the clock of what is kept: items, shots, music, sounds, highlights and captions.

Each function sorts a plan's times and its kept stretches once, however many times a row has, and groups them back by row in the same
partitions. A plan without kept stretches has a final clock of no length: ranges go, points land at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

#: Names of sounds that lead up to their time, bounds of pitch, the gain of a sound that has none, the shortest silence, and what marks a bad row.
RISERS, PITCH, GAIN, SILENCE, BAD = ("riser_short", "riser_long"), 24.0, -6.0, 0.05, "dato_invalido"
#: Captions begin so long before their first word, and meet it within so much.
LEAD, NEAR = 0.06, 0.002


def number(x: Column) -> Column:
    """x as a finite double, or null."""
    x = x.try_cast("double")
    return F.when(iv.finite(x), x)


def all_remapped(rows: DataFrame, kept: DataFrame, by: list[str], key: list[str], times: dict[str, Column]) -> DataFrame:
    """rows with a column for each of times: the time on the final clock, clamped to the stretch before it inside a cut; null stays null.

    key tells the rows of a plan apart; rows that share it become one.
    """
    others = [c for c in rows.columns if c not in [*by, *key]]
    points = F.array(*(F.struct(F.lit(n).alias("n"), x.cast("double").alias("t")) for n, x in times.items()))
    long = rows.select(*by, *key, F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.explode(points).alias("_p"))
    found = iv.remapped(long.select(*by, *key, "_row", F.col("_p.n").alias("_n"), F.col("_p.t").alias("_t0")), kept, by, "_t0")
    got = [F.max(F.when((F.col("_n") == n) & F.col("_t0").isNotNull(), F.col("clamped"))).alias(n) for n in times]
    return found.groupBy(*by, *key).agg(F.any_value("_row").alias("_row"), *got).select(*by, *key, *(f"_row.{c}" for c in others), *times)


def items_mapped(items: DataFrame, kept: DataFrame, by: list[str], key: list[str], shortest: float = 1e-6) -> DataFrame:
    """items (start and end, or else at and dur) with final_start and final_end. A range of which nothing is left goes, and so does an item without times; a point keeps its dur."""
    start, end, at = number(F.col("start")), number(F.col("end")), number(F.col("at"))
    ranged = start.isNotNull() & end.isNotNull()
    first = F.when(ranged, F.least(start, end)).otherwise(at)
    rows = all_remapped(items, kept, by, key, {"final_start": first, "_last": F.when(ranged, F.greatest(start, end))})
    a, b = F.col("final_start"), F.col("_last")
    rows = rows.where(a.isNotNull() & (b.isNull() | (b - a > shortest)))
    return rows.withColumn("final_end", F.coalesce(b, a + F.coalesce(number(F.col("dur")), F.lit(0.0)))).drop("_last")


def shots_mapped(shots: DataFrame, plans: DataFrame, kept: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """shots with final_start, final_end and index, the place a shot had among all of its plan. A start that is missing is 0, an end the plan's duration."""
    place = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).alias("index")
    rows = shots.join(plans.select(*by, F.col("duration").alias("_d")), by).select("*", place)
    a, b = F.coalesce("start", F.lit(0.0)), F.coalesce("end", "_d")
    rows = all_remapped(rows, kept, by, ["index"], {"final_start": F.least(a, b), "final_end": F.greatest(a, b)})
    return rows.where("final_end - final_start > 1e-6").drop("_d")


def music_mapped(music: DataFrame, kept: DataFrame, by: list[str], digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """A plan's music (stops of at and dur, swells of start, end and db, drop_at, enabled, source) on the final clock, with active; and by, part, i and reason of bad rows.

    A silence that crosses a cut lasts for what is left of it; one without a dur keeps none. A swell that is cut altogether goes.
    """
    stop = lambda x, i: F.struct(F.lit("stops").alias("part"), i.cast("int").alias("i"), number(x["at"]).alias("a"), (number(x["at"]) + F.when(number(x["dur"]) > 0, number(x["dur"]))).alias("b"), number(x["dur"]).alias("more"))
    swell = lambda x, i: F.struct(F.lit("swells").alias("part"), i.cast("int").alias("i"), number(x["start"]).alias("a"), number(x["end"]).alias("b"), number(x["db"]).alias("more"))
    drop = F.array(F.struct(F.lit("drop_at").alias("part"), F.lit(0).alias("i"), number(F.col("drop_at")).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("more")))
    none = F.array().cast(drop_type := "array<struct<part:string,i:int,a:double,b:double,more:double>>")
    entries = F.concat(F.coalesce(F.transform("stops", stop).cast(drop_type), none), F.coalesce(F.transform("swells", swell).cast(drop_type), none), drop.cast(drop_type))
    rows = music.select(*by, "enabled", "source", F.inline(entries))
    a, b, swells = F.col("a"), F.col("b"), F.col("part") == "swells"
    mapped = all_remapped(rows, kept, by, ["part", "i"], {"fa": F.when(swells, F.least(a, b)).otherwise(a), "fb": F.when(swells, F.greatest(a, b)).otherwise(b)})
    wrong = (F.col("part") != "drop_at") & (a.isNull() | (swells & b.isNull()))
    skipped = mapped.where(wrong).select(*by, "part", "i", F.concat(F.lit("music:"), "part", F.lit(f":{BAD}")).alias("reason"))
    at, until = F.round("fa", digits), F.round("fb", digits)
    length = F.when(b.isNotNull(), F.round(F.greatest(F.lit(SILENCE), F.col("fb") - F.col("fa")), digits))
    good = ~wrong & (~swells | (F.col("fb") - F.col("fa") > 1e-6))
    listed = lambda part, *fields: F.transform(F.sort_array(F.collect_list(F.when(good & (F.col("part") == part), F.struct("i", F.struct(*fields).alias("x"))))), lambda x: x["x"])
    config = mapped.groupBy(*by).agg(
        listed("stops", at.alias("at"), F.coalesce(length, "more").alias("dur")).alias("stops"), listed("swells", at.alias("start"), until.alias("end"), F.col("more").alias("db")).alias("swells"),
        F.max(F.when(F.col("part") == "drop_at", at)).alias("drop_at"), F.any_value(F.coalesce("enabled", F.lit(True)) & (F.coalesce("source", F.lit("ai")) != "none")).alias("active"),
    )
    return config, skipped


def sounds_mapped(sounds: DataFrame, plans: DataFrame, kept: DataFrame, by: list[str], key: str = "id", digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Enabled sounds (name, at, gain_db, pan, variant, pitch, dur) on the final clock, and by, key and reason of those without a time.

    The dur of a riser lies before its time, that of others after it; what a cut leaves of it counts, or all of it where nothing is left. A sound at the end or behind goes.
    """
    rows = sounds.where(F.coalesce("enabled", F.lit(True))).withColumns({"_at": number(F.col("at")), "_dur": number(F.col("dur"))})
    skipped = rows.where("_at is null").select(*by, key, F.concat(F.lit("sfx:"), F.col(key).cast("string"), F.lit(f":{BAD}")).alias("reason"))
    riser = F.startswith(F.coalesce("name", F.lit("")), F.lit(RISERS[0])) | F.startswith(F.coalesce("name", F.lit("")), F.lit(RISERS[1]))
    other = F.when(F.col("_dur") > 0, F.col("_at") + F.when(riser, -F.col("_dur")).otherwise(F.col("_dur")))
    mapped = all_remapped(rows.where("_at is not null"), kept, by, [key], {"_a": F.col("_at"), "_b": other})
    left = F.abs(F.col("_b") - F.col("_a"))
    total = iv.kept_seconds(kept, plans, by).select(*by, "kept")
    return mapped.join(total, by).where("_a < kept").select(
        *by, key, "name", F.round("_a", digits).alias("at"), F.coalesce(number(F.col("gain_db")), F.lit(GAIN)).alias("gain_db"), F.coalesce(number(F.col("pan")), F.lit(0.0)).alias("pan"),
        F.when(F.col("variant") >= 0, F.col("variant").cast("int")).alias("variant"), F.when(number(F.col("pitch")).isNotNull(), F.greatest(F.lit(-PITCH), F.least(F.lit(PITCH), number(F.col("pitch"))))).alias("pitch"),
        F.when(F.col("_dur") > 0, F.round(F.when(left > 1e-3, left).otherwise(F.col("_dur")), digits)).alias("dur"),
    ), skipped


def highlights_mapped(highlights: DataFrame, plans: DataFrame, kept: DataFrame, by: list[str], order: list[str], fps: float = 30.0, shortest: float = 1.0) -> DataFrame:
    """Enabled highlights as clips on whole frames of the final clock: by, index (its place among all of the plan), title, start and end. Clips under shortest seconds go."""
    place = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).alias("index")
    rows = highlights.select("*", place).where(F.coalesce("enabled", F.lit(True)) & iv.finite(F.col("start")) & iv.finite(F.col("end")))
    rows = all_remapped(rows, kept, by, ["index"], {"_a": F.least("start", "end"), "_b": F.greatest("start", "end")}).where("_b - _a > 1e-6")
    total = iv.kept_seconds(kept, plans, by).select(*by, "kept")
    first = F.floor(F.col("_a") * fps + 1e-6) / fps
    last = F.least("kept", F.ceil(F.col("_b") * fps - 1e-6) / fps)
    return rows.join(total, by).where(last - first >= shortest).select(*by, "index", "title", F.round(first, 4).alias("start"), F.round(last, 4).alias("end"))


def preview_groups(words: DataFrame, by: list[str], order: str, size: int = 4, gap: float = 0.45) -> DataFrame:
    """words with group: at most size words, broken behind . ! ? and at longer gaps; a group of one word then joins the one before it, if it is near.

    Of single words in a row only every second joins, from the last on, as the one before it has a second word by then. Two sorts by plan, up and down in time, and no fold.
    """
    w, until = Window.partitionBy(*by).orderBy(order), iv._until(by, order)
    down = Window.partitionBy(*by).orderBy(F.desc(order))
    rows = words.withColumn("_stop", F.right(F.rtrim("text"), F.lit(1)).isin(".", "!", "?"))  # before rows are shuffled: where nobody asks for the text, it stays behind
    rows = rows.select("*", (F.col("start") - F.lag("end").over(w)).alias("_gap"), F.lag("_stop").over(w).alias("_ends"), F.row_number().over(w).alias("_n"))
    new = F.col("_gap").isNull() | (F.col("_gap") > gap) | F.col("_ends")
    place = F.col("_n") - F.max(F.when(new, F.col("_n"))).over(until)
    rows = rows.withColumn("_first", (place % size == 0).cast("int"))
    alone = (F.col("_first") == 1) & (F.lead("_first", 1, 1).over(w) == 1)
    rows = rows.withColumn("_joins", F.coalesce(alone & (F.col("_gap") < gap), F.lit(False)))
    # how many rows from this one on to the first that doesn't join, or to the end; single words are rows of their own
    until_down = down.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_left", F.coalesce(F.min(F.when(~F.col("_joins"), F.col("_n"))).over(until_down), F.max("_n").over(until_down) + 1) - F.col("_n"))
    rows = rows.withColumn("_starts", F.when(F.col("_joins") & (F.col("_left") % 2 == 1), 0).otherwise(F.col("_first")))
    behind = F.sum("_starts").over(until_down) - F.col("_starts")
    total = F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("group", (total - behind - 1).cast("int")).select(*words.columns, "group")


def words_of_groups(groups: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """words with the group (its struct in _hit) that holds them: the last whose first word, LEAD behind its start, is no later. Words before all groups go."""
    return iv.asof(words, groups.withColumn("_first", F.col("start") + LEAD), by, "start", "_first", eps=NEAR).where("_hit is not null")


def captions_on_both_clocks(words: DataFrame, kept: DataFrame, by: list[str], order: str, size: int = 4) -> DataFrame:
    """Groups of the words that are kept: by, group, start and end on the original clock, start_final and end_final, and the words with their original times."""
    rows = all_remapped(words, kept, by, [order], {"_a": F.least("start", "end"), "_b": F.greatest("start", "end")}).where("_b - _a > 0.01")
    final = rows.select(*by, order, "text", F.col("_a").alias("start"), F.col("_b").alias("end"), F.struct("text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end")).alias("_word"))
    grouped = preview_groups(final, by, order, size)
    groups = grouped.groupBy(*by, "group").agg(
        F.min_by("start", order).alias("start_final"), F.max_by("end", order).alias("end_final"), F.transform(F.sort_array(F.collect_list(F.struct(order, "_word"))), lambda x: x["_word"]).alias("words")
    )
    first = iv.inverted(groups, kept, by, "start_final").withColumnRenamed("original", "start")
    return iv.inverted(first, kept, by, "end_final").withColumnRenamed("original", "end")
