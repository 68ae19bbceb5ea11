"""Rows that point to other rows, and what is picked by following the pointers.

A greedy rule that walks through a plan (cut here, go on there) is no loop over the plan where the next stop depends on the present one alone: each row then points to its next stop, and the stops
are what the pointers reach from the first row. Pointers are doubled round by round, so 2 ** k stops take k rounds of equi joins, and no task holds a plan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import asof


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the folder that spark.checkpoint.dir names. Only a local session without one gets a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    at = f"{folder.rstrip('/')}/held-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def chained(links: DataFrame, firsts: DataFrame, by: list[str], at: str, to: str) -> DataFrame:
    """by and at of the rows that following to, from row to row, reaches from firsts, these included.

    Pointers go onwards only, so no row is reached twice; a null pointer ends a walk. The number of rounds is the logarithm of the longest walk.
    """
    onwards = links.where(F.col(to).isNotNull()).select(*by, F.col(at).alias("_from"), F.col(to).alias("_to"))
    reached = firsts.select(*by, F.col(at).alias("_from"))
    useful = onwards.select(*by, F.col("_to").alias("_from")).unionByName(reached).distinct()  # rows that nothing points to are not on any walk
    step = held(onwards.join(useful, [*by, "_from"], "left_semi"))
    while not step.isEmpty():
        met = reached.join(step, [*by, "_from"]).select(*by, F.col("_to").alias("_from"))
        reached = held(reached.unionByName(met))
        step = held(step.join(step.select(*by, F.col("_from").alias("_to"), F.col("_to").alias("_next")), [*by, "_to"]).select(*by, "_from", F.col("_next").alias("_to")))
    return reached.select(*by, F.col("_from").alias(at))


def chunks_at_gaps(words: DataFrame, by: list[str], seconds: float, look: int = 12, clear: float = 0.35, lead: float = 0.2) -> DataFrame:
    """Chunks of words (by, word_i from 0, start, end) that are cut in pauses: by, chunk, first, last, start, end (null for the last one) and n.

    A chunk is full with the first word that ends seconds after its start or later. It is cut after one of the look words from there on: after the first with a pause of clear or more behind it,
    else after the one with the longest pause. The next chunk starts in the middle of that pause; the first one lead seconds before its first word. A chunk that no word fills goes on to the end.
    """
    w = Window.partitionBy(*by).orderBy("word_i")
    pause = F.lead("start").over(w) - F.col("end")
    rows = words.select(*by, "word_i", "start", "end", pause.alias("_pause"), F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_reach"))
    near = w.rowsBetween(0, look - 1)
    longest = F.max(F.when(F.col("_pause") > -1, F.struct("_pause", (-F.col("word_i")).alias("i")))).over(near)
    cleared = F.min(F.when(F.col("_pause") >= clear, F.col("word_i"))).over(near)
    rows = rows.withColumns({"_longest": longest, "_clear": cleared})
    cut = F.when(F.col("_pause").isNotNull(), F.coalesce("_clear", -F.col("_longest.i"), "word_i"))
    begin = F.coalesce((F.lag("end").over(w) + F.col("start")) / 2, F.greatest(F.lit(0.0), F.col("start") - lead))
    rows = held(rows.select(*by, "word_i", "start", "end", "_reach", cut.alias("_cut"), begin.alias("_begin"), (F.col("_reach") > F.coalesce(F.lag("_reach").over(w), F.lit(float("-inf")))).alias("_new")))
    fills = rows.where("_new").select(*by, "_reach", "word_i", "_cut")
    met = asof(rows.select(*by, "word_i", "_cut", (F.col("_begin") + seconds).alias("_goal")), fills, by, "_goal", "_reach", forward=True)
    own = F.when(F.col("_hit.word_i") <= F.col("word_i"), F.col("_cut")).otherwise(F.col("_hit._cut"))
    links = met.select(*by, "word_i", (own + 1).alias("_next"))
    firsts = chained(links, rows.where("word_i = 0"), by, "word_i", "_next").withColumn("_first", F.lit(1))
    flagged = rows.join(firsts, [*by, "word_i"], "left").withColumn("chunk", F.sum(F.coalesce("_first", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    told = flagged.groupBy(*by, "chunk").agg(F.min("word_i").alias("first"), F.max("word_i").alias("last"), F.min_by("_begin", "word_i").alias("start"), F.count("*").alias("n"))
    return told.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("chunk"))).select(*by, "chunk", "first", "last", "start", "end", "n")
