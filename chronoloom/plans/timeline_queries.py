"""Interval sets and the two clocks, over the events' plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources import adapters as src
from .registry import query, rounded

BY = ["plan_id"]
CLEAN = """, clean AS (
  SELECT c.plan_id, greatest(least(start, "end"), 0) AS s, least(greatest(start, "end"), duration) AS e, duration
  FROM cuts c JOIN plans USING (plan_id) WHERE enabled AND greatest(least(start, "end"), 0) < least(greatest(start, "end"), duration))
"""
KEEPS = (
    src.SQL
    + CLEAN
    + """, bounds AS (SELECT plan_id, s, e FROM clean UNION ALL SELECT plan_id, duration, duration FROM plans),
gaps AS (SELECT plan_id, coalesce(max(e) OVER (PARTITION BY plan_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM bounds),
keeps AS (SELECT plan_id, a, b, row_number() OVER w - 1 AS i, coalesce(sum(b - a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
          FROM gaps WHERE b - a > 0.05 WINDOW w AS (PARTITION BY plan_id ORDER BY a))
"""
)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.keeps(src.cuts(spark, sf_dir), src.plans(spark, sf_dir), BY)


@query(KEEPS + 'SELECT plan_id, round(a, 3) AS a, round(b, 3) AS b, i, round("offset", 3) AS "offset" FROM keeps')
def w1_keeps(spark, sf_dir):
    return rounded(kept(spark, sf_dir), "a", "b", "offset")


@query(
    src.SQL
    + CLEAN
    + """, flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY plan_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM clean),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY plan_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
    SELECT plan_id, round(min(s), 3) AS start, round(max(e), 3) AS "end", count(*) AS n FROM numbered GROUP BY plan_id, island"""
)
def w2_merged_cuts(spark, sf_dir):
    clean = iv.cleaned(src.cuts(spark, sf_dir), src.plans(spark, sf_dir), BY)
    return rounded(iv.merged(clean.select("plan_id", "start", "end"), BY), "start", "end")


@query(KEEPS + "SELECT plan_id, round(duration, 3) AS duration, round(coalesce(sum(b - a), 0), 3) AS kept, round(duration - coalesce(sum(b - a), 0), 3) AS removed FROM plans LEFT JOIN keeps USING (plan_id) GROUP BY plan_id, duration")
def a2_kept_seconds(spark, sf_dir):
    return rounded(iv.kept_seconds(kept(spark, sf_dir), src.plans(spark, sf_dir), BY), "duration", "kept", "removed")


@query(
    KEEPS
    + """SELECT w.plan_id, word_i, round(CASE WHEN w.start <= b + 1e-9 THEN least("offset" + greatest(0, w.start - a), "offset" + b - a) END, 3) AS final,
         round(coalesce(least("offset" + greatest(0, w.start - a), "offset" + b - a), 0), 3) AS clamped
         FROM words w ASOF LEFT JOIN (SELECT *, a - 1e-9 AS a9 FROM keeps) k ON w.plan_id = k.plan_id AND w.start >= k.a9"""
)
def j2_j3_remapped(spark, sf_dir):
    times = src.words(spark, sf_dir).select("plan_id", "word_i", F.col("start").alias("t"))
    return rounded(iv.remapped(times, kept(spark, sf_dir), BY).drop("t"), "final", "clamped")


@query(
    KEEPS
    + """, times AS (SELECT plan_id, word_i, start / 2 AS t FROM words)
    SELECT t.plan_id, word_i, round(t, 3) AS t, round(least(a + t - "offset", b), 3) AS original
    FROM times t ASOF LEFT JOIN (SELECT *, "offset" - 1e-9 AS o9 FROM keeps) k ON t.plan_id = k.plan_id AND t.t >= k.o9"""
)
def j4_inverted(spark, sf_dir):
    times = src.words(spark, sf_dir).select("plan_id", "word_i", (F.col("start") / 2).alias("t"))
    return rounded(iv.inverted(times, kept(spark, sf_dir), BY), "t", "original")


@query(
    KEEPS
    + """, mapped AS (SELECT w.plan_id, word_i,
      (SELECT coalesce(max(least("offset" + greatest(0, w.start - a), "offset" + b - a)), 0) FROM keeps k WHERE k.plan_id = w.plan_id AND k.a - 1e-9 <= w.start) AS final_start,
      (SELECT coalesce(max(least("offset" + greatest(0, w."end" - a), "offset" + b - a)), 0) FROM keeps k WHERE k.plan_id = w.plan_id AND k.a - 1e-9 <= w."end") AS final_end FROM words w)
    SELECT plan_id, word_i, round(final_start, 3) AS final_start, round(final_end, 3) AS final_end FROM mapped WHERE final_end - final_start > 0.01"""
)
def r4_remapped_words(spark, sf_dir):
    rows = iv.range_remapped(src.words(spark, sf_dir), kept(spark, sf_dir), BY, 0.01)
    return rounded(rows.select("plan_id", "word_i", "final_start", "final_end"), "final_start", "final_end")


@query(
    KEEPS
    + """, b4 AS (SELECT *, lag(b) OVER (PARTITION BY plan_id ORDER BY a) AS before FROM keeps)
    SELECT plan_id, i, round("offset", 3) AS t, round(before, 3) AS before, round(a, 3) AS after, round(a - before, 3) AS gap FROM b4 WHERE i > 0"""
)
def w11_joins(spark, sf_dir):
    return rounded(iv.joins(kept(spark, sf_dir), BY), "t", "before", "after", "gap")


@query(
    src.SQL
    + """SELECT c.plan_id, c.id, w.word_i FROM cuts c JOIN words w ON c.plan_id = w.plan_id AND c."end" > w.start AND c.start < w."end" """
)
def j1_overlapping_words(spark, sf_dir):
    return iv.overlapping(src.cuts(spark, sf_dir), src.words(spark, sf_dir), BY, 50_000.0).select("plan_id", "id", F.col("r_word_i").alias("word_i"))


@query(
    src.SQL
    + """, pairs AS (SELECT w.plan_id, w.word_i, c.start AS near, abs(c.start - w.start) AS d FROM words w JOIN cuts c ON c.plan_id = w.plan_id AND abs(c.start - w.start) <= 5000),
    best AS (SELECT plan_id, word_i, near, row_number() OVER (PARTITION BY plan_id, word_i ORDER BY d, near) AS n FROM pairs)
    SELECT w.plan_id, w.word_i, round(b.near, 3) AS near FROM words w LEFT JOIN best b ON b.plan_id = w.plan_id AND b.word_i = w.word_i AND n = 1"""
)
def j7_nearest_cut(spark, sf_dir):
    rows = iv.nearest(src.words(spark, sf_dir), src.cuts(spark, sf_dir), BY, "start", "start", 5000.0)
    return rounded(rows.select("plan_id", "word_i", "near"), "near")


@query(
    src.SQL
    + """SELECT w.plan_id, w.word_i, c.id AS cut_id, w.start < c."end" AS open FROM words w ASOF LEFT JOIN cuts c ON w.plan_id = c.plan_id AND w.start >= c.start"""
)
def j5_latest_open(spark, sf_dir):
    found = iv.asof(src.words(spark, sf_dir), src.cuts(spark, sf_dir), BY, "start", "start")
    return found.select("plan_id", "word_i", F.col("_hit.id").alias("cut_id"), (F.col("start") < F.col("_hit.end")).alias("open"))


@query(src.SQL + """SELECT plan_id, word_i FROM words w WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.plan_id = w.plan_id AND c.start < w."end" AND c."end" > w.start)""")
def f7_words_outside_cuts(spark, sf_dir):
    words = src.words(spark, sf_dir)
    hit = iv.overlapping(words, src.cuts(spark, sf_dir), BY, 50_000.0).select("plan_id", "word_i").distinct()
    return words.join(hit, ["plan_id", "word_i"], "left_anti").select("plan_id", "word_i")


@query(
    KEEPS
    + """, t AS (SELECT plan_id, word_i, start FROM words)
    SELECT t.plan_id, t.word_i FROM t ASOF LEFT JOIN (SELECT *, a - 1e-9 AS a9 FROM keeps) k ON t.plan_id = k.plan_id AND t.start >= k.a9 WHERE k.a IS NULL OR t.start > k.b + 1e-9"""
)
def f6_words_in_cuts(spark, sf_dir):
    times = src.words(spark, sf_dir).select("plan_id", "word_i", F.col("start").alias("t"))
    return iv.remapped(times, kept(spark, sf_dir), BY).where("final is null").select("plan_id", "word_i")


@query(
    KEEPS
    + """, frames AS (SELECT plan_id, floor(a / 60 + 1e-6) AS s, ceil(b / 60 - 1e-6) AS e FROM keeps WHERE b - a >= 0.15),
    flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY plan_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM frames),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY plan_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
    SELECT plan_id, min(s)::BIGINT AS first_frame, max(e)::BIGINT AS end_frame FROM numbered GROUP BY plan_id, island"""
)
def w13_frame_grid(spark, sf_dir):
    return iv.gridded(kept(spark, sf_dir), BY, 1 / 60)


@query(
    KEEPS
    + """, edges AS (SELECT plan_id, a AS t FROM keeps UNION SELECT plan_id, b FROM keeps UNION SELECT plan_id, start FROM cuts)
    SELECT plan_id, round(t, 3) AS t FROM edges"""
)
def u1_boundaries(spark, sf_dir):
    k = kept(spark, sf_dir)
    edges = k.select("plan_id", F.col("a").alias("t")).union(k.select("plan_id", "b")).union(src.cuts(spark, sf_dir).select("plan_id", "start")).distinct()
    return rounded(edges, "t")


@query(
    src.SQL
    + """, RECURSIVE_INPUT AS (SELECT plan_id, start, row_number() OVER (PARTITION BY plan_id ORDER BY start) AS n FROM cuts)
    SELECT plan_id, round(unnest(list_reduce(list_prepend([]::DOUBLE[], list(list_value(start) ORDER BY start)), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[len(acc)] >= 20000 THEN list_concat(acc, x) ELSE acc END)), 3) AS start
    FROM RECURSIVE_INPUT GROUP BY plan_id"""
)
def w12_spaced_cuts(spark, sf_dir):
    return rounded(iv.apart(src.cuts(spark, sf_dir), BY, "start", 20_000.0), "start")


@query(
    src.SQL
    + """SELECT plan_id, id, round(start, 3) AS start, round(greatest(0, least("end", 500000) - greatest(start, 400000)), 3) AS overlap, round(greatest(0, least("end", 500000) - greatest(start, 400000)) / ("end" - start), 4) AS fraction
         FROM cuts WHERE "end" > start"""
)
def m13_overlap_with_window(spark, sf_dir):
    overlap = F.greatest(F.lit(0.0), F.least("end", F.lit(500_000.0)) - F.greatest("start", F.lit(400_000.0)))
    rows = src.cuts(spark, sf_dir).where("end > start").select("plan_id", "id", "start", overlap.alias("overlap"), (overlap / (F.col("end") - F.col("start"))).alias("fraction"))
    return rounded(rounded(rows, "start", "overlap"), "fraction", digits=4)
