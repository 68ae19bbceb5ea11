"""Chunks of transcripts, means over exclusive time, quiet runs, repeats of bars and track segments, over the events' plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, sections
from ..operators import sequences as sq
from ..sources import adapters as src
from .registry import query, rounded

BY = ["plan_id"]
SECONDS, LOOK, CLEAR, LEAD = 60_000.0, 12, 9_000.0, 0.2


@query(
    src.SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", gaps AS (SELECT *, lead(start) OVER w - "end" AS gap, (lead(start) OVER w + "end") / 2 AS mid FROM words WINDOW w AS (PARTITION BY plan_id ORDER BY word_i)),
    after AS (SELECT a.plan_id, a.word_i, coalesce(min(CASE WHEN b.gap >= {CLEAR} THEN b.word_i END), min_by(b.word_i, (-b.gap, b.word_i)) FILTER (b.gap > -1), a.word_i) AS cut
      FROM gaps a JOIN gaps b ON a.plan_id = b.plan_id AND b.word_i BETWEEN a.word_i AND a.word_i + {LOOK - 1} AND b.gap IS NOT NULL WHERE a.gap IS NOT NULL GROUP BY a.plan_id, a.word_i),
    chunks(plan_id, first, begin) AS (
      SELECT plan_id, 0::BIGINT, greatest(0, start - {LEAD}) FROM words WHERE word_i = 0
      UNION ALL
      SELECT f.plan_id, g.word_i + 1, g.mid FROM (
        SELECT c.plan_id, c.first, min(x.word_i) AS k FROM chunks c JOIN words x ON x.plan_id = c.plan_id AND x.word_i >= c.first AND x."end" >= c.begin + {SECONDS} GROUP BY c.plan_id, c.first) f
      JOIN after ON after.plan_id = f.plan_id AND after.word_i = f.k JOIN gaps g ON g.plan_id = f.plan_id AND g.word_i = after.cut),
    told AS (SELECT plan_id, first, begin, lead(first) OVER c AS next, lead(begin) OVER c AS stop, row_number() OVER c - 1 AS chunk FROM chunks WINDOW c AS (PARTITION BY plan_id ORDER BY first)),
    sizes AS (SELECT plan_id, count(*) AS n FROM words GROUP BY 1)
    SELECT plan_id, chunk, first, coalesce(next, n) - 1 AS last, round(begin, 3) AS start, round(stop, 3) AS "end", coalesce(next, n) - first AS n FROM told JOIN sizes USING (plan_id)"""
)
def w36_chunks(spark, sf_dir):
    return rounded(chains.chunks_at_gaps(src.words(spark, sf_dir), BY, SECONDS, LOOK, CLEAR, LEAD), "start", "end")


@query(
    src.SQL
    + """, bounds AS (SELECT plan_id, start AS t FROM cuts WHERE "end" > start UNION SELECT plan_id, "end" FROM cuts WHERE "end" > start),
    pieces AS (SELECT plan_id, t AS a, lead(t) OVER (PARTITION BY plan_id ORDER BY t) AS b FROM bounds),
    alone AS (SELECT p.plan_id, p.a, p.b, any_value(c.id) AS id FROM pieces p JOIN cuts c ON c.plan_id = p.plan_id AND c.start <= p.a AND c."end" >= p.b GROUP BY p.plan_id, p.a, p.b HAVING count(*) = 1),
    known AS (SELECT plan_id, start, arg_max(value, idx) AS value FROM series GROUP BY 1, 2),
    steps AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY plan_id ORDER BY start), 1e18) AS stop FROM known)
    SELECT a.plan_id, a.id, round(sum(least(a.b, s.stop) - greatest(a.a, s.start)), 3) AS seconds,
           round(sum((least(a.b, s.stop) - greatest(a.a, s.start)) * s.value) / sum(least(a.b, s.stop) - greatest(a.a, s.start)), 3) AS mean
    FROM alone a JOIN steps s ON a.plan_id = s.plan_id AND s.start < a.b AND s.stop > a.a GROUP BY a.plan_id, a.id"""
)
def w30_exclusive_means(spark, sf_dir):
    return rounded(sections.exclusive_means(src.cuts(spark, sf_dir), src.series(spark, sf_dir), BY, "id"), "seconds", "mean")


@query(
    src.SQL
    + """, e AS (SELECT plan_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM series GROUP BY 1),
    quiet AS (SELECT plan_id, idx, idx - row_number() OVER (PARTITION BY plan_id ORDER BY idx) AS run FROM series JOIN e USING (plan_id) WHERE greatest(0, least(1, (value - lo) / greatest(hi - lo, 1))) < 0.3),
    runs AS (SELECT plan_id, count(*) AS n FROM quiet GROUP BY plan_id, run HAVING count(*) >= 2)
    SELECT plan_id, coalesce(sum(n), 0)::BIGINT AS quiet, count(n) AS runs FROM (SELECT DISTINCT plan_id FROM series) LEFT JOIN runs USING (plan_id) GROUP BY plan_id"""
)
def w30_quiet_bars(spark, sf_dir):
    bars = sq.normalised(src.series(spark, sf_dir), BY, 0.1, 0.9, 1.0)
    return sections.quiet_bars(bars.select("plan_id", F.col("idx").alias("bar"), "level"), BY, 0.3)


BARS = (
    src.SQL
    + """, pairs AS (SELECT plan_id, idx // 2 AS bar, min(start) AS start, list(value ORDER BY idx) AS feature, sum(value) / 2 AS value, max(start) AS upto FROM series GROUP BY 1, 2 HAVING count(*) = 2),
    e AS (SELECT plan_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, max(start) AS last FROM pairs GROUP BY 1),
    bars AS (SELECT plan_id, bar, start, feature, value / 100 AS energy, last, greatest(0, least(1, (value - lo) / greatest(hi - lo, 1))) AS level FROM pairs JOIN e USING (plan_id))
"""
)


def bars_of(spark, sf_dir):
    """Two samples are a bar, with both values as its feature."""
    pairs = src.series(spark, sf_dir).groupBy("plan_id", F.floor(F.col("idx") / 2).alias("bar")).agg(
        F.min("start").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("feature"), (F.sum("value") / 2).alias("value"), F.count("*").alias("_n")
    )
    last = pairs.where("_n = 2").groupBy("plan_id").agg(F.max("start").alias("last"))
    bars = sq.normalised(pairs.where("_n = 2"), BY, 0.1, 0.9, 1.0).join(last, "plan_id")
    return bars.select("plan_id", "bar", "start", "feature", (F.col("value") / 100).alias("energy"), "last", "level")


@query(
    BARS
    + f""", lags AS (SELECT unnest([{", ".join(f"{{'lag': {k}, 'rank': {i}, 'bonus': {b}}}" for i, (k, b) in enumerate(sections.LAGS.items()))}]) AS l),
    like_of AS (SELECT a.plan_id, a.bar, a.start, b.start AS other, a.last, l.lag AS lag, l.rank AS rank, l.bonus AS bonus,
       (a.feature[1] * b.feature[1] + a.feature[2] * b.feature[2]) / (sqrt(a.feature[1] ** 2 + a.feature[2] ** 2) * sqrt(b.feature[1] ** 2 + b.feature[2] ** 2) + 1e-9) AS alike,
       abs(a.energy - b.energy) AS differs, (SELECT avg(m.level) FROM bars m WHERE m.plan_id = a.plan_id AND m.bar >= a.bar AND m.bar < b.bar) AS level
      FROM bars a JOIN lags ON true JOIN bars b ON a.plan_id = b.plan_id AND b.bar = a.bar + l.lag),
    scores AS (SELECT *, alike + {sections.BEFORE} * coalesce(lag(alike) OVER w, alike) - {sections.DIFFERS} * differs - {sections.DIFFERED} * coalesce(lag(differs) OVER w, 0) + bonus + 0.2 * least(level, {sections.MOST}) AS score
      FROM like_of WINDOW w AS (PARTITION BY plan_id, lag ORDER BY bar)),
    gates AS (SELECT plan_id, 0 AS gate, min(bar) FILTER (level >= 0.35) AS first_bar FROM bars GROUP BY 1 UNION ALL SELECT plan_id, 1, min(bar) FILTER (level >= 0.0) FROM bars GROUP BY 1),
    best AS (SELECT plan_id, gate, rank, max_by({{'score': score, 'start': start, 'other': other, 'lag': lag}}, (score, -bar)) AS b FROM scores JOIN gates USING (plan_id) WHERE bar >= first_bar AND other <= last - 0.05 GROUP BY plan_id, gate, rank),
    so_far AS (SELECT *, max(b.score) OVER w AS top FROM best WINDOW w AS (PARTITION BY plan_id, gate ORDER BY rank)),
    seen AS (SELECT * FROM so_far s WHERE NOT EXISTS (SELECT 1 FROM so_far t WHERE t.plan_id = s.plan_id AND t.gate = s.gate AND t.rank < s.rank AND t.top > {sections.ENOUGH})),
    picked AS (SELECT plan_id, gate, max_by(b, (b.score, -rank)) AS b FROM seen GROUP BY plan_id, gate)
    SELECT plan_id, min(gate)::BIGINT AS gate, min_by(b.start, gate) AS first, min_by(b.other, gate) AS second, min_by(b.lag, gate)::BIGINT AS lag, round(min_by(b.score, gate), 4) AS score FROM picked GROUP BY plan_id"""
)
def w29_repeats(spark, sf_dir):
    return rounded(sections.repeats(bars_of(spark, sf_dir), BY), "score", digits=4)


#: Samples of a track every third frame: place and size go with the value, and nothing is found where it is large. Purchases are cuts.
STEP, MOST, FOUND = 3, 2, 30.0
TRACK = (
    src.SQL
    + f""", samples AS (SELECT plan_id, idx, idx * {STEP} AS frame, CASE WHEN value <= {FOUND} THEN value / 50 END AS cx, 0.5::DOUBLE AS cy, 0.1 + value / 200 AS w FROM series),
    marks AS (SELECT plan_id, word_i * {STEP} AS c FROM words WHERE text = 'purchase'),
    found AS (SELECT *, lag(idx) OVER p AS idx0, lag(frame) OVER p AS frame0, lag(cx) OVER p AS cx0, lag(w) OVER p AS w0 FROM samples WHERE cx IS NOT NULL WINDOW p AS (PARTITION BY plan_id ORDER BY idx)),
    flagged AS (SELECT plan_id, idx, frame, CASE WHEN idx0 IS NULL OR idx - idx0 > {MOST} OR sqrt((cx - cx0) ** 2 + 0.0) > greatest(0.1, 1.2 * w0) OR greatest(w, w0) / least(w, w0) > 1.6
        OR EXISTS (SELECT 1 FROM marks m WHERE m.plan_id = found.plan_id AND m.c > frame0 AND m.c <= frame) THEN 1 ELSE 0 END AS new FROM found),
    segmented AS (SELECT plan_id, idx, frame, sum(new) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM flagged)
"""
)


def track_of(spark, sf_dir):
    value = F.col("value")
    return src.series(spark, sf_dir).select("plan_id", "idx", (F.col("idx") * STEP).alias("frame"), F.when(value <= FOUND, value / 50).alias("cx"), F.lit(0.5).alias("cy"), (0.1 + value / 200).alias("w"))


def marks_of(spark, sf_dir):
    return src.words(spark, sf_dir).where("text = 'purchase'").select("plan_id", (F.col("word_i") * STEP).alias("frame"))


@query(TRACK + "SELECT plan_id, segment::BIGINT AS segment, min(idx) AS first, max(idx) AS last, count(*) AS n FROM segmented GROUP BY 1, 2")
def w23_segments(spark, sf_dir):
    found = sections.segments(track_of(spark, sf_dir), marks_of(spark, sf_dir), BY, MOST)
    return found.groupBy("plan_id", F.col("segment").cast("long").alias("segment")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))


@query(
    TRACK
    + f""", spans AS (SELECT plan_id, segment, min(frame) AS lo, max(frame) AS hi FROM segmented GROUP BY 1, 2),
    near AS (SELECT *, lag(hi) OVER p AS prev, lead(lo) OVER p AS nxt, (SELECT max(c) FROM marks m WHERE m.plan_id = spans.plan_id AND m.c <= lo) AS cl, (SELECT min(c) FROM marks m WHERE m.plan_id = spans.plan_id AND m.c > hi) AS cr
      FROM spans WINDOW p AS (PARTITION BY plan_id ORDER BY segment)),
    reach AS (SELECT plan_id, segment, lo, hi,
      greatest(CASE WHEN prev IS NULL THEN lo - {STEP * 0.5 + 0.5} WHEN cl > prev THEN lo - least({MOST * STEP * 0.5}, lo - cl) ELSE lo - least({MOST * STEP * 0.5}, (lo - prev) / 2) END, coalesce(cl, -1e9)) AS a,
      least(CASE WHEN nxt IS NULL THEN hi + {STEP * 0.5 + 0.5} WHEN cr <= nxt THEN hi + least({MOST * STEP * 0.5}, cr - 1 - hi) ELSE hi + least({MOST * STEP * 0.5}, (nxt - hi) / 2) END, coalesce(cr - 1, 1e9)) AS b FROM near),
    frames AS (SELECT plan_id, unnest(range({STEP} * count(*))) AS frame FROM series GROUP BY 1)
    SELECT f.plan_id, f.frame, min_by(segment, (CASE WHEN f.frame < lo THEN lo - f.frame WHEN f.frame > hi THEN f.frame - hi ELSE 0 END, segment))::BIGINT AS segment
    FROM frames f JOIN reach r ON f.plan_id = r.plan_id AND f.frame BETWEEN r.a AND r.b GROUP BY f.plan_id, f.frame"""
)
def w23_reached_frames(spark, sf_dir):
    found = sections.segments(track_of(spark, sf_dir), marks_of(spark, sf_dir), BY, MOST)
    plans = src.series(spark, sf_dir).groupBy("plan_id").agg((F.count("*") * STEP).alias("frames"))
    return sections.reached_frames(found, marks_of(spark, sf_dir), plans, BY, STEP, MOST).select("plan_id", "frame", F.col("segment").cast("long").alias("segment"))
