"""Words and samples in order, over the events' plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as sq
from ..sources import adapters as src
from .registry import query, rounded

BY = ["plan_id"]
PHRASES = (
    src.SQL
    + """, flagged AS (SELECT *, CASE WHEN lag("end") OVER w IS NULL OR start - lag("end") OVER w > 6000 OR lag(text) OVER w = 'purchase' THEN 1 ELSE 0 END AS hard FROM words WINDOW w AS (PARTITION BY plan_id ORDER BY start, word_i)),
isl AS (SELECT *, sum(hard) OVER (PARTITION BY plan_id ORDER BY start, word_i ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
pos AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY plan_id, island ORDER BY start, word_i) - 1) % 3 = 0 THEN 1 ELSE 0 END AS fresh FROM isl),
phrased AS (SELECT plan_id, word_i, text, start, "end", sum(fresh) OVER (PARTITION BY plan_id ORDER BY start, word_i ROWS UNBOUNDED PRECEDING) - 1 AS phrase FROM pos)
"""
)


def phrased(spark, sf_dir):
    return sq.phrases(src.words(spark, sf_dir), BY, 6000.0, 3, "^purchase$")


@query(PHRASES + "SELECT plan_id, word_i, phrase::BIGINT AS phrase FROM phrased")
def w5_phrases(spark, sf_dir):
    return phrased(spark, sf_dir).select("plan_id", "word_i", "phrase")


@query(PHRASES + """SELECT plan_id, phrase::BIGINT AS phrase, round(min(start), 3) AS start, round(max("end"), 3) AS "end", count(*) AS n, string_agg(text, ' ' ORDER BY start, word_i) AS text FROM phrased GROUP BY 1, 2""")
def a3_phrase_texts(spark, sf_dir):
    return rounded(sq.grouped_text(phrased(spark, sf_dir), ["plan_id", "phrase"]), "start", "end")


@query(PHRASES + """SELECT plan_id, word_i, round(coalesce(lead(start) OVER (PARTITION BY plan_id, phrase ORDER BY start, word_i), "end"), 3) AS "end" FROM phrased""")
def w10_gapless_words(spark, sf_dir):
    return rounded(sq.gapless(phrased(spark, sf_dir), ["plan_id", "phrase"]).select("plan_id", "word_i", "end"), "end")


@query(src.SQL + """SELECT plan_id, word_i, round(least("end" + 500, coalesce(lead(start) OVER (PARTITION BY plan_id ORDER BY start, word_i), "end" + 500)), 3) AS "end" FROM words""")
def w9_bounded_words(spark, sf_dir):
    return rounded(sq.bounded(src.words(spark, sf_dir), BY, 500.0).select("plan_id", "word_i", "end"), "end")


@query(
    src.SQL
    + """, shifted AS (SELECT plan_id, word_i, start - (word_i % 3) * 4000 AS start, "end" FROM words),
    fixed AS (SELECT *, max(start) OVER (PARTITION BY plan_id ORDER BY word_i ROWS UNBOUNDED PRECEDING) AS s FROM shifted)
    SELECT plan_id, word_i, round(s, 3) AS start, round(greatest("end", s + 0.05), 3) AS "end" FROM fixed"""
)
def w33_monotone_words(spark, sf_dir):
    shifted = src.words(spark, sf_dir).withColumn("start", F.col("start") - (F.col("word_i") % 3) * 4000)
    return rounded(sq.monotone(shifted, BY).select("plan_id", "word_i", "start", "end"), "start", "end")


@query(
    PHRASES
    + """SELECT plan_id, word_i, round(min(start) OVER g + (max("end") OVER g - min(start) OVER g) * coalesce(sum(length(text)) OVER b, 0) / sum(length(text)) OVER g, 2) AS start,
         round(min(start) OVER g + (max("end") OVER g - min(start) OVER g) * (coalesce(sum(length(text)) OVER b, 0) + length(text)) / sum(length(text)) OVER g, 2) AS "end"
         FROM phrased WINDOW g AS (PARTITION BY plan_id, phrase), b AS (PARTITION BY plan_id, phrase ORDER BY word_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def w32_words_by_characters(spark, sf_dir):
    return rounded(sq.by_characters(phrased(spark, sf_dir), ["plan_id", "phrase"]).select("plan_id", "word_i", "start", "end"), "start", "end", digits=2)


@query(
    src.SQL
    + """, v AS (SELECT plan_id, word_i, word_i - row_number() OVER (PARTITION BY plan_id ORDER BY word_i) AS run FROM words WHERE text IN ('view', 'click'))
    SELECT plan_id, min(word_i) AS first, max(word_i) AS last, count(*) AS n FROM v GROUP BY plan_id, run"""
)
def w3_islands(spark, sf_dir):
    return sq.islands(src.words(spark, sf_dir).where("text in ('view', 'click')"), BY, "word_i")


@query(
    src.SQL
    + """, lim AS (SELECT plan_id, quantile_cont(value, 0.95) - 35 AS lim FROM series GROUP BY 1),
    q AS (SELECT s.plan_id, idx, idx - row_number() OVER (PARTITION BY s.plan_id ORDER BY idx) AS run FROM series s JOIN lim USING (plan_id) WHERE value < lim)
    SELECT plan_id, min(idx) AS first, max(idx) AS last, count(*) AS n FROM q GROUP BY plan_id, run HAVING count(*) >= 5"""
)
def w4_quiet_runs(spark, sf_dir):
    return sq.quiet_runs(src.series(spark, sf_dir), BY, 0.95, 35.0, 5)


@query(
    src.SQL
    + """, b AS (SELECT plan_id, floor((start - 600) / 70000)::BIGINT AS bucket, idx, start, value FROM series WHERE start >= 600),
    r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, bucket ORDER BY value DESC, start, idx) AS n FROM b)
    SELECT plan_id, bucket, idx, round(start, 3) AS start, value FROM r WHERE n = 1"""
)
def w14_tumbling_peaks(spark, sf_dir):
    return rounded(sq.tumbling_peaks(src.series(spark, sf_dir), BY, 70_000.0, 600.0).select("plan_id", "bucket", "idx", "start", "value"), "start")


@query(src.SQL + "SELECT plan_id, (idx // 4)::BIGINT AS block, round(avg(value), 4) AS mean FROM series GROUP BY 1, 2 HAVING count(*) = 4")
def a9_blocks(spark, sf_dir):
    return rounded(sq.blocks(src.series(spark, sf_dir), BY, 4), "mean", digits=4)


@query(src.SQL + ", w AS (SELECT plan_id, idx, avg(value) OVER x AS mean, count(*) OVER x AS n FROM series WINDOW x AS (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT plan_id, idx, round(mean, 4) AS mean FROM w WHERE n = 4")
def w15_sliding_mean(spark, sf_dir):
    return rounded(sq.sliding(src.series(spark, sf_dir), BY, F.avg("value"), 0, 3, "mean", full=True).select("plan_id", "idx", "mean"), "mean", digits=4)


@query(
    src.SQL
    + """, m AS (SELECT plan_id, idx, max(value) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS held FROM series)
    SELECT plan_id, idx, held, min(held) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS opened FROM m"""
)
def w16_held_maximum(spark, sf_dir):
    held = sq.sliding(src.series(spark, sf_dir), BY, F.max("value"), 2, 1, "held")
    return sq.sliding(held, BY, F.min("held"), 1, 1, "opened").select("plan_id", "idx", "held", "opened")


@query(
    src.SQL
    + """, one AS (SELECT plan_id, idx, 60 * sum(CAST(round(value * 100) AS BIGINT)) OVER w // count(*) OVER w AS v FROM series WINDOW w AS (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    two AS (SELECT plan_id, idx, sum(v) OVER w AS s, count(*) OVER w AS n FROM one WINDOW w AS (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT plan_id, idx, ((20000 * s + 6000 * n) // (12000 * n))::BIGINT / 10000 AS smooth FROM two"""
)
def w18_zero_phase_mean(spark, sf_dir):
    """Twice the mean of five: hundredths are added up as whole numbers (60 is divided by three, four and five), so that the order of a sum says nothing and halves are rounded up."""
    samples = src.series(spark, sf_dir).select("plan_id", "idx", F.round(F.col("value") * 100).cast("long").alias("c"))
    once = sq.sliding(sq.sliding(samples, BY, F.sum("c"), 2, 2, "s"), BY, F.count("*"), 2, 2, "n").select("plan_id", "idx", F.expr("60 * s div n").alias("v"))
    twice = sq.sliding(sq.sliding(once, BY, F.sum("v"), 2, 2, "s"), BY, F.count("*"), 2, 2, "n")
    return twice.select("plan_id", "idx", (F.expr("(20000 * s + 6000 * n) div (12000 * n)") / 10000).alias("smooth"))


@query(
    src.SQL
    + """, n AS (SELECT plan_id, idx, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
    SELECT plan_id, idx, CASE WHEN a IS NULL OR b IS NULL THEN value ELSE list_sort([a, value, b])[2] END AS median FROM n"""
)
def w19_three_point_median(spark, sf_dir):
    return sq.centred_median(src.series(spark, sf_dir), BY).select("plan_id", "idx", "median")


@query(
    src.SQL
    + """, n AS (SELECT plan_id, idx, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
    SELECT plan_id, idx, round((coalesce(a * 0.25, 0) + value * 0.5 + coalesce(b * 0.25, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + 0.5 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END), 4) AS smooth FROM n"""
)
def w19_weighted_mean(spark, sf_dir):
    return rounded(sq.weighted(src.series(spark, sf_dir), BY, [0.25, 0.5, 0.25], "smooth").select("plan_id", "idx", "smooth"), "smooth", digits=4)


@query(
    src.SQL
    + """, holes AS (SELECT plan_id, idx, CASE WHEN idx % 3 = 1 THEN value END AS value FROM series)
    SELECT plan_id, idx, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0.5) AS value FROM holes"""
)
def w21_forward_fill(spark, sf_dir):
    holes = src.series(spark, sf_dir).withColumn("value", F.when(F.col("idx") % 3 == 1, F.col("value")))
    return sq.filled(holes, BY, "value", 0.5).select("plan_id", "idx", "value")


@query(
    src.SQL
    + """, ends AS (SELECT plan_id, min(start) AS a, max(start) AS b FROM series GROUP BY 1),
    grid AS (SELECT plan_id, unnest(generate_series(ceil(a / 30000)::BIGINT, floor(b / 30000)::BIGINT)) * 30000.0::DOUBLE AS t FROM ends),
    known AS (SELECT plan_id, start AS x, arg_max(value, idx) AS y FROM series GROUP BY 1, 2),
    low AS (SELECT g.plan_id, g.t, k.x AS x0, k.y AS y0 FROM grid g ASOF LEFT JOIN known k ON g.plan_id = k.plan_id AND g.t >= k.x),
    both_sides AS (SELECT l.*, k.x AS x1, k.y AS y1 FROM low l ASOF LEFT JOIN known k ON l.plan_id = k.plan_id AND l.t <= k.x)
    SELECT plan_id, t, round(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (t - x0) / (x1 - x0) END, 4) AS value FROM both_sides"""
)
def w20_interpolated(spark, sf_dir):
    rows = sq.interpolated(src.series(spark, sf_dir), BY, 30_000.0)
    return rounded(rows.withColumn("t", F.col("t").cast("double")), "value", digits=4)


PEAKS = (
    src.SQL
    + """, near AS (SELECT plan_id, idx, value, list(value) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a,
      list(value) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS b FROM series),
    both_sides AS (SELECT plan_id, idx, value, list_concat(coalesce(a, []), coalesce(b, [])) AS l FROM near),
    peaks AS (SELECT plan_id, idx, value FROM both_sides WHERE len(l) > 0 AND value > 2 * list_median(l) AND value >= list_max(l))
"""
)


@query(PEAKS + "SELECT plan_id, idx, value FROM peaks")
def w24_peaks(spark, sf_dir):
    return sq.peaks(src.series(spark, sf_dir), BY, 4, 2.0)


@query(
    PEAKS
    + """, folded AS (SELECT plan_id, list_reduce(list_prepend([]::STRUCT(idx BIGINT, value DOUBLE)[], list([{'idx': idx, 'value': value}] ORDER BY idx)),
      lambda acc, x: CASE WHEN len(acc) = 0 OR x[1].idx - acc[len(acc)].idx >= 6 THEN list_concat(acc, x) WHEN x[1].value > acc[len(acc)].value THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END) AS l FROM peaks GROUP BY 1),
    one AS (SELECT plan_id, unnest(l) AS x FROM folded) SELECT plan_id, x.idx AS idx, x.value AS value FROM one"""
)
def w25_suppressed_peaks(spark, sf_dir):
    return sq.suppressed(sq.peaks(src.series(spark, sf_dir), BY, 4, 2.0), BY, 6)


@query(
    src.SQL
    + """, j AS (SELECT plan_id, idx, value - greatest(lag(value, 1) OVER w, lag(value, 2) OVER w) AS jump, lag(value, 2) OVER w AS ok FROM series WINDOW w AS (PARTITION BY plan_id ORDER BY idx)),
    r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY jump DESC, idx) AS n FROM j WHERE ok IS NOT NULL) SELECT plan_id, idx, round(jump, 4) AS jump FROM r WHERE n = 1"""
)
def w26_largest_jump(spark, sf_dir):
    return rounded(sq.jumps(src.series(spark, sf_dir), BY), "jump", digits=4)


@query(
    src.SQL
    + """SELECT plan_id, idx, round(coalesce(sum(value) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value) OVER (PARTITION BY plan_id) * 100, 4) AS a,
         round(sum(value) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY plan_id) * 100, 4) AS b FROM series"""
)
def w42_shares(spark, sf_dir):
    return rounded(sq.shares(src.series(spark, sf_dir), BY, ["idx"], "value").select("plan_id", "idx", "a", "b"), "a", "b", digits=4)


@query(
    src.SQL
    + """, e AS (SELECT plan_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM series GROUP BY 1)
    SELECT plan_id, idx, round(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1))), 4) AS level FROM series JOIN e USING (plan_id)"""
)
def a22_normalised(spark, sf_dir):
    return rounded(sq.normalised(src.series(spark, sf_dir), BY, 0.1, 0.9, 1.0).select("plan_id", "idx", "level"), "level", digits=4)


@query(
    src.SQL
    + """, c AS (SELECT plan_id, CAST(round(value * 100) AS BIGINT) AS value FROM series), m AS (SELECT plan_id, avg(value) AS m FROM c WHERE value > 500 GROUP BY 1)
    SELECT plan_id, ((20000 * sum(value) + 100 * count(*)) // (200 * count(*)))::BIGINT / 10000 AS gated FROM c JOIN m USING (plan_id) WHERE value > 500 AND value > m - 4000 GROUP BY 1"""
)
def a7_gated_mean(spark, sf_dir):
    """Over hundredths, as whole numbers; a half is rounded up."""
    samples = src.series(spark, sf_dir).select("plan_id", "idx", F.round(F.col("value") * 100).cast("long").alias("value"))
    kept = sq.gated(samples, BY, 500.0, 4000.0).groupBy("plan_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return kept.select("plan_id", (F.expr("(20000 * s + 100 * n) div (200 * n)") / 10000).alias("gated"))


@query(
    src.SQL
    + """, m AS (SELECT plan_id, avg(value) AS m FROM series WHERE value > 5 GROUP BY 1)
    SELECT plan_id, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.1), 4) AS "range" FROM series JOIN m USING (plan_id) WHERE value > 5 AND value > m - 40 GROUP BY 1"""
)
def a8_gated_range(spark, sf_dir):
    rows = sq.gated(src.series(spark, sf_dir), BY, 5.0, 40.0)
    return rounded(rows.groupBy("plan_id").agg((F.percentile("value", 0.95) - F.percentile("value", 0.1)).alias("range")), "range", digits=4)


@query(
    src.SQL
    + """SELECT plan_id, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, list_sort(list(value))[(floor(count(*) * 0.9)::BIGINT + 1)] AS p90,
         max(value) AS largest, round(avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0 END), 4) AS within FROM series GROUP BY 1"""
)
def a5_statistics(spark, sf_dir):
    rows = src.series(spark, sf_dir).groupBy("plan_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.expr("get(sort_array(collect_list(value)), cast(floor(count(1) * 0.9D) as int))").alias("p90"),
        F.max("value").alias("largest"), F.avg(F.when(F.col("value") <= 50, 1.0).otherwise(0.0)).alias("within"),
    )
    return rounded(rows, "mean", "median", "within", digits=4)


@query(src.SQL + "SELECT plan_id, round(exp(avg(ln(value))), 4) AS geometric FROM series WHERE value > 0 GROUP BY 1")
def a14_geometric_mean(spark, sf_dir):
    return rounded(src.series(spark, sf_dir).where("value > 0").groupBy("plan_id").agg(F.exp(F.avg(F.ln("value"))).alias("geometric")), "geometric", digits=4)


@query(src.SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY value DESC, idx) AS rank FROM series) SELECT plan_id, idx, value, rank FROM r WHERE rank <= 3")
def a21_best_samples(spark, sf_dir):
    return sq.first_of(src.series(spark, sf_dir), ["plan_id"], [F.desc("value"), "idx"], 3).select("plan_id", "idx", "value", F.col("rank").cast("long").alias("rank"))
