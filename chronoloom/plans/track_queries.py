"""Items on tracks, tags and small rules, over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tags
from ..operators import tracks as tr
from ..sources import adapters as src
from . import fold_sql
from .registry import query, rounded

BY = ["plan_id"]


def _t(spark, sf_dir, name):
    return src.table(spark, sf_dir, name)


def _bars(spark, sf_dir):
    return src.plans(spark, sf_dir).select("plan_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / 100_000))).alias("bar")).select("plan_id", "bar", (F.col("bar") * 100_000.0).alias("start"), (F.col("bar") * 100_000.0 + 80_000).alias("end"))


@query(src.SQL + """SELECT plan_id, id FROM cuts WHERE CASE WHEN id % 3 = 0 THEN abs(start - 300000) <= 40000 ELSE start <= 300000 AND "end" > 300000 END""")
def f5_active_items(spark, sf_dir):
    items = src.cuts(spark, sf_dir).withColumn("at", F.when(F.col("id") % 3 == 0, F.col("start")))
    return tr.active_at(items, 300_000.0, 40_000.0).select("plan_id", "id")


@query(src.SQL + "SELECT plan_id, word_i, CASE WHEN start - floor(start / 100000) * 100000 < 80000 THEN floor(start / 100000)::BIGINT END AS bar FROM words")
def j6_bars_of_words(spark, sf_dir):
    times = src.words(spark, sf_dir).select("plan_id", "word_i", F.col("start").alias("t"))
    return tr.in_bars(times, _bars(spark, sf_dir), BY).select("plan_id", "word_i", "bar")


@query(
    src.SQL
    + """, w AS (SELECT plan_id, word_i AS id, floor(start)::DOUBLE + 0.5 AS t FROM words) SELECT w.plan_id, w.id, arg_min(c.id % 100, c.id) AS y FROM w LEFT JOIN cuts c ON c.plan_id = w.plan_id AND w.t >= c.start AND w.t <= c."end" GROUP BY 1, 2"""
)
def j8_first_matching_range(spark, sf_dir):
    times = src.words(spark, sf_dir).select("plan_id", F.col("word_i").alias("id"), (F.floor("start") + 0.5).alias("t"))
    ranges = src.cuts(spark, sf_dir).select("plan_id", "start", "end", F.col("id").alias("ord"), (F.col("id") % 100).alias("y"))
    return tr.first_match(times, ranges, BY, "y", 50_000.0).select("plan_id", "id", "y")


@query(
    src.SQL
    + """SELECT c.plan_id, c.id, string_agg(w.text, ' ' ORDER BY w.start, w.word_i) AS text FROM cuts c JOIN words w ON w.plan_id = c.plan_id AND c."end" + 5000 > w.start AND c.start - 5000 < w."end" GROUP BY 1, 2"""
)
def j26_spans_with_margin(spark, sf_dir):
    return tr.spans_with_margin(src.cuts(spark, sf_dir), src.words(spark, sf_dir), BY, 5000.0, 50_000.0)


@query(src.SQL + "SELECT a.plan_id, a.event_id AS id, b.event_id AS r_id FROM clocked a JOIN clocked b ON a.plan_id = b.plan_id AND a.text = 'click' AND b.text = 'view' AND abs(a.start - b.start) <= 3000")
def j21_companions(spark, sf_dir):
    rows = src.clocked(_t(spark, sf_dir, "events")).select("plan_id", F.col("event_id").alias("id"), F.col("start").alias("at"), "text")
    return tr.companions(rows.where("text = 'click'"), rows.where("text = 'view'"), BY, 3000.0)


@query(
    src.SQL
    + """, t AS (SELECT plan_id, word_i, start AS t FROM words) SELECT t.plan_id, t.t AS t, round(coalesce(exp(sum(ln(1 + (c.id % 5) / 10.0))), 1), 5) AS scale FROM (SELECT DISTINCT plan_id, round(t, 3) AS t FROM t) t
    LEFT JOIN cuts c ON c.plan_id = t.plan_id AND c.start <= t.t AND t.t < c."end" GROUP BY 1, 2"""
)
def m15_scales(spark, sf_dir):
    times = src.words(spark, sf_dir).select("plan_id", F.round("start", 3).alias("t")).distinct()
    items = src.cuts(spark, sf_dir).withColumn("scale", 1 + (F.col("id") % 5) / 10)
    return rounded(tr.scale_at(items, times, BY, 50_000.0), "scale", digits=5)


@query(src.SQL + "SELECT plan_id, CASE WHEN avg((idx % 4 > 0)::INT) >= 0.75 THEN median(CASE WHEN idx % 4 > 0 THEN value END) END AS median, round(avg((idx % 4 > 0)::INT), 5) AS valid FROM series GROUP BY 1")
def a6_median_if_enough(spark, sf_dir):
    rows = src.series(spark, sf_dir).withColumn("value", F.when(F.col("idx") % 4 > 0, F.col("value")))
    return rounded(tr.median_if_enough(rows, BY, "value", 0.75), "valid", digits=5)


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS quality, min(l_discount) AS worst, sum(l_discount * l_quantity) / sum(l_quantity) < 0.05 AS warn FROM lineitem GROUP BY 1")
def a15_weighted_quality(spark, sf_dir):
    return rounded(tr.weighted_quality(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity", 0.05), "quality", digits=6)


@query(
    """WITH n AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, day) AS p FROM n),
    f AS (SELECT DISTINCT user_id, day FROM p), b AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM f),
    u AS (SELECT b.user_id, b.day, event_type, p FROM b JOIN p ON p.user_id = b.user_id AND p.day = b.day WHERE prev IS NOT NULL UNION ALL SELECT b.user_id, b.day, event_type, -p FROM b JOIN p ON p.user_id = b.user_id AND p.day = b.prev),
    e AS (SELECT user_id, day, event_type, abs(sum(p)) AS d FROM u GROUP BY 1, 2, 3) SELECT user_id, day, round(sum(d), 5) AS distance FROM e GROUP BY 1, 2"""
)
def a19_histogram_distance(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("day"), "event_type")
    return rounded(tr.histogram_distance(rows, ["user_id"], "day", "event_type"), "distance", digits=5)


@query(fold_sql.GREEDY)
def l6_greedy_spans(spark, sf_dir):
    return tr.greedy_spans(src.cuts(spark, sf_dir).withColumn("rank", F.col("start") - F.col("end")), BY)


@query(fold_sql.CROSSFADED)
def w31_crossfaded(spark, sf_dir):
    clips = src.series(spark, sf_dir).select("plan_id", F.col("idx").alias("i"), (F.col("value") / 100).alias("duration"))
    return rounded(tr.crossfaded(clips, BY, 0.5), "at", digits=6)


@query(fold_sql.ALTERNATING)
def w34_alternating(spark, sf_dir):
    rows = src.series(spark, sf_dir).withColumn("wanted", F.col("value") > 60)
    return tr.alternating(rows, BY, "idx", "wanted")


@query(src.SQL + """SELECT plan_id, id, p::INT AS part, round(start + ("end" - start) / 4 * p, 3) AS start, round(start + ("end" - start) / 4 * (p + 1), 3) AS "end" FROM cuts, generate_series(0, 3) g(p)""")
def w41_even_parts(spark, sf_dir):
    return rounded(tr.evenly_spaced(src.cuts(spark, sf_dir), ["plan_id", "id"], 4), "start", "end")


@query(src.SQL + """, g AS (SELECT plan_id, k::INT AS k, duration * k / 6 AS t FROM plans, generate_series(1, 5) s(k)) SELECT g.plan_id, k, round(t, 3) AS t, w.word_i FROM g ASOF LEFT JOIN words w ON g.plan_id = w.plan_id AND g.t >= w.start""")
def l5_anchors(spark, sf_dir):
    return rounded(tr.anchors(src.plans(spark, sf_dir), src.words(spark, sf_dir), BY, 5), "t")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, length(p_name), p_name DESC, p_partkey LIMIT 20")
def l3_best_parts(spark, sf_dir):
    return _t(spark, sf_dir, "part").orderBy(F.desc("p_size"), F.length("p_name"), F.desc("p_name"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 5")
def l12_beyond_newest(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return _t(spark, sf_dir, "orders").withColumn("n", n).where("n > 5").select("o_custkey", "o_orderkey")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'signup') THEN 'signup' ELSE NULL END AS best, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def l8_first_preferred(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("there"))
    return rows.select("user_id", tags.first_present(["purchase", "signup"], F.col("there")).alias("best"), F.size("there").cast("long").alias("kinds"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN '💍' END AS emoji, sha1(p_name || '|' || p_size) AS digest, greatest(1, CASE WHEN p_size % 10 = 5 THEN (p_size // 10) + (p_size // 10) % 2 ELSE round(p_size / 10.0) END)::INT AS target FROM part")
def x24_a16_a20_tags(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", tags.emoji(F.col("p_name")).alias("emoji"), F.sha1(F.concat_ws("|", "p_name", "p_size")).alias("digest"), tags.keyword_target(F.col("p_size"), 10.0).alias("target"))


@query("SELECT event_id, round(CASE WHEN value BETWEEN 100 AND 300 THEN greatest(0, least((value - 100) / 50, (300 - value) / 100, 1)) ELSE 0 END, 6) AS level, CASE WHEN value >= 1 THEN floor(60 * (100 - least(value, 100)) / least(value, 100) + 0.5)::BIGINT END AS eta FROM events")
def m4_m19_envelopes(spark, sf_dir):
    v = F.col("value")
    return _t(spark, sf_dir, "events").select("event_id", F.round(tags.envelope(v, F.lit(100.0), F.lit(300.0), 50.0, 100.0), 6).alias("level"), tags.eta(F.lit(60.0), F.least(v, F.lit(100.0))).alias("eta"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(l_quantity - 25, l_linenumber * 5.0 - 10)) AS start, greatest(greatest(l_quantity - 25, l_linenumber * 5.0 - 10), greatest(0, least(l_quantity - 25, l_linenumber * 5.0 - 10)) + 0.5) AS \"end\" FROM lineitem")
def z6_ordered_bounds(spark, sf_dir):
    x = tags.ordered_bounds(F.col("l_quantity") - 25, F.col("l_linenumber") * 5.0 - 10, 0.5)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.start", "x.end")


@query("SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 300))) AS rare, list_sort(list_distinct(list(event_type) FILTER (value < 5))) AS low FROM events GROUP BY 1")
def a18_distinct_lists(spark, sf_dir):
    kinds = lambda c: F.when(F.count_if(c) > 0, F.sort_array(F.collect_set(F.when(c, F.col("event_type")))))
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(kinds(F.col("value") > 300).alias("rare"), kinds(F.col("value") < 5).alias("low"))


@query("(SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def u4_u6_set_operations(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))
    return c.intersect(_t(spark, sf_dir, "supplier").select("s_nationkey")).exceptAll(_t(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey"))


@query("SELECT o_orderkey, length(o_orderpriority) AS plan_size, o_totalprice FROM orders WHERE o_orderkey > 500")
def s3_s16_light_changes(spark, sf_dir):
    from ..operators.jobs import changed_since

    return changed_since(_t(spark, sf_dir, "orders"), "o_orderkey", 500).select("o_orderkey", F.length("o_orderpriority").alias("plan_size"), "o_totalprice")


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"(/[A-Za-z]+)', 1))) AS sid FROM pages WHERE contains(html, 'href=\"')")
def f17_references(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").where(F.col("html").contains('href="'))
    return rows.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[A-Za-z]+)'), F.lit(1)))).alias("sid"))


@query("SELECT c.conv_id, c.turn, c.role, d.turn AS next_turn FROM conversations c LEFT JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1")
def j12_positional_zip(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next_turn"))
    return c.join(after, ["conv_id", "turn"], "left")
