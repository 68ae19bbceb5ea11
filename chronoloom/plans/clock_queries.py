"""Tracks of the events' plans on the final clock."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clocks
from ..sources import adapters as src
from .registry import query, rounded
from .timeline_queries import BY, KEEPS, kept

ROWS = KEEPS + ", rows_ AS (SELECT c.*, row_number() OVER (PARTITION BY plan_id ORDER BY event_id) - 1 AS place FROM clocked c)"
#: To put behind a list times (plan_id, id, t): where each lands.
LANDED = ", landed AS (SELECT t.plan_id, id, which, coalesce(least(\"offset\" + greatest(0, t.t - a), \"offset\" + b - a), 0) AS f FROM times t ASOF LEFT JOIN (SELECT *, a - 1e-9 AS a9 FROM keeps) k ON t.plan_id = k.plan_id AND t.t >= k.a9)"
WIDE = LANDED + ", wide AS (SELECT plan_id, id, max(f) FILTER (which = 1) AS fa, max(f) FILTER (which = 2) AS fb FROM landed GROUP BY 1, 2)"


def _events(spark, sf_dir):
    return src.clocked(src.table(spark, sf_dir, "events"))


@query(
    ROWS
    + """, times AS (SELECT plan_id, event_id AS id, 1 AS which, start AS t FROM clocked UNION ALL SELECT plan_id, event_id, 2, start + value * 50 FROM clocked WHERE event_id % 3 > 0)"""
    + WIDE
    + """ SELECT plan_id, c.event_id AS id, round(fa, 3) AS final_start, round(CASE WHEN event_id % 3 = 0 THEN fa + value ELSE fb END, 3) AS final_end
    FROM clocked c JOIN wide w USING (plan_id) WHERE w.id = c.event_id AND (event_id % 3 = 0 OR fb - fa > 1e-6)"""
)
def r2_items_mapped(spark, sf_dir):
    ranged = F.col("event_id") % 3 > 0
    items = _events(spark, sf_dir).select(
        "plan_id", F.col("event_id").alias("id"), F.when(ranged, F.col("start") + F.col("value") * 50).alias("start"), F.when(ranged, F.col("start")).alias("end"),
        F.when(~ranged, F.col("start")).alias("at"), F.when(~ranged, F.col("value")).alias("dur"),
    )
    return rounded(clocks.items_mapped(items, kept(spark, sf_dir), BY, ["id"]).select("plan_id", "id", "final_start", "final_end"), "final_start", "final_end")


@query(
    ROWS
    + """, times AS (SELECT plan_id, place AS id, 1 AS which, CASE WHEN place % 9 = 0 THEN 0 ELSE start END AS t FROM rows_
    UNION ALL SELECT r.plan_id, place, 2, CASE WHEN place % 7 = 0 THEN duration ELSE start + value * 100 END FROM rows_ r JOIN plans USING (plan_id))"""
    + WIDE
    + """ SELECT plan_id, id AS "index", round(fa, 3) AS final_start, round(fb, 3) AS final_end FROM wide WHERE fb - fa > 1e-6"""
)
def r3_shots_mapped(spark, sf_dir):
    shots = _events(spark, sf_dir).select("plan_id", "event_id", "start", (F.col("start") + F.col("value") * 100).alias("end"))
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("event_id")) - 1
    shots = shots.withColumn("_n", place).withColumns({"start": F.when(F.col("_n") % 9 > 0, F.col("start")), "end": F.when(F.col("_n") % 7 > 0, F.col("end"))}).drop("_n")
    rows = clocks.shots_mapped(shots, src.plans(spark, sf_dir), kept(spark, sf_dir), BY, ["event_id"])
    return rounded(rows.select("plan_id", "index", "final_start", "final_end"), "final_start", "final_end")


def _music(spark, sf_dir):
    """Clicks are silences, views are swells; a silence in seven has no time, one in three no dur. A plan in five has no drop."""
    rows = _events(spark, sf_dir).where("text IN ('click', 'view')")
    e = F.col("event_id")
    stop = F.struct(e, F.struct(F.when(e % 7 > 0, F.col("start").cast("string")).otherwise("x").alias("at"), F.when(e % 3 > 0, F.col("value") * 100).alias("dur")).alias("x"))
    swell = F.struct(e, F.struct(F.col("start").alias("start"), (F.col("start") + F.col("value") * 200).alias("end"), F.when(e % 2 == 0, 3.0).otherwise(-2.0).alias("db")).alias("x"))
    listed = lambda kind, x: F.transform(F.sort_array(F.collect_list(F.when(F.col("text") == kind, x))), lambda y: y["x"])
    by_plan = rows.groupBy("plan_id").agg(listed("click", stop).alias("stops"), listed("view", swell).alias("swells"))
    p = F.col("plan_id")
    return by_plan.withColumns({"drop_at": F.when(p % 5 > 0, p * 1000.0), "enabled": F.when(p % 4 > 0, p % 2 == 0), "source": F.when(p % 10 == 0, "none")})


MUSIC = ROWS + """, m AS (SELECT *, row_number() OVER (PARTITION BY plan_id, text ORDER BY event_id) - 1 AS i FROM clocked WHERE text IN ('click', 'view')),
    points AS (SELECT plan_id, text AS part, i, start AS a, start + CASE WHEN text = 'view' THEN value * 200 WHEN event_id % 3 > 0 AND value > 0 THEN value * 100 END AS b,
      CASE WHEN text = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 3.0 ELSE -2.0 END WHEN event_id % 3 > 0 THEN value * 100 END AS more FROM m WHERE text = 'view' OR event_id % 7 > 0
      UNION ALL SELECT DISTINCT plan_id, 'drop', 0, plan_id * 1000.0, NULL, NULL FROM m WHERE plan_id % 5 > 0),
    times AS (SELECT plan_id, part || i AS id, 1 AS which, a AS t FROM points UNION ALL SELECT plan_id, part || i, 2, b FROM points WHERE b IS NOT NULL)""" + WIDE  # fmt: skip


@query(
    MUSIC
    + """, got AS (SELECT p.*, round(fa, 6) AS fa, round(fb, 6) AS fb FROM points p JOIN wide w ON w.plan_id = p.plan_id AND w.id = p.part || p.i)
    SELECT plan_id, count(*) FILTER (part = 'click') AS n_stops, round(coalesce(sum(fa) FILTER (part = 'click'), 0), 6) AS stops_at, round(coalesce(sum(CASE WHEN b IS NULL THEN more ELSE greatest(0.05, fb - fa) END) FILTER (part = 'click'), 0), 6) AS stops_dur,
    count(*) FILTER (part = 'view' AND fb - fa > 1e-6) AS n_swells, round(coalesce(sum((fb - fa) * more) FILTER (part = 'view' AND fb - fa > 1e-6), 0), 6) AS swells_db, max(fa) FILTER (part = 'drop') AS drop_at,
    any_value(CASE WHEN plan_id % 4 > 0 THEN plan_id % 2 = 0 ELSE true END AND plan_id % 10 > 0) AS active
    FROM (SELECT DISTINCT plan_id FROM m) LEFT JOIN got USING (plan_id) GROUP BY 1"""
)
def r5_music_mapped(spark, sf_dir):
    config, _ = clocks.music_mapped(_music(spark, sf_dir), kept(spark, sf_dir), BY, 6)
    total = lambda name, f: F.round(F.aggregate(name, F.lit(0.0), lambda acc, x: acc + F.coalesce(f(x), F.lit(0.0))), 6)
    return config.select(
        "plan_id", F.size("stops").cast("long").alias("n_stops"), total("stops", lambda x: x["at"]).alias("stops_at"), total("stops", lambda x: x["dur"]).alias("stops_dur"),
        F.size("swells").cast("long").alias("n_swells"), total("swells", lambda x: (x["end"] - x["start"]) * x["db"]).alias("swells_db"), "drop_at", "active",
    )


@query("SELECT user_id AS plan_id, 'stops' AS part, i, 'music:stops:dato_invalido' AS reason FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS i FROM events WHERE event_type = 'click') WHERE event_id % 7 = 0")
def r5_music_skipped(spark, sf_dir):
    return clocks.music_mapped(_music(spark, sf_dir), kept(spark, sf_dir), BY)[1]


def _sounds(spark, sf_dir):
    e = F.col("event_id")
    name = F.when(e % 3 == 0, "riser_long_2").when(e % 3 == 1, "pop").otherwise("riser_short")
    return _events(spark, sf_dir).where("text = 'purchase'").select(
        "plan_id", e.alias("id"), name.alias("name"), F.when(e % 11 > 0, F.col("start")).alias("at"), F.when(e % 4 > 0, F.col("value") * 20).alias("dur"), F.when(e % 2 > 0, F.col("value") - 20).alias("pitch"),
        F.when(e % 5 > 0, F.col("value") / 10).alias("gain_db"), F.lit(None).cast("double").alias("pan"), (e % 6 - 1).alias("variant"), (e % 13 > 0).alias("enabled"),
    )


@query(
    ROWS
    + """, s AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN value * 20 END AS dur FROM clocked WHERE text = 'purchase' AND event_id % 13 > 0 AND event_id % 11 > 0),
    times AS (SELECT plan_id, event_id AS id, 1 AS which, start AS t FROM s UNION ALL SELECT plan_id, event_id, 2, CASE WHEN event_id % 3 = 1 THEN start + dur ELSE start - dur END FROM s WHERE dur > 0)"""
    + WIDE
    + """, total AS (SELECT plan_id, sum(b - a) AS kept FROM keeps GROUP BY 1)
    SELECT s.plan_id, s.event_id AS id, ['riser_long_2', 'pop', 'riser_short'][event_id % 3 + 1] AS name, round(fa, 6) AS at, CASE WHEN event_id % 5 > 0 THEN value / 10 ELSE -6 END AS gain_db, 0.0::DOUBLE AS pan,
    CASE WHEN event_id % 6 > 0 THEN (event_id % 6 - 1)::INT END AS variant, CASE WHEN event_id % 2 > 0 THEN greatest(-24, least(24, value - 20)) END AS pitch,
    CASE WHEN dur > 0 THEN round(CASE WHEN abs(fb - fa) > 1e-3 THEN abs(fb - fa) ELSE dur END, 6) END AS dur
    FROM s JOIN wide w ON w.plan_id = s.plan_id AND w.id = s.event_id JOIN total t ON t.plan_id = s.plan_id WHERE fa < kept"""
)
def r6_sounds_mapped(spark, sf_dir):
    return clocks.sounds_mapped(_sounds(spark, sf_dir), src.plans(spark, sf_dir), kept(spark, sf_dir), BY, digits=6)[0]


@query(
    ROWS
    + """, h AS (SELECT * FROM rows_ WHERE event_id % 4 > 0), times AS (SELECT plan_id, place AS id, 1 AS which, start AS t FROM h UNION ALL SELECT plan_id, place, 2, start + value FROM h)"""
    + WIDE
    + """, total AS (SELECT plan_id, sum(b - a) AS kept FROM keeps GROUP BY 1),
    f AS (SELECT plan_id, id, floor(fa * 30 + 1e-6) / 30 AS s, least(kept, ceil(fb * 30 - 1e-6) / 30) AS e FROM wide JOIN total USING (plan_id) WHERE fb - fa > 1e-6)
    SELECT f.plan_id, id AS "index", text AS title, round(s, 3) AS start, round(e, 3) AS "end" FROM f JOIN rows_ r ON r.plan_id = f.plan_id AND r.place = f.id WHERE e - s >= 1"""
)
def r7_highlight_clips(spark, sf_dir):
    rows = _events(spark, sf_dir).select("plan_id", "event_id", F.col("text").alias("title"), "start", (F.col("start") + F.col("value")).alias("end"), (F.col("event_id") % 4 > 0).alias("enabled"))
    return rounded(clocks.highlights_mapped(rows, src.plans(spark, sf_dir), kept(spark, sf_dir), BY, ["event_id"]), "start", "end")


#: Words of the texts on a clock of their own: half a second each and a gap that grows by place.
SPOKEN = """WITH w0 AS (SELECT doc_id AS plan_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_i FROM documents WHERE text IS NOT NULL),
    spoken AS (SELECT plan_id, word_i, text, word_i * 0.75::DOUBLE AS start, word_i * 0.75::DOUBLE + CASE WHEN word_i % 5 = 0 THEN 0.25 ELSE 0.5 END AS "end" FROM w0)"""


def spoken(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("plan_id"), F.posexplode(F.split("text", " ")).alias("word_i", "text"))
    start = F.col("word_i") * 0.75
    return rows.select("plan_id", "word_i", "text", start.alias("start"), (start + F.when(F.col("word_i") % 5 == 0, 0.25).otherwise(0.5)).alias("end"))


@query(
    SPOKEN
    + """, b AS (SELECT *, start - lag("end") OVER w AS gap, CASE WHEN coalesce(start - lag("end") OVER w > 0.45, true) OR regexp_matches(rtrim(lag(text) OVER w), '[.!?]$') THEN 1 ELSE 0 END AS fresh FROM spoken WINDOW w AS (PARTITION BY plan_id ORDER BY word_i)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY plan_id ORDER BY word_i) AS island FROM b),
    c AS (SELECT *, (row_number() OVER (PARTITION BY plan_id, island ORDER BY word_i) - 1) // 4 AS part FROM i),
    g AS (SELECT plan_id, min(word_i) AS a, max(word_i) AS z, arg_min(gap, word_i) AS gap, count(*) AS n FROM c GROUP BY plan_id, island, part),
    j AS (SELECT *, n = 1 AND coalesce(gap < 0.45, false) AS joins FROM g), k AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY a DESC) AS run FROM j),
    l AS (SELECT *, CASE WHEN joins AND row_number() OVER (PARTITION BY plan_id, run, joins ORDER BY a DESC) % 2 = 1 THEN 0 ELSE 1 END AS own FROM k),
    o AS (SELECT *, sum(own) OVER (PARTITION BY plan_id ORDER BY a) - 1 AS grp FROM l)
    SELECT plan_id, grp::INT AS "group", min(a)::INT AS first_word, (max(z) - min(a) + 1)::BIGINT AS n FROM o GROUP BY 1, 2"""
)
def w6_preview_groups(spark, sf_dir):
    rows = clocks.preview_groups(spoken(spark, sf_dir), BY, "word_i")
    return rows.groupBy("plan_id", "group").agg(F.min("word_i").alias("first_word"), F.count("*").alias("n"))


@query(
    src.SQL
    + """, g AS (SELECT plan_id, word_i // 5 AS g, min(start) AS start FROM words GROUP BY 1, 2), f AS (SELECT *, start + 0.06 - 0.002 AS first FROM g)
    SELECT w.plan_id, w.word_i, f.g AS "group" FROM words w ASOF JOIN f ON w.plan_id = f.plan_id AND w.start >= f.first"""
)
def j27_words_of_groups(spark, sf_dir):
    words = src.words(spark, sf_dir)
    groups = words.groupBy("plan_id", F.floor(F.col("word_i") / 5).alias("g")).agg(F.min("start").alias("start"))
    return clocks.words_of_groups(groups, words.select("plan_id", "word_i", "start"), BY).select("plan_id", "word_i", F.col("_hit.g").alias("group"))


@query(
    KEEPS
    + """, times AS (SELECT plan_id, word_i AS id, 1 AS which, start AS t FROM words UNION ALL SELECT plan_id, word_i, 2, "end" FROM words)"""
    + WIDE
    + """, f AS (SELECT w.plan_id, word_i, w.start, fa, fb FROM words w JOIN wide ON wide.plan_id = w.plan_id AND id = word_i WHERE fb - fa > 0.01),
    b AS (SELECT *, fa - lag(fb) OVER w AS gap FROM f WINDOW w AS (PARTITION BY plan_id ORDER BY word_i)),
    i AS (SELECT *, sum(CASE WHEN gap <= 0.45 THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY word_i) AS island FROM b),
    c AS (SELECT *, (row_number() OVER (PARTITION BY plan_id, island ORDER BY word_i) - 1) // 4 AS part FROM i),
    g AS (SELECT plan_id, min(word_i) AS k, arg_min(fa, word_i) AS s, arg_max(fb, word_i) AS e, arg_min(gap, word_i) AS gap, count(*) AS n, sum(round(start, 3)) AS total FROM c GROUP BY plan_id, island, part),
    j AS (SELECT *, n = 1 AND coalesce(gap < 0.45, false) AS joins FROM g), r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY k DESC) AS run FROM j),
    l AS (SELECT *, CASE WHEN joins AND row_number() OVER (PARTITION BY plan_id, run, joins ORDER BY k DESC) % 2 = 1 THEN 0 ELSE 1 END AS own FROM r),
    o AS (SELECT *, sum(own) OVER (PARTITION BY plan_id ORDER BY k) - 1 AS grp FROM l),
    done AS (SELECT plan_id, grp, arg_min(s, k) AS s, arg_max(e, k) AS e, sum(n) AS n, sum(total) AS total FROM o GROUP BY 1, 2),
    back AS (SELECT d.*, least(a + s - "offset", b) AS s0 FROM done d ASOF LEFT JOIN (SELECT *, "offset" - 1e-9 AS o9 FROM keeps) q ON d.plan_id = q.plan_id AND d.s >= q.o9),
    both_ AS (SELECT d.plan_id, grp, s, e, n, total, s0, least(a + e - "offset", b) AS e0 FROM back d ASOF LEFT JOIN (SELECT *, "offset" - 1e-9 AS o9 FROM keeps) q ON d.plan_id = q.plan_id AND d.e >= q.o9)
    SELECT plan_id, grp::INT AS "group", round(s, 3) AS start_final, round(e, 3) AS end_final, round(s0, 3) AS start, round(e0, 3) AS "end", n::BIGINT AS n, round(total, 3) AS total FROM both_"""
)
def r9_captions_on_both_clocks(spark, sf_dir):
    rows = clocks.captions_on_both_clocks(src.words(spark, sf_dir), kept(spark, sf_dir), BY, "word_i")
    total = F.round(F.aggregate("words", F.lit(0.0), lambda acc, x: acc + x["start"]), 3)
    return rounded(rows.select("plan_id", "group", "start_final", "end_final", "start", "end", F.size("words").cast("long").alias("n"), total.alias("total")), "start_final", "end_final", "start", "end")
