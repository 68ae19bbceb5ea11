"""Names and titles found in texts, rows matched one to one, cards placed and lines balanced."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, matching
from ..sources import adapters as src
from .registry import query, rounded

BY = ["plan_id"]
INTRO, HONORIFIC, PARTICLES = ("the", "der", "la", "el", "le"), ("of", "de", "die"), ("and", "und", "et", "y", "de")


#: What parts words, and what is neither that nor a letter or digit; half a surrogate pair is no character.
SPACE = r" \t\n\x0b\f\r"
OTHER = rf"[^\p{{L}}\p{{N}}\p{{Cs}}{SPACE}]"


def keys(text):
    """The words of a text in lower case, without anything but letters and digits at their ends: runs of other characters go from the whole text where a word begins or ends, before it is split."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?={OTHER})(?:(?<![^{SPACE}]){OTHER}++|(?<!{OTHER}){OTHER}++(?![^{SPACE}]))", "")
    return F.array_remove(F.split(bare, f"[{SPACE}]+"), "")


def keyed_words(docs, *by):
    return docs.select(*by, F.posexplode(keys(F.col("text"))).alias("word_i", "key"))


@query()
def j18_spoken_names(spark, sf_dir):
    """Names are the first three words of the benchmark's items; they are looked for in all documents."""
    names = keyed_words(src.table(spark, sf_dir, "benchmark"), F.col("item_id").alias("name_id")).where("word_i < 3").where((F.length("key") >= 3) & ~F.col("key").isin(*PARTICLES))
    words = keyed_words(src.table(spark, sf_dir, "documents"), "doc_id")
    return matching.name_spans(words, names.select("name_id", F.col("key").alias("token")), ["doc_id"], INTRO, HONORIFIC, PARTICLES)


@query(
    r"""WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    tokens AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(l[1]), '[ \t\n\x0b\f\r]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS t,
       list_filter(list_transform(regexp_split_to_array(lower(array_to_string(l[2:], chr(10))), '[ \t\n\x0b\f\r]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS w FROM lines),
    words AS (SELECT doc_id, t, len(t) AS k, unnest(w) AS key, generate_subscripts(w, 1) - 1 AS i FROM tokens WHERE len(t) > 0),
    said AS (SELECT *, list_position(t, key) AS place FROM words WHERE list_contains(t, key)),
    grouped AS (SELECT a.doc_id, a.t, a.k, a.i, a.place, list({'j': 0::BIGINT, 'm': 0::BIGINT, 'last': 0::BIGINT, 'i': b.i::BIGINT, 'w': b.key} ORDER BY b.i) FILTER (b.i IS NOT NULL) AS seen
      FROM said a LEFT JOIN said b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i < a.i + 2 * a.k + 4 WHERE a.place <= greatest(1, a.k // 2 + 1) GROUP BY a.doc_id, a.t, a.k, a.i, a.place),
    near AS (SELECT *, list_prepend({'j': place::BIGINT, 'm': 1::BIGINT, 'last': i::BIGINT, 'i': i::BIGINT, 'w': ''}, coalesce(seen, [])) AS all_seen FROM grouped),
    folded AS (SELECT doc_id, k, i, list_reduce(all_seen, lambda a, x: CASE WHEN a.j < k AND list_position(t[a.j + 1:a.j + 3], x.w) > 0
        THEN {'j': a.j + list_position(t[a.j + 1:a.j + 3], x.w), 'm': a.m + 1, 'last': x.i, 'i': x.i, 'w': ''} ELSE a END) AS s FROM near),
    best AS (SELECT doc_id, k, max_by({'first': i, 'last': s.last, 'm': s.m}, (s.m, i - s.last, -i)) AS b FROM folded GROUP BY doc_id, k)
    SELECT doc_id, b.first AS first, b.last AS last, b.m AS matched FROM best WHERE b.m >= greatest(CASE WHEN k > 1 THEN 2 ELSE 1 END, floor(0.6 * k + 0.5))"""
)
def j17_spoken_windows(spark, sf_dir):
    """A document's first line is its title, the others are its transcript."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = src.table(spark, sf_dir, "documents").select("doc_id", F.element_at(lines, 1).alias("title"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("text"))
    docs = docs.select("doc_id", "text", keys(F.col("title")).alias("tokens"))
    words = keyed_words(docs.where(F.size("tokens") > 0), "doc_id", "tokens").where(F.array_contains("tokens", F.col("key"))).drop("tokens")  # the others can't count, and needn't be dealt out
    found = matching.spoken_windows(docs.select("doc_id", "tokens"), words, ["doc_id"])
    return found.select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("matched").cast("long").alias("matched"))


#: The errors of a plan before and after: even ones have a new id and go on for another while, some others another length.
OLD_NEW = (
    src.SQL
    + """, old AS (SELECT plan_id, id, start, "end", round("end" - start, 0)::BIGINT AS content FROM cuts),
    new AS (SELECT plan_id, CASE WHEN enabled THEN id + 1000000000 ELSE id END AS id, start + id % 7 * 900 AS start, "end" + id % 5 * 700 AS "end", round("end" - start, 0)::BIGINT + id % 3 AS content FROM cuts)
"""
)


@query(
    OLD_NEW.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, kept AS (SELECT o.plan_id, o.id, CASE WHEN n.content = o.content THEN 'same' ELSE 'changed' END AS status, n.id AS new_id FROM old o JOIN new n USING (plan_id, id)),
    pairs AS (SELECT o.plan_id, o.id, n.id AS new_id, least(o."end", n."end") - greatest(o.start, n.start) AS overlap FROM old o JOIN new n ON o.plan_id = n.plan_id AND least(o."end", n."end") - greatest(o.start, n.start) > -0.3
      WHERE o."end" >= o.start AND n."end" >= n.start AND NOT EXISTS (SELECT 1 FROM new x WHERE x.plan_id = o.plan_id AND x.id = o.id) AND NOT EXISTS (SELECT 1 FROM old x WHERE x.plan_id = n.plan_id AND x.id = n.id)
        AND NOT EXISTS (SELECT 1 FROM old x WHERE x.plan_id = n.plan_id AND x.content = n.content AND x.id <> o.id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY overlap DESC, id, new_id) AS r FROM pairs),
    greedy(plan_id, r, used_old, used_new, id, new_id) AS (
      SELECT plan_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT plan_id FROM ranked)
      UNION ALL
      SELECT g.plan_id, k.r, CASE WHEN free THEN list_append(used_old, k.id) ELSE used_old END, CASE WHEN free THEN list_append(used_new, k.new_id) ELSE used_new END, CASE WHEN free THEN k.id END, CASE WHEN free THEN k.new_id END
      FROM (SELECT g.*, k.r AS kr, NOT list_contains(g.used_old, k.id) AND NOT list_contains(g.used_new, k.new_id) AS free FROM greedy g JOIN ranked k ON k.plan_id = g.plan_id AND k.r = g.r + 1) g JOIN ranked k ON k.plan_id = g.plan_id AND k.r = g.kr),
    taken AS (SELECT plan_id, id, new_id FROM greedy WHERE id IS NOT NULL)
    SELECT * FROM kept UNION ALL
    SELECT o.plan_id, o.id, CASE WHEN t.id IS NULL THEN 'none' ELSE 'replaced' END, coalesce(t.new_id, o.id) FROM old o LEFT JOIN taken t USING (plan_id, id) WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.plan_id = o.plan_id AND k.id = o.id)"""
)
def j20_identified(spark, sf_dir):
    length = F.round(F.col("end") - F.col("start"), 0).cast("long")
    old = src.cuts(spark, sf_dir).select("plan_id", "id", "start", "end", length.alias("content"), "enabled")
    new = old.select(
        "plan_id", F.when(F.col("enabled"), F.col("id") + 1000000000).otherwise(F.col("id")).alias("id"), (F.col("start") + F.col("id") % 7 * 900).alias("start"), (F.col("end") + F.col("id") % 5 * 700).alias("end"),
        (F.col("content") + F.col("id") % 3).alias("content"),
    )
    return matching.identified(old.drop("enabled"), new, BY, 50_000.0)


#: Purchases are cards, with a face where the value is low; clicks and views are boxes on the frame for a while.
def cards_of(spark, sf_dir):
    v = F.col("value")
    rows = src.clocked(src.table(spark, sf_dir, "events")).where("text = 'purchase'")
    face = F.when(v < 25, F.struct((0.4 + v / 100).alias("x"), (0.3 + v / 100).alias("y"), F.lit(0.2).alias("w"), (0.15 + v / 200).alias("h")))
    return rows.select("plan_id", F.col("event_id").alias("id"), "start", (F.col("start") + 90000).alias("end"), (0.2 + v / 200).alias("w"), (0.15 + v / 150).alias("h"), face.alias("face"), F.when(F.col("event_id") % 3 == 0, 0.7).alias("top"))


def boxes_of(spark, sf_dir):
    v = F.col("value")
    rows = src.clocked(src.table(spark, sf_dir, "events")).where("text IN ('click', 'view')")
    return rows.select("plan_id", "start", (F.col("start") + v * 2000).alias("end"), (v / 100).alias("x0"), (v / 60).alias("y0"), (v / 100 + 0.3).alias("x1"), (v / 60 + 0.2).alias("y1"))


def _placed_sql() -> str:
    left, top, right, low = layout.SAFE
    m, (side, above, below) = layout.MARGIN, layout.ZONE
    area = lambda a, b, c, d: f"greatest(0, least(bx1, {c}) - greatest(bx0, {a})) * greatest(0, least(by1, {d}) - greatest(by0, {b}))"
    return (
        src.SQL
        + f""", items AS (SELECT plan_id, event_id AS id, start, start + 90000 AS "end", 0.2 + value / 200 AS w, 0.15 + value / 150 AS h, value < 25 AS faced, 0.4 + value / 100 AS fx, 0.3 + value / 100 AS fy, 0.2::DOUBLE AS fw,
        0.15 + value / 200 AS fh, least({low}, CASE WHEN event_id % 3 = 0 THEN 0.7 ELSE {low} END)::DOUBLE AS bottom FROM clocked WHERE text = 'purchase'),
    boxes AS (SELECT plan_id, start, start + value * 2000 AS "end", value / 100 AS x0, value / 60 AS y0, value / 100 + 0.3 AS x1, value / 60 + 0.2 AS y1 FROM clocked WHERE text IN ('click', 'view')),
    tries AS (SELECT unnest([{", ".join(f"{{'rank': {2 * i + j}, 's': {s}::DOUBLE, 'side': {j}}}" for i, s in enumerate(layout.SCALES) for j in range(2))}]) AS t),
    sized AS (SELECT i.*, t.rank AS rank, t.s AS s, t.side AS side, w * t.s AS ww, h * t.s AS hh FROM items i, tries),
    wished AS (SELECT *, CASE WHEN NOT faced THEN side::DOUBLE WHEN side = 0 THEN fy + fh / 2 + {below} + {m} + hh / 2 ELSE fy - fh / 2 - {above} - {m} - hh / 2 END AS cy FROM sized),
    fitted AS (SELECT *, 0.5::DOUBLE AS x, CASE WHEN {top} + hh / 2 + {m} > bottom - hh / 2 - {m} THEN ({top} + bottom) / 2 ELSE least(greatest(cy, {top} + hh / 2 + {m}), bottom - hh / 2 - {m}) END AS y FROM wished),
    carded AS (SELECT *, x - ww / 2 AS bx0, y - hh / 2 AS by0, x + ww / 2 AS bx1, y + hh / 2 AS by1 FROM fitted),
    faced_area AS (SELECT *, CASE WHEN faced THEN {area(f"fx - fw / 2 - {side}", f"fy - fh / 2 - {above}", f"fx + fw / 2 + {side}", f"fy + fh / 2 + {below}")} ELSE 0 END AS fo FROM carded),
    scored AS (SELECT c.plan_id, c.id, rank, x, y, s, fo, sum(CASE WHEN b.plan_id IS NULL THEN 0 ELSE {area("b.x0", "b.y0", "b.x1", "b.y1")} END) AS ao FROM faced_area c
      LEFT JOIN boxes b ON b.plan_id = c.plan_id AND b.start < c."end" AND b."end" > c.start GROUP BY c.plan_id, c.id, rank, x, y, s, fo),
    chosen AS (SELECT plan_id, id, coalesce(min_by(scored, rank) FILTER (fo <= 1e-9 AND ao <= 1e-9), min_by(scored, (round(ao, 8), rank)) FILTER (fo <= 1e-9), min_by(scored, (round(fo, 8), rank))) AS p FROM scored GROUP BY plan_id, id)
    SELECT plan_id, id, round(p.x, 6) AS x, round(p.y, 6) AS y, p.s AS scale FROM chosen"""
    )


@query(_placed_sql())
def m10_placed(spark, sf_dir):
    return rounded(layout.placed(cards_of(spark, sf_dir), boxes_of(spark, sf_dir), BY, 100_000.0), "x", "y", digits=6)


WEAK = ("the", "of", "and", "de", "la", "der", "die", "und", "le", "et", "el", "y")


@query(
    rf"""WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations),
    words AS (SELECT conv_id, turn, line, list_filter(regexp_split_to_array(l, ' +'), lambda w: w <> '') AS w FROM lines),
    sized AS (SELECT *, len(w) AS n, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(list_transform(w[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS ends FROM words WHERE len(w) > 0),
    cuts AS (
      SELECT *, 0 AS a, n AS b, 1 AS k FROM sized WHERE n = 1 UNION ALL
      SELECT *, unnest(range(1, 2)) AS a, n AS b, 2 AS k FROM sized WHERE n = 2 UNION ALL
      SELECT *, unnest(range(a + 1, n)) AS b, 3 AS k FROM (SELECT *, unnest(range(1, n - 1)) AS a FROM sized WHERE n >= 3)),
    widths AS (SELECT *, CASE k WHEN 1 THEN [ends[n + 1] - 1] WHEN 2 THEN [ends[a + 1] - 1, ends[n + 1] - ends[a + 1] - 1] ELSE [ends[a + 1] - 1, ends[b + 1] - ends[a + 1] - 1, ends[n + 1] - ends[b + 1] - 1] END AS ws,
        (CASE WHEN k >= 2 AND list_contains({list(WEAK)}, lower(w[a])) THEN 1 ELSE 0 END + CASE WHEN k = 3 AND list_contains({list(WEAK)}, lower(w[b])) THEN 1 ELSE 0 END) AS weak FROM cuts),
    costs AS (SELECT conv_id, turn, line, w, k, a, b, 20000 * k * list_max(ws) + 2 * k * (ws[1] + coalesce(ws[3], 0)) + 9000 * (ends[n + 1] - 1) * weak AS cost FROM widths),
    best AS (SELECT conv_id, turn, line, min_by({{'w': w, 'k': k, 'a': a, 'b': b}}, (cost, a, b)) AS c FROM costs GROUP BY 1, 2, 3)
    SELECT conv_id, turn, line, array_to_string(CASE c.k WHEN 1 THEN c.w ELSE c.w[1:c.a] END, ' ') || CASE WHEN c.k >= 2 THEN ' / ' || array_to_string(c.w[c.a + 1:CASE WHEN c.k = 2 THEN len(c.w) ELSE c.b END], ' ') ELSE '' END
      || CASE WHEN c.k = 3 THEN ' / ' || array_to_string(c.w[c.b + 1:], ' ') ELSE '' END AS text FROM best"""
)
def w38_balanced_lines(spark, sf_dir):
    """Each line of a conversation's turns, dealt into three."""
    lines = src.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    words = lines.select("conv_id", "turn", F.col("line").cast("long").alias("line"), F.filter(F.split("l", " +"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    return layout.balanced(words, ["conv_id", "turn", "line"], 3, WEAK).select("conv_id", "turn", "line", F.array_join("parts", " / ").alias("text"))
