"""Text, link, number and color functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, maths, text
from ..sources.adapters import table
from .registry import query, rounded

FOLD = f"translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}')"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, md5(regexp_replace({FOLD}, '[^a-z0-9]', '', 'g')) AS digest FROM documents")
def x1_key_alnum(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.key_alnum(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace({FOLD}, '[^a-z'']', '', 'g')) AS digest FROM documents")
def x2_key_letters(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.key_letters(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(trim(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def x3_key_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.key_words(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS digest FROM documents")
def x4_key_unicode(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.key_unicode(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5(trim(regexp_replace({FOLD}, '[^a-z0-9 -]+', '', 'g'))) AS digest FROM documents")
def x5_key_dashed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.key_dashed(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS distinct_words FROM documents")
def x7_words(spark, sf_dir):
    own = documents(spark, sf_dir)
    return own.select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n"), F.size(F.array_distinct(text.words(F.lower("text")))).cast("long").alias("distinct_words"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def x9_titled(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.titled(F.col("p_name")).alias("title"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'))[1:80] AS line FROM documents")
def x10_one_line(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.one_line(F.col("text"), 80).alias("line"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(translate(lower(p_name || ' ' || p_brand), '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9]+', '-', 'g')[1:12], '^-+|-+$', '', 'g') AS slug FROM part")
def x32_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand"), 12).alias("slug"))


def _others(lang: str) -> str:
    return ", ".join(f"'{w}'" for k, v in text.STOP.items() if k != lang for w in v)


@query(r"SELECT doc_id, lang, list_has_any(regexp_extract_all(lower(text), '\p{L}+'), CASE lang " + " ".join(f"WHEN '{k}' THEN [{_others(k)}]" for k in text.STOP) + " END) AS leak FROM documents")
def f13_language_leak(spark, sf_dir):
    own = documents(spark, sf_dir)
    leak = F.lit(None).cast("boolean")
    for lang in text.STOP:
        leak = F.when(F.col("lang") == lang, text.leaks(F.col("text"), lang)).otherwise(leak)
    return own.select("doc_id", "lang", leak.alias("leak"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 3 AS neutral, len(list_filter(string_split(text, ' '), lambda w: length(regexp_replace(w, '[^\p{L}]', '', 'g')) < 3)) AS neutral_words FROM documents")
def f14_neutral(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.neutral(F.col("text")).alias("neutral"), F.size(F.filter(F.split("text", " "), text.neutral)).cast("long").alias("neutral_words"))


@query("SELECT event_id, (floor(value)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS clock, (floor(value * 100 + 0.5)::BIGINT // 360000)::VARCHAR || ':' || lpad((floor(value * 100 + 0.5)::BIGINT // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((floor(value * 100 + 0.5)::BIGINT // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((floor(value * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') AS subtitle FROM events")
def x29_clocks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.col("value")).alias("clock"), text.subtitle_clock(F.col("value")).alias("subtitle"))


@query("SELECT o_orderkey, replace(format('{:,}', o_totalprice::BIGINT - CASE WHEN o_totalprice::BIGINT > o_totalprice THEN 1 ELSE 0 END), ',', '.') AS shown FROM orders")
def x28_separated(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.separated(F.floor("o_totalprice")).alias("shown"))


@query("SELECT event_id, try_cast(regexp_replace(props, '[^0-9.eE+-]', '', 'g') AS DOUBLE) AS x FROM events")
def x28_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.number(F.col("props")).alias("x"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1) AS i FROM documents),
    r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(word, '[0-9]') DESC, length(word) DESC, i) AS n FROM w WHERE lower(word) NOT IN ('the', 'and', 'les', 'und'))
    SELECT d.doc_id, coalesce((SELECT string_agg(word, ' ' ORDER BY n) FROM r WHERE r.doc_id = d.doc_id AND n <= 2), '') AS words FROM documents d"""
)
def l4_keywords(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.keywords(F.col("text"), ["the", "and", "les", "und"], 2), " ").alias("words"))


HOST = "regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)', 1)), '^(?:www|m|mobile)\\.', '')"


@query(f"SELECT page_id, {HOST} AS host, 'web' AS platform, regexp_matches(url, '^https?://') AS public FROM pages")
def x17_platforms(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", links.host(url).alias("host"), links.platform(url).alias("platform"), links.public(url).alias("public"))


EMAIL = links.EMAIL.replace("'", "''")


@query(f"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS email FROM documents) SELECT doc_id, email, count(*) AS n FROM e GROUP BY 1, 2")
def x19_emails(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(links.EMAIL), F.lit(1))).alias("email"))
    return rows.groupBy("doc_id", "email").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, round(t * t * t, 6) AS in_cubic, round(1 - (1 - t) * (1 - t) * (1 - t), 6) AS out_cubic, round(CASE WHEN t < 0.5 THEN 2 * t * t ELSE 1 - 2 * (1 - t) * (1 - t) END, 6) AS inout_quad,
    round(sin(t * pi() / 2), 6) AS out_sine, round(1 + 2.70158 * (t - 1) * (t - 1) * (t - 1) + 1.70158 * (t - 1) * (t - 1), 6) AS out_back FROM (SELECT l_orderkey, l_linenumber, l_quantity / 64 AS t FROM lineitem)"""
)
def m2_easings(spark, sf_dir):
    names = ["in_cubic", "out_cubic", "inout_quad", "out_sine", "out_back"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(maths.easing(x, F.col("l_quantity") / 64).alias(x) for x in names))
    return rounded(rows, *names, digits=6)


@query("SELECT l_orderkey, l_linenumber, round(1 - exp(-0.5 * w * t) * (cos(w * sqrt(0.75) * t) + 0.5 / sqrt(0.75) * sin(w * sqrt(0.75) * t)), 5) AS x FROM (SELECT l_orderkey, l_linenumber, l_quantity / 64 AS t, 2 * pi() * 1.5 AS w FROM lineitem)")
def m3_spring(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", maths.spring(F.col("l_quantity") / 64, 1.5, 0.5).alias("x")), "x", digits=5)


@query("SELECT event_id, round(20 * log10(greatest(value, 1e-10)), 5) AS db, round(pow(10, value / 400), 5) AS linear, round(440 * pow(2, (value / 10 - 69) / 12), 4) AS hz, round(least(greatest(value, 10), 100), 3) AS held, round(5 + least(greatest((value - 10) / 90, 0), 1) * -3, 5) AS mapped FROM events")
def m1_m5_m6_levels(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.round(maths.to_db(v), 5).alias("db"), F.round(maths.from_db(v / 20), 5).alias("linear"), F.round(maths.midi_hz(v / 10), 4).alias("hz"),
        F.round(maths.clamp(v, 10.0, 100.0), 3).alias("held"), F.round(maths.remap(v, 10.0, 100.0, 5.0, 2.0), 5).alias("mapped"),
    )
    return rows


HEX = "'#' || upper(substr(md5(p_name || p_partkey), 1, 6))"
LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@query(
    f"""WITH c AS (SELECT p_partkey, {HEX} AS color FROM part),
    l AS (SELECT p_partkey, color, {' + '.join(f"{w} * (" + LIN.format(c=f"(('0x' || color[{2 + 2 * i}:{3 + 2 * i}])::INT / 255.0::DOUBLE)") + ")" for i, w in enumerate((0.2126, 0.7152, 0.0722)))} AS y FROM c)
    SELECT p_partkey, color, round(y, 6) AS luminance, round(1.05 / (y + 0.05), 5) AS on_white, CASE WHEN 1.05 / (y + 0.05) >= (y + 0.05) / 0.05 THEN '#FFFFFF' ELSE '#000000' END AS ink FROM l"""
)
def m7_colors(spark, sf_dir):
    color = F.concat(F.lit("#"), F.upper(F.substring(F.md5(F.concat("p_name", "p_partkey")), 1, 6)))
    rows = table(spark, sf_dir, "part").select("p_partkey", maths.normal_color(color).alias("color"))
    c = F.col("color")
    return rows.select("p_partkey", "color", F.round(maths.luminance(c), 6).alias("luminance"), F.round(maths.contrast(c, F.lit("#FFFFFF")), 5).alias("on_white"), maths.ink(c).alias("ink"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(l_quantity + 20, 45) - greatest(l_quantity, 15)) * greatest(0, least(l_linenumber + 4, 6) - greatest(l_linenumber, 2)) AS area, (floor(l_quantity / 2 + 0.5)::BIGINT * 2) AS even FROM lineitem")
def m8_m9_rectangles(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    area = maths.overlap_area([q, n, F.lit(20.0), F.lit(4.0)], [F.lit(15.0), F.lit(2.0), F.lit(30.0), F.lit(4.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", area.alias("area"), maths.even(q).alias("even"))


@query("SELECT event_id, coalesce(CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END, -1) AS x FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'true' WHEN 2 THEN '1e400' WHEN 3 THEN NULL ELSE value::VARCHAR END AS x FROM events)")
def m18_finite(spark, sf_dir):
    dirty = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 5 == 1, "true").when(F.col("event_id") % 5 == 2, "1e400").when(F.col("event_id") % 5 == 4, F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", maths.finite(dirty, -1.0).alias("x"))


def _links_sql(documents: str = "documents") -> str:
    q = lambda x: x.replace("'", "''")
    host = "regexp_replace(lower(regexp_extract(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)', 1)), '^(?:www|m|mobile)\\.', '')"
    platform = "CASE " + " ".join(f"WHEN host = '{d}' OR host LIKE '%.{d}' THEN '{n}'" for n, ds in links.PLATFORMS.items() for d in ds) + " ELSE 'web' END"
    among = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    reserved = " OR ".join(f"platform = '{k}' AND name IN {among(v)}" for k, v in links.RESERVED.items())
    said = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in links.SAID.items())
    return f"""WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '@{{2,}}', '@', 'g') AS t FROM {documents}),
    r AS (SELECT doc_id, t, regexp_replace(t, '{q(links.EMAIL)}', ' ', 'g') AS r FROM c),
    s AS (SELECT doc_id, t, r, regexp_replace(r, '{q(links.URL)}', ' ', 'g') AS s FROM r),
    l AS (SELECT doc_id, t, r, s, regexp_replace(s, '{q(links.BARE)}', ' ', 'g') AS l FROM s),
    u0 AS (SELECT doc_id, unnest(regexp_extract_all(r, '{q(links.URL)}', 1)) AS x FROM r UNION ALL SELECT doc_id, unnest(regexp_extract_all(s, '{q(links.BARE)}', 1)) FROM s),
    u1 AS (SELECT *, {host} AS host, lower(regexp_extract(x, '^(?:[A-Za-z]+://)?[^/?#]+/(?:(?:in|company|add|stories)/)?@?([A-Za-z0-9_.-]{{2,30}})(?:[/?#]|$)', 1)) AS name FROM u0),
    u2 AS (SELECT *, {platform} AS platform FROM u1),
    u3 AS (SELECT *, CASE WHEN platform IN {among(links.NAMED)} AND name <> '' AND NOT ({reserved}) THEN '@' || name END AS handle FROM u2),
    h0 AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(l, '@') AS p FROM l)),
    h1 AS (SELECT doc_id, '@' || lower(regexp_extract(p[i + 1], '{links.NAME}', 1)) AS name, lower(regexp_extract(right(p[i], {links.CONTEXT}), '(?is).*\\b({links.NAMES})\\b', 1)) AS said FROM h0
      WHERE NOT regexp_matches(right(p[i], 1), '{links.INSIDE}') AND regexp_matches(p[i + 1], '{links.NAME}')),
    h2 AS (SELECT doc_id, name, CASE said {said} END AS said FROM h1),
    p0 AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(l, '{q(links.BEFORE)}', ' ', 'g'), '{q(links.PHONE)}', 1)) AS x FROM l),
    every AS (
      SELECT doc_id, 'email' AS kind, lower(x) AS value, 'email' AS platform, NULL AS handle, 'mailto:' || lower(x) AS address, false AS ambiguous FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{q(links.EMAIL)}', 1)) AS x FROM c)
      UNION ALL SELECT doc_id, 'url', x, platform, handle, 'https://' || host || CASE WHEN handle IS NOT NULL THEN '/' || name ELSE regexp_extract(x, '^(?:[A-Za-z]+://)?[^/?#]+([^?#]*?)/*(?:[?#].*)?$', 1) END, false FROM u3
      UNION ALL SELECT doc_id, 'handle', name, coalesce(said, 'instagram'), name, 'https://' || coalesce(said, 'instagram') || '/' || name[2:31], said IS NULL FROM h2
      UNION ALL SELECT doc_id, 'phone', x, 'phone', NULL, 'tel:+' || regexp_replace(x, '[^0-9]', '', 'g'), false FROM p0 WHERE length(regexp_replace(x, '[^0-9]', '', 'g')) >= 8)
    SELECT doc_id, kind, platform, handle, address, ambiguous, min(value) AS value, count(*) AS n FROM every e
    WHERE NOT ambiguous OR NOT EXISTS (SELECT 1 FROM every k WHERE k.doc_id = e.doc_id AND k.handle = e.handle AND NOT k.ambiguous) GROUP BY ALL"""


@query(_links_sql())
def x20_all_links(spark, sf_dir):
    return links.all_links(documents(spark, sf_dir), ["doc_id"])


#: Sentences around a handle, a host or a path, each with a document's number in it: several lines, names on other lines, marks before the handle, paths that are names on one platform only.
AROUND = (
    "instagram here\ntiktok: see @ana_{} and more", "tiktok:@ana_{}, ig @foo_{}.", "mail me: a{}@example.com or @b_{}", "yt/@no_{} but (canal) @yes_{}!", "see shop{}.example.com/a/b, or https://x.com/c and youtube.com/c",
    "https://instagram.com/c{} https://instagram.com/p https://tiktok.com/live https://facebook.com/live", "snap\n\n@s_{}\nfb\n@f_{} @s_{}", "a.b@c_{} word@w_{} .@d_{} ,@e_{}", "linktr.ee/s linktr.ee/t{} www.t.me/name{}",
    "the x @x_{} and then forty-eight characters or more of plain words go by before @y_{}",
)
_AROUND = " ".join(f"WHEN {i} THEN '" + x.replace("{}", "' || doc_id || '") + "'" for i, x in enumerate(AROUND))


@query(_links_sql(f"(SELECT doc_id, CASE doc_id % {len(AROUND)} {_AROUND} END || chr(10) || coalesce(text, '') AS text FROM documents)"))
def x21_links_in_context(spark, sf_dir):
    """One of those sentences before each document's text."""
    said = F.element_at(F.array(*(F.lit(x) for x in AROUND)), (F.col("doc_id") % len(AROUND)).cast("int") + 1)
    text = F.concat(F.replace(said, F.lit("{}"), F.col("doc_id").cast("string")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return links.all_links(documents(spark, sf_dir).withColumn("text", text), ["doc_id"])
