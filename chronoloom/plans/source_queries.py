"""Readers, writers, name resolution and streams, over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import resolve as rs
from ..sources import adapters as src
from ..sources import readers, writers
from ..streaming import jobs as stream
from . import fold_sql
from .registry import query


@query(
    src.SQL
    + """, j AS (SELECT plan_id, word_i, CASE WHEN word_i % 10 = 0 THEN ' ' ELSE ' ' || text END AS t, round(start * 1000)::BIGINT AS f, round("end" * 1000)::BIGINT AS u FROM words)
    SELECT plan_id, word_i::INT AS word_i, trim(t) AS text, f / 1000 AS start, u / 1000 AS "end" FROM j WHERE trim(t) <> ''"""
)
def s1_transcript_words(spark, sf_dir):
    w = src.words(spark, sf_dir)
    text = F.when(F.col("word_i") % 10 == 0, " ").otherwise(F.concat(F.lit(" "), "text"))
    item = F.struct(text.alias("text"), F.struct(F.round(F.col("start") * 1000).cast("long").alias("from"), F.round(F.col("end") * 1000).cast("long").alias("to")).alias("offsets"))
    raw = w.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("word_i", item.alias("x")))).alias("a"))
    json = raw.select("plan_id", F.to_json(F.struct(F.transform("a", lambda x: x["x"]).alias("transcription"))).alias("json"))
    return readers.transcript_words(json, ["plan_id"])


@query(
    """WITH h AS (SELECT page_id, '<head><META content="Page ' || page_id || '" property=''og:title''><meta charset="utf-8"><link href=/i' || page_id || '.png rel="icon" sizes=32x32></head>' || coalesce(html, '') AS html FROM pages),
    t AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?is)^(.*?)(?:<body|$)', 1), '(?i)<(?:meta|link)\\b[^>]*>')) AS t FROM h)
    SELECT page_id, count(*) AS n, 'Page ' || page_id AS title, '/i' || page_id || '.png' AS icon FROM t WHERE regexp_matches(t, '(?i)\\b(?:property|name|itemprop|rel)\\s*=') GROUP BY page_id"""
)
def s9_head_tags(spark, sf_dir):
    """The pages have no heads of their own: each gets one that names it, with a tag that counts for nothing."""
    p = F.col("page_id").cast("string")
    head = F.concat(F.lit('<head><META content="Page '), p, F.lit("\" property='og:title'><meta charset=\"utf-8\"><link href=/i"), p, F.lit('.png rel="icon" sizes=32x32></head>'), F.coalesce("html", F.lit("")))
    tags = readers.head_tags(src.table(spark, sf_dir, "pages").withColumn("html", head), ["page_id"])
    first = lambda key: F.min_by("value", F.when(F.col("key") == key, F.col("i")))
    return tags.groupBy("page_id").agg(F.count("*").alias("n"), first("og:title").alias("title"), first("icon").alias("icon"))


@query("SELECT source, lower(source) AS id, CASE WHEN count(*) % 2 = 0 THEN 'From ' || count(*) || ' texts' ELSE upper(lower(source)[1]) || lower(source)[2:] END AS title FROM documents GROUP BY source")
def s6_library(spark, sf_dir):
    """Sources are files; those of an even number of texts are known by a title."""
    by_source = src.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("id", F.lower("source"))
    known = by_source.where("n % 2 = 0").select("id", F.concat(F.lit("From "), F.col("n").cast("string"), F.lit(" texts")).alias("title"))
    return readers.library(by_source.select("source", "id"), known).select("source", "id", "title")


@query(
    src.SQL
    + """, c AS (SELECT plan_id, word_i, text, floor(start * 100 + 0.5)::BIGINT AS a, floor("end" * 100 + 0.5)::BIGINT AS b FROM words)
    SELECT plan_id, word_i, 'Dialogue: 0,' || (a // 360000) || ':' || lpad((a // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((a // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((a % 100)::VARCHAR, 2, '0') || ',' ||
    (b // 360000) || ':' || lpad((b // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((b // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((b % 100)::VARCHAR, 2, '0') || ',Default,,0,0,0,,' || text AS line FROM c"""
)
def k7_subtitle_lines(spark, sf_dir):
    return writers.subtitle_lines(src.words(spark, sf_dir), ["plan_id", "word_i"]).drop("start")


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def k11_appended(spark, sf_dir):
    old = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return writers.appended(old, src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query(
    """WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part), wanted AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT name || '_2' FROM names UNION SELECT upper(name) FROM names UNION SELECT name || 'x' FROM names UNION SELECT 'nothing'),
    aliases AS (SELECT upper(name) AS alias, name FROM names UNION ALL SELECT name || 'x', 'alias of ' || name FROM names),
    hits AS (SELECT w.name, n.name AS found, CASE WHEN w.name = n.name THEN 0 WHEN regexp_replace(w.name, '[_-]?[0-9]+$', '') = n.name THEN 1 ELSE 3 END AS tier, length(n.name) AS size FROM wanted w JOIN names n ON starts_with(w.name, n.name)
      UNION ALL SELECT w.name, a.name, 2, 0 FROM wanted w JOIN aliases a ON a.alias = w.name),
    best AS (SELECT name, arg_min(found, (tier, -size, found)) AS found FROM hits GROUP BY 1) SELECT w.name, found FROM wanted w LEFT JOIN best USING (name)"""
)
def j19_resolved_names(spark, sf_dir):
    part = src.table(spark, sf_dir, "part")
    names = part.select(F.split("p_name", " ")[0].alias("name")).distinct()
    wanted = part.select(F.col("p_name").alias("name")).union(names.select(F.concat("name", F.lit("_2")))).union(spark.createDataFrame([("nothing",)], "name string"))
    wanted = wanted.union(names.select(F.upper("name"))).union(names.select(F.concat("name", F.lit("x")))).distinct()
    aliases = names.select(F.upper("name").alias("alias"), "name").union(names.select(F.concat("name", F.lit("x")), F.concat(F.lit("alias of "), "name")))
    return rs.resolved(wanted, names, aliases)


@query("SELECT user_id, event_type AS key, min(event_id) AS pos, bool_or(value > 400) AS \"primary\", arg_min(props, event_id) FILTER (event_id % 3 = 0) AS photo FROM events GROUP BY 1, 2")
def a17_merged_links(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("pos"), (F.col("value") > 400).alias("primary"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("photo"))
    return rs.merged_links(rows, ["user_id"])


@query(
    src.SQL
    + """, l AS (SELECT * FROM cuts WHERE enabled) SELECT c.plan_id, c.id FROM cuts c WHERE NOT enabled AND NOT EXISTS (SELECT 1 FROM l WHERE l.plan_id = c.plan_id AND l.id % 3 = c.id % 3
    AND least(c."end", l."end") - greatest(c.start, l.start) > 0.5 * least(c."end" - c.start, l."end" - l.start))"""
)
def j22_without_copies(spark, sf_dir):
    cuts = src.cuts(spark, sf_dir).withColumn("kind", F.col("id") % 3)
    return rs.without_copies(cuts.where("not enabled"), cuts.where("enabled"), ["plan_id"], "kind").select("plan_id", "id")


@query(
    """WITH i AS (SELECT user_id, event_id AS ord, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'tx_' || (event_id % 50) END AS id FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY ord) AS n FROM i), b AS (SELECT *, CASE WHEN id IS NULL OR n > 1 THEN 1 ELSE 0 END AS bad, coalesce(max(split_part(id, '_', 2)::INT) OVER (PARTITION BY user_id), 0) AS m FROM d)
    SELECT user_id, ord, CASE WHEN bad = 1 THEN 'tx_' || (m + sum(bad) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) ELSE id END AS id FROM b"""
)
def w39_renumbered(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("tx_"), (F.col("event_id") % 50).cast("string"))).alias("id"))
    return rs.renumbered(rows, ["user_id"], "tx")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'fresh' WHEN o_orderkey % 3 = 1 THEN 'translated' ELSE 'edited' END AS state FROM orders")
def j24_translation_state(spark, sf_dir):
    items = src.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("text"))
    done = items.where("o_orderkey % 3 > 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 1, F.col("text")).otherwise("?").alias("source"))
    return rs.state_of_translation(items, done, ["o_orderkey"]).select("o_orderkey", "state")


def _streamed(spark, table: str, sf_dir: str):
    """A table as a stream of files."""
    path = f"{sf_dir}/{table}.parquet"
    rows = spark.read.parquet(path)
    is_file = rows.inputFiles()[0].endswith(f"/{table}.parquet")
    return spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/{table}*.parquet" if is_file else path)


def _all_of(stream_df, spark, mode: str):
    """What a stream gives for all that there is now, written batch by batch to the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream_df.schema
    # a batch has a folder of its own, so one that is run again after a failure replaces its rows
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else n}")
    stream_df.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/rows").select(*schema.names)


@query("SELECT event_type, date_trunc('day', ts) AS since, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t4_streamed_windows(spark, sf_dir):
    events = _streamed(spark, "events", sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _all_of(stream.windowed(events, "1 day"), spark, "complete")
    return rows.select("event_type", F.col("since").cast("timestamp_ntz").alias("since"), "n", F.round("total", 2).alias("total"))


@query("SELECT user_id AS id, max((props::JSON->>'k')::BIGINT) AS pct FROM events GROUP BY 1")
def t5_streamed_progress(spark, sf_dir):
    events = _streamed(spark, "events", sf_dir).select(F.col("user_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("pct"))
    return _all_of(stream.progress(events), spark, "complete")


@query(fold_sql.STATES)
def t2_streamed_states(spark, sf_dir):
    names = F.array(*map(F.lit, ["create", "claim", "finish", "cancel", "requeue"]))
    events = _streamed(spark, "events", sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("event"))
    return _all_of(stream.moved(events), spark, "append")


@query(fold_sql.FRESH)
def t3_streamed_fresh(spark, sf_dir):
    events = _streamed(spark, "events", sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 7 % 90).cast("long").alias("token"), "value")
    return _all_of(stream.fresh(events), spark, "append")
