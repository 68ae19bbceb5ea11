"""Plans as JSON documents, made of the events: one user's events are the items of one plan, some of them with faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plan_documents as pd
from ..sources import adapters as src
from .registry import query

DEFAULTS = '{"entities":{"topic":""},"director":{},"fx":{"captions":{"y":0.7},"music":{"gain":1},"grade":{}}}'


def catalog(spark):
    rule = lambda kind, param, type_, default, low=None, high=None, step=None, opts=None: ("effects", kind, param, type_, low, high, step, opts, None, None, None, True, default)
    rows = [r for k in ("click", "view", "purchase") for r in (rule(k, "amount", "num", "5", 10.0, 300.0), rule(k, "count", "num", "1", 0.0, 40.0, 1.0), rule(k, "side", "select", '"left"', opts=["left", "right"]), rule(k, "color", "color", '"#000000"'))]
    return spark.createDataFrame(rows, pd.CATALOG)


def documents(spark, sf_dir):
    """plan_id and json. errors and signups are no known kinds; of every eleven items one has no end, of every three one runs backwards, of every four one has no id or the one before's. Times are whole milliseconds."""
    e = F.col("event_id")
    rows = src.clocked(src.table(spark, sf_dir, "events")).withColumn("start", F.floor(F.col("start") * 1000) / 1000)
    late = F.col("start") + F.col("value") * 10
    item = F.struct(
        F.col("text").alias("kind"), F.when(e % 3 == 0, late).otherwise(F.col("start")).alias("start"), F.when(e % 11 > 0, F.when(e % 3 == 0, F.col("start")).otherwise(late)).alias("end"),
        F.when(e % 4 == 0, None).when(e % 4 == 1, F.concat(F.lit("fx_"), (e % 50).cast("string"))).otherwise(F.concat(F.lit("own"), (e % 20).cast("string"))).alias("id"),
        F.when(e % 7 == 0, "x").otherwise(F.col("value").cast("string")).alias("amount"), (F.get_json_object("props", "$.k").cast("double") + 0.25).alias("count"),
        F.when(e % 2 == 0, "right").when(e % 5 == 0, "up").alias("side"), F.when(e % 6 == 0, "#1af").alias("color"), (e % 9 > 0).alias("enabled"),
    )
    plans = rows.groupBy("plan_id").agg(F.max("start").alias("duration"), F.transform(F.sort_array(F.collect_list(F.struct(e, item.alias("x")))), lambda x: x["x"]).alias("effects"))
    return plans.select("plan_id", F.to_json(F.struct("duration", F.struct("effects").alias("fx"))).alias("json"))


ITEMS = (
    src.SQL
    + """, ms AS (SELECT * REPLACE (floor(start * 1000) / 1000 AS start) FROM clocked), e AS (SELECT c.*, max(start) OVER (PARTITION BY plan_id) AS d, row_number() OVER (PARTITION BY plan_id ORDER BY event_id) - 1 AS i FROM ms c),
    r AS (SELECT *, CASE WHEN text IN ('error', 'signup') THEN 'unknown_kind' WHEN event_id % 11 = 0 OR (d > 0 AND start >= d) THEN 'no_times' END AS reason FROM e)"""
)


@query(ITEMS + " SELECT plan_id, 'effects' AS track, i::INT AS i, reason FROM r WHERE reason IS NOT NULL")
def z4_dropped_items(spark, sf_dir):
    return pd.normal_items(documents(spark, sf_dir), catalog(spark), ["plan_id"])[1]


@query(
    ITEMS
    + """, g AS (SELECT *, CASE WHEN d > 0 THEN least(start + value * 10, d) ELSE start + value * 10 END AS e0, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'fx_' || event_id % 50 ELSE 'own' || event_id % 20 END AS id0 FROM r WHERE reason IS NULL),
    t AS (SELECT *, CASE WHEN e0 - start >= 0.05 THEN start WHEN d > 0 AND start + 0.05 > d THEN greatest(0, d - 0.05) ELSE start END AS s, CASE WHEN e0 - start >= 0.05 THEN e0 WHEN d > 0 AND start + 0.05 > d THEN d ELSE start + 0.05 END AS e1 FROM g),
    n AS (SELECT *, CASE WHEN id0 IS NULL OR row_number() OVER (PARTITION BY plan_id, id0 ORDER BY i) > 1 THEN 1 ELSE 0 END AS fresh, coalesce(max(CASE WHEN event_id % 4 = 1 THEN event_id % 50 END) OVER (PARTITION BY plan_id), 0) AS top FROM t)
    SELECT plan_id, i::INT AS i, CASE WHEN fresh = 1 THEN 'fx_' || (top + sum(fresh) OVER (PARTITION BY plan_id ORDER BY i))::BIGINT ELSE id0 END AS id, round(s, 3) AS start, round(e1, 3) AS "end",
    CASE WHEN event_id % 7 = 0 THEN 5 ELSE greatest(10, least(300, value)) END::DOUBLE AS amount, least(40, greatest(0, (props::JSON->>'k')::BIGINT))::INT AS count,
    CASE WHEN event_id % 2 = 0 THEN 'right' ELSE 'left' END AS side, CASE WHEN event_id % 6 = 0 THEN '#11AAFF' ELSE '#000000' END AS color, event_id % 9 > 0 AS enabled FROM n"""
)
def z4_normal_items(spark, sf_dir):
    rows = pd.normal_items(documents(spark, sf_dir), catalog(spark), ["plan_id"])[0]
    x = F.from_json("item", "start double, end double, amount double, count int, side string, color string, enabled boolean")
    return rows.select("plan_id", "i", "id", x.alias("x")).select("plan_id", "i", "id", F.round("x.start", 3).alias("start"), F.round("x.end", 3).alias("end"), "x.amount", "x.count", "x.side", "x.color", "x.enabled")


@query(ITEMS + " SELECT plan_id, 2 AS version, 0.7::DOUBLE AS y, count(*) FILTER (reason IS NULL)::INT AS n, 0 AS n_text FROM r GROUP BY 1")
def z4_z9_plans(spark, sf_dir):
    plans = pd.normalised(documents(spark, sf_dir), catalog(spark), DEFAULTS, ["plan_id"])[0]
    x = F.from_json("json", "version int, fx struct<captions:struct<y:double>,effects:array<struct<id:string>>,text:array<struct<id:string>>>")
    return plans.select("plan_id", x.alias("x")).select("plan_id", "x.version", "x.fx.captions.y", F.size("x.fx.effects").alias("n"), F.size("x.fx.text").alias("n_text"))
