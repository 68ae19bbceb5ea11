"""The job table, over orders, and schema rules, over the events' JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as jb
from ..operators import rules
from ..sources import adapters as src
from . import fold_sql
from .registry import query


def _orders(spark, sf_dir):
    return src.table(spark, sf_dir, "orders")


@query(src.SQL + "SELECT id, kind, state, created, customer, total FROM jobs WHERE id = 7")
def s2_job_by_id(spark, sf_dir):
    return src.jobs(spark, sf_dir).where("id = 7")


@query(src.SQL + "SELECT id, state, created FROM jobs ORDER BY created DESC, id DESC LIMIT 50")
def l1_recent_jobs(spark, sf_dir):
    return src.jobs(spark, sf_dir).select("id", "state", "created").orderBy(F.desc("created"), F.desc("id")).limit(50)


@query(src.SQL + "SELECT arg_min(id, (created, id)) AS id FROM jobs WHERE state = 'queued'")
def l2_oldest_queued(spark, sf_dir):
    return src.jobs(spark, sf_dir).where("state = 'queued'").agg(F.min_by("id", F.struct("created", "id")).alias("id"))


@query(src.SQL + ", n AS (SELECT id FROM jobs ORDER BY created DESC, id DESC LIMIT 500) SELECT id, state FROM jobs WHERE state NOT IN ('queued', 'running') AND id NOT IN (SELECT id FROM n)")
def k5_expired(spark, sf_dir):
    return jb.expired(src.jobs(spark, sf_dir), 500).select("id", "state")


@query(src.SQL + "SELECT id, count(*) OVER (ORDER BY created) AS place FROM jobs WHERE state = 'queued'")
def a4_queue_places(spark, sf_dir):
    return jb.queue_places(src.jobs(spark, sf_dir)).select("id", "place")


@query(src.SQL + "SELECT id, CASE WHEN state = 'running' AND total > 200000 THEN 'review' WHEN state = 'running' THEN 'queued' ELSE state END AS next FROM jobs")
def k6_recovered(spark, sf_dir):
    return jb.recovered(src.jobs(spark, sf_dir), F.col("total") > 200_000).select("id", "next")


@query(
    src.SQL
    + """, h AS (SELECT customer, id, created, CASE WHEN id % 7 > 0 THEN kind END AS c FROM jobs),
    f AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY customer ORDER BY created, id ROWS UNBOUNDED PRECEDING) AS k FROM h),
    g AS (SELECT *, CASE WHEN k IS NOT NULL AND k IS DISTINCT FROM lag(k) OVER (PARTITION BY customer ORDER BY created, id) THEN 1 ELSE 0 END AS fresh FROM f)
    SELECT id, sum(fresh) OVER (PARTITION BY customer ORDER BY created, id ROWS UNBOUNDED PRECEDING)::BIGINT AS rev FROM g"""
)
def k2_revisions(spark, sf_dir):
    return jb.revisions(src.jobs(spark, sf_dir), ["customer"], ["created", "id"], F.when(F.col("id") % 7 > 0, F.col("kind"))).select("id", "rev")


@query(
    src.SQL
    + """, r AS (SELECT customer AS key, id, total, id % 3 AS token FROM jobs), t AS (SELECT *, max(token) OVER (PARTITION BY key) AS top FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS n FROM t WHERE token = top) SELECT key, id, total, token FROM n WHERE n = 1"""
)
def k4_latest_by_token(spark, sf_dir):
    rows = src.jobs(spark, sf_dir).select(F.col("customer").alias("key"), "id", "total", (F.col("id") % 3).alias("token"))
    return jb.latest(rows, ["key"], [F.desc("id")])


@query(fold_sql.CLAIMS)
def k3_claims(spark, sf_dir):
    rows = src.jobs(spark, sf_dir).select("customer", "id", F.pmod("id", F.lit(4)).alias("expected"))
    return jb.claims(rows, ["customer"], ["id"])


@query(src.SQL + "SELECT id, sum(total) OVER (PARTITION BY customer ORDER BY created DESC, id DESC ROWS UNBOUNDED PRECEDING) <= 400000 AS held FROM jobs")
def a13_within_budget(spark, sf_dir):
    return jb.within_budget(src.jobs(spark, sf_dir), ["customer"], [F.desc("created"), F.desc("id")], "total", 400_000.0).select("id", "held")


@query("WITH n AS (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE n WHEN 1 THEN slug ELSE slug || '-' || n END AS \"unique\" FROM n")
def k10_numbered_slugs(spark, sf_dir):
    rows = src.table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"))
    return jb.numbered_slugs(rows, "slug", ["p_partkey"]).select("p_partkey", "unique")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")
def j14_orders_without_customer(spark, sf_dir):
    good = src.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return _orders(spark, sf_dir).join(good, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT n_nationkey AS key FROM nation EXCEPT (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def j15_unused_keys(spark, sf_dir):
    used = src.table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("key")).union(src.table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_nationkey")).distinct()
    return src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key")).join(used, "key", "left_anti")


@query(
    """WITH i AS (SELECT event_id, event_type AS kind, (props::JSON->>'k')::DOUBLE AS k, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE value::VARCHAR END AS level FROM events)
    SELECT event_id, CASE kind WHEN 'click' THEN least(greatest(k, 10), 50) WHEN 'view' THEN floor(least(greatest(k, 0), 80) / 5 + 0.5) * 5 ELSE k END AS k,
    CASE WHEN level = 'x' THEN 20 ELSE least(greatest(try_cast(level AS DOUBLE), 1), 200) END AS level FROM i WHERE kind <> 'signup'"""
)
def z3_coerced(spark, sf_dir):
    items, catalog = rules.event_items(spark, sf_dir), rules.event_catalog(spark)
    return rules.normalised(items, catalog, ["k", "level"])[0].select("event_id", "k", "level")


@query(
    """WITH i AS (SELECT event_id, event_type AS kind, (props::JSON->>'k')::DOUBLE AS k, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE value::VARCHAR END AS level FROM events)
    SELECT event_id, 'kind' AS param, 'unknown' AS problem FROM i WHERE kind = 'signup'
    UNION ALL SELECT event_id, 'k', 'range' FROM i WHERE kind = 'click' AND (k < 10 OR k > 50) OR kind = 'view' AND k > 80
    UNION ALL SELECT event_id, 'level', 'type' FROM i WHERE kind <> 'signup' AND level = 'x'
    UNION ALL SELECT event_id, 'level', 'range' FROM i WHERE kind <> 'signup' AND level <> 'x' AND (try_cast(level AS DOUBLE) < 1 OR try_cast(level AS DOUBLE) > 200)"""
)
def z5_violations(spark, sf_dir):
    items, catalog = rules.event_items(spark, sf_dir), rules.event_catalog(spark)
    return rules.normalised(items, catalog, ["k", "level"])[1].select("event_id", "param", "problem")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, props::JSON->>'missing' AS missing, len(json_keys(props::JSON)) AS n FROM events")
def z1_json_paths(spark, sf_dir):
    v = F.try_parse_json("props")
    return src.table(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), F.size(F.json_object_keys("props")).cast("long").alias("n")
    )
