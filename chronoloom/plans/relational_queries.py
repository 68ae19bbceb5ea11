"""Joins, groupings, rankings and stateful folds over the tables. The general SQL shapes go beyond what the time operators need."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stateful as st
from ..sources import adapters as src
from . import fold_sql
from .registry import query, rounded


def _t(spark, sf_dir, name):
    return src.table(spark, sf_dir, name)


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01' GROUP BY 1, 2"""
)
def rel_pricing_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'2001-09-01'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1"""
)
def rel_local_revenue(spark, sf_dir):
    t = lambda n: _t(spark, sf_dir, n)
    near = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    buyers = t("customer").join(near, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    lines = buyers.join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.join(t("supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return sold.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(o_orderstatus, 'all') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)")
def a23_cube(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(
        F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n", "total"
    )


@query("SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def z15_pivot(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT p_brand, p_partkey, rank FROM r WHERE rank <= 3")
def l11_ranked_candidates(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return _t(spark, sf_dir, "part").withColumn("rank", rank.cast("long")).where("rank <= 3").select("p_brand", "p_partkey", "rank")


@query("SELECT c_custkey, c_name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def s6_left_join_with_default(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _t(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "n")


@query("SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c.c_nationkey = s.s_nationkey")
def j20_full_join(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return c.join(_t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), "nation", "full")


@query("SELECT vec_id, label, round(a, 4) AS cosine FROM (SELECT v.vec_id, v.label, list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS a FROM embeddings v JOIN embeddings w ON w.vec_id = v.vec_id + 1)")
def w29_neighbour_cosine(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = v.join(after, "vec_id")
    return rows.select("vec_id", "label", F.round(dot("embedding", "other") / F.sqrt(dot("embedding", "embedding") * dot("other", "other")), 4).alias("cosine"))


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t4_daily_windows(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("event_type", F.to_date("w.start").alias("day"), "n", "total")


@query(
    src.SQL
    + """, f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, count(*) AS n, min(ts) AS first FROM s GROUP BY user_id, k"""
)
def t8_sessions(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return found.select("user_id", "n", F.col("first").cast("timestamp_ntz").alias("first"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def a11_distinct_counts(spark, sf_dir):
    return _t(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query(fold_sql.SENTENCES)
def w7_sentences(spark, sf_dir):
    return st.sentences(src.words(spark, sf_dir), ["plan_id"], 12_000.0, ("purchase",))


@query(fold_sql.ATTACK_RELEASE)
def w17_attack_release(spark, sf_dir):
    return rounded(st.attack_release(src.series(spark, sf_dir), ["plan_id"], 0.6, 0.1), "level", digits=6)


@query(fold_sql.FOLLOWED)
def w22_followed(spark, sf_dir):
    return rounded(st.followed(src.series(spark, sf_dir), ["plan_id"], 20.0, 0.5), "followed", digits=6)


@query(fold_sql.SECTIONS)
def w27_sections(spark, sf_dir):
    return st.sections(src.series(spark, sf_dir), ["plan_id"])


@query(fold_sql.SPACED)
def w35_spaced(spark, sf_dir):
    rows = src.series(spark, sf_dir).withColumn("minus", -F.col("value"))
    return st.spaced(rows, ["plan_id"], ["minus", "idx"], 5)


@query(fold_sql.SEGMENTED)
def w37_segmented(spark, sf_dir):
    return st.segmented(src.words(spark, sf_dir), ["plan_id"], 6, 32, 22, ("view",))


@query(fold_sql.PACKED)
def w40_packed_rows(spark, sf_dir):
    return st.packed_rows(src.cuts(spark, sf_dir), ["plan_id"])


@query(fold_sql.MATCHED)
def j16_matched_words(spark, sf_dir):
    """The title of a plan is what the next plan says."""
    words = src.words(spark, sf_dir)
    title = src.words(spark, sf_dir).select((F.col("plan_id") - 1).alias("plan_id"), "word_i", "text").join(words.select("plan_id").distinct(), "plan_id", "left_semi")
    title = title.toDF("plan_id", "word_i", "text")
    return rounded(st.matched_words(title, words.select("plan_id", "word_i", "text", "start"), ["plan_id"]), "start")
