"""Views that give the tables of a dataset the shapes the operators work on.

One user's events are one plan; its clock starts with its first event and counts seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clocked(events: DataFrame) -> DataFrame:
    """plan_id, event_id, start, text, value and props of each event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min("us").over(Window.partitionBy("user_id"))
    return events.withColumn("us", us).select(
        F.col("user_id").alias("plan_id"), "event_id", ((F.col("us") - first) / 1_000_000).alias("start"), F.col("event_type").alias("text"), "value", "props"
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id and duration: to its last event and an hour on."""
    return clocked(table(spark, sf_dir, "events")).groupBy("plan_id").agg((F.max("start") + 3600).alias("duration"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, id, start, end and enabled: an error removes a stretch whose length its value gives."""
    rows = clocked(table(spark, sf_dir, "events")).where("text = 'error'")
    return rows.select("plan_id", F.col("event_id").alias("id"), "start", (F.col("start") + F.col("value") * 1000).alias("end"), (F.col("event_id") % 2 == 0).alias("enabled"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, word_i, text, start and end: each event is a word."""
    rows = clocked(table(spark, sf_dir, "events"))
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("start", "event_id"))
    return rows.select("plan_id", (place - 1).alias("word_i"), "text", "start", (F.col("start") + F.col("value") * 100).alias("end"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, idx, start and value: each event is a sample."""
    rows = clocked(table(spark, sf_dir, "events"))
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("start", "event_id"))
    return rows.select("plan_id", (place - 1).alias("idx"), "start", "value")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, state, created, customer and total: each order is a job."""
    rows = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), state.alias("state"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total"))


#: The same views in DuckDB, to put before a query.
SQL = """
WITH clocked AS (
  SELECT user_id AS plan_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS start,
         event_type AS text, value, props FROM events),
plans AS (SELECT plan_id, max(start) + 3600 AS duration FROM clocked GROUP BY 1),
cuts AS (SELECT plan_id, event_id AS id, start, start + value * 1000 AS "end", event_id % 2 = 0 AS enabled FROM clocked WHERE text = 'error'),
words AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY start, event_id) - 1 AS word_i, text, start, start + value * 100 AS "end" FROM clocked),
series AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY start, event_id) - 1 AS idx, start, value FROM clocked),
jobs AS (SELECT o_orderkey AS id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS state,
         o_orderdate AS created, o_custkey AS customer, o_totalprice AS total FROM orders)
"""
