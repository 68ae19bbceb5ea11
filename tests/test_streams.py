"""Streams over several small batches."""

from pyspark.sql import functions as F

from chronoloom.plans.source_queries import _all_of
from chronoloom.streaming import jobs as stream


def source(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_states_across_batches(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, 1, "create"), (1, 2, "claim")], [(1, 3, "create"), (1, 4, "finish")]], "id long, seq long, event string")
    got = {r.seq: (r.state, r.accepted) for r in _all_of(stream.moved(s), spark, "append").collect()}
    assert got == {1: ("queued", True), 2: ("running", True), 3: ("running", False), 4: ("done", True)}


def test_stale_tokens(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, 1, 5, 0.5)], [(1, 2, 4, 0.6), (1, 3, 6, 0.7)]], "id long, seq long, token long, value double")
    assert sorted(r.seq for r in _all_of(stream.fresh(s), spark, "append").collect()) == [1, 3]


def test_windows_and_repeats(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:01", 1.0), ("a", 1, "2024-01-01 00:00:02", 2.0), ("b", 2, "2024-01-01 01:00:00", 3.0)]
    s = source(spark, tmp_path, [rows], "event_type string, user_id long, t string, value double").withColumn("ts", F.to_timestamp("t"))
    assert {(r.event_type, r.n, r.total) for r in _all_of(stream.windowed(s, "10 minutes", "5 minutes"), spark, "complete").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
    assert {(r.user_id, r.n) for r in _all_of(stream.sessions(s, "5 minutes"), spark, "complete").collect()} == {(1, 2), (2, 1)}
    assert _all_of(stream.once(s, ["event_type"]), spark, "append").count() == 2
    last = stream.limited(s.select(F.col("user_id").alias("id"), "ts", "value"), "1 minute")
    assert {(r.id, r.value) for r in _all_of(last, spark, "complete").collect()} == {(1, 2.0), (2, 3.0)}
