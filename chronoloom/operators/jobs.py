"""A table of jobs: revisions, claims, retention, queue places and recovery, as folds over events and as plain projections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def content_hash(*columns: str | Column) -> Column:
    """SHA-1 of the columns as JSON in the order given."""
    return F.sha1(F.to_json(F.struct(*columns)))


def revisions(events: DataFrame, by: list[str], order: list[str], content: Column) -> DataFrame:
    """events with rev: it rises where the content differs from that of the event before; an event without content keeps what there is."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("_c", F.last(content, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = (~F.lag("_c").over(w).eqNullSafe(F.col("_c"))) & F.col("_c").isNotNull()
    return rows.withColumn("_new", changed.cast("int")).withColumn("rev", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c", "_new")


def claims(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Compare-and-set on a revision: an event is accepted if its expected revision is the current one, which then rises by one.

    events with accepted and rev after it. What is accepted depends on all before, so a job's events are walked through in order; a task sorts the events of its jobs (spilling) and
    streams through all of them, batch by batch: no call for each job, and no job is held.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.asc_nulls_last(c) for c in order))).alias("_n")
    at = events.columns.index("expected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rev = 0
        for batch in batches:
            accepted, revs = [], []
            for place, expected in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist(), strict=True):
                rev = 0 if place == 1 else rev
                ok = expected == rev
                rev += ok
                accepted.append(ok)
                revs.append(rev)
            columns = [*batch.columns[:-1], pa.array(accepted, pa.bool_()), pa.array(revs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "accepted", "rev"])

    schema = f"{', '.join(f'`{c}` {t}' for c, t in events.dtypes)}, accepted boolean, rev long"
    return events.select("*", n).mapInArrow(run, schema)


def latest(updates: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last update of each key whose token is the key's newest one; updates by stale writers don't count."""
    w = Window.partitionBy(*by)
    current = updates.withColumn("_tok", F.max("token").over(w)).where("token = _tok")
    return current.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_tok", "_n")


def expired(jobs: DataFrame, keep: int, id: str = "id", created: str = "created") -> DataFrame:
    """Jobs that aren't active nor among the newest keep. The newest come from a top-k in each task, not from a sort of all."""
    newest = jobs.orderBy(F.desc(created), F.desc(id)).limit(keep).select(id)
    return jobs.where(~F.col("state").isin(*ACTIVE)).join(newest, id, "left_anti")


def queue_places(jobs: DataFrame, created: str = "created") -> DataFrame:
    """Queued jobs with place: how many queued ones were created no later. Counts of days come first, so that no task sorts the whole queue."""
    queued = jobs.where("state = 'queued'").withColumn("_day", F.to_date(created))
    days = queued.groupBy("_day").agg(F.count("*").alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a day
    within = Window.partitionBy("_day").orderBy(created)
    return queued.withColumn("_own", F.count("*").over(within)).join(before, "_day").withColumn("place", F.col("_before") + F.col("_own")).drop("_day", "_own", "_before")


def recovered(jobs: DataFrame, has_plan: Column) -> DataFrame:
    """jobs with next, the state after a crash: what ran goes back to review if it has a plan, else into the queue; the rest stays."""
    return jobs.withColumn("next", F.when((F.col("state") == "running") & has_plan, "review").when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def changed_since(jobs: DataFrame, revision: str, last: int | Column) -> DataFrame:
    """The rows whose revision is newer than the last one read."""
    return jobs.where(F.col(revision) > last)


def within_budget(files: DataFrame, by: list[str], order: list, size: str, most: float) -> DataFrame:
    """files with held: whether it is among the newest whose sizes add up to at most most."""
    total = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("held", total <= most)


def numbered_slugs(rows: DataFrame, slug: str, order: list) -> DataFrame:
    """rows with unique: slug for the first of equal ones, slug-2, slug-3 and so on for the others."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("unique", F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("_n").cast("string")))).drop("_n")
