"""Job events as a stream: states, stale writers, progress, rates and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state a job goes to from a state, by event; any other event is refused.
MOVES = {
    ("", "create"): "queued", ("queued", "claim"): "running", ("running", "review"): "review", ("running", "finish"): "done", ("review", "requeue"): "queued",
    ("queued", "cancel"): "canceled", ("running", "cancel"): "canceled", ("running", "fail"): "error", ("error", "requeue"): "queued", ("canceled", "requeue"): "queued",
}
MOVED = "id long, seq long, event string, state string, accepted boolean"


def moved(events: DataFrame) -> DataFrame:
    """id, seq, event, the state after it and whether it was accepted, for each event (id, seq, event) of a stream, in order of seq within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, event in zip(rows["seq"], rows["event"], strict=True):
            after = MOVES.get((now, event))
            now = after or now
            out.append((key[0], seq, event, now, after is not None))
        state.update((now,))
        yield pd.DataFrame(out, columns=["id", "seq", "event", "state", "accepted"])

    return events.groupBy("id").applyInPandasWithState(step, MOVED, "state string", "append", GroupStateTimeout.NoTimeout)


def fresh(updates: DataFrame) -> DataFrame:
    """The updates (id, token, value) of a stream whose token is not older than any their id has had: stale writers are refused."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        keep = []
        for token in rows["token"]:
            keep.append(token >= newest)
            newest = max(newest, int(token))
        state.update((newest,))
        yield rows[keep][["id", "seq", "token", "value"]]

    return updates.groupBy("id").applyInPandasWithState(step, "id long, seq long, token long, value double", "newest long", "append", GroupStateTimeout.NoTimeout)


def progress(updates: DataFrame) -> DataFrame:
    """id and the largest pct so far: a bar that never falls."""
    return updates.groupBy("id").agg(F.max("pct").alias("pct"))


def limited(updates: DataFrame, every: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last value of each id in each short window (ts, id, value): at most so many writes a second."""
    w = updates.withWatermark("ts", late).groupBy("id", F.window("ts", every).alias("w"))
    return w.agg(F.max_by("value", "ts").alias("value")).select("id", F.col("w.start").alias("since"), "value")


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by event_type in windows of event time; what comes later than the watermark is dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("since"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: since, until and n."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def once(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: a task of the same content starts once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
