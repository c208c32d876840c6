"""Streams over job events: latest progress, the runner's state machine, expiry of finished tasks, windows over event time.

The transition is a plain function, so that a batch over the log and the stream
give the same; state is keyed by job and expires, so that it does not grow with
all jobs ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

RETRIES = 2
FINAL = ("completed", "failed")


def transition(status: str, retries: int, pages: int, event: str, value: int = 0) -> tuple[str, int, int]:
    """The state after an event: start, progress, success, error. Final states stay. After an error a job is retried twice; then it is completed if any page was done, else failed."""
    if status in FINAL:
        return status, retries, pages
    if event == "start":
        return "processing", retries, pages
    if event == "progress":
        return "processing", retries, max(pages, value)
    if event == "success":
        return "completed", retries, max(pages, value)
    if event == "error":
        if retries < RETRIES:
            return "retrying", retries + 1, pages
        return ("completed" if pages > 0 else "failed"), retries, pages
    return status, retries, pages


def fold(events: list[tuple[str, int]]) -> tuple[str, int, int]:
    s = ("queued", 0, 0)
    for e, v in events:
        s = transition(*s, e, v)
    return s


def run_states(events: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """(job_id, status, retries, pages): the state of each job after each batch of its events, in order of ts; state is dropped a day after the last event. events: job_id, ts, event, value; streaming."""
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for e, v in zip(rows["event"], rows["value"], strict=True):
            s = transition(*s, e, int(v) if pd.notna(v) else 0)
        state.update(s)
        state.setTimeoutDuration(ms)
        yield pd.DataFrame([(key[0], *s)], columns=["job_id", "status", "retries", "pages"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, retries int, pages int", "status string, retries int, pages int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest_progress(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last event of each job of a batch in a table; what is there ends when all files are read. A batch that is run again writes the same folder again."""

    def write(df: DataFrame, epoch: int) -> None:
        df.groupBy("job_id").agg(F.max_by(F.struct("event", "value", "ts"), "ts").alias("e")).select("job_id", "e.*").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n): events in windows of their own time, with a limit for late ones. An extension: there is no event time in job processing itself."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def expired(tasks: DataFrame, now: str, seconds: int = 120) -> DataFrame:
    """(job_id): finished tasks that ended more than so many seconds before now; what they hold is dropped, what describes them stays."""
    return tasks.where(F.col("status").isin(*FINAL) & (F.col("completed_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))).select("job_id")


def expire(events: DataFrame, ttl: str = "120 seconds") -> DataFrame:
    """(job_id): finished tasks as their time runs out, by a timer of each task's own: what they hold may go. An event of a task that has not finished stops its timer. events: job_id, ts, status; streaming."""
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0],)], columns=["job_id"])
            return
        last = pd.concat(list(batches)).sort_values("ts")["status"].iloc[-1]
        if last in FINAL:
            state.update((last,))
            state.setTimeoutDuration(ms)
        elif state.exists:
            state.remove()

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string", "status string", "update", GroupStateTimeout.ProcessingTimeTimeout)
