"""Jobs, tasks and events as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyframe.operators.jobs import LIVE_SHARE, TERMINAL, TTL_SECONDS

STATE = "job_id long, status string, progress double, error_message string, updates long"


def job_states(events: DataFrame) -> DataFrame:
    """States of jobs as events(job_id, seq, status, progress, error_message) arrive, in update mode; terminal states are final."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress, error, seen = state.get if state.exists else ("pending", 0.0, None, 0)
        for row in pd.concat(batches).sort_values("seq").itertuples():
            if status in TERMINAL:
                break
            status = row.status if isinstance(row.status, str) else status
            progress = float(row.progress) if row.progress == row.progress and row.progress is not None else progress
            error = row.error_message if isinstance(row.error_message, str) else error
            seen += 1
        state.update((status, progress, error, seen))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "error_message": [error], "updates": [seen]})

    return events.groupBy("job_id").applyInPandasWithState(update, STATE, "status string, progress double, error_message string, updates long", "update", GroupStateTimeout.NoTimeout)


def live_tasks(tasks: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Latest status of tasks(task_id, status, created_at, updated_at); a state goes when event time is `ttl` seconds past its creation.

    It is shown as evicted then, and so is a task that is heard of for the first time after its end, which leaves no state.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "status": ["evicted"]})
            return
        rows = pd.concat(batches)
        created = int(rows["created_at"].min().timestamp() * 1000)
        if state.exists:
            created = min(created, state.get[0])
        status = rows.sort_values("updated_at")["status"].iloc[-1]
        if created + ttl * 1000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            status = "evicted"
        else:
            state.update((created, status))
            state.setTimeoutTimestamp(created + ttl * 1000)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status]})

    marked = tasks.withWatermark("updated_at", "0 seconds")
    return marked.groupBy("task_id").applyInPandasWithState(update, "task_id long, status string", "created long, status string", "update", GroupStateTimeout.EventTimeTimeout)


PROGRESS = "pid long, title string, total long, current long, completed_batches long, completed_chapters long, errors long"


def worker_progress(events: DataFrame) -> DataFrame:
    """States of workers as events(pid, seq, event, title, total, batches) arrive, in update mode; see progress_by_worker()."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        title, total, current, made, chapters, errors = state.get if state.exists else (None, None, 0, 0, 0, 0)
        for row in pd.concat(batches).sort_values("seq").itertuples():
            if row.event == "START":
                title, total, current = row.title, int(row.total), 0
            elif row.event == "UPDATE":
                made += int(row.batches)
                current += int(row.batches) if title is not None else 0
            elif row.event == "DONE":
                title, total, current, chapters = None, None, 0, chapters + 1
            elif row.event == "ERROR":
                errors += 1
        state.update((title, total, current, made, chapters, errors))
        yield pd.DataFrame([(key[0], title, total, current, made, chapters, errors)], columns=[c.split()[0] for c in PROGRESS.split(", ")]).astype({"total": "Int64"})

    return events.groupBy("pid").applyInPandasWithState(update, PROGRESS, PROGRESS.split(", ", 1)[1], "update", GroupStateTimeout.NoTimeout)


def chapter_rates(progress: DataFrame) -> DataFrame:
    """Characters a second of each job, live and blended with the mean of finished chapters."""
    sums = progress.groupBy("job_id").agg(F.sum("chars").alias("chars"), F.sum("seconds").alias("seconds"), F.avg(F.when(F.col("finished"), F.col("chars") / F.col("seconds"))).alias("mean"))
    live = F.col("chars") / F.col("seconds")
    return sums.select("job_id", F.when((F.col("seconds") < 1) | (F.col("chars") == 0), 0.0).when(F.col("mean").isNull(), live).otherwise(LIVE_SHARE * live + (1 - LIVE_SHARE) * F.col("mean")).alias("rate"))


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) in tumbling windows of event time."""
    rows = _watermarked(events, late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events with less than `gap` between them."""
    rows = _watermarked(events, late)
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
