"""Jobs and tasks from their events, in batch form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
TTL_SECONDS = 3600
LIVE_SHARE = 0.6


def latest_state(events: DataFrame) -> DataFrame:
    """Of events(job_id, seq, status, progress, error_message): the last state of each job.

    The first terminal state is final: events after it do not count. Processing keeps its latest progress.
    """
    end = events.filter(F.col("status").isin(*TERMINAL)).groupBy("job_id").agg(F.min("seq").alias("end"))
    live = events.join(end, "job_id", "left").filter(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    return live.groupBy("job_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), F.col("seq"))).alias("progress"),
        F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("seq"))).alias("error_message"),
        F.min("seq").alias("first_seq"),
    )


def recover(jobs: DataFrame) -> DataFrame:
    """On start, jobs left in processing wait again."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def removable(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status <> 'processing'")


def with_status(jobs: DataFrame, *statuses: str) -> DataFrame:
    """Jobs in one of the states, in the order in which they came."""
    return jobs.filter(F.col("status").isin(*statuses)).orderBy("first_seq")


def without_status(jobs: DataFrame, *statuses: str) -> DataFrame:
    return jobs.filter(~F.col("status").isin(*statuses)) if statuses else jobs


def status_counts(jobs: DataFrame) -> DataFrame:
    """One row with the number of jobs in each state."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The pending job that came first."""
    return jobs.filter("status = 'pending'").agg(F.min_by("job_id", "first_seq").alias("job_id"))


def rate(elapsed_s: Column, done_chars: Column, chapter_rates: Column) -> Column:
    """Characters a second: live, or 0.6 live and 0.4 of the mean over finished chapters; 0 in the first second and before any character."""
    live = done_chars / elapsed_s
    mean = F.aggregate(chapter_rates, F.lit(0.0), lambda a, b: a + b) / F.size(chapter_rates)
    return F.when((elapsed_s < 1) | (done_chars == 0), 0.0).when(F.size(chapter_rates) > 0, LIVE_SHARE * live + (1 - LIVE_SHARE) * mean).otherwise(live)


def eta_seconds(total_chars: Column, done_chars: Column, per_second: Column) -> Column:
    return F.when(per_second > 0, F.greatest(F.lit(0), F.floor((total_chars - done_chars) / per_second)))


def evict(tasks: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Tasks(created_at) younger than the TTL; age counts from creation, whatever the status."""
    return tasks.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") < ttl)


def recent_lines(log: DataFrame, most: int = 20) -> DataFrame:
    """The last lines of each job's log(job_id, seq, line)."""
    last = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return log.withColumn("age", last).filter(F.col("age") <= most).drop("age")


def resolve_overrides(jobs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """A null setting of a job is inherited."""
    for name, value in defaults.items():
        jobs = jobs.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return jobs


def output_label(voice: Column, is_multi: Column) -> Column:
    """multi-voice, or the voice's name: of a path or address the last part without its extension."""
    stem = F.regexp_extract(F.regexp_replace(voice, r"/+$", ""), r"([^/]*)$", 1)
    stem = F.when(stem.rlike(r"^.+\.[^.]+$"), F.regexp_extract(stem, r"^(.+)\.[^.]+$", 1)).otherwise(stem)
    return F.when(is_multi, "multi-voice").when(voice.rlike(r"[/\\\\]"), stem).otherwise(voice)


def output_stem(title: Column, label: Column) -> Column:
    return F.concat(F.trim(F.translate(title, '\\/*?:"<>|', "")), F.lit(" ["), label, F.lit("]"))


def unique_names(outputs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """File names of outputs(job_id, title, label): `title [label].m4b`; a name that is taken goes on with _1, _2 and so on.

    Outputs take names in the order of job_id, after existing(file_name). All names of a stem are numbered by windows: the k-th output gets the
    k-th number that is free, the first being the name without one.
    """
    rows = outputs.withColumn("stem", output_stem(F.col("title"), F.col("label")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("job_id")))
    if existing is None:
        rows = rows.withColumn("n", F.col("k") - 1)
    else:
        stem, number = F.regexp_extract("file_name", r"^(.*?)(?:_(\d+))?\.m4b$", 1), F.regexp_extract("file_name", r"^.*?(?:_(\d+))?\.m4b$", 1)
        taken = existing.filter(F.col("file_name").endswith(".m4b")).select(stem.alias("stem"), F.when(number == "", 0).otherwise(number.cast("long")).alias("n")).distinct()
        # the k-th free number is k - 1 and the taken ones up to it: those with n - (taken before) < k
        before = F.row_number().over(Window.partitionBy("stem").orderBy("n")) - 1
        taken = taken.withColumn("free", F.col("n") - before).groupBy("stem").agg(F.array_sort(F.collect_list("free")).alias("free"))
        rows = rows.join(taken, "stem", "left").withColumn("n", F.col("k") - 1 + F.coalesce(F.size(F.filter("free", lambda f: f < F.col("k"))), F.lit(0)))
    return rows.select("job_id", F.concat("stem", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".m4b")).alias("file_name"))


def next_free_name(path: str, exists) -> str:
    """The path itself, or its stem with the next number that does not exist; a number it ends with goes on."""
    if not exists(path):
        return path
    folder, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if stem else (name, "")
    m = re.match(r"^(.+)_(\d+)$", stem)
    stem, n = (m[1], int(m[2]) + 1) if m else (stem, 1)
    while exists(found := f"{folder + '/' if folder else ''}{stem}_{n}{suffix}"):
        n += 1
    return found


def progress_by_worker(events: DataFrame) -> DataFrame:
    """State of workers after events(pid, seq, event, title, total, batches, chars, message) of START, UPDATE, DONE, ERROR, LOG.

    A worker's chapter is that of its last START; current sums its UPDATEs. After DONE the worker is idle: title and total are null.
    """
    last = events.filter(F.col("event") == "START").groupBy("pid").agg(F.max("seq").alias("began"))
    rows = events.join(last, "pid", "left")
    mine = F.col("began").isNotNull() & (F.col("seq") >= F.col("began"))
    out = rows.groupBy("pid").agg(
        F.max_by("title", F.when(mine & (F.col("event") == "START"), F.col("seq"))).alias("title"),
        F.max_by("total", F.when(mine & (F.col("event") == "START"), F.col("seq"))).alias("total"),
        F.coalesce(F.sum(F.when(mine & (F.col("event") == "UPDATE"), F.col("batches"))), F.lit(0)).cast("long").alias("current"),
        F.coalesce(F.max(mine & (F.col("event") == "DONE")), F.lit(False)).alias("idle"),
        F.coalesce(F.sum(F.when(F.col("event") == "UPDATE", F.col("batches"))), F.lit(0)).cast("long").alias("completed_batches"),
        F.count_if(F.col("event") == "DONE").alias("completed_chapters"),
        F.count_if(F.col("event") == "ERROR").alias("errors"),
    )
    off = F.col("idle") | F.col("title").isNull()
    return out.select(
        "pid", *[F.when(~F.col("idle"), F.col(c)).alias(c) for c in ("title", "total")], F.when(off, 0).otherwise(F.col("current")).cast("long").alias("current"),
        "completed_batches", "completed_chapters", "errors",
    )


def audio_totals(results: DataFrame) -> DataFrame:
    """Sums over results(book_id, duration_ms, batches, chars)."""
    return results.groupBy("book_id").agg(*[F.sum(c).cast("long").alias(f"total_{c}") for c in ("duration_ms", "batches", "chars")])
