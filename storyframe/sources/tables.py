"""Stored results: summaries, rosters, manifests as Parquet tables, written a book (or series) at a time; imports of JSON."""

from __future__ import annotations

import tomllib
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyframe.functions.text import to_json_without_nulls
from storyframe.operators.jobs import recover


def put(df: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of the keys in df, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def get(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key) == value)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def get_all(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows, or None if nothing is stored."""
    return spark.read.parquet(path) if exists(spark, path) else None


def put_json(df: DataFrame, path: str, key: str) -> None:
    """Results as JSON texts without nulls, a partition for each key."""
    rows = df.select(F.col(key).alias("_key"), to_json_without_nulls(df).alias("value"))
    rows.withColumnRenamed("_key", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def save_queue(jobs: DataFrame, path: str) -> None:
    """Jobs(job_id, ...) as one table of states: written beside it, then put in its place, so a reader finds the old or the new one."""
    spark = jobs.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    jobs.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{path} could not be replaced")


def load_queue(spark: SparkSession, path: str, legacy: str | None = None, schema: str = "job_id long, first_seq long, status string") -> DataFrame:
    """Stored jobs, those in processing waiting again. Without a table, the records of a legacy JSON file are taken over once; without either, no jobs."""
    if not exists(spark, path) and legacy and exists(spark, legacy):
        save_queue(read_json(spark, legacy, schema), path)
        evict_path(spark, legacy)
    return recover(spark.read.parquet(path)) if exists(spark, path) else spark.createDataFrame([], schema)


def evict_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def evict(spark: SparkSession, path: str, key: str, values: list[str]) -> None:
    """Removes the partitions of these keys."""
    for v in values:
        evict_path(spark, f"{path}/{key}={v}")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lenient import: unknown fields are ignored, missing ones null, broken records give no row."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("_broken", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken is null").drop("_broken")


def write_chapter_metadata(timeline: DataFrame, path: str) -> None:
    """FFMETADATA chapters of timeline(book_id, chapter_idx, title, start_ms, end_ms), a text file set for each book."""
    block = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), "start_ms"), F.concat(F.lit("END="), "end_ms"), F.concat(F.lit("title="), "title"))
    rows = timeline.withColumn("value", block).repartition("book_id").sortWithinPartitions("book_id", "chapter_idx")
    rows.select("book_id", "value").write.mode("overwrite").partitionBy("book_id").text(path)


def resolve_config(spec: str | None, folder: str, default: str = "default-config.toml") -> Path:
    """Where a configuration lies: the default for None, an existing file itself, a bare name in the folder, else the path as it is."""
    if spec is None:
        return Path(folder) / default
    at = Path(spec)
    if at.is_file():
        return at.resolve()
    return Path(folder) / f"{spec}.toml" if "/" not in spec else at.resolve()


def load_config(spec: str | None, folder: str, defaults: dict) -> dict:
    """The settings of a file over the defaults; a missing or broken file leaves the defaults."""
    try:
        found = tomllib.loads(resolve_config(spec, folder).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        found = {}
    return {**defaults, **{k: v for k, v in found.items() if v is not None}}
