"""A corpus pipeline: each stage works on what the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyframe.llm.common import documents, dropped_since, live, written
from storyframe.llm.decontaminate import drop_contaminated
from storyframe.llm.exact_dedup import keep_distinct
from storyframe.llm.language_id import keep_known_language
from storyframe.llm.mixing import mix
from storyframe.llm.simhash import keep_one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null and empty ones among them, or of no language that the model is at all sure of, go."""
    return keep_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays; of rows that repeat doc_id and text, one."""
    return keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, with five-word shingles of a Jaccard similarity of 0.8 or more, the smallest doc_id stays."""
    return keep_one_of_each(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; null and empty texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot in the mix, to be read by (slot, start_char, doc_id); null sources are one source."""
    return mix(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontamination", decontamination), ("mixing", mixing)]

#: Training a network has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mark = live()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped_since(mark, docs)  # what the stages before it wrote
    return STAGES[-1][1](spark, docs, sf_dir)
