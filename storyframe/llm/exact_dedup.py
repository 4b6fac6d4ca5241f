"""Exact dedup by skew-safe combining.

A first scan hashes every normalised text and writes (doc_id, digest); all results are rows of that table, so the order in which the
input is read has no influence. Only texts whose digest occurs more than once can have an equal one. Those are combined in three stages:

1. Local: every Arrow batch, then every partition, keeps one row for each text.
2. Salted: the winners of partitions meet within one of `salts` groups of a digest.
3. Global: the salt winners of a digest meet.

Texts are normalised by lower-casing A-Z only. Each stage compares whole contents, so two texts that share a digest stay apart: their
digest then has several variants, and rows are joined to those by their whole content. A hot text has one winner for each partition and
`salts` winners in the last stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyframe.llm.common import batch, binary, dropped, matched, written

Digest = Callable[[bytes], bytes]
_IDS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
_WINNERS = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("local_id", pa.int64()), ("n", pa.int64())])
_CHUNK = 10_000


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _low(x: int | None) -> tuple:
    return (x is not None, x or 0)


def _digests(digest: Digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(_IDS, doc_id=rows["doc_id"], digest=[digest(t.lower()) for t in binary(rows["text"])])

    return run


def _marks(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), ">u8").astype(np.uint64)


def _winners(digest: Digest, shared):
    """The groups of a batch: digest, content, largest doc_id, rows. Texts whose digest bears no mark of a repeated one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for rows in batches:
            texts = [t.lower() for t in binary(rows["text"])]
            digests = [digest(t) for t in texts]
            at = range(len(texts))
            if marks is not None:
                mine = _marks(digests)
                at = np.flatnonzero(marks[np.minimum(np.searchsorted(marks, mine), len(marks) - 1)] == mine).tolist() if len(marks) else []
            ids = rows["doc_id"].to_pylist()
            groups: dict[tuple[bytes, bytes], list] = {}
            for i in at:
                group = groups.setdefault((digests[i], texts[i]), [ids[i], 0])
                group[0] = max(group[0], ids[i], key=_low)
                group[1] += 1
            yield batch(_WINNERS, digest=[k[0] for k in groups], content=[k[1] for k in groups], local_id=[g[0] for g in groups.values()], n=[g[1] for g in groups.values()])

    return run


class Groups(NamedTuple):
    """ids: (doc_id, digest) of all rows. texts: (digest, keep_id, group_size, variants, content) of repeated digests, with the
    content only where a digest has several variants. tops: (digest, keep_id, n_top) of texts whose keep_id stands in several rows.
    """

    ids: DataFrame
    texts: DataFrame
    tops: DataFrame
    clash: bool
    twice: bool


def _combine(source: DataFrame, salts: int, digest: Digest, most_marks: int) -> Groups:
    ids = written(source.mapInArrow(_digests(digest), "doc_id long, digest binary"), "digests")
    repeated = written(ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-digests")
    marks = None  # too many to be sent: every text goes through the stages
    if repeated.count() <= most_marks:
        marks = np.sort(_marks([bytes(r[0]) for r in repeated.select("digest").toLocalIterator()]))
    shared = source.sparkSession.sparkContext.broadcast(marks)
    winners = source.mapInArrow(_winners(digest, shared), "digest binary, content binary, local_id long, n long")
    local = winners.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "content").agg(F.max("local_id").alias("salt_id"), F.sum("n").alias("n"))
    # dealt by digest alone, so that the variants of a digest meet
    texts = salted.repartition("digest").groupBy("digest", "content").agg(F.max("salt_id").alias("keep_id"), F.sum("n").alias("group_size"))
    texts = texts.withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy("digest"))).withColumn("content", F.when(F.col("variants") > 1, F.col("content")))
    texts = written(texts.filter("group_size > 1 or variants > 1"), "repeated-texts")
    clash = not texts.filter("variants > 1").isEmpty()
    again = matched(ids, "digest", repeated, "n").filter("n is not null").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n_top")).filter("n_top > 1")
    again = written(again.withColumnRenamed("digest", "d"), "repeated-rows")
    twice = not again.isEmpty()
    dropped(repeated)
    return Groups(ids, texts, again, clash, twice)


def _labelled(rows: DataFrame, groups: Groups) -> DataFrame:
    """rows(digest, content if there are clashes, ...) with keep_id and group_size, null for the only text of its digest."""
    one = groups.texts.filter("variants = 1").select("digest", "keep_id", "group_size")
    if not groups.clash:
        return matched(rows, "digest", one, "group_size")
    many = groups.texts.filter("variants > 1").select(F.col("digest").alias("_d"), F.col("content").alias("_c"), "keep_id", "group_size")
    apart = many.select("_d").distinct()
    plain = matched(rows.join(apart, F.col("digest") == F.col("_d"), "left_anti"), "digest", one, "group_size")
    return plain.unionByName(rows.join(many, (F.col("digest") == F.col("_d")) & (F.col("content") == F.col("_c"))).drop("_d", "_c"))


def _with_content(source: DataFrame, digest: Digest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t.lower() for t in binary(rows["text"])]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(map(digest, texts), pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "digest", "content"])

    return source.mapInArrow(run, "doc_id long, digest binary, content binary")


def exact_dedup(docs: DataFrame, salts: int = 16, digest: Digest = sha256, most_marks: int = 1 << 22) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 (the digest in hex).

    Null texts count as empty, and empty texts are equal to each other. Every row counts as a document. Of rows with
    equal text the largest doc_id stays (a null doc_id is below all others); of rows that repeat both doc_id and text
    exactly one is kept. A text of any length is one value. Other columns are ignored; an empty table gives no rows. The first eight
    bytes of at most `most_marks` repeated digests are broadcast; of more, all texts are compared.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = _combine(source, salts, digest, most_marks)
    known = _labelled(_with_content(source, digest) if groups.clash else groups.ids, groups)
    text = ["digest", "content"] if groups.clash else ["digest"]
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = known.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | stays).alias("kept"), *text,
    )
    if groups.twice:
        # rows that are alike in doc_id and text are told apart by nothing: they are counted and dealt out anew
        alike = out.filter("kept and group_size > 1").groupBy("doc_id", "keep_id", "group_size", *text).agg(F.count(F.lit(1)).alias("n"))
        chunks = alike.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK))))
        chunks = chunks.repartition(*text, "chunk").withColumn("no", F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least((F.col("chunk") + 1) * _CHUNK, F.col("n")) - 1)))
        out = out.filter("not kept or group_size = 1").unionByName(chunks.select("doc_id", "keep_id", "group_size", (F.col("no") == 0).alias("kept"), *text))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, salts: int = 16, digest: Digest = sha256, most_marks: int = 1 << 22) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that exact_dedup() keeps. All columns pass unchanged, whatever their names.

    Nulls, empty and long texts as there. Of rows that repeat both doc_id and text any one stays; an empty table gives no rows. Texts without an
    equal one are not shuffled.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = _combine(source, salts, digest, most_marks)
    dropped(groups.ids)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"))
    at, clash = docs.columns.index("text"), groups.clash
    more = [T.StructField("digest", T.BinaryType()), *([T.StructField("content", T.BinaryType())] if clash else [])]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.lower() for t in binary(b.column(0).field(at))]
            columns = [b.column(0), b.column(1), pa.array(map(digest, texts), pa.binary()), *([pa.array(texts, pa.binary())] if clash else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *(f.name for f in more)])

    known = _labelled(rows.mapInArrow(digests, T.StructType([*rows.schema.fields, *more])), groups)
    kept = known.filter(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if groups.twice:
        # few doc_ids stand in several rows with one text: only those are shuffled, one row of each partition
        same = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        alike = groups.tops.select("d", F.col("doc_id").alias("_id"))
        key = ["digest", "doc_id", *(["content"] if clash else [])]
        kept = kept.join(alike, same, "left_anti").unionByName(kept.join(alike, same, "left_semi").dropDuplicates(key))
    return kept.select("row.*")
