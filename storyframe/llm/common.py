"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python operator holds at once.
SLICE_BYTES = 4 << 20


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LIVE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset on one machine (tests), a temporary one; on a cluster an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="storyframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _remove(spark: SparkSession, path: str) -> None:
    if path in _LIVE:
        _LIVE.remove(path)
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again. It goes when it is dropped(), at the latest when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LIVE.append(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() made and nothing reads any more."""
    for t in tables:
        if path := _PATHS.get(t):
            _remove(t.sparkSession, path)


def live() -> int:
    """A mark for dropped_since()."""
    return len(_LIVE)


def dropped_since(mark: int, kept: DataFrame) -> None:
    """Removes the tables that written() made since the mark, all but one."""
    for path in _LIVE[mark:]:
        if path != _PATHS.get(kept):
            _remove(kept.sparkSession, path)


def matched(left: DataFrame, key: str, right: DataFrame, n: str, most: int = 1 << 19) -> DataFrame:
    """left with the columns of right, null where it has no row with the key.

    right is a written table of one row a key, with the number n of rows in left that have it. Up to `most` rows are broadcast. Of a larger
    table only keys with a thousandth of these rows are, of which there are a thousand at most; all other rows are shuffled.
    """
    right = right.withColumnRenamed(key, "_key")
    same = F.col(key) == F.col("_key")
    rows, total = right.agg(F.count(F.lit(1)), F.sum(n)).first()
    if rows <= most:
        return left.join(F.broadcast(right), same, "left").drop("_key")
    hot = F.col(n) >= max(1000, (total or 0) // 1000)
    near = left.join(F.broadcast(right.filter(hot)), same)
    far = left.join(F.broadcast(right.filter(hot).select("_key")), same, "left_anti").join(right.filter(~hot), same, "left")
    return near.unionByName(far).drop("_key")


_TRAINED: dict[tuple[str, bytes], object] = {}


def trained(kind: str, sample: list, train: Callable[[list], object]) -> object:
    """train(sample), or what it gave for the same sample before: training has fixed seeds. The last four models are kept."""
    key = (kind, hashlib.sha256(repr(sample).encode("utf-8", "surrogatepass")).digest())
    if key not in _TRAINED:
        while len(_TRAINED) >= 4:
            del _TRAINED[next(iter(_TRAINED))]
        _TRAINED[key] = train(sample)
    return _TRAINED[key]


def key_of(doc_id: Column | str) -> Column:
    """doc_id as text; the empty text for null."""
    return F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def remainder_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def binary(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `most` bytes together; a longer text stands alone."""
    begin, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(np.asarray(starts, np.int64), lengths)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
