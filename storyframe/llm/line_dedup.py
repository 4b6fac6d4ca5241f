"""Line dedup with two Bloom filters.

A first pass hashes the key of every long enough line into a once-seen filter; a bit that a second document hits is
also set in a twice-seen filter. Map tasks send bit positions, so what moves is a few bytes for each line. The merged
twice-seen filter has a fixed size and is broadcast. Only lines whose bits are all set twice are shuffled, by their full
key, for exact confirmation and the choice of the document that keeps the line.

The filter has `bits_per_row` bits for each row, at most `most_bits` (256 MB). A fuller filter suspects more lines and so
shuffles more; results do not depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import batch, binary, written

MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 32
_SHARD_BITS = 1 << 20
_SKETCH = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_MERGED = pa.schema([("shard", pa.int32()), ("twice", pa.binary())])
_PAIRS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
_OUT_DDL = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: bytes, least: int) -> list[bytes]:
    """The distinct keys of a text's lines that are long enough."""
    return [k for k in {x.strip().lower() for x in text.split(b"\n") if len(x) >= least} if _long_enough(k, least)]


def _positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bit positions of each key."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _sketch(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = [k for t in binary(rows["text"]) for k in _keys(t, least)]
            at, n = np.unique(_positions(keys, bits).ravel(), return_counts=True)
            shard = at // _SHARD_BITS
            within = (at % _SHARD_BITS).astype("<u4")
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = [*cuts[1:], len(at)]
            yield batch(
                _SKETCH,
                shard=[int(shard[a]) for a in cuts],
                once=[within[a:b].tobytes() for a, b in zip(cuts, ends)],
                twice=[within[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts, ends)],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row by row into two bitmaps for each shard, whatever the number of rows."""
    maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for rows in batches:
        for shard, once, twice in zip(*(rows[c].to_pylist() for c in ("shard", "once", "twice"))):
            if shard not in maps:
                maps[shard] = (np.zeros(_SHARD_BITS, bool), np.zeros(_SHARD_BITS, bool))
            seen, again = maps[shard]
            at = np.frombuffer(once, "<u4")
            again[at[seen[at]]] = True
            seen[at] = True
            again[np.frombuffer(twice, "<u4")] = True
    for shard, (_, again) in maps.items():
        yield batch(_MERGED, shard=[shard], twice=[np.packbits(again, bitorder="little").tobytes()])


def _suspects(keys: list[bytes], filled: np.ndarray, bits: int) -> np.ndarray:
    at = _positions(keys, bits)
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _suspected(rows: pa.RecordBatch, shared, bits: int, least: int) -> list[list[bytes]]:
    """The suspected keys of every row."""
    filled = np.frombuffer(shared.value, np.uint8)
    each = [_keys(t, least) for t in binary(rows["text"])]
    found: list[list[bytes]] = [[] for _ in each]
    if flat := [k for keys in each for k in keys]:
        owner = np.repeat(np.arange(len(each)), [len(k) for k in each])
        for i in np.flatnonzero(_suspects(flat, filled, bits)):
            found[owner[i]].append(flat[i])
    return found


def _result(doc_ids: list, texts: list[bytes], drops: list[set[bytes]]) -> pa.RecordBatch:
    kept, lines, dropped = [], [], []
    for text, drop in zip(texts, drops):
        parts = text.split(b"\n")
        stay = [x for x in parts if x.strip().lower() not in drop] if drop else parts
        kept.append(b"\n".join(stay) if drop else text)
        lines.append(len(parts))
        dropped.append(len(parts) - len(stay))
    return batch(_OUT, doc_id=doc_ids, text=pa.array(kept, pa.binary()).cast(pa.string()), n_lines=lines, n_dropped=dropped, kept_sha256=[hashlib.sha256(k).hexdigest() for k in kept])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits_per_row: int = 128, most_bits: int = 1 << 31) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, text (what is kept), n_lines, n_dropped, kept_sha256.

    Lines are split at \\n; a null or empty text is one empty line. A key is the line without ASCII white space at both
    ends, A-Z in lower case. A document is a doc_id: rows that share one are one document, and so are those with a null doc_id,
    which is below all others. Keys of at least `min_chars` code points in at least `min_docs` documents lose all their lines
    but those in the largest doc_id that holds them, in all of its rows. If all lines go, the text is empty. Lines and texts
    may have any length. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = min(most_bits, max(_SHARD_BITS, 1 << (max(1, bits_per_row * source.count()) - 1).bit_length()))
    shards = bits // _SHARD_BITS
    sketch = source.select("text").mapInArrow(_sketch(bits, min_chars), "shard int, once binary, twice binary")
    merged = sketch.repartition(min(shards, 200), "shard").mapInArrow(_merge, "shard int, twice binary").collect()  # `bits` bits at most
    filled = bytearray(bits // 8)
    for shard, twice in merged:
        filled[shard * _SHARD_BITS // 8 : (shard + 1) * _SHARD_BITS // 8] = twice
    shared = spark.sparkContext.broadcast(bytes(filled))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = _suspected(rows, shared, bits, min_chars)
            ids = rows["doc_id"].to_pylist()
            yield batch(_PAIRS, key=[k for keys in found for k in keys], doc_id=[i for i, keys in zip(ids, found) for _ in keys])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = _suspected(rows, shared, bits, min_chars)
            rows = rows.filter(pa.array([not k for k in found]))
            yield _result(rows["doc_id"].to_pylist(), binary(rows["text"]), [set()] * len(rows))

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = _suspected(rows, shared, bits, min_chars)
            rows = rows.filter(pa.array([bool(k) for k in found]))
            yield batch(_TEXTS, doc_id=rows["doc_id"], text=rows["text"].cast(pa.binary()))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield _result(rows["doc_id"].to_pylist(), binary(rows["text"]), [set(k or ()) for k in rows["keys"].to_pylist()])

    # each document once; this deals the holders of a hot line, too
    held = written(source.mapInArrow(pairs, "key binary, doc_id long").distinct(), "suspected-lines")
    sure = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    sure = written(sure, "repeated-lines")
    # at most a thousand keys can have a thousandth of the lines: those are marked by a broadcast and dealt by salts
    hot = max(1000, (sure.agg(F.sum("n")).first()[0] or 0) // 1000)
    marks = F.broadcast(sure.filter(F.col("n") >= hot).select(F.col("key").alias("hot_key")))
    held = held.join(marks, F.col("key") == F.col("hot_key"), "left").withColumn("salt", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    sure = sure.select(F.col("key").alias("k"), "last", F.explode(F.when(F.col("n") >= hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("s"))
    lost = held.join(sure, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s"))).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    lists = lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("doc_id", "d")
    texts = source.mapInArrow(doubtful, "doc_id long, text binary")
    joined = texts.join(lists, texts["doc_id"].eqNullSafe(lists["d"]), "left").select("doc_id", "text", "keys")
    return source.mapInArrow(clean, _OUT_DDL).unionByName(joined.mapInArrow(drop, _OUT_DDL))
