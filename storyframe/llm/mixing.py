"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Every source's documents, in the order of md5(doc_id), are cut into blocks of `block_chars` characters. Weights are
integers a of a hyperperiod P = sum of all a, so weight = a / P. Block j of a source is released at slot floor(j * P / a) and due at
slot ceil((j + 1) * P / a). Each slot goes to the released block with the earliest deadline. As weights sum to one, all
deadlines are met: after every slot each source has had its share of blocks, give or take less than one block.
The schedule repeats every P slots, so only one hyperperiod is computed (by heaps on the driver, in time and memory of P and the sources); block j takes the slot of
block j mod a in hyperperiod j div a.

Without given weights that is so for any number of sources, each of which gets one of about 1000 slots or more, as the SQL of op8 says. If given
weights are less than a quantum (or 0) for a source they stay exact, whatever the input's size, and no
hyperperiod is made: block j of a source stands at slot floor((j + u) / w), with a phase u in [0, 1) from md5 of the source. Up to any slot
each source has had its weight times the slots in blocks, give or take one block; several blocks may share a slot. Sources
of weight 0 follow after all others.

Blocks need running sums within a source, and one source can hold most rows. Sums are taken by (source, leading hex digits of
md5), then over those buckets, so no task sees a whole source.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CHARS, QUANTA, ALPHA = 20_000, 1000, 0.5


def _hyperperiod(a: list[int]) -> list[list[int]]:
    """The slots of a hyperperiod that each source has, in time of the slots. Of equal deadlines the first source's comes first."""
    period, done, slots = sum(a), [0] * len(a), [[] for _ in a]
    released, ready = [(0, i) for i in range(len(a))], []
    for slot in range(period):
        while released and released[0][0] <= slot:
            i = heapq.heappop(released)[1]
            heapq.heappush(ready, (((done[i] + 1) * period + a[i] - 1) // a[i], i))
        i = heapq.heappop(ready)[1]
        slots[i].append(slot)
        done[i] += 1
        heapq.heappush(released, (done[i] * period // a[i], i))
    return slots


def schedule(totals: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, quanta: int = QUANTA, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For totals(key, chars): key, a, period, slots (those of a hyperperiod that the source has), horizon.

    key is '=' and the source, or '' for null sources. Without weights a source gets chars^alpha; a source that weights
    leave out gets weight 0. horizon: the first slot whose block is missing since its source has run out. If weights stay exact: key,
    weight, phase, from_slot (where sources of weight 0 begin), horizon.
    """
    if weights is None:
        raw = F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(alpha))
    else:
        if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError("weights must be at least 0 and not all 0")
        raw = F.coalesce(F.create_map([F.lit(x) for k, w in weights.items() for x in (f"={k}", float(w))])[F.col("key")], F.lit(0.0))
    each = totals.select("key", "chars", raw.alias("raw"))
    n, total, least = each.agg(F.count(F.lit(1)), F.sum("raw"), F.min("raw")).first()
    if weights is not None and n and (not total or least * quanta / total < 1):
        return _exact(each, total, block_chars)
    grid = each.select("key", "chars", F.greatest(F.lit(1), F.round(F.col("raw") * quanta / F.lit(total))).cast("long").alias("a")).orderBy("key").toArrow()
    a, chars = grid["a"].to_pylist(), grid["chars"].to_pylist()
    period, slots = sum(a), _hyperperiod(a)
    blocks = [max(1, -(-n // block_chars)) for n in chars]
    horizon = min(((n // x) * period + s[n % x] for n, x, s in zip(blocks, a, slots)), default=0)
    same = lambda x: pa.array([x] * len(a), pa.int64())
    return totals.sparkSession.createDataFrame(pa.table({"key": grid["key"], "a": pa.array(a, pa.int64()), "period": same(period), "slots": pa.array(slots, pa.list_(pa.int64())), "horizon": same(horizon)}))


def _exact(each: DataFrame, total: float, block_chars: int) -> DataFrame:
    """schedule() by exact weights, for each(key, chars, raw)."""
    if not total:  # no source has a weight: all have the same
        each, total = each.withColumn("raw", F.lit(1.0)), each.count()
    phase = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    rows = each.select("key", (F.col("raw") / total).alias("weight"), phase.alias("phase"), F.greatest(F.lit(1), F.ceil(F.col("chars") / block_chars)).cast("long").alias("blocks"))
    weighted = rows.filter("weight > 0").select(_exact_slot(F.col("blocks"), F.lit(0)).alias("out"))
    ends = weighted.agg(F.min("out").alias("horizon"), (F.max("out") + 1).alias("from_slot"))
    return rows.crossJoin(F.broadcast(ends)).select("key", "weight", "phase", F.when(F.col("weight") > 0, 0).otherwise(F.col("from_slot")).cast("long").alias("from_slot"), "horizon")


def _exact_slot(block: Column, from_slot: Column) -> Column:
    return from_slot + F.floor((block + F.col("phase")) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)).cast("long")


def _slot(block: Column, a: Column, period: Column, slots: Column) -> Column:
    return F.floor(block / a) * period + F.element_at(slots, (F.pmod(block, a) + 1).cast("int"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, quanta: int = QUANTA, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, source, text, n_chars, block, slot, start_char,
    in_target.

    Reading the rows by (slot, start_char, doc_id) interleaves the sources by their weights. start_char is where the document
    begins in its source's characters. A document takes the block in which it begins; one longer than a block leaves the next blocks
    of its source to itself. in_target: the slot comes before the first missing block, so the prefix of these rows has the
    target weights; later rows go on in the same grid without the sources that have run out. No row is dropped or
    repeated. Null sources are a source of their own; null texts have no characters; repeated rows stand side by side.
    Other columns are ignored; an empty table gives no rows.
    """
    digits = min(8, max(1, math.ceil(math.log(max(docs.count(), 1) / 2000, 16))))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    base = base.select(
        "*",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, digits))
    sums = base.groupBy("key", "bucket").agg(F.sum("n_chars").alias("chars"))
    before = sums.select(
        F.col("key").alias("k"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("chars").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    plan = schedule(sums.groupBy("key").agg(F.sum("chars").alias("chars")), weights, alpha, quanta, block_chars).withColumnRenamed("key", "p")
    within = F.sum("n_chars").over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1))
    at = base.withColumn("within_bucket", F.coalesce(within, F.lit(0)))
    exact = "weight" in plan.columns
    before = before.join(plan, F.col("k") == F.col("p"))  # any number of sources: met by the sums, of which a large source has many
    at = at.join(before, (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b"))).withColumn("start_char", F.col("before") + F.col("within_bucket"))
    at = at.withColumn("block", F.floor(F.col("start_char") / block_chars))
    at = at.withColumn("slot", _exact_slot(F.col("block"), F.col("from_slot")) if exact else _slot(F.col("block"), F.col("a"), F.col("period"), F.col("slots")))
    return at.select("doc_id", "source", "text", "n_chars", "block", "slot", "start_char", (F.col("slot") < F.col("horizon")).alias("in_target"))
