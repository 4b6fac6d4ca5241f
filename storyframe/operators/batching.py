"""Sequential packing as folds over a chapter's paragraphs: batches, chunks, scene groups, excerpts; and timelines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyframe.functions.text import SPACE, is_scene_break, paragraph_words, sentences, word_count

FIRST_BATCH, NEXT_BATCH = 250, 800
CHUNK_WORDS, OVERLAP_WORDS = 700, 100
SCENE_PAUSE_MS, PAUSE_GROWTH = 4000, 0.7
EXCERPT_WORDS, BUCKETS = 4000, 5
_NO_STRINGS = "array<string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def batches(paragraphs: Column, most: Column | int, merge_short: bool = True) -> Column:
    """Paragraphs packed into texts of at most `most` characters.

    Short paragraphs are joined by blanks while they fit (or stand alone); a longer one is cut after sentences, its pieces are
    never joined with another paragraph, and a sentence that is too long stays whole. Blank paragraphs are skipped.
    """
    most = F.lit(most) if isinstance(most, int) else most

    def items(p: Column, i: Column) -> Column:
        long = F.length(p) > most
        return F.transform(F.when(long, sentences(p)).otherwise(F.array(p)), lambda s: F.struct(s.alias("text"), F.when(long | (not merge_short), i).otherwise(-1).alias("own")))

    flat = F.flatten(F.transform(F.filter(paragraphs, lambda p: F.trim(p) != ""), items))

    def add(acc: Column, item: Column) -> Column:
        fits = (acc["own"] == item["own"]) & acc["cur"].isNotNull() & (F.length(acc["cur"]) + 1 + F.length(item["text"]) <= most)
        return F.struct(
            F.when(fits | acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))).alias("out"),
            F.when(fits, F.concat_ws(" ", acc["cur"], item["text"])).otherwise(item["text"]).alias("cur"),
            item["own"].alias("own"),
        )

    start = F.struct(F.array().cast(_NO_STRINGS).alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(-1).alias("own"))
    return F.aggregate(flat, start, add, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


def batch_limit(is_first: Column) -> Column:
    """The first chapter of a book gets small batches, so that sound starts soon."""
    return F.when(is_first, FIRST_BATCH).otherwise(NEXT_BATCH)


def chunk_bounds(counts: Column, target: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """array<struct<begin,end>>: [begin, end) of overlapping chunks of paragraphs with these word counts.

    A chunk ends with the paragraph that brings it to `target` words. The next begins so far back that it repeats `overlap` words, but at
    least one paragraph on. Each begin depends on the chunk before; sums make a step a binary search.
    """

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def bounds(columns: pd.Series) -> pd.Series:
        out = []
        for c in columns:
            n = 0 if c is None else len(c)
            sums = np.concatenate([[0], np.cumsum(c)]) if n else np.zeros(1, np.int64)
            begin, found = 0, []
            while begin < n:
                end = min(n, max(begin + 1, int(np.searchsorted(sums, sums[begin] + target))))
                found.append({"begin": begin, "end": end})
                if end >= n:
                    break
                back = int(np.searchsorted(sums, sums[end] - overlap, side="right")) - 1
                begin = max(begin + 1, min(back, end - 1))
            out.append(found)
        return pd.Series(out)

    return bounds(counts)


def chunks(chapters: DataFrame, target: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Of chapters(book_id, chapter_idx, paragraphs): chunk_idx, first_para, last_para, words, text."""
    rows = chapters.withColumn("counts", F.transform("paragraphs", word_count))
    rows = rows.select("book_id", "chapter_idx", "paragraphs", "counts", F.posexplode(chunk_bounds(F.col("counts"), target, overlap)).alias("chunk_idx", "b"))
    part = lambda c: F.slice(c, F.col("b.begin") + 1, F.col("b.end") - F.col("b.begin"))
    return rows.select(
        "book_id", "chapter_idx", "chunk_idx", F.col("b.begin").alias("first_para"), (F.col("b.end") - 1).alias("last_para"),
        F.aggregate(part("counts"), F.lit(0), lambda a, b: a + b).alias("words"), F.array_join(part("paragraphs"), "\n\n").alias("text"),
    )


def chunk_quotes(chunked: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes in each chunk that has their paragraph; the join is on the chapter and the exploded paragraphs."""
    each = chunked.select("book_id", "chapter_idx", "chunk_idx", F.explode(F.sequence("first_para", "last_para")).alias("para_idx"))
    return each.join(quotes, ["book_id", "chapter_idx", "para_idx"])


def scene_groups(paragraphs: Column) -> Column:
    """Paragraphs between scene breaks; one empty group if there are none."""
    n = F.size(paragraphs)
    places = F.filter(F.transform(paragraphs, lambda p, i: F.when(is_scene_break(p), i)), lambda i: i.isNotNull())

    def cut(ends: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda k: F.slice(paragraphs, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))

    groups = _let(F.concat(F.array(F.lit(-1)), places, F.array(n)), cut)
    full = F.filter(groups, lambda g: F.size(g) > 0)
    return F.when(F.size(full) > 0, full).otherwise(F.array(F.array().cast(_NO_STRINGS)))


def pause_ms(breaks: Column, base: int = SCENE_PAUSE_MS) -> Column:
    """Half the base for a scene break without blank lines, else growing with the logarithm of their number."""
    return F.when(breaks <= 0, F.floor(F.lit(base) / 2)).otherwise(F.floor(base * (1 + PAUSE_GROWTH * F.ln(breaks)))).cast("long")


def frames_after_eos(text: Column, override: Column | None = None) -> Column:
    default = F.greatest(F.lit(3), F.floor(F.length(text) / 150))
    return (F.coalesce(override, default) if override is not None else default).cast("long")


def timeline(durations: DataFrame) -> DataFrame:
    """start_ms and end_ms of durations(book_id, chapter_idx, duration_ms): sums of what comes before within the book."""
    order = Window.partitionBy("book_id").orderBy("chapter_idx")
    start = F.coalesce(F.sum("duration_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return durations.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


# What stands between paragraphs, and between the parts of an excerpt.
BLANK_LINE, CUT = "\n\n", "\n\n[...]\n\n"


def excerpt(paragraphs: Column, target: int = EXCERPT_WORDS, buckets: int = BUCKETS) -> Column:
    """The first paragraphs of each of `buckets` parts of equal number, each up to a share of `target` words; the whole text if it is short.

    Blank paragraphs do not count, and those that the division leaves over belong to no part.
    """
    share = max(1, target // buckets)

    def head(part: Column) -> Column:
        # a paragraph stays while those before it fall short of the share
        def add(acc: Column, p: Column) -> Column:
            short = acc["words"] < share
            return F.struct((acc["words"] + F.when(short, word_count(p)).otherwise(0)).alias("words"), (acc["n"] + F.when(short, 1).otherwise(0)).alias("n"))

        n = F.aggregate(part, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), add, lambda acc: acc["n"])
        return F.array_join(F.slice(part, F.lit(1), n), BLANK_LINE)

    def sampled(full: Column) -> Column:
        size = F.greatest(F.lit(1), F.floor(F.size(full) / buckets).cast("int"))
        parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.slice(full, i * size + 1, size)), lambda part: F.size(part) > 0)
        return F.array_join(F.transform(parts, head), CUT)

    full = F.filter(paragraphs, lambda p: ~p.rlike(f"{SPACE}*$".replace("(?U)", "(?U)^")))
    return F.when(paragraph_words(paragraphs) <= target, F.array_join(paragraphs, BLANK_LINE)).otherwise(_let(full, sampled))


def batch_info(chapters: DataFrame) -> DataFrame:
    """Of chapters(book_id, chapter_idx, paragraphs, most): number and characters of the batches, keyed by index as titles repeat."""
    made = chapters.withColumn("b", batches(F.col("paragraphs"), F.col("most")))
    return made.select("book_id", "chapter_idx", F.size("b").cast("long").alias("batches"), F.aggregate("b", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("chars"))


def segment_info(segments: DataFrame) -> DataFrame:
    """Of a chapter's segments: each but scene breaks is one batch."""
    spoken = ~F.col("is_scene_break")
    return segments.groupBy("book_id", "chapter_idx").agg(F.count_if(spoken).alias("batches"), F.coalesce(F.sum(F.when(spoken, F.length("text"))), F.lit(0)).cast("long").alias("chars"))


def reassemble(rendered: DataFrame) -> DataFrame:
    """Chapters (book_id, chapter_idx, parts, duration_ms) of rendered(book_id, chapter_idx, seg_idx, part, duration_ms), their parts in the order of segments."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "part")))
    return rendered.groupBy("book_id", "chapter_idx").agg(F.transform(ordered, lambda p: p["part"]).alias("parts"), F.sum("duration_ms").cast("long").alias("duration_ms"))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(samples))


def gain_db(level: Column, target_db: float = -20.0, silence: float = 1e-8, most: float = 24.0) -> Column:
    """What brings a level to the target, within +-24 dB; silence gets none."""
    wanted = 20 * F.log10(F.lit(10.0 ** (target_db / 20)) / level)
    return F.when(level < silence, 0.0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), wanted)))
