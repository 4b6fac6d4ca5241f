"""Dialogue and italics in paragraphs, and the segments that attributed quotes make of a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyframe.functions.text import ETX, STX, is_scene_break

QUOTE = '(?s)["“].+?["”]'
ITALIC = f"(?s){STX}.+?{ETX}"
NARRATOR, UNKNOWN, SCENE_BREAK = "NARRATOR", "Unknown", "SCENE_BREAK"
CHAPTER = ("book_id", "chapter_idx")


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start,end,kind,match>> of all matches: places follow from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        match = F.get(found, i)
        end = start + F.length(match)
        hit = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>").alias("hits"))
    order = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: i < F.size(found))
    return F.aggregate(order, empty, add, lambda acc: acc["hits"])


def quote_spans(text: Column) -> Column:
    """Quotes and italics in order; of two that overlap, the later start is dropped."""
    both = F.array_sort(F.concat(matches(text, QUOTE, "dialogue"), matches(text, ITALIC, "italic")))

    def keep(acc: Column, m: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        return F.when(m["start"] >= last, F.concat(acc, F.array(m))).otherwise(acc)

    return F.aggregate(both, F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>"), keep)


def spoken(span: Column) -> Column:
    """What a span says: dialogue with its marks, italics without."""
    return F.when(span["kind"] == "italic", F.substring(span["match"], F.lit(2), F.length(span["match"]) - 2)).otherwise(span["match"])


def extract_quotes(paragraphs: DataFrame) -> DataFrame:
    """Of paragraphs(book_id, chapter_idx, para_idx, text): quote_id within the chapter, para_idx, char_offset, kind, text.

    char_offset counts in the chapter's paragraphs joined by blank lines. Chapters are the unit of order, so a window never
    spans more than one.
    """
    order = Window.partitionBy(*CHAPTER).orderBy("para_idx")
    before = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = paragraphs.withColumn("before", before).select(*CHAPTER, "para_idx", "before", F.posexplode(quote_spans(F.col("text"))).alias("n", "span"))
    number = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("para_idx", "n")) - 1
    return spans.select(
        *CHAPTER, number.alias("quote_id"), "para_idx", (F.col("before") + F.col("span.start")).alias("char_offset"), F.col("span.kind").alias("kind"), spoken(F.col("span")).alias("text")
    )


def paragraph_spans(paragraphs: DataFrame, quotes: DataFrame, attributions: DataFrame) -> DataFrame:
    """Every paragraph as (para_idx, span_idx, speaker, text, is_break, whole); joined, spans give the paragraph without its marks.

    whole: the paragraph itself, in its first span. Paragraphs without an attributed quote are one narrator span. Where a text is quoted twice in a paragraph, the first
    attribution holds for both.
    """
    said = quotes.join(attributions.select(*CHAPTER, "quote_id", "speaker"), [*CHAPTER, "quote_id"])
    said = said.groupBy(*CHAPTER, "para_idx").agg(F.array_sort(F.collect_list(F.struct("quote_id", "text", "speaker"))).alias("said"))
    rows = paragraphs.join(said, [*CHAPTER, "para_idx"], "left")
    spans, text = quote_spans(F.col("text")), F.col("text")

    def piece(speaker: Column, words: Column) -> Column:
        return F.struct(speaker.alias("speaker"), words.alias("text"))

    def cut(m: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["end"])
        words = spoken(m)
        who = F.filter(F.col("said"), lambda s: s["text"] == words)
        return F.array(
            piece(F.lit(NARRATOR), F.substring(text, begin + 1, m["start"] - begin)),
            piece(F.coalesce(F.try_element_at(who, F.lit(1))["speaker"], F.lit(NARRATOR)), words),
        )

    rows = rows.withColumn("spans", spans)
    last = F.coalesce(F.try_element_at(F.col("spans"), F.lit(-1))["end"], F.lit(0))
    tail = piece(F.lit(NARRATOR), F.substring(text, last + 1, F.length(text)))
    pieces = F.filter(F.concat(F.flatten(F.transform("spans", cut)), F.array(tail)), lambda p: p["text"] != "")
    whole = F.array(piece(F.lit(NARRATOR), text))
    rows = rows.withColumn("is_break", is_scene_break(text))
    rows = rows.withColumn(
        "pieces", F.when(F.col("is_break"), F.array(piece(F.lit(SCENE_BREAK), F.lit("")))).when(F.col("said").isNull() | (F.size(pieces) == 0), whole).otherwise(pieces)
    )
    rows = rows.select(*CHAPTER, "para_idx", "is_break", F.col("text").alias("paragraph"), F.posexplode("pieces").alias("span_idx", "p"))
    return rows.select(*CHAPTER, "para_idx", "span_idx", "is_break", "p.speaker", "p.text", F.when(F.col("span_idx") == 0, F.col("paragraph")).alias("whole"))


def build_segments(paragraphs: DataFrame, quotes: DataFrame, attributions: DataFrame) -> DataFrame:
    """Segments (book_id, chapter_idx, seg_idx, speaker, is_scene_break, text) of chapters.

    Neighbouring spans of a speaker are one segment, joined by a blank line for the narrator and by a blank for others; scene breaks stay
    alone. A chapter without quotes is one narrator segment, its scene breaks included.
    """
    spans = paragraph_spans(paragraphs, quotes, attributions)
    quoted = quotes.select(*CHAPTER).distinct().withColumn("quoted", F.lit(True))
    spans = spans.join(quoted, list(CHAPTER), "left")
    plain = spans.filter("quoted is null and span_idx = 0").groupBy(*CHAPTER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "whole"))), lambda s: s["whole"]), "\n\n").alias("text"))
    plain = plain.select(*CHAPTER, F.lit(0).alias("seg_idx"), F.lit(NARRATOR).alias("speaker"), F.lit(False).alias("is_scene_break"), "text")
    order = Window.partitionBy(*CHAPTER).orderBy("para_idx", "span_idx")
    new = (F.lag("speaker").over(order).isNull()) | (F.lag("speaker").over(order) != F.col("speaker")) | F.col("is_break")
    spans = spans.filter("quoted").withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    merged = spans.groupBy(*CHAPTER, F.col("island").cast("int").alias("seg_idx"), "speaker", F.col("is_break").alias("is_scene_break")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "span_idx", "text"))), lambda s: s["text"]).alias("texts")
    )
    text = F.when(F.col("speaker") == NARRATOR, F.array_join("texts", "\n\n")).otherwise(F.array_join("texts", " "))
    return merged.select(*CHAPTER, "seg_idx", "speaker", "is_scene_break", text.alias("text")).unionByName(plain)
