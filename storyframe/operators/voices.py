"""Voices and casting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyframe.functions.text import pronoun_gender, split_hf_url

NARRATOR = "NARRATOR"
SOURCES = ("compiled", "builtin", "packaged", "user")


def parse_voice_name(stem: Column) -> Column:
    """Name-Gender-Dataset-Speaker-Accent; the accent keeps its hyphens, missing parts are null."""
    p = F.split(stem, "-", 5)
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.struct(
        at(1).alias("name"), F.when(at(2) == "M", "Male").when(at(2) == "F", "Female").alias("gender"), at(3).alias("dataset"), at(4).alias("speaker_id"), at(5).alias("accent")
    )


def plain_voice_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def union_sources(*tables: DataFrame) -> DataFrame:
    """Voices of several sources, ordered by source, then by file name: voice_ord is unique within a source."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("source_ord", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def filter_voices(voices: DataFrame, **criteria: str | None) -> DataFrame:
    """Equal in any case in all given columns; a null criterion is ignored, a null value is ''."""
    for column, value in criteria.items():
        if value is not None:
            voices = voices.filter(F.lower(F.coalesce(F.col(column), F.lit(""))) == value.lower())
    return voices


def resolve_voice(wanted: DataFrame, voices: DataFrame) -> DataFrame:
    """The first voice (by voice_ord) whose name is wanted(query), in any case and without the last extension; null if none."""
    key = F.regexp_replace(F.lower("query"), r"\.[^.]*$", "")
    first = voices.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "voice_ord").alias("voice"))
    return wanted.withColumn("key", key).join(first, "key", "left").select("query", "voice")


DEFAULT_VOICE = "alba"


def voice_kind(identifier: Column) -> Column:
    """How an identifier is loaded: hub, path, registry name, and so which need a login."""
    return F.when(identifier.startswith("hf://"), "hub").when(identifier.rlike(r"[/\\]|\.(wav|safetensors)$"), "path").otherwise("registry")


def needs_auth(identifier: Column) -> Column:
    return voice_kind(identifier).isin("hub", "path")


def load_voices(wanted: DataFrame, voices: DataFrame, files: DataFrame, downloads: DataFrame, default: str = DEFAULT_VOICE) -> DataFrame:
    """What wanted(identifier) stands for: (identifier, kind, voice).

    An hf:// address gives the file of downloads(user, repo, path, file), else the default; then a path of files(path) itself; then a name of
    voices(name, voice_ord, file_path), in any case and without its extension: its file, or its name if it has none; else the identifier.
    """
    hub = split_hf_url(F.col("identifier"))
    rows = wanted.select("identifier").distinct().withColumn("h", hub)
    got = downloads.select(F.struct("user", "repo", "path").alias("h"), F.col("file").alias("downloaded"))
    rows = rows.join(got, "h", "left").join(files.select(F.col("path").alias("identifier"), F.lit(True).alias("is_file")).distinct(), "identifier", "left")
    known = voices.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.coalesce("file_path", "name"), "voice_ord").alias("named"))
    rows = rows.withColumn("key", F.regexp_replace(F.lower("identifier"), r"\.[^.]*$", "")).join(known, "key", "left")
    is_hub = F.col("identifier").startswith("hf://")
    kind = F.when(is_hub & F.col("downloaded").isNotNull(), "hub").when(is_hub, "default").when(F.col("is_file"), "path").when(F.col("named").isNotNull(), "registry").otherwise("raw")
    voice = F.when(is_hub, F.coalesce("downloaded", F.lit(default))).when(F.col("is_file"), F.col("identifier")).otherwise(F.coalesce("named", "identifier"))
    return rows.select("identifier", kind.alias("kind"), voice.alias("voice"))


def ordered_voices(voices: DataFrame) -> DataFrame:
    """`place` within a source: by file name, bundled ones by name."""
    return voices.withColumn("place", F.row_number().over(Window.partitionBy("source_ord").orderBy(F.coalesce("file_path", "name"), "name")))


def exclude_voice(excluded: Column, name: str) -> Column:
    """A list of excluded voices with one more, unless it is there."""
    return F.when(F.array_contains(excluded, name), excluded).otherwise(F.array_append(excluded, name))


def include_voice(excluded: Column, name: str) -> Column:
    return F.array_remove(excluded, name)


def chapter_voice(overrides: Column, chapter_idx: Column, voice: Column) -> Column:
    """A chapter's own voice, by its number as text, else the book's."""
    return F.coalesce(F.nullif(F.try_element_at(overrides, chapter_idx.cast("string")), F.lit("")), voice)


def speaker_voice(cast: Column, speaker: Column, narrator: Column, default: str = DEFAULT_VOICE) -> Column:
    """A speaker's voice in a map of the cast, else the narrator's, else the default; an empty voice is none."""
    return F.coalesce(F.nullif(F.try_element_at(cast, speaker), F.lit("")), F.nullif(narrator, F.lit("")), F.lit(default))


def list_voices(voices: DataFrame, excluded: DataFrame) -> DataFrame:
    marks = excluded.select("name").distinct().withColumn("excluded", F.lit(True))
    return voices.join(marks, "name", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def pool_exhausted(listed: DataFrame) -> DataFrame:
    """Of each gender, whether all of its voices are excluded."""
    return listed.filter("gender is not null").groupBy("gender").agg(F.min(F.col("excluded").cast("int")).cast("boolean").alias("exhausted"))


def pools(voices: DataFrame, narrator: str, excluded: list[str] = ()) -> DataFrame:
    """One row (male, female): voice names in order, without excluded ones and the narrator's unless none were left."""

    def names(gender: str) -> Column:
        every = F.transform(F.array_sort(F.collect_list(F.when(F.lower("gender") == gender, F.struct("voice_ord", "name")))), lambda v: v["name"])
        left = F.filter(every, lambda v: ~v.isin(*excluded)) if excluded else every
        left = F.when(F.size(left) > 0, left).otherwise(every)
        other = F.filter(left, lambda v: v != narrator)
        return F.when(F.size(other) > 0, other).otherwise(left)

    return voices.agg(names("male").alias("male"), names("female").alias("female"))


def suggest_cast(characters: DataFrame, voice_pools: DataFrame, default_voice: str) -> DataFrame:
    """Voices in turn, by prominence within a book of characters(book_id, character_id, pronoun, prominence, ord).

    The k-th male gets male voice k modulo the pool, females likewise; others take from the pool whose characters have
    had less prominence so far (male on ties), and add to it. An empty pool gives the other one to others, else the default.
    One fold over the ordered characters of a book, in an Arrow stage: arrays that grow by a character at each step take time of their square.
    Once a prominence is null, others count as the female pool's.
    """
    ordered = characters.withColumn("gender", pronoun_gender(F.col("pronoun")))
    books = ordered.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("prominence")).alias("low"), "ord", "character_id", "gender", F.col("prominence").cast("long").alias("prominence")))).alias("cast"))
    books = books.select("book_id", F.col("cast.character_id").alias("ids"), F.col("cast.gender").alias("genders"), F.col("cast.prominence").alias("prominences"))
    books = books.crossJoin(F.broadcast(voice_pools.select("male", "female")))  # a single row
    kinds = dict(characters.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                book, ids, genders, prominences, male, female = (rows[c].slice(i, 1) for c in ("book_id", "ids", "genders", "prominences", "male", "female"))
                voices = _in_turn(genders.flatten().to_pylist(), prominences.flatten().to_pylist(), male[0].as_py() or [], female[0].as_py() or [], default_voice)
                yield pa.RecordBatch.from_arrays([book.take(pa.array([0] * len(voices), pa.int64())), ids.flatten(), pa.array(voices, pa.string())], names=["book_id", "character_id", "voice"])

    return books.mapInArrow(run, f"book_id {kinds['book_id']}, character_id {kinds['character_id']}, voice string")


def _in_turn(genders: list[str], prominences: list[int | None], male: list[str], female: list[str], default_voice: str) -> list[str]:
    """The fold of one book."""
    m = f = 0
    mq: int | None = 0
    fq: int | None = 0
    out = []
    for gender, prominence in zip(genders, prominences):
        other = gender not in ("male", "female")
        # None: not known, as nulls are compared
        as_male = (None if mq is None or fq is None else mq <= fq) if other else gender == "male"
        take_male = (bool(male) if as_male else not female) if other else as_male
        if take_male and male:
            out.append(male[m % len(male)])
            m += 1
        elif not take_male and female:
            out.append(female[f % len(female)])
            f += 1
        else:
            out.append(default_voice)
        if as_male:
            mq = None if mq is None or prominence is None else mq + prominence
        elif as_male is not None:
            fq = None if fq is None or prominence is None else fq + prominence
    return out


def simple_cast(characters: DataFrame, male: str, female: str, narrator: str) -> DataFrame:
    """One voice for each gender; all others speak with the narrator's."""
    g = pronoun_gender(F.col("pronoun"))
    return characters.select("book_id", "character_id", F.when(g == "male", male).when(g == "female", female).otherwise(narrator).alias("voice"))


def dominant_voice(characters: DataFrame, voices: DataFrame, default_voice: str, excluded: list[str] = ()) -> DataFrame:
    """By the most prominent character with a gender: the first voice of it that is not excluded; else the first male voice, else the default."""
    voices = voices.filter(~F.col("name").isin(*excluded)) if excluded else voices
    g = pronoun_gender(F.col("pronoun"))
    top = characters.groupBy("book_id").agg(F.min_by(g, F.when(g != "they", F.struct(-F.col("prominence"), "ord"))).alias("gender"), F.max(F.when(g != "they", F.col("prominence"))).alias("most"))
    first = voices.agg(F.min_by("name", F.when(F.lower("gender") == "male", F.col("voice_ord"))).alias("m"), F.min_by("name", F.when(F.lower("gender") == "female", F.col("voice_ord"))).alias("f"))
    rows = top.crossJoin(F.broadcast(first))  # a single row
    return rows.select("book_id", F.when((F.col("gender") == "female") & (F.col("most") > 0) & F.col("f").isNotNull(), F.col("f")).otherwise(F.coalesce("m", F.lit(default_voice))).alias("voice"))


# Speakers that are no characters.
NO_CHARACTERS = (NARRATOR, "SCENE_BREAK", "Unknown")


def chapter_speakers(segments: DataFrame) -> DataFrame:
    """Characters (book_id, chapter_idx, character_id) heard in each chapter of segments(..., speaker)."""
    return segments.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin("", *NO_CHARACTERS)).select("book_id", "chapter_idx", F.col("speaker").alias("character_id")).distinct()


def cooccurrence(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """Pairs of characters that share a chapter and a voice: (book_id, chapter_idx, voice, a, b) with a < b. The pairs are the result; only those
    of one chapter and voice meet."""
    heard = chapter_speakers(segments).join(cast, ["book_id", "character_id"])
    left = heard.withColumnRenamed("character_id", "a")
    right = heard.withColumnRenamed("character_id", "b")
    return left.join(right, ["book_id", "chapter_idx", "voice"]).filter("a < b")


def _settled(cast: DataFrame, chapters: DataFrame, characters: DataFrame, voice_pools: DataFrame, narrator: str) -> DataFrame:
    """(book_id, character_id, voice, other, chapter_idx): the cast, with `other` null, and a row for each conflict that no voice was left for."""
    pool = voice_pools.first()  # one row
    male, female = list(pool["male"]), list(pool["female"])
    rows = chapters.distinct().join(cast, ["book_id", "character_id"]).join(characters.select("book_id", "character_id", "prominence", "ord", pronoun_gender(F.col("pronoun")).alias("gender")), ["book_id", "character_id"])

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chapter_idx", "prominence", "ord"], ascending=[True, False, True])
        voice, gender = dict(zip(pdf["character_id"], pdf["voice"])), dict(zip(pdf["character_id"], pdf["gender"]))
        scenes = [(chapter, list(group)) for chapter, group in pdf.groupby("chapter_idx", sort=True)["character_id"]]
        unsolved: dict[frozenset, tuple] = {}
        for _ in range(len(voice) + 1):
            changed = False
            for chapter, present in scenes:
                sharing: dict[str, list] = {}
                for ch in present:
                    sharing.setdefault(voice[ch], []).append(ch)
                used = {*sharing, narrator}
                for shared, (first, *others) in sharing.items():
                    for ch in others:
                        if free := next((v for v in (male if gender[ch] == "male" else female) if v not in used), None):
                            voice[ch], changed = free, True
                            used.add(free)
                        else:
                            unsolved.setdefault(frozenset((first, ch)), (ch, shared, first, chapter))
            if not changed:
                break
        out = [(ch, v, None, None) for ch, v in voice.items()] + list(unsolved.values())
        return pd.DataFrame([(pdf["book_id"].iloc[0], *r) for r in out], columns=["book_id", "character_id", "voice", "other", "chapter_idx"]).astype({"chapter_idx": "Int64"})

    kinds = dict(cast.dtypes)
    return rows.groupBy("book_id").applyInPandas(book, f"book_id {kinds['book_id']}, character_id {kinds['character_id']}, voice string, other {kinds['character_id']}, chapter_idx long")


def resolve_conflicts(cast: DataFrame, chapters: DataFrame, characters: DataFrame, voice_pools: DataFrame, narrator: str) -> DataFrame:
    """Gives characters that share a chapter and a voice another one: of those with a voice the most prominent (by ord on ties) keeps it, each other takes
    the first voice of its pool that no one in the chapter has and that is not the narrator's: males of the male pool, all others of the female
    one. Chapters are passed in order until nothing changes, at most once more than there are characters.

    chapters: (book_id, chapter_idx, character_id). A book's cast is small, so a book is one pandas group.
    """
    fixed = _settled(cast, chapters, characters, voice_pools, narrator).filter("other is null").select("book_id", "character_id", F.col("voice").alias("new"))
    out = cast.join(fixed, ["book_id", "character_id"], "left")
    return out.select("book_id", "character_id", F.coalesce("new", "voice").alias("voice"))


def conflict_warnings(cast: DataFrame, chapters: DataFrame, characters: DataFrame, voice_pools: DataFrame, narrator: str) -> DataFrame:
    """Pairs (book_id, chapter_idx, voice, character_id, other) that resolve_conflicts() leaves with one voice, each once, where they first meet."""
    left = _settled(cast, chapters, characters, voice_pools, narrator).filter("other is not null")
    return left.select("book_id", "chapter_idx", "voice", "character_id", "other")


def merge_casts(auto: DataFrame, inherited: DataFrame, narrator: DataFrame) -> DataFrame:
    """Later ones win: narrator, then auto, then inherited; all (book_id, character_id, voice)."""
    keys = ["book_id", "character_id"]
    out = narrator.withColumnRenamed("voice", "v0").join(auto.withColumnRenamed("voice", "v1"), keys, "full").join(inherited.withColumnRenamed("voice", "v2"), keys, "full")
    return out.select(*keys, F.coalesce("v2", "v1", "v0").alias("voice"))


def cast_order(cast: DataFrame) -> DataFrame:
    """cast_ord: by lower-case name, the narrator last."""
    key = F.when(F.col("character_id") == NARRATOR, F.lit("~")).otherwise(F.lower("character_id"))
    return cast.withColumn("cast_ord", F.row_number().over(Window.partitionBy("book_id").orderBy(key, "character_id")))


def cast_report(cast: DataFrame, characters: DataFrame) -> DataFrame:
    """The cast with what is known of its characters; defaults where nothing is."""
    rows = cast.join(characters.select("book_id", "character_id", "pronoun", "prominence"), ["book_id", "character_id"], "left")
    return rows.select("book_id", "character_id", "voice", F.coalesce("pronoun", F.lit("")).alias("pronoun"), F.coalesce("prominence", F.lit(0)).cast("long").alias("prominence"))


def adjacent_repeats(chapter_voices: DataFrame) -> DataFrame:
    """Chapters with the voice of the chapter before, of (book_id, chapter_idx, voice)."""
    before = F.lag("voice").over(Window.partitionBy("book_id").orderBy("chapter_idx"))
    return chapter_voices.withColumn("repeats", F.coalesce(before == F.col("voice"), F.lit(False)))
