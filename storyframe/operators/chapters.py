"""Chapters: title classes, presets, ordered filter chains, selections and totals."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.functions.text import paragraph_words

# What titles of each family match, in the order in which families are tried.
FRONT_MATTER = ("^acknowledgments", "^preface", "introduction", "^contents", "^copyright", "^dedication", "^foreword", "^epigraph", r"^about\s+this\s+(book|edition)")
BACK_MATTER = ("^references", "^index", "^bibliography", "^appendix", "^notes", "^glossary", r"^about\s+the\s+author", r"^also\s+by", r"^praise\s+for", r"^a\s+note\s+(from|on|about)", r"^author'?s?\s+note", "^excerpt", "^afterword", r"^reading\s+(group|guide)", r"^discussion\s+questions")
TITLE_PAGE = ("^title", "^cover", "^colophon")
_ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|one|two|three|four|five"
PART_DIVIDER = (r"^part\s+[0-9ivxlc]+", rf"^part\s+({_ORDINALS})", rf"^book\s+({_ORDINALS}|[0-9]+|[ivx]+)", r"^volume\s+[0-9ivxlc]+", rf"^volume\s+({_ORDINALS})")
STUB_WORDS = 30

TAGS = ("front_matter", "back_matter", "title_page", "part_divider", "chapter")


@dataclass
class Classifier:
    """Title families; patterns may be added and reset."""

    families: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.families = {"front_matter": list(FRONT_MATTER), "back_matter": list(BACK_MATTER), "title_page": list(TITLE_PAGE), "part_divider": list(PART_DIVIDER)}

    def add(self, family: str, pattern: str) -> None:
        if family not in self.families:
            raise ValueError(f"unknown family {family!r}")
        re.compile(pattern)
        self.families[family].append(pattern)

    def tags(self, title: Column, word_count: Column | None = None) -> Column:
        """struct of is_front_matter, is_back_matter, is_title_page, is_part_divider, is_chapter; the first family wins."""
        low = F.trim(F.lower(title))
        hit = F.lit(None).cast("string")
        for name, patterns in reversed(self.families.items()):
            hit = F.when(low.rlike("|".join(patterns)), name).otherwise(hit)
        hit = F.when(F.coalesce(title, F.lit("")) == "", "none").otherwise(hit)
        short = F.coalesce(word_count < STUB_WORDS, F.lit(False)) if word_count is not None else F.lit(False)
        chapter = F.when(hit.isNull(), ~short).otherwise(hit == "part_divider")
        return F.struct(*[F.coalesce(hit == k, F.lit(False)).alias(f"is_{k}") for k in TAGS[:4]], chapter.alias("is_chapter"))


def tag_list(tags: Column) -> Column:
    """Names of the tags that hold, in a fixed order."""
    return F.array_compact(F.array(*[F.when(tags[f"is_{k}"], k.replace("_", "-")) for k in TAGS]))


def with_tags(chapters: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Adds word_count and tags to chapters(title, paragraphs)."""
    c = classifier or Classifier()
    return chapters.withColumn("word_count", paragraph_words(F.col("paragraphs"))).withColumn("tags", c.tags(F.col("title"), F.col("word_count")))


_PRESETS: dict[str, Callable[[Column], Column]] = {
    "all": lambda t: F.lit(True),
    "none": lambda t: F.lit(False),
    "content-only": lambda t: ~(t["is_front_matter"] | t["is_back_matter"] | t["is_title_page"]),
    "chapters-only": lambda t: t["is_chapter"] & ~t["is_part_divider"],
    "with-parts": lambda t: t["is_chapter"],
}


_HELP = {
    "all": "every chapter",
    "none": "no chapter",
    "content-only": "all but front matter, back matter and title pages",
    "chapters-only": "chapters without part dividers",
    "with-parts": "chapters and part dividers",
}


def register_preset(name: str, predicate: Callable[[Column], Column], description: str = "") -> None:
    _PRESETS[name] = predicate
    _HELP[name] = description


def presets() -> list[str]:
    return sorted(_PRESETS)


def preset_help() -> str:
    """A line for each preset, in the order in which they were registered."""
    return "\n".join(["Available filter presets:", *(f"  {name:15} - {_HELP.get(name, '')}" for name in _PRESETS)])


def apply_preset(chapters: DataFrame, name: str) -> DataFrame:
    """Chapters(tags) that a preset takes; all of them if it is not known."""
    return chapters.filter(_PRESETS[name](F.col("tags"))) if name in _PRESETS else chapters


def _known(name: str) -> None:
    if name not in _PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(presets())}")


def preset(name: str, tags: Column) -> Column:
    _known(name)
    return _PRESETS[name](tags)


Operation = tuple[str, str]


def validate(operations: list[Operation]) -> None:
    for kind, value in operations:
        if kind == "preset":
            _known(value)
        elif kind in ("include", "exclude"):
            try:
                re.compile(value)
            except re.error as e:
                raise ValueError(f"bad pattern {value!r}: {e}") from e
        elif kind == "index":
            int(value)
        else:
            raise ValueError(f"unknown operation {kind!r}")


def selection(operations: list[Operation], title: Column, tags: Column, index: Column) -> Column:
    """One predicate for a chain of operations: presets replace, include and index add, exclude takes away."""
    validate(operations)
    if not operations:
        return F.lit(True)
    chosen = F.lit(operations[0][0] == "exclude")
    for kind, value in operations:
        if kind == "preset":
            chosen = preset(value, tags)
        elif kind == "include":
            chosen = chosen | F.coalesce(title, F.lit("")).rlike(value)
        elif kind == "exclude":
            chosen = chosen & ~F.coalesce(title, F.lit("")).rlike(value)
        else:
            chosen = chosen | (index == int(value))
    return chosen


def apply_filter(chapters: DataFrame, operations: list[Operation]) -> DataFrame:
    """Chapters(title, tags, chapter_idx) that a chain selects; order them by chapter_idx when they are shown."""
    return chapters.filter(selection(operations, F.col("title"), F.col("tags"), F.col("chapter_idx")))


def select_chapters(chapters: DataFrame, name: str, included: list[int] = (), excluded: list[int] = ()) -> DataFrame:
    """A stored selection: manual and custom take the included indices, or content-only without any; then exclusions."""
    if name == "none":
        return chapters.filter(F.lit(False))
    if name in ("manual", "custom"):
        operations = [("index", str(i)) for i in included] or [("preset", "content-only")]
    else:
        operations = [("preset", name)]
    out = apply_filter(chapters, operations)
    return out.filter(~F.col("chapter_idx").isin(*excluded)) if excluded else out


def totals(chapters: DataFrame) -> DataFrame:
    """Per book: chapters, paragraphs and words."""
    return chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total_chapters"), F.sum(F.size("paragraphs")).alias("paragraph_count"), F.sum("word_count").alias("total_word_count")
    )


def restrict_or_all(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chapters with a wanted (book_id, chapter_idx); all of a book's chapters if none is wanted there."""
    books = wanted.join(chapters.select("book_id", "chapter_idx"), ["book_id", "chapter_idx"], "left_semi").select("book_id").distinct()
    some = chapters.join(wanted, ["book_id", "chapter_idx"], "left_semi")
    return some.unionByName(chapters.join(books, "book_id", "left_anti"))
