"""Scalar text functions as Columns: cleaning, names, words, slugs, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Contractions and what they stand for.
CONTRACTIONS = {
    "won't": "will not",
    "can't": "cannot",
    "don't": "do not",
    "doesn't": "does not",
    "didn't": "did not",
    "isn't": "is not",
    "aren't": "are not",
    "wasn't": "was not",
    "weren't": "were not",
    "haven't": "have not",
    "hasn't": "has not",
    "hadn't": "had not",
    "couldn't": "could not",
    "wouldn't": "would not",
    "shouldn't": "should not",
    "mustn't": "must not",
    "needn't": "need not",
    "shan't": "shall not",
}

# Words that carry no name.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "lord", "lady", "sir", "captain", "capt", "gen", "sgt", "cpl", "pvt", "rev", "fr", "br", "sr", "jr", "ii", "iii", "iv")
PARTICLES = ("the", "a", "an", "of", "von", "de", "le", "la", "du", "van", "den", "der", "des", "di", "da", "del", "bin", "bint")

# What a character's name does not begin with, is not, and does not contain.
PHRASE_STARTERS = ("a", "an", "the", "any", "all", "some", "no", "every", "his", "her", "their", "its", "my", "your", "this", "that", "these", "those")
COMMON_NOUNS = ("man", "woman", "girl", "boy", "person", "people", "lord", "lady", "king", "queen", "knight", "soldier", "sister", "sisters", "brother", "brothers", "guard", "servant", "merchant", "captain")
RELATIVE_WORDS = ("who", "whom", "whose", "which", "that", "when", "where", "standing", "sitting", "named", "called", "known", "said", "having", "being", "wearing", "holding", "carrying", "watching", "looking", "walking", "speaking", "telling")
MAX_NAME_WORDS = 4

STX, ETX = "\x02", "\x03"


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: White space of Unicode, and the four separators of ASCII.
SPACE = r"(?U)[\s\x1c-\x1f]"


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def paragraph_words(paragraphs: Column) -> Column:
    return F.aggregate(F.transform(paragraphs, word_count), F.lit(0), lambda a, b: a + b)


def clean_text(text: Column) -> Column:
    """Invalid UTF-8 is replaced, white space becomes single blanks."""
    return F.trim(F.regexp_replace(F.make_valid_utf8(text), f"{SPACE}+", " "))


def sanitize_filename(name: Column) -> Column:
    return F.translate(name, '\\/*?:"<>|', "")


def strip_marks(text: Column) -> Column:
    return F.translate(text, STX + ETX, "")


def expand_contractions(text: Column) -> Column:
    """n't forms written out; upper case and a leading capital are kept, other capitals are lowered."""
    out = F.replace(text, F.lit("\u2019"), F.lit("'"))
    for short, long in CONTRACTIONS.items():
        head, tail = short[0], short[1:]
        for pattern, to in (
            (rf"\b{short.upper()}\b", long.upper()),
            (rf"\b{head.upper()}(?i:{tail})\b", long.capitalize()),
            (rf"\b{head}(?i:{tail})\b", long),
        ):
            out = F.regexp_replace(out, pattern, to)
    return out


def is_scene_break(text: Column) -> Column:
    """Blank, two or more asterisks, two or more dashes or a lone #, white space around them."""
    return text.rlike(rf"{SPACE}*(|\*[\s*]*\*|[-\u2014]{{2,}}|#)[\s\x1c-\x1f]*$".replace("(?U)", "(?U)^", 1))


def sentences(text: Column) -> Column:
    """Pieces that end in .!? and white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def slugify(name: Column) -> Column:
    # The four patterns.
    s = F.regexp_replace(F.trim(F.lower(name)), r"[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def normalize_bitrate(value: Column, default: str = "96k") -> Column:
    # The default and the two forms.
    v = F.lower(F.trim(value))
    return (
        F.when(value.isNull() | (v == ""), default)
        .when(v.rlike(r"^\d+[kmg]$"), v)
        .when(v.rlike(r"^\d+$"), F.when(v.cast("decimal(38,0)") >= 1000, v).otherwise(F.concat(v, F.lit("k"))))
        .otherwise(default)
    )


# What stands for each set of pronouns.
PRONOUN_FORMS = {
    "he/him": ("he/him", "he", "him", "his", "m", "male", "man"),
    "she/her": ("she/her", "she", "her", "hers", "f", "female", "woman"),
    "they/them": ("they/them", "they", "them", "their", "theirs", "nonbinary", "non-binary"),
}


def normalize_pronoun(value: Column) -> Column:
    """One of he/him, she/her, they/them, or ''; the whole value counts."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    out = F.lit("")
    for pronoun, forms in PRONOUN_FORMS.items():
        out = F.when(v.isin(*forms), pronoun).otherwise(out)
    return out


def pronoun_gender(pronoun: Column) -> Column:
    """male, female or they, by the first telling part between slashes."""
    parts = F.transform(F.split(F.lower(F.coalesce(pronoun, F.lit(""))), "/"), F.trim)
    kinds = F.transform(parts, lambda p: F.when(p.isin("he", "him", "his", "male"), "male").when(p.isin("she", "her", "hers", "female"), "female"))
    return F.coalesce(F.try_element_at(F.filter(kinds, lambda k: k.isNotNull()), F.lit(1)), F.lit("they"))


def book_hash(path: Column, mtime: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":"), mtime), 256), 1, 32)


def eta_text(seconds: Column) -> Column:
    """1h 2m, 3m 4s, 5s; a dash for nothing left."""
    h, m, s = (x.cast("string") for x in (F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))))
    return (
        F.when(seconds.isNull() | (seconds <= 0), "\u2014")
        .when(seconds >= 3600, F.concat(h, F.lit("h "), m, F.lit("m")))
        .when(seconds >= 60, F.concat(m, F.lit("m "), s, F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def chapters_eta(elapsed_s: Column, done: Column, total: Column) -> Column:
    """MM:SS for the chapters left at the mean time of those done; null before the first is."""
    left = F.floor(elapsed_s / done * (total - done)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.lit(2), F.length(x.cast("string"))), F.lit("0"))
    return F.when(done > 0, F.concat(two(F.floor(left / 60)), F.lit(":"), two(F.pmod(left, F.lit(60)))))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, or --:--:-- for null."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(seconds.isNull(), "--:--:--").otherwise(F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60)))))


def clamp_progress(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def phase_progress(phase: Column, value: Column, chunks: Column) -> Column:
    """Progress of a whole job from a phase: scan 10 + 15 k to 90, attribution 5 + 8 k to 95, preparation 0.3 k to 14.9."""
    return (
        F.when(phase == "scan", F.least(F.lit(90.0), 10 + 15 * chunks))
        .when(phase == "attribution", F.least(F.lit(95.0), 5 + 8 * chunks))
        .when(phase == "prepare", F.least(F.lit(14.9), 0.3 * chunks))
        .otherwise(clamp_progress(value))
    )


# What a line of attribution begins with, and what is shown in its place.
PHASE, PHASE_SHOWN = "[Attribution]", "[yellow]Attribution[/yellow]  "


def short_label(text: Column, most: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def progress_label(text: Column) -> Column:
    """A line of progress: 60 characters, or 80 after the phase's name."""
    rest = F.regexp_replace(F.substring(text, F.lit(len(PHASE) + 1), F.length(text)), f"^{SPACE}+|{SPACE}+$".replace("(?U)", ""), "")
    return F.when(text.startswith(PHASE), short_label(F.concat(F.lit(PHASE_SHOWN), rest), 80)).otherwise(short_label(text, 60))


def roster_line(name: Column, aliases: Column) -> Column:
    """A character as a prompt shows it, with the other names it is known by."""
    others = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a != name)
    return F.concat(F.lit('- "'), name, F.when(F.size(others) > 0, F.concat(F.lit('"  (also known as: '), F.array_join(others, ", "), F.lit(")"))).otherwise('"'))


def name_summary(names: Column, most: int = 8) -> Column:
    """The first names, and how many more there are."""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def voice_description(source: Column, gender: Column, accent: Column, dataset: Column) -> Column:
    """What is known of a voice, by its source."""
    known = lambda *parts: F.concat_ws(" \u00b7 ", *[F.nullif(p, F.lit("")) for p in parts])
    shown = lambda text, default: F.when(text != "", text).otherwise(default)
    return F.when(source == "builtin", shown(known(gender, accent), "Built-in")).when(source == "compiled", shown(known(gender, accent, dataset), "Compiled voice")).otherwise("Custom voice")


def voice_label(name: Column, description: Column) -> Column:
    """The name, filled to 20 characters (never cut), and the description."""
    return F.concat(F.rpad(name, F.greatest(F.lit(20), F.length(name)), F.lit(" ")), F.lit(" "), description)


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def now_epoch() -> Column:
    return F.unix_micros(F.current_timestamp()) / 1_000_000


def without_nulls(value: Column, kind: DataType) -> Column:
    """The value without null elements and map entries at any depth; to_json() then leaves out its null fields."""
    if isinstance(kind, StructType):
        parts = [without_nulls(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, ArrayType):
        return F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: without_nulls(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(F.map_filter(value, lambda _, x: x.isNotNull()), lambda _, x: without_nulls(x, kind.valueType))
    return value


def to_json_without_nulls(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON without any null."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.to_json(F.struct(*[without_nulls(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]))


def split_hf_url(url: Column) -> Column:
    """hf://user/repo/path as a struct; a path is voice.wav if left out. Null for any other string and without a user."""
    body = F.regexp_replace(F.substring(url, F.lit(6), F.length(url)), r"[?#].*$", "")
    user = F.substring_index(body, "/", 1)
    rest = F.split(F.regexp_replace(F.substring(body, F.length(user) + 2, F.length(body)), "^/+|/+$", ""), "/", 2)
    path = F.coalesce(F.try_element_at(rest, F.lit(2)), F.lit("voice.wav"))
    return F.when(url.startswith("hf://") & (user != ""), F.struct(user.alias("user"), F.element_at(rest, 1).alias("repo"), path.alias("path")))


def split_anchor(href: Column) -> Column:
    """File and anchor, cut at the first #; no anchor is null."""
    return F.struct(F.substring_index(href, "#", 1).alias("file"), F.when(F.instr(href, "#") > 0, F.regexp_extract(href, "(?s)#(.*)$", 1)).alias("anchor"))


def is_proper_name(phrase: Column) -> Column:
    w = F.transform(words(phrase), F.lower)
    first = F.try_element_at(w, F.lit(1))
    return (
        F.size(w).between(1, MAX_NAME_WORDS)
        & ~F.coalesce(first.isin(*PHRASE_STARTERS), F.lit(False))
        & ~((F.size(w) == 1) & first.isin(*COMMON_NOUNS))
        & ~F.arrays_overlap(w, strings(RELATIVE_WORDS))
    )


def significant_words(name: Column) -> Column:
    """Lower-case words of two letters or more that are neither titles nor particles."""
    stripped = F.transform(words(F.lower(name)), lambda w: F.regexp_replace(w, "^[.,'\\-\u2019\u2018]+|[.,'\\-\u2019\u2018]+$", ""))
    return F.filter(stripped, lambda w: (F.length(w) > 1) & ~w.isin(*TITLES, *PARTICLES))


def is_alias(candidate: Column, canonical: Column) -> Column:
    """Of arrays of significant words: the candidate is shorter and has no word of its own."""
    return (F.size(candidate) > 0) & (F.size(candidate) < F.size(F.array_distinct(canonical))) & (F.size(F.array_except(candidate, canonical)) == 0)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the shorter name's words that the longer has, as a word or, from three letters on, as a beginning."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))

    def share(short: Column, long: Column) -> Column:
        hit = F.filter(short, lambda w: F.array_contains(long, w) | ((F.length(w) >= 3) & F.exists(long, lambda v: v.startswith(w))))
        return F.size(hit) / F.size(short)

    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(F.size(x) <= F.size(y), share(x, y)).otherwise(share(y, x))


def name_score(a: Column, b: Column) -> Column:
    """Of arrays of lower-case names: 1 if they share one, else the best overlap of any two."""
    best = F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: word_overlap(x, y)))))
    return F.when(F.arrays_overlap(a, b), 1.0).otherwise(F.coalesce(best, F.lit(0.0)))


def natural_key(name: Column) -> Column:
    """Sorts file2 before file10, whatever the case."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def quoted_pattern(text: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.regexp_replace(text, r"([^\w\s])", r"\\$1")
