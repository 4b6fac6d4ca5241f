"""Casts that stay the same over a series of books."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.functions.text import name_score, words

MATCH = 0.7


def _names(canonical: Column, aliases: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(F.array(canonical), F.coalesce(aliases, F.array().cast("array<string>"))), F.lower))


def _keyed(df: DataFrame, id_: str, names: Column, least: float, mine: bool) -> DataFrame:
    """(series, id_, key): pairs of both sides that can score `least`, and over 0, have an equal key.

    Of the shorter name's n words so many hit that any n - hits + 1 of them have a hit; the longest are taken. They meet the words
    of the other side and their beginnings of three letters or more.
    """

    def some(name: Column) -> Column:
        w = F.array_distinct(words(name))
        most = F.size(w) - F.greatest(F.lit(1), F.ceil(F.size(w) * least - 1e-9)).cast("int") + 1
        by_length = F.transform(F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), lambda x: x["w"])
        return F.slice(by_length, 1, F.greatest(F.lit(0), F.least(F.size(w), most)))

    every = F.array_distinct(F.flatten(F.transform("names", words)))
    begins = F.flatten(F.transform(every, lambda w: F.when(F.length(w) > 3, F.transform(F.sequence(F.lit(3), F.length(w) - 1), lambda n: F.left(w, n))).otherwise(F.array().cast("array<string>"))))
    chosen, all_ = F.array_distinct(F.flatten(F.transform("names", some))), F.array_distinct(F.concat(every, begins))
    tag = lambda n, a: F.transform(a, lambda x: F.xxhash64(F.lit(n), x))  # noqa: E731  equal hashes of different keys only add pairs that do not score
    keys = F.concat(tag(0, F.col("names")), tag(1, chosen if mine else all_), tag(2, all_ if mine else chosen))
    return df.withColumn("names", names).select("series", id_, F.explode(F.array_distinct(keys)).alias("key"))


def candidates(characters: DataFrame, entries: DataFrame, least: float = 0.0) -> DataFrame:
    """Scores over 0, and of `least` or more, of characters(series, character_id, aliases) against entries(series, char_ord, canonical, aliases, voice).

    Two names score only if they are equal or a word of one is or begins a word of the other, so pairs meet by an equality join on words
    and beginnings, not by a cross join of casts.
    """
    mine, theirs = _names(F.col("character_id"), F.col("aliases")), _names(F.col("canonical"), F.col("aliases"))
    met = _keyed(characters, "character_id", mine, least, True).join(_keyed(entries, "char_ord", theirs, least, False), ["series", "key"])
    pairs = met.select("series", "character_id", "char_ord").distinct()
    pairs = pairs.join(characters.select("series", "character_id", mine.alias("a")), ["series", "character_id"])
    pairs = pairs.join(entries.select("series", "char_ord", "canonical", "voice", theirs.alias("b")), ["series", "char_ord"])
    scored = pairs.select("series", "character_id", "char_ord", "canonical", "voice", name_score(F.col("a"), F.col("b")).alias("score"))
    return scored.filter((F.col("score") > 0) & (F.col("score") >= least))


def match_series(characters: DataFrame, entries: DataFrame, least: float = MATCH) -> DataFrame:
    """Inherited voices: of each character's entries the best, the first on ties; it needs a score of `least` and a voice."""
    best = candidates(characters, entries, least).groupBy("series", "character_id").agg(F.min_by(F.struct("canonical", "voice", "score"), F.struct(-F.col("score"), "char_ord")).alias("b"))
    best = best.filter(F.coalesce("b.voice", F.lit("")) != "")
    return best.select("series", "character_id", F.col("b.canonical").alias("canonical"), F.col("b.voice").alias("voice"), F.col("b.score").alias("score"))


def union_aliases(old: Column, new: Column) -> Column:
    """Both, each spelling once whatever its case, the first kept."""

    def add(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.concat(old, new), F.array().cast("array<string>"), add)


def score(mine: set[str], theirs: set[str]) -> float:
    """name_score() of two sets of lower-case names."""

    def overlap(a: set[str], b: set[str]) -> float:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return sum(w in long or (len(w) >= 3 and any(v.startswith(w) for v in long)) for w in short) / len(short) if short else 0.0

    return 1.0 if mine & theirs else max((overlap(set(x.split()), set(y.split())) for x in mine for y in theirs), default=0.0)


def _begins(words_: set[str]) -> set[str]:
    """The words and their beginnings of three letters or more."""
    return {w[:n] for w in words_ for n in range(3, len(w))} | words_


class _Near:
    """Finds the entries that can score `least` with names. Of the shorter name's n words so many hit that any n - hits + 1 have a hit: the rarest are looked up."""

    def __init__(self, names: Iterator[str], least: float) -> None:
        self.least, self.count = least, Counter(w for n in names for w in set(n.split()))
        self.by_name: dict[str, list[int]] = {}
        self.by_begin: dict[str, list[int]] = {}
        self.by_rare: dict[str, list[int]] = {}

    def _rare(self, name: str) -> list[str]:
        words_ = sorted(set(name.split()), key=lambda w: (self.count[w], w))
        return words_[: len(words_) - max(1, math.ceil(len(words_) * self.least - 1e-9)) + 1]

    def add(self, i: int, names: set[str]) -> None:
        for index, keys in ((self.by_name, names), (self.by_begin, _begins({w for n in names for w in n.split()})), (self.by_rare, {w for n in names for w in self._rare(n)})):
            for k in keys:
                index.setdefault(k, []).append(i)

    def find(self, names: set[str]) -> Iterator[int]:
        seen: set[int] = set()
        for index, keys in ((self.by_name, names), (self.by_begin, {w for n in names for w in self._rare(n)}), (self.by_rare, _begins({w for n in names for w in n.split()}))):
            for k in keys:
                for i in index.get(k, ()):
                    if i not in seen:
                        seen.add(i)
                        yield i


def _entries_after(entries: list[dict], cast: list[dict], least: float) -> list[dict]:
    """The fold of one series; entries and newcomers meet by their words."""
    out: list[dict] = []
    by_name: dict[str, int] = {}
    lowered = lambda c, aliases: {x.lower() for x in (c, *aliases)}
    near = _Near((n for rows, c in ((entries, "canonical"), (cast, "character_id")) for r in rows for n in lowered(r[c], r["aliases"])), least)

    def add(canonical: str, aliases: list[str], voice: str | None) -> None:
        out.append({"canonical": canonical, "aliases": aliases, "voice": voice})
        by_name.setdefault(canonical.lower(), len(out) - 1)
        near.add(len(out) - 1, lowered(canonical, aliases))

    for e in entries:
        add(e["canonical"], list(e["aliases"]), e["voice"])
    for c in cast:
        aliases = list(c["aliases"])
        if not c["voice"]:
            continue
        if c["pinned"]:
            if (i := by_name.get(c["character_id"].lower())) is not None:
                had = {a.lower() for a in out[i]["aliases"]}
                out[i]["voice"] = c["voice"]
                more = [a for a in aliases if a.lower() not in had]
                out[i]["aliases"] += more
                near.add(i, {a.lower() for a in more})
            continue
        names = lowered(c["character_id"], aliases)
        if not any(score(names, lowered(out[i]["canonical"], out[i]["aliases"])) >= least for i in near.find(names)):
            add(c["character_id"], aliases, c["voice"])
    return out


def upsert_series(entries: DataFrame, cast: DataFrame, least: float = MATCH) -> DataFrame:
    """Entries (series, char_ord, canonical, aliases, voice) after a book's cast(series, character_id, aliases, voice, pinned, ord).

    Characters count in the order of ord; those without a voice do not. A pinned one gives its voice to the first entry of its name in any case, and the
    aliases that the entry lacks in any case; without such an entry nothing happens. Any other is appended unless an entry, old or
    appended before it, scores `least` or more. So each depends on those before: a series is one group.
    """

    def fold(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        series = (old if len(old) else new)["series"].iloc[0]
        found = _entries_after(old.sort_values("char_ord").to_dict("records"), new.sort_values(["ord", "character_id"]).to_dict("records"), least)
        rows = [(series, i, e["canonical"], e["aliases"], e["voice"]) for i, e in enumerate(found)]
        return pd.DataFrame(rows, columns=["series", "char_ord", "canonical", "aliases", "voice"])

    none = F.array().cast("array<string>")
    old = entries.select("series", "char_ord", "canonical", F.coalesce("aliases", none).alias("aliases"), "voice")
    new = cast.select("series", "character_id", F.coalesce("aliases", none).alias("aliases"), "voice", "pinned", "ord")
    return old.groupBy("series").cogroup(new.groupBy("series")).applyInPandas(fold, "series string, char_ord int, canonical string, aliases array<string>, voice string")


def ordered_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests (..., updated_at), the latest first."""
    return manifests.orderBy(F.desc("updated_at"), "series")


def manifest_from(characters: DataFrame, cast: DataFrame) -> DataFrame:
    """Entries of a first book: its characters that have a voice."""
    return characters.join(cast.select("series", "character_id", "voice").filter("voice is not null and voice <> ''"), ["series", "character_id"]).select(
        "series", F.col("ord").alias("char_ord"), F.col("character_id").alias("canonical"), "aliases", "voice"
    )


def roster_candidates(rosters: DataFrame, jobs: DataFrame, key: str = "book_hash") -> DataFrame:
    """Rosters (book_hash) with the title of their completed job, else the first 8 digits of the hash. key: what rosters and jobs meet on, if
    rosters of one hash have jobs of their own.
    """
    done = jobs.filter("status = 'completed'").groupBy(key).agg(F.max("title").alias("title"))
    return rosters.join(done, key, "left").withColumn("title", F.coalesce("title", F.substring("book_hash", 1, 8)))


def not_inherited(characters: DataFrame, inherited: DataFrame) -> DataFrame:
    return characters.join(inherited.select("series", "character_id"), ["series", "character_id"], "left_anti")
