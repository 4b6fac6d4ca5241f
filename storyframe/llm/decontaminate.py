"""Benchmark decontamination by the q-gram lemma.

A probe of `probe_words` words starts at every word of an item. A probe of m characters may differ from a region of a document by
k = min(m * budget, (m - q) / q) edits. By the q-gram lemma such a region shares at least m - q + 1 - k * q character q-grams with the
probe, on at most k + 1 neighbouring diagonals (place in the document less place in the item). Shared q-grams are
counted for whole items in bands of 2 (k + 1) diagonals that overlap by half, then for the probes of a band; those that reach the
bound are verified by a banded alignment. So every region within the budget is found, and none beyond it. q-grams are kept once for an
item, however many probes hold them.

Items too short for a probe are looked for as whole word sequences without an edit, by one automaton.

Items are sent to the executors in blocks of at most `block_chars` characters; a document is read once for all blocks. A worker holds the indexes of all
blocks, so its memory grows with the benchmark (about 60 bytes a character), not with the documents: shared q-grams are worked off in
pieces of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import batch, ranges, slices

Q, BUDGET, PROBE_WORDS, STRIDE, LEAST_WORDS, LEAST_CHARS = 8, 0.1, 12, 1, 6, 30
#: Thai to Myanmar, Khmer, kana, Han: scripts without blanks, in which a character counts as half a word. So does each of a longer run without blanks.
_BLANKLESS, _LONG = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff", 30
_UNITS = re.compile(f"[{_BLANKLESS}]|[^ {_BLANKLESS}]+")
_IS_BLANKLESS = re.compile(f"[{_BLANKLESS}]")
#: Shared q-grams that are worked on at once.
_HELD = 1 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("n_items", pa.int64()), ("n_probes", pa.int64()), ("least_edits", pa.int64()), ("items", pa.string())])
_OUT_DDL = "doc_id long, contaminated boolean, n_items long, n_probes long, least_edits long, items string"
_MIX, _BITS, _BASE = np.uint64(0x9E3779B97F4A7C15), 22, 0x100000001B3
#: Stands between documents; no code point of a text is as large.
_GAP = 0x200000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _spans(text: str, probe_words: int, stride: int, least_words: int) -> list[tuple[int, int]]:
    """Where the probes of a normalised text begin and end."""
    at: list[tuple[int, int, int]] = []  # begin, end, half words
    for m in _UNITS.finditer(text):
        a, b = m.span()
        if b - a > _LONG:
            at += [(i, i + 1, 1) for i in range(a, b)]
        else:
            at.append((a, b, 1 if re.match(f"[{_BLANKLESS}]", m[0]) else 2))
    if not at:
        return []
    begins, ends = [x[0] for x in at], [x[1] for x in at]
    halves = np.cumsum([0, *(x[2] for x in at)])
    if halves[-1] < 2 * least_words and len(text) < LEAST_CHARS:
        return []
    last = max(0, int(np.searchsorted(halves, halves[-1] - 2 * probe_words, side="right")) - 1)
    starts = sorted({*range(0, last, stride), last})
    stops = np.minimum(np.searchsorted(halves, halves[starts] + 2 * probe_words), len(at)) - 1
    return sorted({*((begins[i], ends[j]) for i, j in zip(starts, stops.tolist())), (begins[last], ends[-1])})


def probes(text: str, probe_words: int = PROBE_WORDS, stride: int = STRIDE, least_words: int = LEAST_WORDS) -> list[str]:
    """Overlapping windows of an item's words; none for one of fewer than `least_words` words and LEAST_CHARS characters, which is short."""
    text = normalised(text)
    return [text[a:b] for a, b in _spans(text, probe_words, stride, least_words)]


class Short:
    """Items without a probe, found as whole word sequences."""

    def __init__(self, items: list[tuple[int, str]], probe_words: int, stride: int, least_words: int) -> None:
        owners: dict[str, set[int]] = {}
        for i, t in ((i, normalised(t)) for i, t in items):
            if t and not _spans(t, probe_words, stride, least_words):
                owners.setdefault(t, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for n, (t, ids) in enumerate(owners.items()):
            self.automaton.add_word(t, (n, t, sorted(ids)))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(number, items) of every short item that stands in a normalised text."""
        seen: set[int] = set()
        for last, (n, t, ids) in self.automaton.iter(text) if self.some else ():
            if n not in seen and _apart(text, last - len(t)) and _apart(text, last):
                seen.add(n)
                yield n, ids


def _apart(text: str, i: int) -> bool:
    """Whether a word may end with character i and the next begin after it."""
    return i < 0 or i + 1 >= len(text) or " " in text[i : i + 2] or bool(_IS_BLANKLESS.search(text[i : i + 2]))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A rolling polynomial hash of every q-gram."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - q + 1, np.uint64)
    for i in range(q):
        out *= np.uint64(_BASE)
        out += points[i : i + len(out)]
    return out


class Index:
    """The q-grams of a block of items, and the probes of each item in order of their place."""

    def __init__(self, items: list[tuple[int, str]], q: int, budget: float, probe_words: int = PROBE_WORDS, stride: int = STRIDE, least_words: int = LEAST_WORDS) -> None:
        self.q = q
        texts = [(i, t, [(a, b) for a, b in _spans(t, probe_words, stride, least_words) if b - a >= q]) for i, t in ((i, normalised(t)) for i, t in items)]
        texts = [x for x in texts if x[2]]
        points = [_points(t) for _, t, _ in texts]
        base = np.cumsum([0, *map(len, points)])
        self.points = np.concatenate([*points, np.zeros(1, np.uint32)])
        n = [len(x) for _, _, x in texts]
        self.row = np.repeat(np.arange(len(texts)), n)
        self.item = np.repeat(np.array([i for i, _, _ in texts], np.int64), n)
        span = np.array([x for _, _, s in texts for x in s], np.int64).reshape(-1, 2)
        self.begin, self.size = span[:, 0], span[:, 1] - span[:, 0]
        self.base = base[self.row] + self.begin
        self.key = (self.row << 32) + self.begin
        self.edits = np.minimum((self.size * budget + 1e-9).astype(np.int64), (self.size - q) // q)
        self.least = self.size - q + 1 - self.edits * q
        # of each item: diagonals to a band, the least q-grams and the most places of a probe
        first = np.cumsum([0, *n])[:-1]
        self.step, self.low, self.reach = (f.reduceat(x, first) if n else np.zeros(0, np.int64) for f, x in ((np.maximum, self.edits + 1), (np.minimum, self.least), (np.maximum, self.size - q)))
        grams = [_grams(p, q) for p in points]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.grams * _MIX) >> np.uint64(64 - _BITS)] = True

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, a place in the middle of it, edits) of every region of points within a probe's budget."""
        none = np.zeros(0, np.int64)
        grams = _grams(points, self.q)
        hit = np.flatnonzero(self.table[(grams * _MIX) >> np.uint64(64 - _BITS)])
        if not len(hit):
            return none, none, none
        rank = np.minimum(np.searchsorted(self.grams, grams[hit]), len(self.grams) - 1)
        real = self.grams[rank] == grams[hit]
        hit, rank = hit[real], rank[real]
        if not len(hit):
            return none, none, none
        found = [self._search(points, hit[a:b], rank[a:b]) for a, b in self._pieces(hit, self.count[rank])]
        probe, middle, edits = (np.concatenate(x) for x in zip(*found))
        return probe, middle, edits

    def _pieces(self, hit: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of hits with about _HELD entries that overlap by a whole region, so that each region lies in one of them."""
        sums, region, a = np.cumsum(n), int((self.size + self.edits).max()), 0
        while True:
            b = max(int(np.searchsorted(sums, (sums[a - 1] if a else 0) + _HELD, side="right")), int(np.searchsorted(hit, hit[a] + 2 * region)))
            yield a, b
            if b >= len(hit):
                return
            a = int(np.searchsorted(hit, hit[b] - region))

    def _search(self, points: np.ndarray, hit: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        n = self.count[rank]
        entry = ranges(self.first[rank], n)
        row, place = self.owner[entry], self.place[entry]
        # all of an item's bands in order; + 2^31 as a band can be below zero
        each = (row << 33) + np.floor_divide(np.repeat(hit, n) - place, self.step[row]) + (1 << 31)
        order = np.argsort(each, kind="stable")
        place = place[order]
        key, first, have = np.unique(each[order], return_index=True, return_counts=True)
        both = have.copy()
        if len(key) > 1:
            both[:-1] += np.where(np.diff(key) == 1, have[1:], 0)
        low = self.low[key >> 33]
        # a band begins at its own diagonals or one step before them
        start = np.unique(np.concatenate([key[both >= low], key[have >= low] - 1]))
        if not len(start):
            return none, none, none
        # places of the q-grams of each band, in order
        who, at = [], []
        for more in (0, 1):
            i = np.minimum(np.searchsorted(key, start + more), len(key) - 1)
            m = np.where(key[i] == start + more, have[i], 0)
            who.append(np.repeat(np.arange(len(start)), m))
            at.append(place[ranges(first[i], m)])
        held = np.unique((np.concatenate(who) << 32) + np.concatenate(at))
        who, at = held >> 32, held & 0xFFFFFFFF
        row = start[who] >> 33
        # probes whose first shared q-gram is this one, where enough others follow
        enough = np.searchsorted(held, held + self.reach[row], side="right") - np.arange(len(held)) >= self.low[row]
        before = np.concatenate([[-1], np.where(np.diff(who) == 0, at[:-1], -1)])
        after = np.maximum(before + 1, np.maximum(at - self.reach[row], 0))
        who, at, row, after = who[enough], at[enough], row[enough], after[enough]
        a, b = np.searchsorted(self.key, (row << 32) + after), np.searchsorted(self.key, (row << 32) + at, side="right")
        probe, who = ranges(a, b - a), np.repeat(who, b - a)
        begin = (who << 32) + self.begin[probe]
        shared = np.searchsorted(held, begin + self.size[probe] - self.q, side="right") - np.searchsorted(held, begin)
        good = shared >= self.least[probe]
        probe, band = probe[good], (start[who[good]] & ((1 << 33) - 1)) - (1 << 31)
        if not len(probe):
            return none, none, none
        found = [self._align(points, probe[a : a + 4096], band[a : a + 4096]) for a in range(0, len(probe), 4096)]
        end, edits = (np.concatenate(x) for x in zip(*found))
        near = edits <= self.edits[probe]
        return probe[near], end[near] - self.size[probe[near]] // 2 - 1, edits[near]

    def _align(self, points: np.ndarray, probe: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits between each whole probe and a region that begins and ends on the band's diagonals."""
        step = self.step[self.row[probe]]
        start = band * step + self.begin[probe]
        across = np.arange(int(2 * step.max()), dtype=np.int32)[:, None]
        beyond = across >= 2 * step
        far = np.int32(1 << 20)
        cost = np.where(beyond, far, np.int32(0))
        out, end = np.full(len(probe), 1 << 20, np.int64), np.zeros(len(probe), np.int64)
        size, base, row = self.size[probe], self.base[probe], np.arange(len(probe))
        for i in range(int(size.max())):
            at = start + across + i
            text = np.where((at >= 0) & (at < len(points)), points[np.clip(at, 0, len(points) - 1)], _GAP)
            now = cost + (text != self.points[base + i])
            now[:-1] = np.minimum(now[:-1], cost[1:] + 1)
            cost = np.minimum.accumulate(now - across, axis=0) + across
            cost[beyond] = far
            done = size == i + 1
            if done.any():
                out[row[done]] = cost[:, done].min(axis=0)
                end[row[done]] = start[done] + cost[:, done].argmin(axis=0) + i + 1
            # the least of a row never falls: those beyond the budget and those at their end go
            if done.any() or i % 8 == 7:
                on = ~done & (cost.min(axis=0) <= self.edits[probe[row]])
                start, size, base, row, cost, beyond = start[on], size[on], base[on], row[on], cost[:, on], beyond[:, on]
                if not len(row):
                    break
        return end, out


def _shared(benchmark: DataFrame, block_chars: int) -> list:
    """The items, broadcast in blocks of about half of block_chars."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars))
    shared = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # about block_chars / 2 characters
        shared.append(spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in rows)))

    return shared


class Indexes:
    """All blocks of items."""

    def __init__(self, blocks: list[list[tuple[int, str]]], q: int, budget: float, probe_words: int = PROBE_WORDS, stride: int = STRIDE, least_words: int = LEAST_WORDS) -> None:
        self.long = [Index(x, q, budget, probe_words, stride, least_words) for x in blocks]
        self.short = Short([i for x in blocks for i in x], probe_words, stride, least_words)


def _found(texts: list[str], indexes: Indexes) -> Iterator[tuple[int, int, list[dict]]]:
    """Of row ranges (begin, end): for each row {probe: (least edits, item)}; a short item is its own probe."""
    kept = indexes.long
    texts = [normalised(t) for t in texts]
    for a, b in slices(texts):
        parts = [_points(t) for t in texts[a:b]]
        # no region within its budget reaches over a gap
        gap = 1 + max((int(i.edits.max(initial=0)) for i in kept), default=0)
        ends = np.cumsum([len(p) + gap for p in parts])
        whole = np.full(int(ends[-1]), _GAP, np.uint32)
        for p, e in zip(parts, ends):
            whole[e - gap - len(p) : e - gap] = p
        found: list[dict] = [{} for _ in parts]
        for n, index in enumerate(kept):
            if len(index.grams):
                probe, middle, edits = index.search(whole)
                owner = np.searchsorted(ends, middle, side="right")
                for p, o, e in zip(probe.tolist(), owner.tolist(), edits.tolist()):
                    found[o][n, p] = (min(e, found[o].get((n, p), (e,))[0]), int(index.item[p]))
        for row, text in zip(found, texts[a:b]):
            for n, ids in indexes.short.search(text):
                for i in ids:
                    row[-1 - n, i] = (0, i)
        yield a, b, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET, probe_words: int = PROBE_WORDS, stride: int = STRIDE, least_words: int = LEAST_WORDS, block_chars: int = 4 << 20) -> DataFrame:
    """One row for each row of docs(doc_id, text) against benchmark(item_id, text): doc_id, contaminated, n_items,
    n_probes, least_edits (null if clean), items (their ids, sorted and joined by commas).

    Texts are compared in lower case with white space as single blanks. A probe counts once however often
    it occurs. Items of fewer than `least_words` words and fewer than LEAST_CHARS characters are looked for as whole word sequences, without
    edits; null and empty items are not looked for. Texts of any length are read whole. A character of a script without blanks counts as half a word. Items with a null item_id count as item -1. Null or empty documents are clean; repeated rows are judged alike. Other
    columns are ignored; an empty table gives no rows.
    """
    cut = {"probe_words": probe_words, "stride": stride, "least_words": least_words}
    shared = _shared(benchmark, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Indexes([x.value for x in shared], q, budget, **cut)
        for rows in batches:
            ids = rows["doc_id"].to_pylist()
            for a, b, found in _found([t or "" for t in rows["text"].to_pylist()], kept):
                names = [sorted({i for _, i in f.values()}) for f in found]
                yield batch(
                    _OUT,
                    doc_id=ids[a:b],
                    contaminated=[bool(f) for f in found],
                    n_items=[len(x) for x in names],
                    n_probes=[len(f) for f in found],
                    least_edits=[min((e for e, _ in f.values()), default=None) for f in found],
                    items=[",".join(map(str, x)) for x in names],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT_DDL)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET, block_chars: int = 4 << 20) -> DataFrame:
    """The rows of docs(text, ...) that decontaminate() calls clean. All columns pass unchanged, whatever their names.

    Null and empty texts are clean; repeated rows stay or go together; an empty table or benchmark is no error.
    """
    shared = _shared(benchmark, block_chars)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Indexes([x.value for x in shared], q, budget)
        for rows in batches:
            clean = [not f for _, _, found in _found([t or "" for t in rows.column(at).to_pylist()], kept) for f in found]
            yield rows.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
