"""LM scoring by a class-based bigram model with exchange clustering.

Words are lower-cased (A-Z) and cut at ASCII white space; every text ends in one end token. Training rows are those whose
crc32(doc_id as text) mod 5 is not 1. Counts of words and of neighbours cover all training text.

The `cluster_words` most frequent words and the end token are symbols of their own; all other words fall into
`GROUPS` groups by their last two bytes, which are symbols too. So neighbour counts have a fixed size whatever the corpus.
Exchange clustering moves one symbol at a time to the class that raises the likelihood of the class bigrams most, until
`sweeps` passes are done. With class k(s) of symbol s,

    log P(w | before) = log P(k(s) | k(before)) + log P(s | k(s)) + [for groups] log P(w | s),

each smoothed by adding a half, so unseen words and transitions have a probability. The perplexity of a text is 10^(-score / n_tokens).

Counts of words above a count that at most `head_words` words reach are broadcast; all other words of a text meet their counts
in a join, so the vocabulary may grow without bound.

With `every_word` groups serve only to cluster the head and for words not seen in training. Every other training word has a class of its own:
the one under which its neighbours' classes, counted over all training text, are most likely. Class bigrams are then
counted anew over all words, and log P(w | before) = log P(k(w) | k(before)) + log P(w | k(w)).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import batch, binary, remainder, slices, written

HEAD_WORDS, CLUSTER_WORDS, CLASSES, SWEEPS, GROUPS = 100_000, 1500, 48, 4, 64
END = b""
UNKNOWN = 255
_FLUSH = 300_000
_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_PARTS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
])
_PARTS_DDL = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, times array<int>"


_NEAR = pa.schema([("word", pa.binary()), ("slots", pa.list_(pa.int16())), ("times", pa.list_(pa.int32()))])
_CLASSED = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("k", pa.int32())])
_SEQUENCES = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
    ("classes", pa.binary()), ("which", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("guess", pa.list_(pa.int32())),
])
_SEQUENCES_DDL = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, classes binary, which array<int>, words array<binary>, times array<int>, guess array<int>"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for rows in batches:
        for text in binary(rows["text"]):
            found.update(tokens(text))
            if len(found) > _FLUSH:
                yield batch(_COUNTS, word=list(found), n=list(found.values()))
                found = Counter()
    if found:
        yield batch(_COUNTS, word=list(found), n=list(found.values()))


def groups_of(words: list[bytes]) -> np.ndarray:
    """The group of each word, from its last two bytes."""
    last = np.frombuffer(b"".join([w[-2:].rjust(2, b" ") for w in words]), dtype="<u2").astype(np.int64)
    return (last * 40503 & 0xFFFF) >> 10


class Vocabulary:
    """The broadcast words in order of (count, word), most frequent first: the first ones, with the end token, are symbols."""

    def __init__(self, counted: list[tuple[bytes, int]], cluster_words: int) -> None:
        counted = sorted(((w, n) for w, n in counted), key=lambda x: (x[0] != END, -x[1], x[0]))
        self.own = min(cluster_words + 1, len(counted))  # the end token comes first
        self.words = [w for w, _ in counted]
        self.counts = np.array([n for _, n in counted], np.int64)
        self.symbol = np.concatenate([np.arange(self.own), self.own + groups_of(self.words[self.own :])]) if len(counted) > self.own else np.arange(self.own)
        self.size = self.own + GROUPS

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def look(self, flat: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens: place among the words (-1: not there), symbol, and where those that are not there stand."""
        place = np.fromiter(map(index.get, flat, repeat(-1)), np.int32, len(flat))
        away = np.flatnonzero(place < 0)
        symbol = self.symbol[place]
        if len(away):
            symbol[away] = self.own + groups_of([flat[i] for i in away.tolist()])
        return place, symbol, away


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of symbols from their neighbour counts (before, after). Symbol 0, the end, keeps class 0 for itself."""

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    size = len(counts)
    classes = max(2, min(classes, size))
    total = counts.sum(axis=0) + counts.sum(axis=1)
    order = np.argsort(-total[1:], kind="stable") + 1
    member = np.zeros(size, np.int64)
    member[order] = 1 + np.arange(size - 1) % (classes - 1)
    one = np.zeros((size, classes))
    one[np.arange(size), member] = 1
    grid = one.T @ counts @ one
    after, before = counts @ one, counts.T @ one  # of each symbol, by class
    left, right = grid.sum(axis=1), grid.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for s in order:
            old, own = member[s], counts[s, s]
            out, into = after[s].copy(), before[s].copy()
            out[old] -= own
            into[old] -= own
            n_out, n_in = counts[s].sum(), counts[:, s].sum()
            grid[old] -= out
            grid[:, old] -= into
            grid[old, old] -= own
            left[old] -= n_out
            right[old] -= n_in
            base = f(grid)
            row, column = f(grid + out) - base, f(grid.T + into) - base.T
            gain = row.sum(axis=1) - np.diag(row) + column.sum(axis=1) - np.diag(column)
            gain += f(np.diag(grid) + out + into + own) - np.diag(base)
            gain -= f(left + n_out) - f(left) + f(right + n_in) - f(right)
            gain[0] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else int(old)
            grid[new] += out
            grid[:, new] += into
            grid[new, new] += own
            left[new] += n_out
            right[new] += n_in
            if new != old:
                moved += 1
                member[s] = new
                after[:, old] -= counts[:, s]
                after[:, new] += counts[:, s]
                before[:, old] -= counts[s]
                before[:, new] += counts[s]
        if not moved:
            break
    return member


class Model:
    """Log probabilities (base 10) of class transitions and symbols; `rest` is what a word of a group adds to log10(c + 0.5)."""

    def __init__(self, vocabulary: Vocabulary, member: np.ndarray, counts: np.ndarray, group_tokens: np.ndarray, group_words: np.ndarray) -> None:
        self.vocabulary, self.member = vocabulary, member
        classes = int(member.max(initial=0)) + 1
        one = np.zeros((len(member), classes))
        one[np.arange(len(member)), member] = 1
        grid = one.T @ counts @ one
        self.step = np.log10(grid + 0.5) - np.log10(grid.sum(axis=1, keepdims=True) + 0.5 * classes)
        seen = counts.sum(axis=0)
        self.symbol = np.log10(seen + 0.5) - np.log10((seen @ one + 0.5 * one.sum(axis=0)))[member]
        self.rest = np.zeros(len(member))
        self.rest[vocabulary.own :] = -np.log10(group_tokens + 0.5 * (group_words + 1))
        self.log_count = np.log10(vocabulary.counts + 0.5)
        self.grid, self.classes = grid, classes


def _totals(counts: DataFrame) -> tuple[int, int]:
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    return int(n or 0), int(v)


def fit(train: DataFrame, counts: DataFrame, head_words: int, cluster_words: int, classes: int, sweeps: int) -> Model:
    """From training rows (text) and their word counts (word, c)."""
    sc = train.sparkSession.sparkContext
    # sixteen steps to a doubling of the count: a bounded number of rows
    steps = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 1 << 30, 0
    for step, n in sorted(steps, reverse=True):
        if total + n > head_words:
            break
        least, total = step, total + n
    head = counts.filter((F.floor(F.log2("c") * 16) >= least) | (F.col("word") == F.lit(END)))
    vocabulary = Vocabulary([(bytes(w), n) for w, n in head.select("word", "c").collect()], cluster_words)  # head_words + 1 at most
    shared = sc.broadcast(vocabulary)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        index, total = v.index(), np.zeros(v.size * v.size, np.int64)
        for rows in batches:
            texts = binary(rows["text"])
            for a, b in slices(texts):
                flat = [END]
                for t in texts[a:b]:
                    flat += tokens(t)
                _, symbol, _ = v.look(flat, index)
                total += np.bincount(symbol[:-1].astype(np.int64) * v.size + symbol[1:], minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield batch(_PAIRS, pair=at[i : i + (1 << 16)], n=total[at[i : i + (1 << 16)]])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, tokens) and (GROUPS + group, words) of the words that are no symbols of their own."""
        v = shared.value
        own, total = set(v.words[: v.own]), np.zeros(2 * GROUPS, np.int64)
        for rows in batches:
            words, n = binary(rows["word"]), rows["c"].to_numpy(zero_copy_only=False)
            rare = np.flatnonzero([w not in own for w in words])
            if len(rare):
                group = groups_of([words[i] for i in rare.tolist()])
                total[:GROUPS] += np.bincount(group, n[rare], GROUPS).astype(np.int64)
                total[GROUPS:] += np.bincount(group, minlength=GROUPS)
        yield batch(_PAIRS, pair=np.arange(2 * GROUPS), n=total)

    size = vocabulary.size
    found = train.select("text").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size^2 rows at most
    matrix = np.zeros(size * size)
    matrix[found["pair"].to_numpy()] = found["n"].to_numpy()
    matrix = matrix.reshape(size, size)
    grouped = counts.mapInArrow(by_group, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    group = np.zeros(2 * GROUPS)
    for i, n in grouped:
        group[i] = n
    model = Model(vocabulary, exchange(matrix, classes, sweeps), matrix, group[:GROUPS], group[GROUPS:])
    model.head = least
    return model


def _parts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        v = model.vocabulary
        index = v.index()
        for rows in batches:
            texts, ids, held, row = binary(rows["text"]), rows["doc_id"].to_pylist(), rows["held_out"].to_pylist(), rows["row"].to_pylist()
            for a, b in slices(texts):
                flat: list[bytes] = [END]
                ends = []
                for t in texts[a:b]:
                    flat += tokens(t)
                    ends.append(len(flat) - 1)
                place, symbol, away = v.look(flat, index)
                here = np.append(model.log_count, 0.0)[place]  # the last, 0, is for place -1
                member = model.member[symbol]
                score = model.symbol[symbol] + model.rest[symbol] + np.where(symbol >= v.own, here, 0.0)
                score[1:] += model.step[member[:-1], member[1:]]
                # the end token before the first text is only context
                begins = np.array([0, *ends[:-1]]) + 1
                cut = lambda x: np.add.reduceat(x, begins).tolist()
                n = np.diff([0, *ends])
                places = np.searchsorted(away, begins).tolist() + [len(away)]
                rest = [Counter(flat[i] for i in away[x:y].tolist()) for x, y in zip(places, places[1:])]
                yield batch(
                    _PARTS,
                    row=row[a:b],
                    doc_id=ids[a:b],
                    held_out=held[a:b],
                    n_tokens=n,
                    known=cut((place >= 0).astype(np.int64)),
                    base=cut(here),
                    score=cut(score),
                    words=[list(c) for c in rest],
                    times=[list(c.values()) for c in rest],
                )

    return run


def _neighbours(shared):
    """(word, slots, times) of words that are no symbols: slot k is class k before the word, classes + k after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        v, wide = model.vocabulary, 2 * model.classes
        index = v.index()
        number: dict[bytes, int] = {}
        keys: list[np.ndarray] = []
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            words, begin = list(number), np.searchsorted(key, np.arange(len(number) + 1) * wide)
            for a in range(0, len(words), 1 << 16):
                b = min(len(words), a + (1 << 16))
                low, high, at = begin[a], begin[b], pa.array(begin[a : b + 1] - begin[a], pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x[low:high].astype(t))) for x, t in ((key % wide, np.int16), (n, np.int32))]
                yield batch(_NEAR, word=words[a:b], slots=lists[0], times=lists[1])

        for rows in batches:
            texts = binary(rows["text"])
            for a, b in slices(texts):
                flat = [END]
                for t in texts[a:b]:
                    flat += tokens(t)
                flat.append(END)
                _, symbol, _ = v.look(flat, index)
                k = model.member[symbol]
                at = np.flatnonzero(symbol[:-1] >= v.own)
                at = at[at > 0]
                if len(at):
                    who = np.array([number.setdefault(flat[i], len(number)) for i in at.tolist()], np.int64) * wide
                    keys += [who + k[at - 1], who + model.classes + k[at + 1]]
                    held += len(at)
                if len(number) > _FLUSH or held > 4 * _FLUSH:
                    yield from told()
                    number, keys, held = {}, [], 0
        if number:
            yield from told()

    return run


def best_classes(near: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For rows of neighbour-class counts (before, then after): the class, other than that of the end, that makes them most likely."""
    size = len(grid)
    before = np.log((grid + 0.5) / (grid.sum(axis=0) + 0.5 * size))
    after = np.log((grid.T + 0.5) / (grid.sum(axis=1) + 0.5 * size))
    gain = near @ np.concatenate([before, after])
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        wide = 2 * model.classes
        for rows in batches:
            slots, times = rows["slots"], rows["times"]
            n = slots.value_lengths().to_numpy(zero_copy_only=False)
            key = np.repeat(np.arange(len(n)) * wide, n) + slots.flatten().to_numpy(zero_copy_only=False)
            near = np.bincount(key, times.flatten().to_numpy(zero_copy_only=False), len(n) * wide).reshape(-1, wide)
            yield batch(_CLASSED, word=rows["word"].cast(pa.binary()), c=near[:, : model.classes].sum(axis=1).astype(np.int64), k=best_classes(near, model.grid))

    return run


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _lines(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bytes cut at bounds, as a binary array."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(flat, np.uint8))])


def _sequences(shared):
    """Each text's classes, beginning with that of the end token before it; UNKNOWN where one of `words` stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared.value
        v = model.vocabulary
        index = v.index()
        class_of = np.append(own, UNKNOWN).astype(np.uint8)  # the last is for place -1
        end = int(own[0]) if v.words[:1] == [END] else int(model.member[v.own + groups_of([END])[0]])
        for rows in batches:
            texts = binary(rows["text"])
            for a, b in slices(texts):
                flat: list[bytes] = []
                ends = [0]
                for t in texts[a:b]:
                    flat += tokens(t)
                    ends.append(len(flat))
                bounds = np.array(ends)
                place, symbol, away = v.look(flat, index)
                known = place >= 0
                number: dict[bytes, int] = {}
                word = np.array([number.setdefault(flat[i], len(number)) for i in away.tolist()], np.int64)
                owner = np.searchsorted(bounds, away, side="right") - 1
                # the different words of each text that are not broadcast
                pairs, which, times = np.unique(owner * max(1, len(number)) + word, return_inverse=True, return_counts=True)
                first = np.searchsorted(pairs, np.arange(b - a + 1) * max(1, len(number)))
                guess = np.zeros(max(1, len(number)), np.int32)
                guess[word] = model.member[symbol[away]]
                mine = pairs % max(1, len(number))
                tokens_at = np.searchsorted(away, bounds)
                yield batch(
                    _SEQUENCES,
                    row=rows["row"].slice(a, b - a),
                    doc_id=rows["doc_id"].slice(a, b - a),
                    held_out=rows["held_out"].slice(a, b - a),
                    n_tokens=np.diff(bounds),
                    known=np.add.reduceat(known.astype(np.int64), bounds[:-1]),
                    base=np.add.reduceat(np.append(model.log_count, 0.0)[place], bounds[:-1]),
                    classes=_lines(np.insert(class_of[place], bounds[:-1], end), bounds + np.arange(b - a + 1)),
                    which=_lists(pa.array(which - first[owner], pa.int32()), tokens_at),
                    words=_lists(pa.array(list(number), pa.binary()).take(pa.array(mine)), first),
                    times=_lists(pa.array(times, pa.int32()), first),
                    guess=_lists(pa.array(guess[mine], pa.int32()), first),
                )

    return run


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Values and bounds; null is an empty list."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(n)])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the classes of words that met their counts in a join into their places."""
    for rows in batches:
        lines = binary(rows["classes"])
        bounds = np.cumsum([0, *map(len, lines)])
        k = np.frombuffer(b"".join(lines), np.uint8).copy()
        (guess, first), (which, at), (found, had) = (_flat(rows[c]) for c in ("guess", "which", "found"))
        best = guess.to_numpy(zero_copy_only=False).astype(np.uint8)
        if len(found):
            no, new = (found.field(c).to_numpy(zero_copy_only=False) for c in ("no", "k"))
            best[np.repeat(first[:-1], np.diff(had)) + no] = new
        if len(which):
            k[np.flatnonzero(k == UNKNOWN)] = best[np.repeat(first[:-1], np.diff(at)) + which.to_numpy(zero_copy_only=False)]
        keep = [rows[c] for c in ("doc_id", "held_out", "n_tokens", "known", "base")]
        yield pa.RecordBatch.from_arrays([*keep, _lines(k, bounds)], names=["doc_id", "held_out", "n_tokens", "known", "base", "classes"])


def _every_word(source: DataFrame, train: DataFrame, model: Model, head: float, n: int, v: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base and score with a class for every training word; counts above `head` are broadcast."""
    sc = source.sparkSession.sparkContext
    first = sc.broadcast(model)
    near = train.select("text").mapInArrow(_neighbours(first), "word binary, slots array<short>, times array<int>")
    near = near.groupBy("word").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.flatten(F.collect_list("times")).alias("times"))
    classed = written(near.mapInArrow(_assign(first), "word binary, c long, k int"), "word-classes")
    vocabulary = model.vocabulary
    own = np.zeros(len(vocabulary.words), np.int64)
    own[: vocabulary.own] = model.member[: vocabulary.own]
    index = vocabulary.index()
    for word, k in classed.filter(F.floor(F.log2("c") * 16) >= head).select("word", "k").collect():  # head_words at most
        own[index[bytes(word)]] = k
    # tokens and words of each class
    size = model.classes
    mass = np.bincount(own[: vocabulary.own], vocabulary.counts[: vocabulary.own], size) + 0.5 * (np.bincount(own[: vocabulary.own], minlength=size) + 1)
    for k, t, w in classed.groupBy("k").agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[k] += t + 0.5 * w
    shared = sc.broadcast((model, own))
    lines = written(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sequences(shared), _SEQUENCES_DDL), "text-classes")
    rare = lines.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("no", "w")).select("row", "no", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    counted = rare.join(classed.withColumnRenamed("word", "known_word"), F.col("word") == F.col("known_word"), "left")
    sums = counted.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
        F.collect_list(F.when(F.col("k").isNotNull(), F.struct("no", "k"))).alias("found"),
    )
    both = lines.drop("words", "times").join(sums, F.col("row") == F.col("r"), "left")
    both = both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("known"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base"), "classes", "which", "guess", "found")
    both = written(both.mapInArrow(_resolved, "doc_id long, held_out boolean, n_tokens long, known long, base double, classes binary"), "text-all-classes")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for rows in batches:
            lines = binary(rows["classes"])
            k = np.frombuffer(b"".join(lines), np.uint8).astype(np.int64)
            step_of = k[:-1] * size + k[1:]
            total += np.bincount(step_of, minlength=size * size)
            # from the end of a text to the token before the next
            total -= np.bincount(step_of[np.cumsum([*map(len, lines)])[:-1] - 1], minlength=size * size)
        yield batch(_PAIRS, pair=np.arange(size * size), n=total)

    grid = np.zeros(size * size)
    for i, t in both.filter("not held_out").select("classes").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        grid[i] = t
    grid = grid.reshape(size, size)
    step = np.log10(grid + 0.5) - np.log10(grid.sum(axis=1, keepdims=True) + 0.5 * size) - np.log10(mass)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lines = binary(rows["classes"])
            k = np.frombuffer(b"".join(lines), np.uint8)
            first = np.cumsum([0, *map(len, lines)])[:-1]
            gain = np.append(step[k[:-1], k[1:]], 0.0)
            gain[first[1:] - 1] = 0.0  # from the end of a text to the token before the next
            score = rows["base"].to_numpy(zero_copy_only=False) + (np.add.reduceat(gain, first) if len(lines) else 0.0)
            yield batch(_SCORES, **{c: rows[c] for c in ("doc_id", "held_out", "n_tokens", "known", "base")}, score=score)

    return both.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double").select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def brown_scores(docs: DataFrame, head_words: int = HEAD_WORDS, cluster_words: int = CLUSTER_WORDS, classes: int = CLASSES, sweeps: int = SWEEPS, every_word: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    base_score: sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))) with the training counts c, their sum N and number
    V. score: the log10 probability of the text under the class model, with `every_word` that in which each training word has a class. Null texts count as empty, one end token. A null
    doc_id counts as the empty text for the split. Repeated rows count as so many documents. If no row is for training, all
    counts are 0. Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    train = source.filter(~F.col("held_out"))
    counts = train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = written(counts, "word-counts")
    n, v = _totals(counts)
    model = fit(train, counts, head_words, cluster_words, classes, sweeps)
    if every_word:
        return _every_word(source, train, model, model.head, n, v)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_parts(shared), _PARTS_DDL)
    parts = written(parts, "text-scores")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    counted = rare.join(counts.withColumnRenamed("word", "known_word"), F.col("word") == F.col("known_word"), "left")
    sums = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
    )
    out = parts.drop("words", "times").join(sums.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    rest = F.coalesce("rest", F.lit(0.0))
    score = F.col("score") + rest
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
