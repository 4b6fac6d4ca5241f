"""SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits and link at `threshold` differing bits or fewer. The 64 bits are cut into three parts; of up to
four or five differing bits, one part has at most one. The anchors of a part are the words of a covering code of radius 1: the
perfect Hamming code of length 15 on the first 15 bits, all words on the rest. Every fingerprint goes to each anchor
within radius + 1 = 2 of its part. If two fingerprints differ in at most one bit of that part, the anchor that covers the
one is within 2 of the other, so both meet there. At an anchor, members are compared over all 64 bits.

With a `similarity` more bits may differ than three parts find, so the same code is laid on sampled bits: SAMPLES sets of 15 bits take the
anchor that covers them (radius 1: exactly one), together with three more bits as they are. Members of an anchor that differ in at most
SIMILAR_BITS bits are candidates, and only those whose shingles have the Jaccard similarity are linked. Of pairs with 8, 10, 12 and 14 differing
bits 99.9, 98, 90 and 70 % share an anchor (simulated). First an anchor sends the edges of a smallest tree, so every candidate sends one or more.
Those that have the similarity make classes. Then each pair of candidates in different classes meets again at its anchors, where a tree had three rows or
more, and is compared, all but those that their parities rule out: sets with the similarity differ in few shingles, and the parities of their numbers in
each of 512 buckets differ in no more.

Equal fingerprints are one class before, so groups of copies cost one row. An anchor with more than `most_members`
members is dealt in cells: members are split into g cells and each pair of cells is compared in a task of its own. The
number of anchors is fixed by the code (fewer than 3 * 2^18), so their counts have a proven size.
Each comparison task sends only the links that join something new at its anchor, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyframe.llm.common import batch, binary, key_of, matched, ranges, written
from storyframe.llm.components import SALTS, connected_components, joined_components

THRESHOLD, SHINGLE = 4, 4
SAMPLES, SIMILAR_BITS, FEW, MANY, BUCKETS = 64, 14, 64, 1 << 12, 512
#: Classes that are broadcast; more are shuffled.
MOST_SENT = 1 << 16
#: doc_ids of candidates that are broadcast; with more their texts are shuffled.
MOST_IDS = 1 << 19
#: First bit and width of the three parts.
PARTS = ((0, 21), (21, 21), (42, 22))
_CODE = 15
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_AT = pa.schema([("anchor", pa.int64()), ("cell", pa.int32()), ("fp", pa.int64())])
_COUNTS = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_EDGES = pa.schema([*_LINKS, ("samples", pa.int64())])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Of a text that is in lower case already; 0 without words."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(i + 1 for i in blanks)], [*blanks, len(joined)]
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    digest, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        h = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])])
        total += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row of docs(doc_id, text), by shingles of `width` words. Null and empty texts have 0; texts of any length are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(_PRINTS, doc_id=rows["doc_id"], fp=[fingerprint(t.lower(), width) for t in binary(rows["text"])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes() -> np.ndarray:
    """The Hamming syndrome of every 15-bit word: the exclusive or of the (1-based) places of its bits."""
    words = np.arange(1 << _CODE)
    out = np.zeros(1 << _CODE, np.int64)
    for i in range(_CODE):
        out ^= np.where(words >> i & 1, i + 1, 0)
    return out


def _near_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words within 2 of every 15-bit word: where each word's begin, the code words, their distances."""
    words, syndrome = np.arange(1 << _CODE), _syndromes()
    at, code, far = [], [], []
    flips = [(0, 0)] + [(1 << i, 1) for i in range(_CODE)] + [(1 << i | 1 << j, 2) for i in range(_CODE) for j in range(i)]
    for flip, d in flips:
        hit = words[syndrome[words ^ flip] == 0]
        at.append(hit)
        code.append(hit ^ flip)
        far.append(np.full(len(hit), d))
    at, code, far = map(np.concatenate, (at, code, far))
    order = np.argsort(at, kind="stable")
    index = np.cumsum(syndrome == 0) - 1  # code words by their rank
    return np.searchsorted(at[order], np.arange((1 << _CODE) + 1)), index[code[order]], far[order]


_TABLE: list = []


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within 2 of one of the three parts of each fingerprint (uint64)."""
    if not _TABLE:
        _TABLE.append(_near_words())
    begin, code, far = _TABLE[0]
    rows, found = [], []
    for part, (low, width) in enumerate(PARTS):
        bits = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        word, rest, extra = bits & ((1 << _CODE) - 1), bits >> _CODE, width - _CODE
        n = begin[word + 1] - begin[word]
        row = np.repeat(np.arange(len(fps)), n)
        at = ranges(begin[word], n)
        for flip, d in [(0, 0)] + [(1 << i, 1) for i in range(extra)] + [(1 << i | 1 << j, 2) for i in range(extra) for j in range(i)]:
            ok = far[at] + d <= 2
            rows.append(row[ok])
            found.append((part << 18) | ((rest[row[ok]] ^ flip) << 11) | code[at[ok]])
    return np.concatenate(rows), np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each anchor among a task's rows."""
    total = np.zeros(len(PARTS) << 18, np.int64)
    for rows in batches:
        fps = rows["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(fps), 1 << 14):
            total += np.bincount(anchors(fps[a : a + (1 << 14)])[1], minlength=len(total))
    at = np.flatnonzero(total)
    for a in range(0, len(at), 1 << 16):
        yield batch(_COUNTS, anchor=at[a : a + (1 << 16)], n=total[at[a : a + (1 << 16)]])


class _Labels:
    """Union by arrays: root[i] is the smallest row that row i is joined to."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _close(fps: np.ndarray, key: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (in blocks) with equal key, which is sorted, and at most `most` differing bits."""
    ends = np.searchsorted(key, key, side="right")
    left = np.arange(len(key))
    lag = 1
    while len(left := left[left + lag < ends[left]]):
        near = np.bitwise_count(fps[left] ^ fps[left + lag]) <= most
        yield left[near], left[near] + lag
        lag += 1


def _links(key: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Joins of rows that meet at an anchor (equal key) and link there: each row with the first of its component."""
    labels = _Labels(len(key))
    sizes = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)))
    large = np.repeat(sizes > 512, sizes)
    few = np.flatnonzero(~large)
    for x, y in _close(fps[few], key[few], most):
        labels.join(few[x], few[y])
    for k in np.unique(key[large]):
        # chunks of the 64 bits, one more than the differing bits: one chunk is equal
        many = np.flatnonzero(key == k)
        for c in range(most + 1):
            low, high = 64 * c // (most + 1), 64 * (c + 1) // (most + 1)
            chunk = ((fps[many] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
            order = many[np.argsort(chunk, kind="stable")]
            for x, y in _close(fps[order], np.sort(chunk, kind="stable"), most):
                labels.join(order[x], order[y])
    moved = np.flatnonzero(labels.root != np.arange(len(key)))
    return moved, labels.root[moved]


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (anchor, cell); the last group of a batch waits for the next."""
        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(n: int) -> pa.RecordBatch:
            x, y = _links(key[:n], fps[:n], most)
            pairs = np.unique(np.stack([fps[x].view(np.int64), fps[y].view(np.int64)], axis=1), axis=0)
            return batch(_LINKS, a=pairs[:, 0].copy(), b=pairs[:, 1].copy())

        for rows in batches:
            anchor, cell, fp = (rows[c].to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "fp"))
            key = np.concatenate([key, (anchor.astype(np.int64) << 32) | cell])
            fps = np.concatenate([fps, fp.view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut >= 1 << 14:
                yield linked(cut)
                key, fps = key[cut:], fps[cut:]
        if len(key):
            yield linked(len(key))

    return run


def simhash_links(prints: DataFrame, threshold: int = THRESHOLD, most_members: int = 1 << 16) -> DataFrame:
    """For prints(fp long) without repeats: links (a, b) between fingerprints whose components are those of all links.

    Any threshold up to 5 is met: of five differing bits one of three parts has at most one.
    """
    if threshold > 5:
        raise ValueError("three parts of radius 2 find up to five differing bits")
    spark = prints.sparkSession
    counts = prints.select("fp").mapInArrow(_count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    crowded = counts.filter(F.col("n") > most_members).collect()  # anchors are fixed in number
    grids = spark.sparkContext.broadcast({a: -(-n // most_members) + 1 for a, n in crowded})

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = rows["fp"].to_numpy(zero_copy_only=False)
            for a in range(0, len(fps), 1 << 12):
                f = fps[a : a + (1 << 12)]
                row, anchor = anchors(f.view(np.uint64))
                cell = np.zeros(len(row), np.int64)
                if grids.value:
                    grid = np.array([grids.value.get(x, 1) for x in anchor.tolist()])
                    again = np.repeat(np.arange(len(row)), grid)
                    other = ranges(np.zeros(len(row), np.int64), grid)
                    mine = (((f[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % grid)[again]
                    row, anchor, cell = row[again], anchor[again], (np.minimum(mine, other) << 15) | np.maximum(mine, other)
                yield batch(_AT, anchor=anchor, cell=cell.astype(np.int32), fp=f[row])

    at = prints.select("fp").mapInArrow(replicate, "anchor long, cell int, fp long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = at.repartition(parts, "anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def sampled_anchors(fps: np.ndarray) -> np.ndarray:
    """(SAMPLES, rows): the anchor of each fingerprint in each sample of its bits."""
    if len(_TABLE) < 2:
        if not _TABLE:
            _TABLE.append(_near_words())
        begin, code, far = _TABLE[0]
        one = np.flatnonzero(far <= 1)  # a word is within 1 of one code word
        rng = np.random.default_rng(17)
        _TABLE.append((code[one], [rng.permutation(64)[: _CODE + 3] for _ in range(SAMPLES)]))
    nearest, bits = _TABLE[1]
    out = np.empty((SAMPLES, len(fps)), np.int64)
    plain = [((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) for b in range(64)]
    for n, at in enumerate(bits):
        word = sum(plain[b] << i for i, b in enumerate(at[:_CODE]))
        rest = sum(plain[b] << i for i, b in enumerate(at[_CODE:]))
        out[n] = n << 14 | rest << 11 | nearest[word]
    return out


def _tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, differing bits) of the edges of a smallest spanning tree, in time of the rows squared and memory of the rows."""
    left, up = np.arange(1, len(fps)), np.zeros(len(fps) - 1, np.int64)
    far = np.bitwise_count(fps[1:] ^ fps[0])
    x, y, bits = (np.empty(len(left), np.int64) for _ in range(3))
    for n in range(len(left)):
        k = int(far.argmin())
        x[n], y[n], bits[n] = left[k], up[k], far[k]
        new = left[k]
        left[k], up[k], far[k] = left[-1], up[-1], far[-1]
        left, up, far = left[:-1], up[:-1], far[:-1]
        now = np.bitwise_count(fps[left] ^ fps[new])
        closer = now < far
        far = np.where(closer, now, far)
        up[closer] = new
    return x, y, bits


def _forest(n: int, x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the pairs of n rows are the edges of smallest trees: every tree takes its shortest way out, until none has one."""
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((y, x, bits))] = np.arange(len(x))
    of = np.argsort(rank)
    labels, chosen, left = _Labels(n), [np.zeros(0, np.int64)], np.arange(len(x))
    while True:
        a, b = labels.root[x[left]], labels.root[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return np.concatenate(chosen)
        best = np.full(n, len(x), np.int64)
        np.minimum.at(best, a, rank[left])
        np.minimum.at(best, b, rank[left])
        chosen.append(of[np.unique(best[best < len(x)])])
        labels.join(x[chosen[-1]], y[chosen[-1]])


def _stars(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) of at most `most` differing bits, one or more for each row that has any; of rows that are all close, a few for each."""
    left, x, y = np.arange(len(fps)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[left[0]]) <= most)
        near = near[near != left[0]]
        x.append(np.full(len(near), left[0]))
        y.append(near)
        left = left[1:][~np.isin(left[1:], near)]
    return np.concatenate(x), np.concatenate(y)


def _pairs_at(key: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (row, row, whether their tree has more rows than these) of smallest trees over the pairs of rows with equal key, which is sorted, and at
    most `most` differing bits. A key that more than MANY rows have gives stars instead. Every row of such a pair has an edge; trees of more than two
    rows can leave out pairs, for _rest_at() to find.
    """
    sizes = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)))
    few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    none = np.zeros(0, np.int64)
    found = list(_close(fps[few], key[few], most))
    x, y = (np.concatenate([none, *(few[f[i]] for f in found)]) for i in (0, 1))
    chosen = _forest(len(key), x, y, np.bitwise_count(fps[x] ^ fps[y]))
    x, y = [x[chosen]], [y[chosen]]
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > FEW):
        rows = np.arange(ends[i] - sizes[i], ends[i])
        # in an order that is the same at all anchors
        rows = rows[np.argsort(fps[rows] * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
        if len(rows) > MANY:
            a, b = _stars(fps[rows], most)
        else:
            a, b, far = _tree(fps[rows])
            a, b = a[far <= most], b[far <= most]
        x.append(rows[a])
        y.append(rows[b])
    x, y, trees = np.concatenate(x), np.concatenate(y), _Labels(len(key))
    trees.join(x, y)
    return x, y, np.bincount(trees.root, minlength=len(key))[trees.root[x]] > 2


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each bucket: whether the number of hashes in it is odd."""
    return np.packbits(np.bincount(hashes % BUCKETS, minlength=BUCKETS).astype(np.uint8) & 1).tobytes()


def _can_be_alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, odd: np.ndarray, similarity: float) -> np.ndarray:
    """False for pairs of rows whose shingles, by their number n and their parities, differ in more than sets with the Jaccard similarity do."""
    out = np.empty(len(x), bool)
    for i in range(0, len(x), 1 << 14):
        a, b = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
        apart = np.maximum(np.abs(n[a] - n[b]), np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64))
        out[i : i + (1 << 14)] = apart <= (n[a] + n[b]) * (1 - similarity) / (1 + similarity) + 1e-6
    return out


def _rest_at(key: np.ndarray, fps: np.ndarray, label: np.ndarray, n: np.ndarray, odd: np.ndarray, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with equal key, which is sorted, different labels and at most `most` differing bits that can have the similarity."""
    sizes = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)))
    few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(x: np.ndarray, y: np.ndarray) -> None:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        ok = _can_be_alike(x, y, n, odd, similarity)
        xs.append(x[ok])
        ys.append(y[ok])

    for x, y in _close(fps[few], key[few], most):
        add(few[x], few[y])
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > FEW):
        rows = np.arange(ends[i] - sizes[i], ends[i])
        labels, of, members = np.unique(label[rows], return_inverse=True, return_counts=True)
        # rows of the largest class meet no other of it
        largest = of == members.argmax()
        rows = np.concatenate([rows[~largest], rows[largest]])
        for k in range(int((~largest).sum())):
            later = rows[k + 1 :]
            later = later[np.bitwise_count(fps[later] ^ fps[rows[k]]) <= most]
            add(np.full(len(later), rows[k]), later)
    return np.concatenate(xs), np.concatenate(ys)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with a fingerprint, fp, by its sampled anchors; with a column samples only by those of the samples whose bits it has."""
    names = rows.columns

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1 << 10):
                part = b.slice(a, 1 << 10)
                fps = part["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
                wanted = part["samples"].to_numpy(zero_copy_only=False).view(np.uint64) if "samples" in names else np.full(len(fps), 2**64 - 1, np.uint64)
                for anchor in np.split(sampled_anchors(fps), SAMPLES // 4):
                    at, row = np.nonzero((wanted >> (anchor[:, :1] >> 14).astype(np.uint64)) & np.uint64(1))
                    some = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[at, row]), *some.columns], names=["anchor", *names])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("anchor", T.LongType()), *rows.schema.fields])
    return rows.mapInArrow(replicate, schema).repartition(parts, "anchor").sortWithinPartitions("anchor")


def candidates(prints: DataFrame, most: int = SIMILAR_BITS) -> DataFrame:
    """For prints(fp long) without repeats: pairs (a, b), a < b, of fingerprints that share a sampled anchor and differ in at most `most` bits; of each
    fingerprint that has such pairs one or more, not all. samples: bits of the samples at whose anchors there can be others for a and b.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last group of a batch waits for the next."""
        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def pairs(n: int) -> pa.RecordBatch:
            x, y, more = _pairs_at(key[:n], fps[:n], most)
            samples = np.where(more, np.uint64(1) << (key[x] >> 14).astype(np.uint64), np.uint64(0)).view(np.int64)
            x, y = fps[x].view(np.int64), fps[y].view(np.int64)
            return batch(_EDGES, a=np.minimum(x, y), b=np.maximum(x, y), samples=samples)

        for rows in batches:
            key = np.concatenate([key, rows["anchor"].to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, rows["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut >= 1 << 14:
                yield pairs(cut)
                key, fps = key[cut:], fps[cut:]
        if len(key):
            yield pairs(len(key))

    edges = _dealt(prints.select("fp")).mapInArrow(compare, "a long, b long, samples long")
    return edges.groupBy("a", "b").agg(F.bit_or("samples").alias("samples"))


def other_candidates(rows: DataFrame, similarity: float, most: int = SIMILAR_BITS) -> DataFrame:
    """For rows(fp long, label long, n long, odd binary, samples long) without repeats: all pairs (a, b), a < b, of fingerprints that share an anchor of a sample
    of both, differ in at most `most` bits, have different labels and by their numbers of shingles, n, and parities, odd, can have the similarity.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last group of a batch waits for the next."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BUCKETS // 64), np.uint64)]

        def pairs(n: int) -> pa.RecordBatch:
            x, y = (held[1][i].view(np.int64) for i in _rest_at(*(x[:n] for x in held), most, similarity))
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return batch(_LINKS, a=both[:, 0].copy(), b=both[:, 1].copy())

        for b in batches:
            fresh = [b[c].to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "label", "n")]
            fresh[1] = fresh[1].view(np.uint64)
            fresh.append(np.frombuffer(b"".join(b["odd"].to_pylist()), np.uint64).reshape(-1, BUCKETS // 64))
            held = [np.concatenate(x) for x in zip(held, fresh)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut >= 1 << 14:
                yield pairs(cut)
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield pairs(len(held[0]))

    return _dealt(rows.select("fp", "label", "n", "odd", "samples")).mapInArrow(compare, "a long, b long").distinct()


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles that fingerprint() counts. Of a thousand shingles two share one in about one text of 9,000,
    which moves a similarity by a thousandth.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.uint32)
    found = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x, 42) for x in found), np.uint32, len(found)))


def similar_components(docs: DataFrame, classes: DataFrame, width: int, similarity: float) -> DataFrame:
    """connected_components() of the links between fingerprints of classes(fp, rep) whose texts (of docs, with doc_id rep) have the Jaccard similarity of shingles: of
    candidates() those that have it, which make classes, and of pairs in different classes all that have it, which join classes.
    """
    pairs = written(candidates(classes.select("fp")), "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes.select("fp", "rep"), "fp").select(key_of("rep").alias("_id"), F.col("fp").alias("_fp"))
    needed = written(needed, "candidate-texts")
    texts = docs.select(key_of("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    if needed.count() <= MOST_IDS:
        needed = F.broadcast(needed)
    ids = needed.select("_id")
    schema = pa.schema([("id", pa.string()), ("fp", pa.int64()), ("n", pa.int64()), ("odd", pa.binary()), ("hashes", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            low = [t.lower() for t in binary(rows["text"])]
            found = [shingle_hashes(t, width) for t in low]
            yield batch(schema, id=rows["id"], fp=[fingerprint(t, width) for t in low], n=[len(h) for h in found], odd=[parities(h) for h in found], hashes=[h.tobytes() for h in found])

    found = texts.join(ids, F.col("id") == F.col("_id"), "left_semi").mapInArrow(hashed, "id string, fp long, n long, odd binary, hashes binary")
    found = found.join(needed, (F.col("id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi").drop("id").dropDuplicates(["fp"])
    found = written(found, "candidate-shingles")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for x, y in zip(rows["x"].to_pylist(), rows["y"].to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), assume_unique=True))
                union = (len(x) + len(y)) // 4 - both
                keep.append(both >= similarity * union)
            yield batch(_LINKS, a=rows["a"], b=rows["b"]).filter(pa.array(keep, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        met = pairs.join(found.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(found.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
        return met.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")

    joined = connected_components(written(linked(pairs), "tree-links"))
    labels = joined.select(F.col("node").alias("fp"), F.col("component").alias("label"))
    open_ = pairs.filter("samples <> 0").select(F.explode(F.array("a", "b")).alias("fp"), "samples").groupBy("fp").agg(F.bit_or("samples").alias("samples"))
    labelled = found.select("fp", "n", "odd").join(open_, "fp").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return joined_components(joined, linked(written(other_candidates(labelled, similarity), "other-candidates")))


def simhash_dedup(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id, component.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a fingerprint bit is 1 if set in over half of
    the XXH64 values (seed 42) of all shingles of `width` words. component_id is the smallest doc_id that links reach; null only
    if all doc_ids reached are null. component is the group's smallest fingerprint, as a signed number. A null or empty text has fingerprint zero and links like any other. Repeated rows
    share a fingerprint. Other columns are ignored; an empty table gives no rows.

    With a similarity, fingerprints link where the sets of shingles of their texts have that Jaccard similarity, not at a number of bits; equal
    fingerprints are one class all the same.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    links = connected_components(simhash_links(classes.select("fp"), threshold)) if similarity is None else similar_components(docs, classes, width, similarity)
    links = links.unionByName(links.select("component").distinct().withColumn("node", F.col("component")))  # the least node has no row of its own
    linked = classes.join(links, F.col("fp") == F.col("node"))
    # a component may hold a large share of all classes: they meet its least doc_id by salts
    lowest = linked.groupBy("component").agg(F.min("rep").alias("component_id")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("component", "c")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    named = linked.join(lowest, (F.col("component") == F.col("c")) & (salt == F.col("s"))).select("fp", "n", "component", "component_id")
    named = written(named, "linked-classes")
    alone = classes.select("fp", "rep", F.col("n").alias("rows"))
    known = matched(matched(prints, "fp", alone, "rows", MOST_SENT), "fp", named, "n", MOST_SENT)
    own = F.col("component").isNull()
    return known.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(own, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "fp").alias("component"))


def keep_one_of_each(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Of each group of simhash_dedup() one row of docs(doc_id, text, ...), of the smallest doc_id. All columns pass unchanged.

    Null and empty texts are one group; of rows that repeat doc_id and fingerprint any one stays; a null doc_id stays only where its group has
    no other. An empty table gives no rows. The groups' kept fingerprints meet the rows by doc_id, of which each has few rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"))
    at = docs.columns.index("text")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.lower(), width) for t in binary(b.column(0).field(at))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], names=["row", "doc_id", "fp"])

    first = simhash_dedup(docs, threshold, width, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component").agg(F.min(F.struct("fingerprint", "doc_id")).alias("f")).select(key_of(F.col("f.doc_id")).alias("kept_id"), F.col("f.fingerprint").alias("kept_fp"))
    rows = rows.mapInArrow(prints, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])).withColumn("fp", F.lower(F.lpad(F.hex("fp"), 16, "0"))).withColumn("doc_id", key_of("doc_id"))
    rows = rows.join(first, (rows["doc_id"] == first["kept_id"]) & (rows["fp"] == first["kept_fp"]), "left_semi")
    # rows that repeat both doc_id and fingerprint
    return rows.dropDuplicates(["doc_id", "fp"]).select("row.*")
