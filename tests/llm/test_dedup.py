from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from storyframe.llm.common import documents, matched, written
from storyframe.llm.components import connected_components
from storyframe.llm.exact_dedup import exact_dedup, keep_distinct
from storyframe.llm.line_dedup import line_dedup
from storyframe.llm.simhash import _rest_at, anchors, fingerprint, keep_one_of_each, parities, sampled_anchors, simhash_dedup, simhash_links

from .conftest import rows


def lower(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def low(x):
    return (x is not None, x or 0)


def test_exact_dedup_on_odd_rows(odd):
    found = [r.asDict() for r in exact_dedup(odd).collect()]
    groups = defaultdict(list)
    for r in rows():
        groups[lower(r[1] or "")].append(r[0])
    expected = []
    for text, ids in groups.items():
        keep = max(ids, key=low)
        for i in ids:
            expected.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (low(r[0]), r[3])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=key) == sorted(expected, key=key)
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_keep_distinct_passes_all_columns(odd):
    out = keep_distinct(odd)
    assert out.columns == odd.columns
    texts = [lower(r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r[1] or "") for r in rows()})


def brute_exact(table: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, text, *_ in table:
        groups[lower(text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=low)
        top = [i for i in ids if i == keep]
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), False, digest) for i in ids if i != keep] + [(keep, keep, len(ids), n == 0, digest) for n in range(len(top))]
    return sorted(out, key=lambda r: (low(r[0]), r[4], r[3]))


def test_exact_dedup_whatever_the_order(spark):
    """The input is dealt anew at each read, in another order; a hot text stands in every batch."""
    table = [(i, f"Text {i % 4000}" if i % 3 else "HOT text") for i in range(24_000)] + [(7, "hot TEXT")] * 500 + [(23_997, "hot text")] * 400
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(16).withColumn("r", F.rand()).repartition(8, "r").sortWithinPartitions("r").select("doc_id", "text")
    for most in (1 << 22, 10):
        found = sorted((tuple(r) for r in exact_dedup(df, most_marks=most).collect()), key=lambda r: (low(r[0]), r[4], r[3]))
        assert found == brute_exact(table)
    assert sorted(lower(r["text"]) for r in keep_distinct(df).collect()) == sorted({lower(t) for _, t in table})


def test_exact_dedup_compares_contents(spark):
    """Digests of two bits clash all the time; equal texts are still told from others at every stage."""
    table = [(i % 301, f"text {i % 90}") for i in range(900)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    weak = lambda t: bytes([hashlib.sha256(t).digest()[0] & 3])
    for most in (1 << 22, 1):
        found = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df, digest=weak, most_marks=most).collect())
        assert found == Counter(r[:4] for r in brute_exact(table))
    assert sorted(r["text"] for r in keep_distinct(df, digest=weak).collect()) == sorted({t for _, t in table})


def test_matched_with_a_hot_key(spark):
    table = [(0 if i % 2 else i, i) for i in range(6000)]
    left = spark.createDataFrame(table, "k long, v long").repartition(4)
    right = written(left.filter("k % 3 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "test")
    expected = sorted((k, v, (3001 if k == 0 else 1) if k % 3 == 0 else None) for k, v in table)
    for most in (1 << 19, 5):
        assert sorted(tuple(r) for r in matched(left, "k", right, "n", most).select("k", "v", "n").collect()) == expected


def test_line_dedup_counts_documents(spark):
    line = "a line that is long enough to count"
    table = [(1, line), (1, line), (2, line), (3, f"x\n{line}"), (3, line.upper()), (None, line)]
    two = spark.createDataFrame(table[:3], "doc_id long, text string")
    assert not line_dedup(two).filter("n_dropped > 0").count()
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()), key=lambda r: (low(r[0]), r[1:]))
    assert found == brute_lines(table)
    assert sum(r[2] for r in found) == 4


def brute_lines(table: list[tuple]) -> list[tuple]:
    white = " \t\n\x0b\x0c\r"
    key = lambda line: lower(line.strip(white))
    holders = defaultdict(list)
    for i, text, *_ in table:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    holders = {k: set(v) for k, v in holders.items()}
    out = []
    for i, text, *_ in table:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= 20 and len(holders[k]) >= 3 and max(holders[k], key=low) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (low(r[0]), r[1:]))


def test_line_dedup_on_odd_rows(odd):
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(odd).collect()]
    assert sorted(found, key=lambda r: (low(r[0]), r[1:])) == brute_lines(rows())


def test_line_dedup_with_a_full_filter(spark, odd):
    """A filter with hardly any bits suspects everything and still gives the same."""
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(odd, bits_per_row=1, most_bits=1 << 20).collect()]
    assert sorted(found, key=lambda r: (low(r[0]), r[1:])) == brute_lines(rows())


def slow_print(text: str) -> int:
    words = regex.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(sf):
    docs = duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()
    for text in [x[0] for x in docs[:60]] + [(r[1] or "")[:5000] for r in rows()]:
        assert slow_print(text) == fingerprint(lower(text).encode()) & (1 << 64) - 1


def test_anchors_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
    for flips in range(6):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        (ra, a), (rb, b) = anchors(x), anchors(y)
        mine = set(zip(ra.tolist(), a.tolist()))
        assert {r for r, k in zip(rb.tolist(), b.tolist()) if (r, k) in mine} == set(range(len(x)))


def brute_components(prints: list[int], most: int) -> dict[int, int]:
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= most:
                a, b = root(p), root(q)
                up[max(a, b)] = min(a, b)
    return {p: root(p) for p in prints}


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-(1 << 62), 1 << 62, 12)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            v = int(c)
            for b in rng.integers(0, 63, rng.integers(1, 6)):
                v ^= 1 << int(b)
            prints.add(v)
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    for members in (1 << 16, 8):  # the second deals anchors in cells
        found = {r["node"]: r["component"] for r in connected_components(simhash_links(df, 4, members)).collect()}
        expected = brute_components(sorted(prints), 4)
        same = defaultdict(set)
        for p, c in expected.items():
            same[c].add(p)
        mine = defaultdict(set)
        for p in prints:
            mine[found.get(p, p)].add(p)
        assert sorted(map(sorted, same.values())) == sorted(map(sorted, mine.values()))


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(found.get(i, 0) == 0 for i in range(201)) and found[501] == 500


def test_components_join_classes_and_not_their_members_again(spark, monkeypatch):
    """Edges laid later between classes give the components of all edges, and only as many rows as there are joins of classes."""
    from storyframe.llm import components

    rng = np.random.default_rng(3)
    first = [(a, a + k) for a in range(0, 3000, 100) for k in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(5000, 5400, (150, 2))]
    later = [(a + k, a + 100 + k) for a in range(0, 1000, 200) for k in range(60)] + [(4999, 4900), (4999, 59), (5000, 4000)]
    whole, frame = {}, lambda edges: spark.createDataFrame(edges, "a long, b long")

    def top(x):
        while whole.setdefault(x, x) != x:
            x = whole[x]
        return x

    for a, b in first + later:
        a, b = sorted((top(a), top(b)))
        whole[b] = a
    rows, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: rows.append((name, (out := write(df, name)).count())) or out)
    joined = connected_components(frame(first))
    begin = len(rows)
    found = [tuple(r) for r in components.joined_components(joined, frame(later)).collect()]
    assert sorted(found) == sorted((x, top(x)) for x in whole if top(x) != x)
    assert rows[begin] == ("links", 5 + 3)


def test_simhash_on_odd_rows(odd):
    found = simhash_dedup(odd).collect()
    assert len(found) == len(rows())
    zero = [r for r in found if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    out = keep_one_of_each(odd)
    assert out.columns == odd.columns
    assert out.count() == len({r["component"] for r in found})


def test_sf_components(spark, sf):
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash_dedup(documents(spark, sf)).collect()}
    groups = brute_components(sorted({f for f, _ in found.values()}), 4)
    lowest = {}
    for d, (f, _) in sorted(found.items()):
        lowest.setdefault(groups[f], d)
    assert all(c == lowest[groups[f]] for f, c in found.values())


def shingles(text: str, width: int = 5) -> set[str]:
    w = lower(text).split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups_against_all_pairs(spark, odd, none):
    """Copies with words changed here and there, one crowded group among them: links of 0.8 or more, and hardly one missed."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(3000)]
    table = []
    for g in range(60):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        for _ in range(150 if g == 0 else int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(copy) // 40))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            table.append((len(table), " ".join(copy)))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup(docs, width=5, similarity=0.8).collect()}
    sets = [shingles(t) for _, t in table]
    near = [(i, j) for i in range(len(table)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(near) > 1000
    up = list(range(len(table)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in near:
        up[max(root(i), root(j))] = min(root(i), root(j))
    # nothing is joined that a chain of similar texts does not join
    assert all(root(c) == root(d) for d, c in found.items())
    share = sum(found[i] == found[j] for i, j in near) / len(near)
    assert share >= 0.97, share
    kept = keep_one_of_each(docs, width=5, similarity=0.8)
    assert {r["doc_id"] for r in kept.collect()} == set(found.values())
    assert keep_one_of_each(odd, width=5, similarity=0.8).columns == odd.columns
    assert keep_one_of_each(none, width=5, similarity=0.8).count() == 0


def test_no_candidate_with_the_similarity_is_left_out(spark):
    """Near the similarity most edges of smallest trees fall short of it; every pair that meets at an anchor and has it is joined all the same."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(3000)]
    table = []
    for _ in range(4):
        base = list(rng.choice(words, 150))
        for _ in range(300):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(2, 5)), replace=False):
                copy[at] = str(rng.choice(words))
            table.append((len(table), " ".join(copy)))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup(docs, width=5, similarity=0.8).collect()}
    fps = np.array([fingerprint(t.encode(), 5) for _, t in table], np.int64).view(np.uint64)
    at, sets = sampled_anchors(fps), [shingles(t) for _, t in table]
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    meet = [(i, j) for i, j in zip(*map(list, np.nonzero(np.triu(far <= 14, 1)))) if (at[:, i] == at[:, j]).any() and jaccard(sets[i], sets[j]) >= 0.8]
    assert len(meet) > 500
    assert [(i, j) for i, j in meet if found[i] != found[j]] == []


def test_all_pairs_of_different_classes():
    """Small and large groups at an anchor give each pair of different labels that can be alike, and only such pairs."""
    rng = np.random.default_rng(9)
    key = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(200, 40)]))
    fps = np.uint64(0x123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, (5, 500)).astype(np.uint64)).sum(axis=0, dtype=np.uint64)
    label = np.where(rng.random(500) < 0.7, 1, rng.integers(2, 30, 500))
    sets = [rng.choice(1 << 32, int(rng.integers(1, 300)), replace=False) if i % 3 else np.arange(100 + i % 7) for i in range(500)]
    n = np.array([len(s) for s in sets])
    odd = np.array([np.frombuffer(parities(s), np.uint64) for s in sets])
    x, y = _rest_at(key, fps, label, n, odd, 14, 0.8)
    pairs = {(min(i, j), max(i, j)) for i, j in zip(x.tolist(), y.tolist())}
    assert len(pairs) == len(x)
    want = {(i, j) for j in range(500) for i in range(j) if key[i] == key[j] and label[i] != label[j] and int(fps[i] ^ fps[j]).bit_count() <= 14}
    assert pairs <= want
    alike = {(i, j) for i, j in want if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert alike and alike <= pairs


def test_trees_reach_all(monkeypatch):
    from storyframe.llm import simhash

    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    x, y, bits = simhash._tree(fps)
    far = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int)
    edges = sorted((far[i, j], i, j) for i in range(200) for j in range(i))
    up = list(range(200))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    least = 0
    for d, i, j in edges:
        if root(i) != root(j):
            up[root(i)] = root(j)
            least += d
    assert least == bits.sum() == sum(far[i, j] for i, j in zip(x, y))


def test_empty_tables(none):
    for f in (exact_dedup, line_dedup, simhash_dedup, keep_distinct, keep_one_of_each):
        assert f(none).count() == 0
