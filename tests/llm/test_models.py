from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np

from storyframe.llm import brown
from storyframe.llm.common import documents
from storyframe.llm.language_id import keep_known_language, language_id
from storyframe.llm.recurrent import Gru, Lstm, Tagger

from .conftest import rows


def crc(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def test_gradients_of_both_cells():
    rng = np.random.default_rng(0)
    for cell in (Gru, Lstm):
        t = Tagger(cell, 6, 3, 4)
        t.params = {k: v.astype(np.float64) for k, v in t.params.items()}
        x = rng.integers(0, 7, (5, 3))
        weight = rng.normal(size=(5, 3, 3))
        keep: dict = {}
        t.scores(x, keep)
        grads = t.gradients(x, keep, weight.astype(np.float64))
        for name in ("f.u", "b.x", "f.v", "c"):
            flat = t.params[name].reshape(-1)
            for i in rng.integers(0, flat.size, 4):
                old, e = flat[i], 1e-2
                flat[i] = old + e
                up = (t.scores(x, {}) * weight).sum()
                flat[i] = old - e
                down = (t.scores(x, {}) * weight).sum()
                flat[i] = old
                assert abs((up - down) / (2 * e) - grads[name].reshape(-1)[i]) < 2e-2 * max(1, abs(grads[name].reshape(-1)[i]))


def test_prediction_equals_training_scores():
    rng = np.random.default_rng(1)
    for cell in (Gru, Lstm):
        t = Tagger(cell, 20, 4, 5)
        x = rng.integers(0, 21, (30, 9))
        assert np.allclose(np.moveaxis(t.predict(x), 1, 2), t.scores(x, {}), atol=1e-4)


def test_language_accuracy_and_rows(spark, odd, none):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = language_id(docs, per_language=80).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if crc(d, 4) == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    out = {r["doc_id"]: r for r in language_id(odd, docs, per_language=20).collect()}
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} >= {3, 4, 5, 6}
    assert out[10]["lang_pred"] != "und"
    kept = keep_known_language(docs, per_language=20)
    assert kept.columns == docs.columns
    assert language_id(none).count() == 0
    assert {r["lang_pred"] for r in language_id(odd, none).collect()} == {"und"}


def test_letters_are_those_of_unicode():
    from storyframe.llm.language_id import has_letter

    assert not any(map(has_letter, ("", "12 !?", "\u00bd \u00b2 \u2167", "\u0661\u0662", "_", "\U0001f600")))
    assert all(map(has_letter, ("a", "1\u00e9", "\u4e2d", "\u02b0", "\u0915")))


def test_every_labelled_language_can_be_predicted(spark):
    """More languages than the commonest few hundred: each gives a document to the sample, and the one of a rare label is learned."""
    from storyframe.llm.language_id import training_rows

    table = [(i, f"text {i} of l{i % 230}", f"l{i % 230}") for i in range(1500)] + [(9000 + i, "x" * 20_000 + "z" * 300, "long") for i in range(8)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
    sample = training_rows(df, per_language=4, most_documents=500)
    have = {lang for i, _, lang in table if crc(i, 4) != 2}
    assert {lang for lang, _ in sample} == have and len(sample) <= 500
    assert max(len(t) for _, t in sample) <= 4096 and {t for lang, t in sample if lang == "long"} != {b"x" * 4096} or len(have) == 231


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(5)
    kind = np.array([0] + [1 + i % 3 for i in range(30)])
    step = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]])
    counts = np.zeros((31, 31))
    before = 0
    for _ in range(20000):
        now = int(rng.choice(np.flatnonzero(kind == int(step[kind[before]].argmax()))))
        counts[before, now] += 1
        before = now
    member = brown.exchange(counts, 4, 10)
    assert len({(a, b) for a, b in zip(kind, member)}) == 4


def brute_brown(table, head_words, cluster_words, classes, sweeps):
    """The same model from plain counts, a token at a time."""
    texts = [(i, (t or "").encode()) for i, t, *_ in table]
    train = [t for i, t in texts if crc(i, 5) != 1]
    count = Counter(w for t in train for w in brown.tokens(t))
    n, v = sum(count.values()), len(count)
    own = [brown.END] + [w for w, _ in sorted(((w, c) for w, c in count.items() if w != brown.END), key=lambda x: (-x[1], x[0]))[:cluster_words]]
    place = {w: i for i, w in enumerate(own)}
    symbol = lambda w: place[w] if w in place else len(own) + int(brown.groups_of([w])[0])
    size = len(own) + brown.GROUPS
    grid = np.zeros((size, size))
    for t in train:
        before = 0
        for w in brown.tokens(t):
            grid[before, symbol(w)] += 1
            before = symbol(w)
    member = brown.exchange(grid, classes, sweeps)
    k = member.max() + 1
    step = np.zeros((k, k))
    for a in range(size):
        for b in range(size):
            step[member[a], member[b]] += grid[a, b]
    seen = grid.sum(axis=0)
    out = []
    for i, t in texts:
        base = score = 0.0
        before = 0
        for w in brown.tokens(t):
            base += math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
            s = symbol(w)
            a, b = member[before], member[s]
            score += math.log10((step[a, b] + 0.5) / (step[a].sum() + 0.5 * k))
            mates = np.flatnonzero(member == b)
            score += math.log10((seen[s] + 0.5) / (seen[mates].sum() + 0.5 * len(mates)))
            if s >= len(own):
                rare = [c for x, c in count.items() if x not in place and symbol(x) == s]
                score += math.log10((count[w] + 0.5) / (sum(rare) + 0.5 * (len(rare) + 1)))
            before = s
        out.append((i, len(brown.tokens(t)), sum(w in count for w in brown.tokens(t)), base, score))
    return n, out


def test_scores_against_a_plain_model(spark, none):
    docs = documents(spark, "/root/testdata/sf0.001")
    table = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 800 order by doc_id limit 40").fetchall() + [(900001, None), (900002, ""), (900003, "zzz qqq")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    n, expected = brute_brown(table, 60, 20, 6, 3)
    found = {r["doc_id"]: r for r in brown.brown_scores(df, head_words=60, cluster_words=20, classes=6, sweeps=3).collect()}
    assert docs.count() and len(found) == len(table)
    for i, tokens, known, base, score in expected:
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, crc(i, 5) == 1)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6
    assert brown.brown_scores(none).count() == 0


def brute_every_word(table, cluster_words, classes, sweeps):
    """Each training word in a class by its neighbours, a token at a time."""
    texts = [(i, (t or "").encode()) for i, t in table]
    train = [[brown.END, *brown.tokens(t)] for i, t in texts if crc(i, 5) != 1]
    count = Counter(w for t in train for w in t[1:])
    own = [brown.END] + sorted((w for w in count if w != brown.END), key=lambda w: (-count[w], w))[:cluster_words]
    place = {w: i for i, w in enumerate(own)}
    symbol = lambda w: place[w] if w in place else len(own) + int(brown.groups_of([w])[0])
    grid = np.zeros((len(own) + brown.GROUPS,) * 2)
    for t in train:
        for x, y in zip(t, t[1:]):
            grid[symbol(x), symbol(y)] += 1
    member = brown.exchange(grid, classes, sweeps)
    size = member.max() + 1
    one = np.eye(size)[member]
    first = one.T @ grid @ one
    near = {w: np.zeros(2 * size) for w in count if w not in place}
    for t in train:
        for x, w, y in zip(t, t[1:], t[2:]):
            if w in near:
                near[w][member[symbol(x)]] += 1
                near[w][size + member[symbol(y)]] += 1
    kinds = {w: int(member[place[w]]) for w in own} | {w: int(brown.best_classes(x[None], first)[0]) for w, x in near.items()}
    kind = lambda w: kinds.get(w, int(member[symbol(w)]))
    step, mass = np.zeros((size, size)), np.full(size, 0.5)
    for t in train:
        for x, y in zip(t, t[1:]):
            step[kind(x), kind(y)] += 1
    for w, c in count.items():
        mass[kind(w)] += c + 0.5
    out = {}
    for i, t in texts:
        t = [brown.END, *brown.tokens(t)]
        out[i] = sum(math.log10((step[kind(x), kind(y)] + 0.5) / (step[kind(x)].sum() + 0.5 * size) * (count[y] + 0.5) / mass[kind(y)]) for x, y in zip(t, t[1:]))
    return out


def test_every_training_word_has_a_class(spark, odd, none):
    table = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 800 order by doc_id limit 40").fetchall() + [(900001, None), (900002, ""), (900003, "zzz qqq")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    expected = brute_every_word(table, 20, 6, 3)
    for head in (60, 100_000):
        found = brown.brown_scores(df, head_words=head, cluster_words=20, classes=6, sweeps=3, every_word=True).collect()
        plain = {r["doc_id"]: r for r in brown.brown_scores(df, head_words=head, cluster_words=20, classes=6, sweeps=3).collect()}
        assert len(found) == len(table)
        for r in found:
            assert abs(r["score"] - expected[r["doc_id"]]) < 1e-6
            assert r["n_known"] == plain[r["doc_id"]]["n_known"] and abs(r["base_score"] - plain[r["doc_id"]]["base_score"]) < 1e-6
    assert len(brown.brown_scores(odd, cluster_words=5, classes=3, every_word=True).collect()) == len(rows())
    assert brown.brown_scores(none, every_word=True).count() == 0


def test_scores_on_odd_rows(odd):
    found = brown.brown_scores(odd, cluster_words=5, classes=3).collect()
    assert len(found) == len(rows())
    assert all(r["n_tokens"] == len(brown.tokens((t or "").encode())) for r in found for i, t, *_ in rows() if i == r["doc_id"] and i not in (None,))
