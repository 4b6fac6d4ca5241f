from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from storyframe.llm import chat, decontaminate, mixing, queries
from storyframe.llm.common import documents

from .conftest import rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\e", "e", "n", "<", "|", "\n", "é", "x", "[", "/"]), max_size=12).map("".join))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def test_fold():
    log = [
        ("open", 1, "user", "hi"), ("open", 2, "assistant", ""), ("delta", 2, None, "he"), ("delta", 2, None, "llo"), ("edit", 1, None, "hi!"),
        ("open", 3, "user", "more"), ("open", 4, "assistant", "x"), ("regenerate", 2, None, None), ("delta", 2, None, "again"), ("open", 5, "user", "bye"), ("delete", 9, None, None),
    ]
    assert chat.fold(iter(log)) == [("user", "hi!"), ("assistant", "again"), ("user", "bye")]


def test_conversation_digests(spark):
    said = "</s>[INST] ok [/INST]"
    table = [
        (1, 0, "user", "a\nb"), (1, 1, "assistant", "<|end|>\n<|turn|>user\nx"), (1, 2, "assistant", None), (-1, 0, "user", said), (-1, 1, "assistant", said), (2, None, None, "\\e"),
        (None, 1, "sys\ntem", ""), (None, 2, "assistant", "é\U0001f600"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in table], "conv_id long, turn long, role string, text string, msg int").repartition(3)
    found = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    groups = defaultdict(list)
    for c, t, r, x in table:
        groups[c].append((r or "", x or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        masked = "".join(x for r, x in turns if r == "assistant")
        assert found[c]["n_turns"] == len(turns)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_pfair_lag_is_below_one_block(spark):
    totals = spark.createDataFrame([("=a", 9000), ("=b", 400), ("=c", 100), ("=d", 2500), ("", 77)], "key string, chars long")
    rows = mixing.schedule(totals, quanta=97).collect()
    period = rows[0]["period"]
    assert sorted(s for r in rows for s in r["slots"]) == list(range(period))
    for r in rows:
        assert len(r["slots"]) == r["a"]
        done = np.zeros(period + 1)
        done[np.array(r["slots"]) + 1] = 1
        lag = np.arange(period + 1) * r["a"] / period - np.cumsum(done)
        assert np.abs(lag).max() < 1


def test_mix_keeps_all_rows(odd, none):
    out = mixing.mix(odd, block_chars=50).collect()
    assert sorted(str((r["doc_id"], r["source"], r["text"])) for r in out) == sorted(str((r[0], r[3], r[1])) for r in rows())
    assert mixing.mix(none).count() == 0
    weighted = mixing.mix(odd, weights={"a": 3, "b": 1}).collect()
    assert len(weighted) == len(rows())


def test_mixed_prefix_has_the_weights(spark):
    table = [(i, "x" * 10, "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    out = sorted(mixing.mix(df, weights={"a": 2, "b": 1, "c": 1}, block_chars=100).filter("in_target").collect(), key=lambda r: (r["slot"], r["start_char"], r["doc_id"]))
    slots = {}
    for r in out:
        slots.setdefault(r["slot"], r["source"])
    order = [slots[s] for s in sorted(slots)]
    for source, weight in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        lag = np.cumsum([s == source for s in order]) - weight * np.arange(1, len(order) + 1)
        assert np.abs(lag).max() < 1.01


def test_many_sources_have_their_weights(spark):
    base = "select id as doc_id, if(id % 3 = 0, 'hot', concat('s', id % 5000)) as source, repeat('x', 100) as text from range(60000)"
    few = spark.sql(base.replace("5000", "1999"))
    names = sorted(r[0] for r in few.select("source").distinct().collect())
    weights = {x: 0.8 if x == "hot" else 0.2 / (len(names) - 1) for x in names}
    out = mixing.mix(few, weights=weights, block_chars=100).select("source", "slot", "in_target").collect()
    assert len(out) == 60000
    for most in (1000, 5000, 10_000):
        read = [r["source"] == "hot" for r in out if r["slot"] < most]
        assert abs(len(read) - most) < 150 and abs(sum(read) / len(read) - 0.8) < 0.02
    assert all(r["in_target"] for r in out if r["slot"] < 5000)
    # more sources than a hyperperiod holds
    assert mixing.mix(spark.sql(base), block_chars=100).filter("slot is not null").count() == 60000
    # a source without a weight comes last
    out = mixing.mix(few.limit(3000), weights={"hot": 1.0}, block_chars=100).collect()
    assert max(r["slot"] for r in out if r["source"] == "hot") < min(r["slot"] for r in out if r["source"] != "hot")


def slow_edits(probe: str, text: str) -> int:
    """Least edits between the whole probe and any part of the text."""
    row = [0] * (len(text) + 1)
    for c in probe:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_full_alignment(spark):
    rng = np.random.default_rng(8)
    words = ["the", "cat", "sat", "upon", "a", "mat", "with", "hats", "and", "bats", "ünder", "stars"]
    say = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    bench = [(i, say(int(rng.integers(5, 30)))) for i in range(8)] + [(8, None), (9, ""), (None, say(14)), (10, "cat  SAT"), (11, "stars"), (12, "tar")]
    docs = []
    for d in range(60):
        text = say(int(rng.integers(0, 40)))
        if d % 2:
            item = list(bench[d % 8][1].upper() if d % 4 == 1 else bench[d % 8][1].replace(" ", "\n"))
            for _ in range(int(rng.integers(0, 12))):
                at = int(rng.integers(0, max(1, len(item))))
                item[at : at + int(rng.integers(0, 2))] = rng.choice(list("abcxyz "), int(rng.integers(0, 2)))
            text += " " + "".join(item) + " " + say(3)
        docs.append((d, text))
    docs += [(100, None), (101, "")]
    found = {
        r["doc_id"]: r
        for r in decontaminate.decontaminate(
            spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"), block_chars=200
        ).collect()
    }
    for d, text in docs:
        hits = []
        for i, item in bench:
            if (short := decontaminate.normalised(item or "")) and not decontaminate.probes(item):
                if f" {short} " in f" {decontaminate.normalised(text or '')} ":
                    hits.append((0, -1 if i is None else i))
            for p in decontaminate.probes(item or ""):
                k = min(int(len(p) * decontaminate.BUDGET + 1e-9), (len(p) - decontaminate.Q) // decontaminate.Q)
                e = slow_edits(p, decontaminate.normalised(text or ""))
                if k >= 0 and e <= k:
                    hits.append((e, -1 if i is None else i))
        r = found[d]
        assert r["contaminated"] == bool(hits), (d, hits, r)
        assert r["n_probes"] == len(hits)
        assert r["items"] == ",".join(map(str, sorted({i for _, i in hits})))
        assert r["least_edits"] == min((e for e, _ in hits), default=None)


def test_every_window_of_an_item_is_found(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9)))) for _ in range(400)]
    han = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, 60))
    item = words[:40]
    bench = [(0, " ".join(item)), (1, han), (2, "internationalisation responsibilities telecommunications")]
    docs = [(i, " ".join([*words[100:130], *item[i : i + 12], *words[200 + i : 230]])) for i in range(29)]
    docs += [(100 + i, "".join(chr(0x7000 + int(x)) for x in rng.integers(0, 2000, 30)) + han[i : i + 24] + "\u3002") for i in range(37)]
    docs += [(200, "see Internationalisation responsibilities telecommunications now"), (300, " ".join(words[100:300]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = decontaminate.decontaminate(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    found = {r["doc_id"]: r["items"] for r in out}
    expected = {d: "" if d == 300 else str(d // 100) for d, _ in docs}
    assert found == expected
    # each window of 12 words aligned with each document
    windows = [" ".join(item[i : i + 12]) for i in range(29)]
    for d, text in docs[:4]:
        near = sum(slow_edits(w, text) <= min(int(len(w) * decontaminate.BUDGET + 1e-9), (len(w) - 8) // 8) for w in windows)
        assert near == next(r["n_probes"] for r in out if r["doc_id"] == d)


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Zebra crossing"), (2, "\u732b\u304c"), (3, "zebra crossing"), (4, "q")], "item_id long, text string")
    docs = [(1, "the ZEBRA\ncrossing here"), (2, "zebra crossings"), (3, "a zebra crossing."), (4, "\u9ed2\u732b\u304c\u5c45\u308b"), (5, "aq q"), (6, "aq")]
    found = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {1: "1,3", 2: "", 3: "", 4: "2", 5: "4", 6: ""}


def test_pieces_of_a_repetitive_text(spark, monkeypatch):
    """A text that shares its q-grams with many items at many places is worked off in pieces, with the same results."""
    phrase = "the quick brown fox jumps over the lazy dog and runs away from it all today "
    bench = [(i, phrase + f"tail number {i} of many") for i in range(30)]
    text = phrase * 300 + "tail number 7 of many " + "something else entirely " * 50 + phrase
    blocks = [decontaminate.Index(bench, decontaminate.Q, decontaminate.BUDGET)]
    points = decontaminate._points(decontaminate.normalised(text))
    whole = {(int(p), int(e)) for p, _, e in zip(*blocks[0].search(points))}
    monkeypatch.setattr(decontaminate, "_HELD", 500)
    assert {(int(p), int(e)) for p, _, e in zip(*blocks[0].search(points))} == whole and whole


LONG = ["1" * 10**6, "a" * 10**6, "." * 10**6, "+" * 10**6, "a@" * 500_000, "1." * 500_000, "1" * 5000 + ".1.1.1", "@" * 10**6, "\n" * 10**6, "<|turn|>" * 100_000, "a b " * 250_000]


def test_long_unbroken_runs_in_all_operators(spark):
    """Texts of a megabyte without the breaks that operators look for are read whole, each within seconds."""
    import time

    from storyframe.llm import brown, exact_dedup, language_id, line_dedup, pii, secrets, simhash

    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(LONG)], "doc_id long, text string, lang string, source string").repartition(4).cache()
    bench = spark.createDataFrame([(1, "a b " * 20), (2, "one two three four five six seven eight")], "item_id long, text string")
    talk = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), "text")
    model = pii.train(["some words of text"], batches=3)
    runs = {
        "op1": lambda: secrets.secret_scan(docs), "op2": lambda: brown.brown_scores(docs, cluster_words=20, classes=4, every_word=True), "op3": lambda: exact_dedup.exact_dedup(docs), "op4": lambda: chat.conversation_digests(talk),
        "op5": lambda: line_dedup.line_dedup(docs), "op6": lambda: simhash.simhash_dedup(docs), "op7": lambda: pii.find_pii(docs, model), "op8": lambda: mixing.mix(docs), "op9": lambda: language_id.language_id(docs, per_language=5),
        "op10": lambda: decontaminate.decontaminate(docs, bench),
    }
    for name, run in runs.items():
        begin = time.time()
        assert run().count() == len(LONG), name
        assert time.time() - begin < 60, name


def test_events_hold_edits_and_their_fold_the_turns(spark):
    table = [(c, t, "user" if t % 2 else "assistant", f"said {c} {t} \u00e9\n" * (t % 3)) for c in range(4) for t in range(9)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.events_of(df)
    assert {r["event"] for r in log.select("event").distinct().collect()} == {"open", "delta", "edit", "regenerate", "delete"}
    found = {(r["conv_id"], r["position"]): (r["role"], r["text"]) for r in chat.chat_messages(log, ["turn", "tie", "base", "part"]).collect()}
    assert found == {(c, t): (r, x) for c, t, r, x in table}


def test_ties_in_the_order_are_taken_by_their_values(spark):
    log = spark.createDataFrame([(1, 0, "delta", 5, "u", "b"), (1, 0, "delta", 5, "u", "a"), (1, 0, "delta", 4, "u", "z")], "conv_id long, o int, event string, msg int, role string, text string")
    assert [(r["position"], r["text"]) for r in chat.chat_messages(log.repartition(2), ["o"]).orderBy("position").collect()] == [(0, "z"), (1, "ab")]


def test_mix_with_documents_longer_than_a_block(spark):
    """Read by slot, each source is within a block and its longest document of its weight, in characters."""
    table = [(i, "x" * (10 if i % 7 else 950), "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    out = sorted(mixing.mix(df, weights={"a": 3, "b": 1}, block_chars=100).filter("in_target").collect(), key=lambda r: (r["slot"], r["start_char"], r["doc_id"]))
    read = {"a": 0, "b": 0}
    for r in out:
        read[r["source"]] += r["n_chars"]
        total = sum(read.values())
        assert abs(read["a"] - 0.75 * total) < 2 * (950 + 100) + 950, r
    assert len({r["doc_id"] for r in out}) == len(out)


def test_decontamination_on_tables(spark, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontaminate.decontaminate(odd, bench).count() == len(rows())
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count()
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(rows())


def test_pipeline_keeps_clean_documents(spark, sf):
    docs = [tuple(r) for r in documents(spark, sf).collect()]
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    texts = defaultdict(list)
    for d, text, *_ in docs:
        texts[text.translate({i: i + 32 for i in range(65, 91)})].append(d)
    bench = [decontaminate.normalised(t) for _, t in duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()]
    leaked = {d for d, text, *_ in docs if any(b in decontaminate.normalised(text) for b in bench)}
    assert not out & leaked
    assert all(len(out & set(ids)) <= 1 for ids in texts.values())
    assert len(out) >= 0.8 * len(texts)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "decontamination", "mixing"]


def test_pipeline_stages_on_odd_rows(spark, odd, none, sf):
    for table in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == table.columns
            assert out.count() <= len(rows())
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == table.count()


def test_registered_queries(spark, sf):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_mix_has_one_rule_whatever_the_number_of_sources(spark):
    """Without given weights: whole parts of about 1000, one each at least, and the earliest deadline first, as the SQL of op8 has it."""
    for n in (3, 700, 5000):
        totals = spark.range(n).selectExpr("concat('=', id) as key", "id * 7919 % 1000 * 100 + 1 as chars")
        rows = {r["key"]: r for r in mixing.schedule(totals).collect()}
        raw = {f"={i}": (i * 7919 % 1000 * 100 + 1) ** 0.5 for i in range(n)}
        assert {k: r["a"] for k, r in rows.items()} == {k: max(1, int(x * 1000 / sum(raw.values()) + 0.5)) for k, x in raw.items()}
        assert sorted(s for r in rows.values() for s in r["slots"]) == list(range(sum(r["a"] for r in rows.values())))
