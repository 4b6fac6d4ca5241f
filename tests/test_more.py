"""Operators that SQL does not cover: compositions, stored tables, streams, and the plain form of folds."""

from __future__ import annotations

import datetime
import json
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from storyframe.functions import text as T
from storyframe.operators import analysis, attribution, batching, chapters, jobs, roster, series, voices
from storyframe.plans import fixtures as X
from storyframe.plans import more  # noqa: F401  adds its queries
from storyframe.plans.queries import ORACLES, QUERIES
from storyframe.sources import books, html, tables
from storyframe.streaming import jobs as streams

ROOT = Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_chunks(counts, target, overlap):
    out, start = [], 0
    while start < len(counts):
        end, words = start, 0
        while end < len(counts):
            words += counts[end]
            end += 1
            if words >= target:
                break
        out.append((start, end))
        if end >= len(counts):
            break
        back, words = end, 0
        while back > start + 1:
            back -= 1
            words += counts[back]
            if words >= overlap:
                break
        start = max(start + 1, back)
    return out


def test_chunk_bounds_against_a_plain_walk(spark):
    import random

    rng = random.Random(4)
    table = [(i, [rng.choice((0, 0, 1, 5, 30, 200)) for _ in range(rng.randrange(0, 25))]) for i in range(300)]
    df = spark.createDataFrame(table, "id long, counts array<int>")
    for target, overlap in ((50, 10), (1, 1), (200, 100), (30, 40)):
        found = {r["id"]: [(b["begin"], b["end"]) for b in r["b"]] for r in df.select("id", batching.chunk_bounds(F.col("counts"), target, overlap).alias("b")).collect()}
        assert found == {i: plain_chunks(c, target, overlap) for i, c in table}


def test_scene_groups(spark):
    groups = lambda *p: one(spark, batching.scene_groups(F.array(*map(F.lit, p))))
    assert groups("a", "***", "b", "c", "\t---", "#", "d") == [["a"], ["b", "c"], ["d"]]
    assert groups("***", "") == [[]] and groups("a") == [["a"]]


def test_excerpt_leaves_the_rest_of_a_division_out(spark):
    p = [f"p{i} " + "w " * 9 for i in range(12)] + [" "]
    text = one(spark, batching.excerpt(F.array(*map(F.lit, p)), 50))
    assert [x[:3].strip() for x in text.split("\n\n[...]\n\n")] == ["p0", "p2", "p4", "p6", "p8"]
    assert one(spark, batching.excerpt(F.array(F.lit("a b"), F.lit("")), 50)) == "a b\n\n"


def test_pronouns_and_hours(spark):
    assert [one(spark, T.eta_text(F.lit(s))) for s in (3720, 64, 5, 0, -1)] == ["1h 2m", "1m 4s", "5s", "—", "—"]
    assert [one(spark, T.normalize_pronoun(F.lit(v))) for v in ("M", "woman", "her", "he/they", None)] == ["he/him", "she/her", "she/her", "", ""]


def test_hub_addresses(spark):
    got = lambda u: one(spark, T.split_hf_url(F.lit(u)))
    long = "hf://u/r/" + "x" * 9000
    assert tuple(got("hf://u/r")) == ("u", "r", "voice.wav") and len(got(long)["path"]) == 9000
    assert got("hf:///r/x") is None and got("http://u/r") is None


def test_preset_help_and_legacy_apply(spark):
    chapters.register_preset("long-only", lambda t: t["is_chapter"], "only long ones")
    assert "  long-only       - only long ones" in chapters.preset_help().split("\n")
    df = chapters.with_tags(spark.createDataFrame([("Preface", ["a"]), ("One", ["b " * 40])], "title string, paragraphs array<string>"))
    assert chapters.apply_preset(df, "long-only").count() == 1 and chapters.apply_preset(df, "no such").count() == 2


def test_next_free_name():
    have = {"a/x.m4b", "a/x_1.m4b", "a/y_7.m4b", "z"}
    free = lambda p: jobs.next_free_name(p, have.__contains__)
    assert [free(p) for p in ("a/x.m4b", "a/y_7.m4b", "a/q.m4b", "z")] == ["a/x_2.m4b", "a/y_8.m4b", "a/q.m4b", "z_1"]


def test_conflicts_of_others_take_female_voices(spark):
    people = spark.createDataFrame([(1, "A", "he", 9, 0), (1, "B", "they", 5, 1), (1, "C", "he", 3, 2), (1, "D", "", 1, 3)], "book_id long, character_id string, pronoun string, prominence long, ord long")
    cast = people.select("book_id", "character_id", F.lit("m1").alias("voice"))
    scene = people.select("book_id", F.lit(1).alias("chapter_idx"), "character_id")
    pool = spark.createDataFrame([(["m1", "m2"], ["f1"])], "male array<string>, female array<string>")
    found = {r["character_id"]: r["voice"] for r in voices.resolve_conflicts(cast, scene, people, pool, "n").collect()}
    assert found == {"A": "m1", "B": "f1", "C": "m2", "D": "m1"}
    left = voices.conflict_warnings(cast, scene, people, pool, "n").collect()
    assert [(r["character_id"], r["other"], r["voice"], r["chapter_idx"]) for r in left] == [("D", "A", "m1", 1)]


def plain_overlap(a, b):
    x, y = set(a.split()), set(b.split())
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return sum(w in y or (len(w) >= 3 and any(v.startswith(w) for v in y)) for w in x) / len(x) if x else 0.0


def test_series_fold_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    words = ["ann", "anna", "bob", "bobby", "cole", "dee", "d", "of", "the", "fox", "foxglove"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 4))).title()
    for _ in range(6):
        entries = [("s", i, name(), [name() for _ in range(rng.randrange(3))], rng.choice(("v", "", None))) for i in range(6)]
        cast = [("s", name() + (f" {i}" if i % 2 else ""), [name() for _ in range(rng.randrange(3))], rng.choice(("w", "x", "", None)), rng.random() < 0.3, i) for i in range(25)]
        state = [[c, list(a), v] for _, _, c, a, v in entries]
        for _, who, aliases, voice, pinned, _ in cast:
            if not voice:
                continue
            if pinned:
                for e in state:
                    if e[0].lower() == who.lower():
                        had = {x.lower() for x in e[1]}
                        e[2] = voice
                        e[1] += [x for x in aliases if x.lower() not in had]
                        break
                continue
            mine = {x.lower() for x in (who, *aliases)}
            near = lambda e: max([1.0] if mine & (theirs := {x.lower() for x in (e[0], *e[1])}) else [plain_overlap(a, b) for a in mine for b in theirs], default=0.0)
            if not any(near(e) >= 0.7 for e in state):
                state.append([who, list(aliases), voice])
        out = series.upsert_series(
            spark.createDataFrame(entries, "series string, char_ord long, canonical string, aliases array<string>, voice string"),
            spark.createDataFrame(cast, "series string, character_id string, aliases array<string>, voice string, pinned boolean, ord long"),
        )
        assert [[r["canonical"], r["aliases"], r["voice"]] for r in out.orderBy("char_ord").collect()] == state


def test_match_contents_against_all_pairs(spark):
    left = ["Chapter One", "Prologue", "Part2", "第一章", "a", "***", "", "hapter o", "The Long Road!"]
    right = ["ChapterOne", "Prologues", "Part 2", "转到第一章尾", "xyz", "b *** c", "chapter   one", "long-road", "***"]
    toc = spark.createDataFrame([(1, i, t) for i, t in enumerate(left)], "book_id long, toc_idx long, title string")
    parts = spark.createDataFrame([(1, i, t) for i, t in enumerate(right)] + [(2, 0, "Chapter One")], "book_id long, part_ord long, title string")
    import re

    sq = lambda t: re.sub(r"[\W_]+", "", t.lower())
    within = lambda a, b: b.lower() in a.lower() or (sq(b) and sq(b) in sq(a))
    expected = {}
    for i, a in enumerate(left):
        hits = [j for j, b in enumerate(right) if a and b and (within(a, b) or within(b, a))]
        if hits:
            expected[i] = hits[0]
    assert {r["toc_idx"]: r["part_ord"] for r in books.match_contents(toc, parts).collect()} == expected


def test_mobi_compression_and_broken_files(spark):
    from storyframe.plans import ebooks

    text = "é plain text " * 40 + "abcdefgh" * 9 + "\x01\x02"
    assert books._palmdoc(ebooks.packed(text.encode())).decode() == text
    assert books._palmdoc(bytes([0xC1])) == b" A"
    for packed in (False, True):
        book = books.read_mobi("x.mobi", ebooks.mobi(3, "http://x/" + "y" * 5000, packed))
        assert [c["title"] for c in book["chapters"]] == ["The One", "The Two"] and book["meta"]["title"] == "Mobi 3"
    rows = spark.createDataFrame([("/b/a.mobi", "1", bytearray(b"not a book")), ("/b/b.epub", "1", bytearray(b"PK"))], "path string, mtime string, content binary")
    assert all(r["error"] for r in books.read_books(rows).collect())


def test_parts_without_contents():
    body = "<p>" + "word " * 30 + "</p>"
    parts = [("cover.html", body), ("b1.html", f"<h1>Volume I</h1><h2>Chapter 1. Start</h2>{body}<h2>II. Next</h2>{body}"), ("notes.html", "<p>Notes</p>" + body)]
    found = books.split_parts(parts)
    assert [c["title"] for c in found] == ["Volume I, Chapter 1: Start", "Volume I, II: Next", "notes"]
    assert books.part_of({"href": "b1.html#x".split("#")[0], "title": "?"}, parts) == parts[1][1]
    assert books.part_of({"href": "zzz", "title": "B 1"}, parts) == parts[1][1]
    assert books.part_of({"href": "zzz", "title": "nothing"}, parts) is None


def test_prose_cascade():
    prose = lambda h: html.prose(html.tree(h))
    assert prose("<section><h2>T i</h2>loose<p>one <i>two</i></p><p>x</p></section><p>out</p>") == ["T i", "one \x02two\x03"]
    assert prose("<div>outer <p>inner</p></div><p>" + "w " * 60 + "</p>")[0] == "outer inner"
    assert prose("<b>intro</b><b>ANN LEE:</b> hi<b>BOB:</b> yo") == ["intro", "ANN LEE: | hi", "BOB: | yo"]
    assert prose("first line\nsecond line\nx") == ["first line", "second line"]


def test_roster_tiers(spark):
    texts = spark.createDataFrame([(1, "Ann Lee met Bob. He saw Zed."), (2, "Cy Fox ran. Cy sat. Mia saw her, and her, and her."), (3, "Only Dee here, as she ran.")], "book_id long, text string")
    outside = json.dumps({"characters": [{"id": 4, "g": {"argmax": "her"}, "mentions": {"proper": [{"n": "Ann Lee", "c": 2}, {"n": "Ann", "c": 1}], "common": []}}]})
    external = spark.createDataFrame([(1, outside), (9, "{broken")], "book_id long, json string")
    sampled = spark.createDataFrame([(1, "Zed"), (2, "Cy Fox"), (2, "Nobody")], "book_id long, name string")
    found = {(r["book_id"], r["canonical"]): (r["aliases"], r["pronoun"]) for r in roster.build_roster(texts, external=external, sampled=sampled).collect()}
    assert found == {(1, "Ann Lee"): (["Ann Lee", "Ann"], "he/him"), (2, "Cy Fox"): (["Cy Fox"], "she/her"), (3, "Only Dee"): (["Only Dee"], "she/her")}


def test_analysis_keeps_the_text(spark, sf):
    d = X.dialogue(spark, sf).filter("chapter_idx < 6")
    steps: list[str] = []
    people, segments = analysis.run_analysis(d, progress=steps.append, target=40, overlap=10)
    assert steps == ["Scanning", "Extracting quotes", "Attributing"]
    spoken = {}
    for r in segments.orderBy("chapter_idx", "seg_idx").collect():
        spoken.setdefault(r["chapter_idx"], []).append(r["text"])
    for r in d.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("p")).collect():
        had = "".join("".join(x["text"] for x in r["p"]).translate({2: None, 3: None}).split())
        assert "".join("".join(spoken[r["chapter_idx"]]).split()).replace("***", "") == had.replace("***", "")
    rows = people.orderBy("book_id", "ord").collect()
    assert all(r["prominence"] == (r["mention_count"] or r["quote_count"]) for r in rows)
    assert sum(r["quote_count"] for r in rows) > 0


def test_attribution_carries_the_last_chunk_and_asks_again(spark):
    asked: list[dict] = []
    path = "/tmp/storyframe-asked.jsonl"
    Path(path).unlink(missing_ok=True)

    def provider(prompt):
        with open(path, "a") as f:
            f.write(prompt + "\n")
        q = json.loads(prompt)["quotes"]
        return json.dumps([{"quote_id": x["quote_id"], "speaker": f"S{x['quote_id']}", "emotion": "sad", "confidence": 4} for x in q if x["quote_id"] != 2] + [{"quote_id": 99, "speaker": "?", "confidence": 5}])

    quotes_of = lambda *ids: [{"quote_id": i, "text": f"q{i}"} for i in ids]
    rows = [(1, 1, 0, "t0", ["A"], quotes_of(0, 1, 2)), (1, 1, 1, "t1", ["A"], []), (1, 1, 2, "t2", ["A"], quotes_of(2, 3))]
    df = spark.createDataFrame(rows, "book_id long, chapter_idx long, chunk_idx int, text string, names array<string>, quotes array<struct<quote_id:long,text:string>>")
    out = attribution.last_chunk_wins(attribution.attribute(df, provider, threshold=3, reviewer=lambda p: json.dumps([{"quote_id": 2, "speaker": "R", "confidence": 2}])))
    assert {r["quote_id"]: (r["speaker"], r["confidence"]) for r in out.collect()} == {0: ("S0", 4), 1: ("S1", 4), 2: ("R", 2), 3: ("S3", 4)}
    asked = [json.loads(x) for x in Path(path).read_text().splitlines()]
    assert [a["carried"] for a in asked[:2]] == ["S0, S1", "(start of chapter)"] or [a["carried"] for a in asked[:2]] == ["(start of chapter)", "(start of chapter)"]
    Path(path).unlink()


def test_cache_or_scan_and_annotated_chapters(spark, tmp_path):
    made: list[int] = []

    def make(missing):
        made.append(missing.count())
        return missing.withColumn("chapter_idx", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("title", F.concat(F.lit("c"), "chapter_idx"))

    path = str(tmp_path / "cache")
    first = spark.createDataFrame([("h1", "/a"), ("h2", "/b")], "book_hash string, path string")
    assert analysis.cached_or(spark, path, first, make).count() == 6
    more = spark.createDataFrame([("h1", "/a"), ("h2", "/moved"), ("h3", "/c")], "book_hash string, path string")
    assert sorted((r["book_hash"], r["path"]) for r in analysis.cached_or(spark, path, more, make).select("book_hash", "path").distinct().collect()) == [("h1", "/a"), ("h2", "/moved"), ("h3", "/c")]
    assert made == [2, 2]
    assert [r["chapter_idx"] for r in analysis.annotated_chapters(spark, path, "h1", [3, 1]).collect()] == [1, 3]
    with pytest.raises(FileNotFoundError):
        analysis.annotated_chapters(spark, path, "h9")


def test_queue_is_kept_and_taken_over(spark, tmp_path):
    legacy = tmp_path / "old.json"
    legacy.write_text('{"job_id": 1, "first_seq": 5, "status": "processing"}\n{broken\n{"job_id": 2, "first_seq": 6, "status": "failed", "extra": 1}\n')
    path = str(tmp_path / "queue")
    for _ in range(2):
        assert {(r["job_id"], r["status"]) for r in tables.load_queue(spark, path, str(legacy)).collect()} == {(1, "pending"), (2, "failed")}
    assert not legacy.exists()
    tables.save_queue(jobs.removable(tables.load_queue(spark, path)).filter("job_id = 2"), path + "2")
    assert tables.load_queue(spark, path + "2").count() == 1
    assert tables.load_queue(spark, str(tmp_path / "none")).count() == 0


def test_config_resolution(tmp_path):
    (tmp_path / "mine.toml").write_text('voice = "bo"\n')
    (tmp_path / "bad.toml").write_text("= broken")
    folder = str(tmp_path)
    assert tables.resolve_config(None, folder).name == "default-config.toml"
    assert tables.resolve_config("mine", folder) == tmp_path / "mine.toml" == tables.resolve_config(str(tmp_path / "mine.toml"), folder)
    defaults = {"voice": "alba", "temp": 0.7}
    assert tables.load_config("mine", folder, defaults) == {"voice": "bo", "temp": 0.7}
    assert tables.load_config("bad", folder, defaults) == tables.load_config("absent", folder, defaults) == defaults


def test_json_results_hold_no_nulls(spark, tmp_path):
    df = spark.createDataFrame([("k1", None, ["a", None]), ("k2", 2, [])], "key string, n long, list array<string>")
    tables.put_json(df, str(tmp_path / "j"), "key")
    found = sorted(json.loads(r["value"])["key"] + r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert len(found) == 2 and not any("null" in x for x in found)


def test_chapter_metadata_file(spark, tmp_path):
    line = batching.timeline(spark.createDataFrame([("b", 1, "One", 1000), ("b", 2, "Two", 500)], "book_id string, chapter_idx long, title string, duration_ms long"))
    tables.write_chapter_metadata(line, str(tmp_path / "meta"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "meta")).collect())
    assert "START=1000\nEND=1500\ntitle=Two" in text


def test_adjacent_repeats(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "b")], "book_id long, chapter_idx long, voice string")
    assert [(r["book_id"], r["chapter_idx"]) for r in voices.adjacent_repeats(df).filter("repeats").collect()] == [(1, 2)]


def test_eta_and_manifest_order(spark):
    assert one(spark, jobs.eta_seconds(F.lit(100), F.lit(40), F.lit(7.0))) == 8 and one(spark, jobs.eta_seconds(F.lit(100), F.lit(40), F.lit(0.0))) is None
    m = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "series string, updated_at long")
    assert [r["series"] for r in series.ordered_manifests(m).collect()] == ["b", "c", "a"]


def _run(df, spark, name, rounds, feed):
    query = df.writeStream.format("memory").queryName(name).outputMode("update").start()
    try:
        for rows in rounds:
            feed(rows)
            query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_late_tasks_are_evicted_at_once(spark, tmp_path):
    folder = tmp_path / "tasks"
    folder.mkdir()
    at = lambda m: datetime.datetime(2024, 1, 1, 10, 0, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=m)
    n = [0]

    def feed(rows):
        n[0] += 1
        lines = [json.dumps({"task_id": t, "status": s, "created_at": at(c).isoformat(), "updated_at": at(u).isoformat()}) for t, s, c, u in rows]
        (folder / f"{n[0]}.json").write_text("\n".join(lines))

    stream = spark.readStream.schema("task_id long, status string, created_at timestamp, updated_at timestamp").json(str(folder))
    rounds = [[(1, "run", 0, 1)], [(2, "run", 100, 130)], [(3, "run", 5, 131), (4, "run", 120, 131)], [(5, "x", 131, 131)]]
    found = _run(streams.live_tasks(stream), spark, "late_tasks", rounds, feed)
    assert (1, "run") in found and (1, "evicted") in found
    assert (3, "evicted") in found and (3, "run") not in found
    assert (4, "run") in found and (2, "run") in found


def test_worker_progress_stream_equals_the_batch(spark, tmp_path):
    folder = tmp_path / "workers"
    folder.mkdir()
    rounds = [
        [(1, 1, "START", "A", 9, 0), (1, 2, "UPDATE", None, None, 2), (2, 3, "UPDATE", None, None, 5)],
        [(1, 4, "UPDATE", None, None, 3), (1, 5, "DONE", None, None, 0), (2, 6, "START", "B", 4, 0)],
        [(2, 7, "ERROR", None, None, 0), (2, 8, "UPDATE", None, None, 1), (1, 9, "LOG", None, None, 0)],
    ]
    schema = "pid long, seq long, event string, title string, total long, batches long"
    n = [0]

    def feed(rows):
        n[0] += 1
        names = [c.split()[0] for c in schema.split(", ")]
        (folder / f"{n[0]}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))

    found = _run(streams.worker_progress(spark.readStream.schema(schema).json(str(folder))), spark, "worker_rows", rounds, feed)
    last = {r[0]: r for r in found}
    batch = jobs.progress_by_worker(spark.createDataFrame([r for x in rounds for r in x], schema))
    assert last == {r["pid"]: tuple(r) for r in batch.select("pid", "title", "total", "current", "completed_batches", "completed_chapters", "errors").collect()}


def test_library_without_the_subpackage(tmp_path):
    """A copy without the two folders and the pipeline imports, and its own queries are all there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_an_import_error_of_another_kind_is_raised(tmp_path):
    """Only a missing subpackage is forgiven, not a missing module that it needs."""
    if not (ROOT / "storyframe" / "llm").exists():
        pytest.skip("the subpackage is not there")
    code = "import sys; sys.modules['ahocorasick'] = None\ntry:\n    import __spark_entry__\nexcept ImportError:\n    sys.exit(7)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 7


def test_queries_meet_their_sql_on_odd_tables(spark, tmp_path):
    """Letters outside ASCII beside pronouns, pages that share an address, tables of several files."""
    talk = [(i, 1, "user", f"Eve enähe sheü {w}") for i, w in enumerate(("he", "thé", "sée", "her", "éhis", "they", "Eve", "himä", "she", "x", "Ann", "y"))]
    tables = {
        "conversations": (talk, "conv_id long, turn int, role string, text string"),
        "pages": ([(3, "http://a/"), (6, "http://a/"), (7, "http://a/"), (8, "http://b/"), (9, "http://c/")], "page_id long, url string"),
    }
    con = duckdb.connect()
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in "benchmark customer documents embeddings events labels lineitem nation orders part region supplier".split():
        (tmp_path / f"{name}.parquet").write_bytes(b"x")
    for name in ("a5_gender", "j10_roster_titles", "s1_find_files", "s2_count_files"):
        found = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert found == sorted(con.execute(ORACLES[name]).fetchall()), name
    assert books.count_books(spark, str(tmp_path), suffixes=[".parquet"]) > 14


def test_equal_titles_are_compared_once(spark):
    """Twenty thousand entries and as many parts of one title: 400 million pairs, of which one is compared."""
    import time

    rows = spark.range(20_000).select(F.lit(1).alias("book_id"), F.col("id").alias("n"), F.lit("The Same Title").alias("title"))
    begin = time.time()
    found = books.match_contents(rows.withColumnRenamed("n", "toc_idx"), rows.withColumnRenamed("n", "part_ord")).groupBy("part_ord").count().collect()
    assert [tuple(r) for r in found] == [(0, 20_000)]
    assert time.time() - begin < 30


def test_casts_of_large_books_take_time_in_proportion(spark):
    """Twelve thousand characters of a book by a plain walk; a fold that copies what it has so far takes minutes."""
    import time

    n = 12_000
    male, female = ["m1", "m2", "m3"], ["f1", "f2"]
    people = spark.range(n).selectExpr("'b' as book_id", "concat('C', id) as character_id", "element_at(array('he', 'she', 'they', ''), cast(id * 7 % 4 + 1 as int)) as pronoun", "id * 31 % 101 as prominence", "id as ord")
    pool = spark.createDataFrame([(male, female)], "male array<string>, female array<string>")
    begin = time.time()
    found = {r["character_id"]: r["voice"] for r in voices.suggest_cast(people, pool, "n").collect()}
    assert time.time() - begin < 20
    expected, m, f, mq, fq = {}, 0, 0, 0, 0
    for i in sorted(range(n), key=lambda i: (-(i * 31 % 101), i)):
        kind = ("he", "she", "they", "")[i * 7 % 4]
        if kind == "he" or kind != "she" and mq <= fq:
            expected[f"C{i}"], m, mq = male[m % 3], m + 1, mq + i * 31 % 101
        else:
            expected[f"C{i}"], f, fq = female[f % 2], f + 1, fq + i * 31 % 101
    assert found == expected


def test_casts_with_unknown_prominence(spark):
    people = spark.createDataFrame([(1, "A", "he", None, 0), (1, "B", "", 5, 1), (1, "C", "she", 3, 2)], "book_id long, character_id string, pronoun string, prominence long, ord long")
    for male, female, expected in (["m"], ["f"], "mff"), (["m"], [], "mmn"), ([], ["f"], "nff"):
        pool = spark.createDataFrame([(male, female)], "male array<string>, female array<string>")
        found = {r["character_id"]: r["voice"] for r in voices.suggest_cast(people, pool, "n").collect()}
        assert "".join(found[c] for c in "ABC") == expected


def test_series_meet_by_the_words_that_can_score(spark, monkeypatch):
    """Names with a common word, and words with a common beginning, are not compared in all pairs."""
    calls = []
    own = series.score
    monkeypatch.setattr(series, "score", lambda a, b: calls.append(1) or own(a, b))
    entries = [{"canonical": f"Customer#{i:06}", "aliases": [f"Old Customer#{i:06}"], "voice": "v"} for i in range(0, 3000, 3)]
    cast = [{"character_id": f"Customer#{i:06}", "aliases": [f"Old Customer#{i:06}"], "voice": "w", "pinned": False} for i in range(3000)]
    out = series._entries_after(entries, cast, series.MATCH)
    assert sorted(e["canonical"] for e in out) == [f"Customer#{i:06}" for i in range(3000)] and len(calls) < 10_000
    rows = [("s", c["character_id"], c["aliases"]) for c in cast]
    people = spark.createDataFrame(rows, "series string, character_id string, aliases array<string>")
    known = spark.createDataFrame([("s", i, e["canonical"], e["aliases"], "v") for i, e in enumerate(entries)], "series string, char_ord int, canonical string, aliases array<string>, voice string")
    keys = series._keyed(people, "character_id", series._names(F.col("character_id"), F.col("aliases")), series.MATCH, True)
    met = keys.join(series._keyed(known, "char_ord", series._names(F.col("canonical"), F.col("aliases")), series.MATCH, False), ["series", "key"])
    assert met.count() < 20_000
    assert {r["character_id"] for r in series.match_series(people, known).collect()} == {f"Customer#{i:06}" for i in range(0, 3000, 3)}


def test_series_candidates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = ["ann", "anna", "annabel", "bo", "b", "bobby", "cole", "de", "of", "the", "fox", "foxglove", "été", "étéa"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 6))).title()
    mine = [("s", f"{name()} {i}" if i % 3 else name() + "  " * (i % 2) + f"\t{i}", [name() for _ in range(rng.randrange(3))]) for i in range(60)]
    theirs = [("s", i, name(), [name() for _ in range(rng.randrange(3))], "v") for i in range(40)]
    a = spark.createDataFrame(mine, "series string, character_id string, aliases array<string>")
    b = spark.createDataFrame(theirs, "series string, char_ord int, canonical string, aliases array<string>, voice string")

    def plain(x, y):
        x, y = {n.lower() for n in x}, {n.lower() for n in y}
        return 1.0 if x & y else max(plain_overlap(p, q) for p in x for q in y)

    scores = {(c, i): plain((c, *al), (d, *bl)) for _, c, al in mine for _, i, d, bl, _ in theirs}
    for least in (0.0, 0.5, 0.7, 1.0):
        found = {(r["character_id"], r["char_ord"]): r["score"] for r in series.candidates(a, b, least).collect()}
        assert found == {k: v for k, v in scores.items() if v > 0 and v >= least}


def test_texts_meet_only_the_names_they_have(spark):
    """Names with letters outside ASCII, in any case, signs at their ends and none but signs; counts as of all pairs."""
    import re

    names = ["Ann", "Ann Archer", "ANN-Marie", "Élodie", "İlk Adam", "Straße", "(Bob", "Bob)", "***", "d'Or", "Анна", "x1", "of the"] + [f"Name{i}" for i in range(300)]
    lines = ["ann archer met ÉLODIE of the street, her STRAẞE", "Bob) said x1 (Bob anna АННА he", "annmarie ann-marie a***b D'OR", "ilk adam. They, İLK ADAM", "Ann_ Anń Ann", "Name7 he he they"]
    aliases = spark.createDataFrame([("b", n, n) for n in names], "book_id string, canonical string, alias string")
    texts = spark.createDataFrame([("b", x) for x in lines], "book_id string, text string")
    met = {r["text"]: {p["alias"] for p in r["people"]} for r in roster._met(texts, aliases, "alias", "canonical", "alias").collect()}
    assert all(len([n for n in found if n.startswith("Name")]) == (t == lines[-1]) for t, found in met.items())
    every = texts.crossJoin(aliases)
    pattern = F.concat(F.lit(r"(?iu)\b"), T.quoted_pattern(F.col("alias")), F.lit(r"\b"))
    expected = {r["canonical"]: r["n"] for r in every.groupBy("canonical").agg(F.sum(F.regexp_count("text", pattern)).alias("n")).collect()}
    assert {r["canonical"]: r["mention_count"] for r in roster.mention_counts(aliases, texts).collect()} == expected
    assert expected["İlk Adam"] == 2 and expected["Straße"] == 1 and expected["***"] == 1
    people = aliases.select("book_id", "canonical", F.array("alias").alias("aliases"))
    for ascii_words in (False, True):
        flags = re.IGNORECASE | (re.ASCII if ascii_words else 0)
        plain = {n: dict.fromkeys(roster.PRONOUNS, 0) for n in names}
        for n in names:
            for x in lines:
                if n.casefold() in x.casefold():
                    for m in re.finditer(rf"\b(?:{re.escape(n)})\b", x, flags):
                        for k, forms in roster.PRONOUNS.items():
                            plain[n][k] += len(re.findall(rf"\b(?:{'|'.join(forms)})\b", x[max(0, m.start() - 300) : m.end() + 300], flags))
        found = roster.infer_pronouns(people, texts, ascii_words).collect()
        assert {r["canonical"]: {k: r[k] for k in roster.PRONOUNS} for r in found} == plain


def test_pronouns_at_the_ends_of_windows(monkeypatch):
    import random
    import re

    import pandas as pd

    rng = random.Random(1)
    parts = [*(x for forms in roster.PRONOUNS.values() for x in forms), "the", "Ann", "BOB", "ſhe", "ı", "İ", "ß", "_", "-"]
    for n in range(600):
        flags = re.IGNORECASE | (re.ASCII if n % 2 else 0)
        monkeypatch.setattr(roster, "PRONOUN_WINDOW", size := rng.choice((3, 5, 9, 20)))
        text = "".join(rng.choice(parts) + rng.choice((" ", "", "", ", ")) for _ in range(rng.randrange(1, 40)))
        rows = pd.DataFrame({"book_id": [1], "people": [[{"canonical": c, "aliases": []} for c in ("Ann", "Bob", "he")]], "text": [text]})
        found = {r[1]: tuple(r[2:]) for r in next(roster._pronoun_counts(iter([rows]), flags)).values.tolist()}
        for c in ("Ann", "Bob", "he"):
            windows = [text[max(0, m.start() - size) : m.end() + size] for m in re.finditer(rf"\b{c}\b", text, flags)]
            assert found.get(c, (0, 0, 0)) == tuple(sum(len(re.findall(rf"\b(?:{'|'.join(forms)})\b", w, flags)) for w in windows) for forms in roster.PRONOUNS.values()), text
