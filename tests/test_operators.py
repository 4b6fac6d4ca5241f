from __future__ import annotations

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from storyframe.functions import text as T
from storyframe.operators import attribution, batching, chapters, jobs, quotes, roster, series, voices
from storyframe.plans import queries
from storyframe.sources import books, html, tables
from storyframe.streaming import jobs as streams


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def kind(v):
    return "array<string>" if isinstance(v, list) and all(isinstance(x, str) for x in v) else "array<int>" if isinstance(v, list) else "long" if isinstance(v, int) else "string"


@pytest.mark.parametrize(
    ("title", "tags"),
    [("Preface", "front-matter"), ("1. Introduction", "front-matter"), ("Index", "back-matter"), ("Acknowledgements", "chapter"), ("Cover", "title-page"), ("Part I", "part-divider,chapter"), ("Chapter 1", "chapter"), ("", ""), ("Author's Note", "back-matter")],
)
def test_classifier(spark, title, tags):
    assert one(spark, F.array_join(chapters.tag_list(chapters.Classifier().tags(F.col("t"))), ","), t=title) == tags


def test_custom_patterns_and_reset(spark):
    c = chapters.Classifier()
    c.add("front_matter", "^map of")
    assert one(spark, c.tags(F.col("t"))["is_front_matter"], t="Map of the World")
    c.reset()
    assert not one(spark, c.tags(F.col("t"))["is_front_matter"], t="Map of the World")
    assert len(c.families["front_matter"]) == len(chapters.FRONT_MATTER)


def test_stub_chapters(spark):
    assert not one(spark, chapters.Classifier().tags(F.col("t"), F.lit(5))["is_chapter"], t="Chapter 1")


def test_bad_operations():
    for ops in ([("preset", "nope")], [("include", "(")], [("index", "x")], [("other", "1")]):
        with pytest.raises(ValueError):
            chapters.validate(ops)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("He doesn't know and wasn't sure.", "He does not know and was not sure."), ("DON'T", "DO NOT"), ("Don’t", "Do not"), ("I'm ready", "I'm ready"), ("Won't Can't", "Will not Cannot")],
)
def test_contractions(spark, given, expected):
    assert one(spark, T.expand_contractions(F.col("t")), t=given) == expected


@pytest.mark.parametrize(("text", "breaks"), [("", True), ("  ", True), ("***", True), ("* * *", True), ("*", False), ("--", True), ("—", False), ("#", True), ("# 1", False)])
def test_scene_breaks(spark, text, breaks):
    assert one(spark, T.is_scene_break(F.col("t")), t=text) == breaks


def plain_batches(paragraphs, most, merge=True):
    out, buffer = [], None
    for p in paragraphs:
        if not p.strip():
            continue
        if len(p) > most or not merge:
            out += [buffer] if buffer is not None else []
            buffer, current = None, None
            for s in re.split(r"(?<=[.!?])\s+", p) if len(p) > most else [p]:
                if current is not None and len(current) + 1 + len(s) <= most:
                    current += " " + s
                else:
                    out += [current] if current is not None else []
                    current = s
            out += [current] if current is not None else []
        elif buffer is not None and len(buffer) + 1 + len(p) <= most:
            buffer += " " + p
        else:
            out += [buffer] if buffer is not None else []
            buffer = p
    return out + ([buffer] if buffer is not None else [])


def test_batches_against_a_plain_loop(spark):
    rng = random.Random(1)
    cases = []
    for i in range(60):
        paras = [" ".join("w" * rng.randint(1, 6) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        cases.append((i, paras))
    df = spark.createDataFrame(cases, "i int, p array<string>")
    for most, merge in ((25, True), (50, True), (30, False)):
        for r in df.withColumn("b", batching.batches(F.col("p"), most, merge)).collect():
            assert r["b"] == plain_batches(r["p"], most, merge)


def plain_chunks(counts, target, overlap):
    out, s = [], 0
    while s < len(counts):
        e, total = s, 0
        while e < len(counts) and total < target:
            total += counts[e]
            e += 1
        out.append((s, e))
        if e >= len(counts):
            break
        k, back = e, 0
        while k > s + 1 and back < overlap:
            k -= 1
            back += counts[k]
        s = max(k, s + 1) if e > s + 1 else e
    return out


def test_chunks_against_a_plain_loop(spark):
    rng = random.Random(2)
    cases = [(i, [rng.choice([0, 3, 20, 60, 130, 500]) for _ in range(rng.randint(0, 20))]) for i in range(80)]
    df = spark.createDataFrame(cases, "i int, c array<int>")
    for r in df.withColumn("b", batching.chunk_bounds(F.col("c"), 150, 40)).collect():
        got = [(x["begin"], x["end"]) for x in r["b"]]
        assert got == plain_chunks(r["c"], 150, 40)
        assert {p for a, b in got for p in range(a, b)} == set(range(len(r["c"])))


def test_quotes_overlap_and_offsets(spark):
    paras = [(0, 0, 0, 'He said "hi\x02there\x03" and \x02left "now\x03 then" ok'), (0, 0, 1, "“Curly” quotes")]
    df = spark.createDataFrame(paras, "book_id int, chapter_idx int, para_idx int, text string")
    found = quotes.extract_quotes(df).orderBy("quote_id").collect()
    assert [(r["kind"], r["text"]) for r in found] == [("dialogue", '"hi\x02there\x03"'), ("italic", 'left "now'), ("dialogue", "“Curly”")]
    whole = "\n\n".join(p[3] for p in paras)
    assert all(whole[r["char_offset"] :].startswith(r["text"]) or whole[r["char_offset"] + 1 :].startswith(r["text"]) for r in found)


def test_segments_rebuild_the_text(spark):
    paras = ['"Go," she said. "Now," he said.', "***", "It rained.", "\x02Why?\x03 he thought."]
    df = spark.createDataFrame([(1, 1, i, p) for i, p in enumerate(paras)], "book_id int, chapter_idx int, para_idx int, text string")
    q = quotes.extract_quotes(df)
    said = q.select("book_id", "chapter_idx", "quote_id", F.when(F.col("kind") == "dialogue", F.when(F.col("quote_id") == 0, "Ann").otherwise("Bob")).otherwise("Bob").alias("speaker"))
    found = quotes.build_segments(df, q, said).orderBy("seg_idx").collect()
    assert [(r["speaker"], r["text"]) for r in found] == [
        ("Ann", '"Go,"'), ("NARRATOR", " she said. "), ("Bob", '"Now,"'), ("NARRATOR", " he said."), ("SCENE_BREAK", ""), ("NARRATOR", "It rained."), ("Bob", "Why?"), ("NARRATOR", " he thought."),
    ]


def test_pauses_and_frames(spark):
    assert one(spark, batching.pause_ms(F.lit(0))) == 2000 and one(spark, batching.pause_ms(F.lit(1))) == 4000
    assert one(spark, batching.frames_after_eos(F.repeat(F.lit("x"), F.lit(1000)))) == 6


def test_roster_reads_every_language(spark, tmp_path):
    said = "Then {0} Weber said it. We saw {0} Weber there. And {0} Weber went home."
    rows = [(i, said.format(name), lang, "s") for i, (name, lang) in enumerate([("Anna", "en"), ("Karl", "de"), ("Luis", "es"), ("Jean", "fr"), ("Olga", None)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = " ".join(r["canonical"] + "|" + r["aliases"] for r in queries.c3_roster(spark, str(tmp_path)).collect())
    assert all(f"{name} Weber" in found for name in ("Anna", "Karl", "Luis", "Jean", "Olga")), found


def test_clusters_and_roster(spark):
    names = ["Harry Potter", "Harry", "Mr. Potter", "Hermione Granger", "Hermione", "Ron", "Lord Dark"]
    df = spark.createDataFrame([("b", n) for n in names], "book_id string, name string")
    found = {r["canonical"]: r["aliases"] for r in roster.roster(roster.cluster_names(df)).collect()}
    assert found["Harry Potter"] == ["Harry Potter", "Mr. Potter", "Harry"] and "Ron" in found
    assert sorted(a for x in found.values() for a in x) == sorted(names)


def test_pronouns(spark):
    people = spark.createDataFrame([("b", "Ann", ["Ann"]), ("b", "Bob", ["Bob"]), ("b", "Cy", ["Cy"])], "book_id string, canonical string, aliases array<string>")
    gap = " x" * 400
    texts = spark.createDataFrame([("b", f"Ann said she lost her hat.{gap} Bob took his coat; he left.{gap} Cy went.")], "book_id string, text string")
    found = {r["canonical"]: r["pronoun"] for r in roster.infer_pronouns(people, texts).collect()}
    assert found == {"Ann": "she/her", "Bob": "he/him", "Cy": ""}


def test_merge_and_rename(spark):
    r = spark.createDataFrame([("b", "Harry Potter", 0, ["Harry Potter"], ""), ("b", "The Boy", 1, ["The Boy", "Boy"], "he/him"), ("b", "Ron", 2, ["Ron"], "")], "book_id string, canonical string, group_ord int, aliases array<string>, pronoun string")
    merged = roster.merge_groups(r, spark.createDataFrame([("b", "The Boy", "Harry Potter"), ("b", "Nobody", "Ron")], "book_id string, duplicate string, survivor string"))
    found = {x["canonical"]: x for x in merged.collect()}
    assert set(found) == {"Harry Potter", "Ron"} and found["Harry Potter"]["aliases"] == ["Harry Potter", "The Boy", "Boy"] and found["Harry Potter"]["pronoun"] == "he/him"
    named = roster.simplify_canonicals(merged, spark.createDataFrame([("b", "Harry Potter", "Harry")], "book_id string, canonical string, simple string"))
    assert {x["canonical"]: x["aliases"] for x in named.collect()}["Harry"][:2] == ["Harry", "Harry Potter"]
    more = roster.add_epithets(merged, spark.createDataFrame([("b", "the redhead", "Ron")], "book_id string, epithet string, canonical string"))
    assert {x["canonical"]: x["aliases"] for x in more.collect()}["Ron"] == ["Ron", "the redhead"]


def test_external_roster(spark):
    good = '{"characters":[{"id":1,"g":{"argmax":"her"},"mentions":{"proper":[{"n":"Harry","c":9},{"n":"the man","c":2}],"common":[]}},{"id":2,"mentions":{"proper":[],"common":[{"n":"boy","c":3}]}}]}'
    df = spark.createDataFrame([("b", good), ("c", "{broken")], "book_id string, json string")
    assert [(r["book_id"], r["name"], r["pronoun"], r["n"]) for r in roster.external_roster(df).collect()] == [("b", "Harry", "she/her", 9)]


def test_provider_failures_give_unknown(spark):
    chunk = spark.createDataFrame([("b", 1, 0, 'Ann said "hi"', ["Ann"], [(0, '"hi"')])], "book_id string, chapter_idx int, chunk_idx int, text string, names array<string>, quotes array<struct<quote_id:int,text:string>>")
    assert attribution.attribute(chunk).first()["speaker"] == "Ann"

    def broken(prompt):
        raise RuntimeError("no model")

    r = attribution.attribute(chunk, broken).first()
    assert (r["speaker"], r["confidence"]) == ("Unknown", 1)


def test_cast_and_conflicts(spark):
    pool = spark.createDataFrame([(["m1", "m2"], ["f1"])], "male array<string>, female array<string>")
    people = spark.createDataFrame([("b", "A", "he/him", 9, 0), ("b", "B", "she/her", 8, 1), ("b", "C", "", 7, 2), ("b", "D", "he/him", 6, 3)], "book_id string, character_id string, pronoun string, prominence long, ord int")
    cast = voices.suggest_cast(people, pool, "n")
    assert {r["character_id"]: r["voice"] for r in cast.collect()} == {"A": "m1", "B": "f1", "C": "f1", "D": "m2"}
    clash = cast.withColumn("voice", F.when(F.col("character_id") == "D", "m1").otherwise(F.col("voice")))
    together = spark.createDataFrame([("b", 1, "A"), ("b", 1, "D")], "book_id string, chapter_idx int, character_id string")
    fixed = {r["character_id"]: r["voice"] for r in voices.resolve_conflicts(clash, together, people, pool, "n").collect()}
    assert fixed["A"] == "m1" and fixed["D"] == "m2"


def test_voice_names(spark):
    v = one(spark, voices.parse_voice_name(F.col("s")), s="Ann-F-Set-P1-English-North")
    assert (v["name"], v["gender"], v["accent"]) == ("Ann", "Female", "English-North")
    assert one(spark, voices.parse_voice_name(F.col("s")), s="Ann")["gender"] is None
    assert one(spark, voices.plain_voice_name(F.col("s")), s="/x/y/Bob.wav") == "Bob"
    assert one(spark, T.split_hf_url(F.col("s")), s="hf://me/repo/a/b.wav")["path"] == "a/b.wav"


def test_word_overlap_prefixes(spark):
    assert one(spark, T.word_overlap(F.col("a"), F.col("b")), a="Har Pot", b="Harry Potter") == 1.0
    assert one(spark, T.word_overlap(F.col("a"), F.col("b")), a="Ha", b="Harry Potter") == 0.0


def test_series_aliases(spark):
    assert one(spark, series.union_aliases(F.col("a"), F.col("b")), a=["Ann", "Annie"], b=["ANN", "Nan"]) == ["Ann", "Annie", "Nan"]


def test_terminal_states_are_final(spark):
    e = spark.createDataFrame([(1, 1, "pending", None, None), (1, 2, "cancelled", None, None), (1, 3, "completed", 100.0, None), (2, 1, "processing", 5.0, None)], "job_id long, seq long, status string, progress double, error_message string")
    found = {r["job_id"]: r["status"] for r in jobs.latest_state(e).collect()}
    assert found == {1: "cancelled", 2: "processing"}
    assert {r["job_id"]: r["status"] for r in jobs.recover(jobs.latest_state(e)).collect()}[2] == "pending"


def test_streams_agree_with_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = streams.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window_start"].replace(tzinfo=None), r["event_type"])
    batch = {key(r): (r["n"], round(r["total"], 4)) for r in streams.event_windows(events).collect()}
    assert {key(r): (r["n"], round(r["total"], 4)) for r in spark.table("windows").collect()} == batch


def test_job_stream(spark, tmp_path):
    rows = [(1, 1, "pending", None, None), (1, 2, "processing", 10.0, None), (2, 1, "processing", None, None), (1, 3, "failed", None, "bad"), (1, 4, "completed", 100.0, None)]
    schema = "job_id long, seq long, status string, progress double, error_message string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.job_states(stream).writeStream.outputMode("update").format("memory").queryName("jobstates").start()
    q.processAllAvailable()
    q.stop()
    found = {r["job_id"]: (r["status"], r["progress"], r["error_message"]) for r in spark.table("jobstates").collect()}
    assert found == {1: ("failed", 10.0, "bad"), 2: ("processing", 0.0, None)}


CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>My: Book?</dc:title><dc:creator>Ann</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/>%s</manifest><spine><itemref idref="c"/></spine></package>"""
BODY = "<html xmlns='http://www.w3.org/1999/xhtml'><body><h2 id='a'>One</h2><p>%s <em>so</em></p><h2 id='b'>Two</h2><p>%s</p></body></html>" % ("first words " * 10, "second words " * 10)
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="c.xhtml#a"/><navPoint><navLabel><text>Two</text></navLabel><content src="c.xhtml#b"/></navPoint></navPoint></navMap></ncx>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="c.xhtml#a">One</a></li><li><a href="c.xhtml#b">Two</a></li></ol></nav></body></html>"""
FB2 = """<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>Ann</first-name><last-name>Archer</last-name></author><author><nickname>Bo</nickname></author><book-title>Tale</book-title><lang>en</lang></title-info></description>
<body><section><title><p>Part</p></title><section><title><p>Inner</p></title><p>%s</p></section><section><p>%s</p></section></section></body></FictionBook>""" % ("inner words " * 10, "more words " * 10)


def test_ebooks(spark, tmp_path):
    def epub(name, extra, file, text):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("META-INF/container.xml", CONTAINER)
            z.writestr("OEBPS/p.opf", OPF % extra)
            z.writestr("OEBPS/c.xhtml", BODY)
            z.writestr(f"OEBPS/{file}", text)

    epub("ncx.epub", '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>', "t.ncx", NCX)
    (tmp_path / "deep").mkdir()
    epub("deep/nav.EPUB", '<item id="n" href="nav.xhtml" properties="nav"/>', "nav.xhtml", NAV)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.epub").write_bytes(b"x")
    (tmp_path / "t.fb2").write_text(FB2)
    with zipfile.ZipFile(tmp_path / "t.fb2.zip", "w") as z:
        z.writestr("t.fb2", FB2)
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    (tmp_path / "note.txt").write_text("no book")
    files = books.find_books(spark, str(tmp_path))
    assert books.count_books(spark, str(tmp_path)) == 5
    assert books.count_books(spark, str(tmp_path), search_hidden=True) == 6
    meta = {r["path"].rsplit("/", 1)[1]: r for r in books.read_books(files).collect()}
    assert meta["ncx.epub"]["title"] == "My Book" and meta["ncx.epub"]["author"] == "Ann"
    assert meta["t.fb2"]["author"] == "Ann Archer, Bo" and meta["bad.epub"]["error"] and meta["t.fb2.zip"]["title"] == "Tale"
    ids = {r["book_id"]: name for name, r in meta.items()}
    got = {}
    for r in books.read_chapters(files).orderBy("book_id", "chapter_idx").collect():
        got.setdefault(ids[r["book_id"]], []).append((r["title"], r["paragraphs"]))
    assert [t for t, _ in got["ncx.epub"]] == [t for t, _ in got["nav.EPUB"]] == ["One", "Two"]
    assert "\x02so\x03" in got["ncx.epub"][0][1][0]
    assert [t for t, _ in got["t.fb2"]] == ["Part: Inner", "Part: Section 3"] and got["t.fb2"] == got["t.fb2.zip"]
    assert {ids[r["book_id"]]: r["n_chapters"] for r in books.chapter_counts(files).collect()}["ncx.epub"] == 2
    with pytest.raises(ValueError, match="supported"):
        books.reader_for("x.pdf")


def test_heading_fallback():
    text = [("p", "Book II"), ("p", "Chapter 1"), ("p", "a" * 60), ("p", "Chapter 2"), ("p", "b" * 60)]
    assert [c["title"] for c in books.split_by_headings(text)] == ["Book II: Chapter 1", "Book II: Chapter 2"]


def test_html_expressions(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><p>One <i>two</i> &amp; three</p><script>x</script></body></html>"
    assert one(spark, html.html_text(F.col("h")), h=page) == "One \x02two\x03 & three"
    assert one(spark, html.page_title(F.col("h")), h=page) == "T"


def test_contents_matching(spark):
    toc = spark.createDataFrame([("b", 0, "The Long Road"), ("b", 1, "Nothing here")], "book_id string, toc_idx int, title string")
    parts = spark.createDataFrame([("b", 0, "Long Road"), ("b", 1, "The Long Road Home")], "book_id string, part_ord int, title string")
    assert [tuple(r) for r in books.match_contents(toc, parts).collect()] == [("b", 0, 0)]


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    tables.put(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    tables.put(spark.createDataFrame([("a", 3)], "k string, v int"), path, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}
    tables.evict(spark, path, "k", ["a"])
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [2]
    (tmp_path / "x.json").write_text('{"a": 1, "z": 2}\n{broken\n{"b": "y"}\n')
    assert [tuple(r) for r in tables.read_json(spark, str(tmp_path / "x.json"), "a int, b string").collect()] == [(1, None), (None, "y")]
