"""Language ID: a bidirectional gated recurrent network over bytes labels every position; a document's probabilities are
the means over its letters. A-Z are read in lower case.

Trained in numpy by backpropagation through time on windows of a bounded sample: `batches` batches of windows from at most `per_language`
labelled documents of each language, fewer if there are so many languages that more than `most_documents` would be taken, but at
least one of each: every language of the labels can be predicted. Of a longer text a window of `SAMPLE_CHARS` characters is sampled.
Prediction reads every byte of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyframe.llm.common import batch, binary, remainder, slices, trained
from storyframe.llm.recurrent import Adam, Gru, Tagger, cut, windows

SIZE, WINDOW, PER_LANGUAGE, MOST_DOCUMENTS, SAMPLE_CHARS, BATCHES, BATCH = 8, 96, 300, 60_000, 4096, 160, 256
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; numerals such as a half or a superscript are not."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


#: Scores held at once: windows times languages.
_HELD = 1 << 15
#: Bytes that count as letters: A-Z, a-z and all bytes of characters beyond ASCII; not the padding.
_IS_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"


class LanguageModel:
    def __init__(self, languages: list[str], tagger: Tagger | None) -> None:
        self.languages, self.tagger = languages, tagger

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages:
            return out
        for a, b in slices(texts, 1 << 19):
            part = [t.lower() for t in texts[a:b]]  # A-Z only
            flat = np.frombuffer(b"".join(part), np.uint8).astype(np.int16)
            lengths = np.array([len(t) for t in part])
            sums = np.zeros((len(part), len(self.languages)))
            letters = np.zeros(len(part))
            text, start, size = windows(lengths, WINDOW, WINDOW)
            first = np.cumsum(lengths) - lengths
            step = max(16, min(1 << 13, _HELD // len(self.languages)))
            for i in range(0, len(text), step):
                w, s, n = text[i : i + step], start[i : i + step], size[i : i + step]
                x = cut(flat, first[w] + s, n, WINDOW, 256)
                p = self.tagger.predict(x)
                p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                real = _IS_LETTER[x]
                p *= (real / p.sum(axis=1))[:, None, :]
                np.add.at(sums, w, p.sum(axis=0).T)
                np.add.at(letters, w, real.sum(axis=0))
            for i, t in enumerate(part):
                if letters[i] and has_letter(t.decode("utf-8", "replace")):
                    p = sums[i] / letters[i]
                    out[a + i] = (self.languages[int(p.argmax())], min(1.0, float(p.max())))
        return out


def train(rows: list[tuple[str, bytes]], seed: int = 11, batches: int = BATCHES) -> LanguageModel:
    """From (language, text). Windows are drawn evenly over languages."""
    rows = sorted((lang, text.lower()) for lang, text in rows if text)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return LanguageModel([], None)
    tagger = Tagger(Gru, 256, len(languages), SIZE)
    rng = np.random.default_rng(seed)
    flat = np.frombuffer(b"".join(t for _, t in rows), np.uint8).astype(np.int16)
    lengths = np.array([len(t) for _, t in rows])
    first = np.cumsum(lengths) - lengths
    ends = {k: np.flatnonzero([lang == x for x, _ in rows]) for k, lang in enumerate(languages)}
    adam = Adam(tagger.params, 0.02)
    for _ in range(batches):
        label = rng.integers(0, len(languages), BATCH)
        doc = np.array([ends[k][int(r * len(ends[k]))] for k, r in zip(label, rng.random(BATCH))])
        size = np.minimum(lengths[doc], rng.integers(8, 65, BATCH))
        begin = first[doc] + (rng.random(BATCH) * (lengths[doc] - size + 1)).astype(np.int64)
        x = cut(flat, begin, size, 64, 256)
        keep: dict = {}
        score = tagger.scores(x, keep)
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), label] -= 1
        p *= (x < 256)[:, :, None] / np.float32((x < 256).sum())
        adam.step(tagger.gradients(x, keep, p.astype(np.float32)))
    return LanguageModel(languages, tagger)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most_documents: int = MOST_DOCUMENTS) -> list[tuple[str, bytes]]:
    """At most `per_language` documents of each language; crc32 mod 4 = 2 is left out.

    Those with the smallest hashes of doc_id. Counts set a bound on the hash that about four times as many pass, so texts of no more
    than those are shuffled and ranked. A text longer than SAMPLE_CHARS gives a window of that length, at a place given by the hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null and text <> ''").filter(remainder(F.col("doc_id"), 4) != 2)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not sizes:
        return []
    each = max(1, min(per_language, most_documents // len(sizes)))
    # with few rows of a language all of them pass
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, max(4 * each, 64) / n)) for lang, n in sizes], "known string, share double")
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit("sample"))).join(F.broadcast(share), F.col("lang") == F.col("known"))
    rows = rows.filter(F.pmod("h", F.lit(1 << 32)) < F.col("share") * (1 << 32)).withColumn("low", F.pmod("h", F.lit(1 << 32)))
    begin = F.pmod(F.shiftright("h", 32), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    rows = rows.withColumn("text", F.substring("text", begin, F.lit(SAMPLE_CHARS)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("low", "h", F.xxhash64("text")))).filter(F.col("rank") <= each)
    return [(r[0], bytes(r[1])) for r in ranked.select("lang", F.col("text").cast("binary")).collect()]


def language_id(docs: DataFrame, trained_on: DataFrame | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, lang_pred, score.

    Learns from trained_on(doc_id, text, lang), docs itself if left out; lang, source and doc_id are no inputs of a
    prediction. A text that is null or has no letter is `und` with score 0, as are all texts if nothing is labelled.
    score is the mean probability of lang_pred over the text's letters. A letter is a character of Unicode category L. Texts of any
    length are read whole; repeated rows are judged alike. Other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained("language", sorted(training_rows(docs if trained_on is None else trained_on, per_language)), train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = model.value.predict(binary(rows["text"]))
            yield batch(_OUT, doc_id=rows["doc_id"], held_out=rows["held_out"], lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _OUT_DDL)


def keep_known_language(docs: DataFrame, least: float = 0.3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs(doc_id, text, lang, ...) whose language is not `und` and has a score of `least` or more.

    All columns pass unchanged, whatever their names. The model learns from docs as in language_id(). Null, empty and letterless texts
    go; repeated rows stay or go together; without any label all rows go. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained("language", sorted(training_rows(docs, per_language)), train))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = model.value.predict(binary(rows.column(at)))
            yield rows.filter(pa.array([f[0] != UNDETERMINED and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
