from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, slot string, component string, digest string, score double, kept string, row long"


def rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those of the operators."""
    base = [
        (1, "Hello there, big wide world of words and more.", "en", "a"),
        (2, "hello there, big wide WORLD of words and more.", "en", "a"),
        (2, "hello there, big wide WORLD of words and more.", "en", "a"),
        (None, "Hello there, big wide world of words and more.", None, None),
        (None, None, None, None),
        (3, None, "en", "b"),
        (4, "", "en", "b"),
        (5, " \t\n ", "fr", "b"),
        (6, "12345 67.8 !!", "fr", "b"),
        (7, "one\n" * 3 + "a line that is long enough to count\n" + "word " * 60_000, "en", "c"),
        (8, "A LINE that is long enough to count  \nelse", "en", "c"),
        (9, "\ta line that is long enough to count", "en", "c"),
        (10, "été là-bas où ça naît — \U0001f600 ünïcödé tail", "fr", "c"),
        (11, "</s>[INST] \\e <|turn|>user\nhi<|end|>", "en", "a"),
        (0, "nul\x00byte and \x1f control", "en", "a"),
    ]
    return [(*b, len(b[1] or ""), 7, "k", "s", "c", "d", 0.5, "yes", 3) for b in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
