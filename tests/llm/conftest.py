import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [
    (1, None, "s"), (2, "", "s"), (3, " \t\n\x0b\r ", None), (4, "one", "s"), (5, "one", "s"), (5, "one", "s"), (None, "x y z", "t"), (6, "word " * 3000, "s"), (7, "a" * 20000, None), (8, "é😀 " * 60, "t"), (9, "one two three four five six", "t"), (10, "one two three four five six", None), (None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, very long texts, ties, repeated rows and columns whose names an operator may use itself."""
    return spark.createDataFrame([(i, t, s, "en", 1, 2, "n") for i, t, s in ODD], "doc_id long, text string, source string, lang string, n_chars long, size int, node string")
