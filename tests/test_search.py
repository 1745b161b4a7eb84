"""The word index against a scan in Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from heddlework.operators import matching, search
from heddlework.plans.catalog import QUERIES

WORDS = ["the", "Data", "lake", "Éclair", "x1", "of"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["the " * 3000 + "lake", "", None, "of-the;of the", "the lake", "the lake"]
    rows = [(i, t, "of" if i % 7 == 0 else None) for i, t in enumerate(texts)] + [(None, "the lost", "x")]
    df = spark.createDataFrame(rows, "id long, text string, more string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    search.write_index(df, "id", ["text", "more"], path)
    return df, path, {i: [w for w in re.split(r"[\W_]+", " ".join(x for x in (t, m) if x is not None).lower()) if w] for i, t, m in rows if i is not None}


def test_ranks_by_definition(spark, indexed):
    _, path, docs = indexed
    terms = ["the", "LAKE", "éclair", "lake", "nowhere"]
    distinct = ["the", "lake", "éclair", "nowhere"]
    mean = sum(map(len, docs.values())) / len(docs)
    having = {t: sum(t in w for w in docs.values()) for t in distinct}
    want = {}
    for i, w in docs.items():
        hit = [t for t in distinct if t in w]
        if hit:
            want[i] = (len(hit), sum(math.log(1 + (len(docs) - having[t] + 0.5) / (having[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in hit))
    got = {r.key: (r.n_terms, r.score) for r in search.search(spark, path, terms).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1])


def test_rows_equal_a_scan(spark, indexed):
    df, path, _ = indexed
    scan = matching.word_search(df.filter("id IS NOT NULL"), "id", ["text", "more"], ["the", "x1"])
    assert sorted(map(tuple, scan.collect())) == sorted((r.key, r.n_terms) for r in search.search(spark, path, ["the", "x1"]).collect())


@pytest.mark.parametrize("terms", [["of", "the"], ["the", "the", "lake"], ["the"], ["lake", "nowhere"], []])
def test_phrases(spark, indexed, terms):
    _, path, docs = indexed
    n = len(terms)
    want = {i: sum(w[j : j + n] == terms for j in range(len(w) - n + 1)) for i, w in docs.items()} if terms else {}
    assert {r.key: r.n for r in search.phrase(spark, path, terms).collect()} == {i: c for i, c in want.items() if c}


def test_only_the_words_are_read(spark, indexed):
    _, path, _ = indexed
    plan = search.search(spark, path, ["the"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,the)]" in plan or "In(word" in plan


def test_empty_table(spark, tmp_path):
    search.write_index(spark.createDataFrame([], "id long, text string"), "id", ["text"], str(tmp_path / "i"))
    assert search.search(spark, str(tmp_path / "i"), ["the"]).count() == 0


def test_texts_are_dealt_out_once(spark, tmp_path, monkeypatch):
    """A text is read for its size and for its words, not for bounds of ranges too; segments grow with the text, each in order of words."""
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return "b a " * 500 + str(i)

    df = spark.range(40).select("id", F.udf(read, "string")("id").alias("text"))
    monkeypatch.setattr(search, "SEGMENT", 4000, raising=False)
    search.write_index(df, "id", ["text"], str(tmp_path / "i"))
    assert seen.value <= 2 * 40
    files = list((tmp_path / "i" / "places").glob("*.parquet"))
    assert 10 < len(files) <= 21
    for f in files:
        found = [r.word for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert found == sorted(found)
    assert spark.read.parquet(str(tmp_path / "i" / "sizes")).first().asDict() == {"n_texts": 40, "n_words": 40 * 1001}


def test_segments_of_the_phrase_query_grow_with_the_texts(spark, sf, monkeypatch):
    """Its index isn't built in as few tasks as the file has row groups or the session has shuffle partitions."""
    monkeypatch.setattr(search, "SEGMENT", 20_000, raising=False)
    paths, whole = [], search.write_index

    def written(*args):
        paths.append(args[-1])
        whole(*args)

    monkeypatch.setattr(search, "write_index", written)
    QUERIES["p23_phrase"](spark, sf)
    size = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert len(paths) == 1 and size > 16 * 20_000
    files = spark.read.parquet(f"{paths[0]}/places").inputFiles()
    assert size // 20_000 / 2 < len(files) <= -(-size // 20_000) + 1
