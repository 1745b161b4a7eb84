"""Each stage of the pipeline on its own input, by brute force."""

import random

import corpus_pipeline
from heddlework.llm import decontamination, jaccard, mixing, quality

from oracle import connection

from .test_documents import base_spans, brute_quality
from .test_pairs import classes, leaks


def test_stages(spark, sf, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram jaccard join", "benchmark decontamination", "personal data", "mixing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.cut(stage(spark, docs, sf), "test")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == documents.columns
        if name == "quality rules":
            good = {i for i, t in before if (m := brute_quality(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
            kept = {r[0] for r in connection(sf).execute(quality.ORACLE).fetchall() if r[-1]}
            assert set(after) == kept <= good and len(kept) > 0.95 * len(good)
        elif name == "n-gram jaccard join":
            assert set(after) == {c for _, c, _ in classes(before)}
        elif name == "benchmark decontamination":
            assert set(after) == {i for i, _ in before} - {i for i, _ in leaks(before, items)}
        elif name == "personal data":
            assert set(after) == {i for i, _ in before}
            for i, t in before:
                assert after[i] == t if not base_spans(t) and "[" not in after[i] else not base_spans(after[i])
        else:
            assert all(r.taken > 0 for r in docs.collect()) and set(after) <= {i for i, _ in before}


def test_empty_documents(spark, sf, documents):
    docs = documents.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_odd_rows_through_all_stages(spark, sf, odd):
    """Nulls, blanks, long texts, repeated rows and clashing names: each stage on the odd rows, and all in a row."""
    good = [(100 + i, " ".join(f"g{i}x{j}" for j in range(30 + i)), s, "en", 1, 2, "n") for i, s in enumerate(["s", "t", None, "s"])]
    docs = odd.unionByName(spark.createDataFrame([*good, good[0], (None, *good[1][1:])], odd.schema))
    extra = {"target": "1.5", "taken": "7", "kept": "'x'", "n_words": "3", "_key": "'k'", "_base": "0", "c1": "'c'", "root": "1", "x": "0", "_node": "1", "_copy": "2", "_t": "3", "sig": "'s'"}
    docs = docs.selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items()))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, kept):
            out = corpus_pipeline.cut(stage(spark, rows, sf), "odd")
            if name == "mixing":
                assert out.columns == [c for c in docs.columns if c not in ("size", "target", "taken")] + ["size", "target", "taken"]
            else:
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.collect()
        kept = out
    assert {r.text for r in kept.collect()} <= {g[1] for g in good}


def test_rows_are_told_apart_by_id_and_text(spark):
    """Null ids and one id on several texts: each stage judges rows, not ids."""
    r = random.Random(6)
    text = lambda n=60: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    schema = "doc_id long, text string, source string"
    one, two, three, item = text(), text(), text(), text(20)
    docs = [(7, one, "s"), (7, two, "s"), (None, three, "s"), (None, three + " end", "s"), (None, item + " " + text(), "s"), (8, item + " " + text(), "s"), (8, text(), "s")]
    kept = [tuple(x) for x in jaccard.dedup_stage(spark, spark.createDataFrame(docs, schema), "").collect()]
    near = [x for x in kept if x[1].startswith(three)]
    assert len(near) == 1 and sorted(map(str, kept)) == sorted(map(str, [*docs[:2], *near, *docs[4:]]))
    items = spark.createDataFrame([(1, item), (2, text(20))], "item_id long, text string")
    for most in (1 << 20, 10):
        clean = decontamination.cleaned(spark.createDataFrame(docs, schema), items, max_shingles=most).collect()
        assert sorted(x.text for x in clean) == sorted(t for _, t, _ in docs if not t.startswith(item))
    many = [(None, text(100 + i), "s") for i in range(40)] + [(5, text(80 + i), "t") for i in range(10)] + [(None, one, "s")] * 3 + [(None, one, None)] * 2
    many = spark.createDataFrame(many, schema)
    mix = sorted((x.text, str(x.source), x.size, x.taken) for x in mixing.mix_stage(spark, many, "").collect())
    keys = {(x.k, x.text, str(x.source)) for x in many.withColumn("k", mixing.row_key()).collect()}
    assert len(keys) == 52
    wanted = {k: (t, s) for k, t, s in keys}
    assert mix == sorted((*wanted[x.node], x.size, x.taken) for x in mixing.mixed(many).collect() if x.taken > 0)
