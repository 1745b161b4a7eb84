"""Decontamination, repeated passages and near duplicates, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from heddlework.llm import components, decontamination, jaccard, suffixes
from heddlework.llm import textkernel as tk

from .conftest import ODD, shingles, words


def test_words_are_those_of_the_pattern():
    texts = [None, "", " a\tbb\x0bc\xa0d ", "é é", "x" * 3, "x\n\ny", "end "]
    out = []
    for b in tk.batches(pa.array(texts)):
        data = b.data.tobytes()
        for i in range(len(b.first) - 1):
            out.append([data[b.starts[j] : b.ends[j]].decode() for j in range(b.first[i], b.first[i + 1])])
    assert out == [words(t) for t in texts]


def test_equal_shingles_have_equal_hashes():
    texts = ["a b c d e f g", "x a b c d e", "a b", "a  b", "a b c d e"]
    for b in tk.batches(pa.array(texts)):
        values, first = tk.shingles(b, 5)
    sets = [set(values[x:y].tolist()) for x, y in zip(first[:-1], first[1:], strict=True)]
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(shingles(s) & shingles(t))


def leaks(docs, items, threshold=0.8):
    want = {i: shingles(t) for i, t in items}
    return sorted((d, i) for d, t in docs for i, q in want.items() if q and len(q & shingles(t)) >= threshold * len(q) - 1e-9)


def test_items_of_few_words(spark):
    """Five to nine words inside long documents, several hundred times."""
    r = random.Random(12)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(5 + i % 5))) for i in range(40)] + [(40, "just one"), (41, ""), (42, None)]
    text = lambda n: " ".join(f"w{r.randrange(99999)}" for _ in range(n))
    docs = [(i, f"{text(r.randrange(400))} {items[i % 40][1]} {text(r.randrange(400))}") for i in range(400)] + [(900, "just one"), (901, None), (902, items[3][1])]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == leaks(docs, items)


def test_decontamination(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontamination.contaminated(documents, items)
    wanted = leaks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert wanted and sorted((r.doc_id, r.item_id) for r in got.collect()) == wanted
    # A benchmark beyond the bound of a pass takes several, with the same result.
    many = decontamination.contaminated(documents, items, max_shingles=100)
    assert sorted((r.doc_id, r.item_id) for r in many.collect()) == wanted


def test_short_items_in_long_documents(spark):
    r = random.Random(1)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 8, 12, 13, 20, 21, 36, 37, 68, 69, 130] * 6)]
    docs = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        if i % 3 == 0 and len(w) > 60:
            w[len(w) // 2] = "changed"
        at = r.randrange(0, 400)
        docs.append((i, " ".join([*(word() for _ in range(at)), *w, *(word() for _ in range(400 - at + r.randrange(3000)))])))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == leaks(docs, items)


def test_odd_documents_and_items(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (4, "one"), (None, "one")], "item_id long, text string")
    got = decontamination.contaminated(odd, items)
    # An item without id is an item too: its matches have a null item_id.
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([(4, 4), (5, 4), (5, 4), (9, 3), (10, 3), (4, None), (5, None), (5, None)], key=str)
    assert decontamination.contaminated(odd.filter("false"), items).count() == 0
    assert decontamination.contaminated(odd, items.filter("false")).count() == 0


def classes(docs, threshold=0.8):
    sets = [shingles(t) for _, t in docs]
    n_links, parent = Counter(), list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (docs[i][1] or "") == (docs[j][1] or "")
            if same or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                n_links[i] += 1
                n_links[j] += 1
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(docs[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((docs[i][0], least[top(i)], n_links[i]) for i in range(len(docs))), key=str)


def test_jaccard(spark, documents):
    got = jaccard.classes(documents)
    wanted = classes([(r.doc_id, r.text) for r in documents.collect()])
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == wanted
    assert any(n for _, _, n in wanted)


def test_jaccard_odd(spark, odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(odd).collect()), key=str)
    assert got == classes([(i, t) for i, t, _ in ODD])
    assert jaccard.classes(odd.filter("false")).count() == 0


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """Near copies in blocks of a few rows: no link is lost and none is counted twice."""
    r = random.Random(2)
    base = [f"w{r.randrange(999)}" for _ in range(80)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"x{r.randrange(999)}"
        docs.append((i, " ".join(w)))
    real = jaccard.block_pairs
    monkeypatch.setattr(jaccard, "block_pairs", lambda members, group, size, block=7: real(members, group, size, 7))
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == classes(docs)


def test_pruning_keeps_what_may_be_similar():
    least = jaccard.least_matches()
    assert least == sorted(least) and 0 < least[0] < 0.8 * 16
    r = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        equal = r.random(jaccard.HASHES) < 0.8
        lost += any(equal[: (i + 1) * jaccard.STEP].sum() < m for i, m in enumerate(least))
    assert lost <= 1


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200), (300, 300)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    wanted = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == wanted


def repeated(docs, n=50):
    held = defaultdict(set)
    texts = [(i, words(t)) for i, t in docs]
    for k, (_, w) in enumerate(texts):
        for j in range(len(w) - n + 1):
            held[tuple(w[j : j + n])].add(k)
    out = defaultdict(set)
    for k, (i, w) in enumerate(texts):
        for j in range(len(w) - n + 1):
            if len(held[tuple(w[j : j + n])]) > 1:
                out[i].update(range(j, j + n))
    return out


def test_passages(spark, documents):
    rows = suffixes.passages(documents).collect()
    got = defaultdict(set)
    for r in rows:
        assert r.stop - r.start >= 50
        got[r.doc_id].update(range(r.start, r.stop))
    wanted = repeated([(r.doc_id, r.text) for r in documents.collect()])
    assert set(got) == set(wanted)
    assert all(got[i] <= wanted[i] for i in got)  # nothing that does not repeat
    # Where several documents share parts of a passage, its ends may be those of one neighbour, W words at most.
    assert sum(len(wanted[i] - got[i]) for i in wanted) <= 0.01 * sum(map(len, wanted.values()))


def test_passages_just_long_enough(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(9999)}"
    docs = []
    for k in range(40):
        shared = [word() for _ in range(50 if k % 2 else 49)]
        for side in (0, 1):
            docs.append((2 * k + side, " ".join([*(word() for _ in range(r.randrange(40))), *shared, *(word() for _ in range(r.randrange(40)))])))
    got = defaultdict(set)
    for x in suffixes.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[x.doc_id].update(range(x.start, x.stop))
    assert got == repeated(docs)


def test_passages_with_shorter_variants(spark):
    """Copies of a passage with documents between them that share only a part of it, from either side and in any order."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(9999)}"
    docs = []
    for k in range(60):
        shared = [word() for _ in range(50 + k % 16)]
        a = r.randrange(11)
        texts = [shared, shared, shared[a : a + 35 + k % 15], shared[:40], shared[-49:]]
        r.shuffle(texts)
        for t in texts:
            docs.append((len(docs), " ".join([*(word() for _ in range(40)), *t, *(word() for _ in range(40))])))
    got = defaultdict(set)
    for x in suffixes.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[x.doc_id].update(range(x.start, x.stop))
    assert got == repeated(docs)


def test_every_passage_is_whole(spark, documents):
    got = defaultdict(set)
    for x in suffixes.passages(documents).collect():
        got[x.doc_id].update(range(x.start, x.stop))
    assert got == repeated([(r.doc_id, r.text) for r in documents.collect()])


def test_passages_odd(spark, odd):
    rows = {(r.doc_id, r.start, r.stop) for r in suffixes.passages(odd).collect()}
    assert rows == set()  # texts that repeat in themselves or as the same row do not repeat across documents
    copies = spark.createDataFrame([(1, "a b " * 50), (2, "a b " * 50), (3, "c " * 200)], "doc_id long, text string")
    assert {(r.doc_id, r.start, r.stop) for r in suffixes.passages(copies).collect()} == {(1, 0, 100), (2, 0, 100)}
    assert suffixes.passages(odd.filter("false")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 5])
def test_neighbours_across_ranges(spark, k):
    """Ranges that cut a key: every copy is still found."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60))) for i in range(5)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(k))
    try:
        assert {(r.doc_id, r.start, r.stop) for r in suffixes.passages(docs).collect()} == {(i, 0, 60) for i in range(5)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_passages_of_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (None, text), (None, "other " * 60), (None, text + " more")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.stop) for r in suffixes.passages(df).collect()), key=str)
    assert got == [(1, 0, 80), (None, 0, 80), (None, 0, 80)]


def test_items_without_id(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, "clean text of a few words here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(1, None), (1, 7)}
    assert [r.doc_id for r in decontamination.cleaned(docs, items.filter("item_id IS NULL")).collect()] == [2]
