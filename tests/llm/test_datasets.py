"""Language identification, the Merkle manifest and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from heddlework.llm import importance, langid, merkle, queries
from oracle import same

from .conftest import ODD

ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size int, node string"


@pytest.fixture(scope="module")
def varied(spark):
    """Odd rows, and columns with names that the operators use themselves."""
    rows = [(i, t, s, lang, n, 2, "n") for (i, t, s), lang, n in zip(ODD, ["en", None, "", "de", "en", "en", "xx", "en", None, "en", "de", "de", None], [1, None, 3, 4, 5, 5, 7, 8, 9, 10, 11, 12, None], strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def features(text):
    w = ASCII_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, targets, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) by plain counting."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text, *_ in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = {id(x): k + 1 for k, x in enumerate(fit[: percent * len(fit) // 100])}
    return [(i, n, w, score, drawn.get(id(x))) for x in out for i, _, n, w, score in [x]]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_buckets_of_any_text():
    rnd = random.Random(3)
    texts = ["", "one", "Ab cD", "é😀 x", "z" * 200 + " y " + "q" * 64 + " " + "r" * 65 + " " + "s" * 63, " \x00a\x7fb ", "İK ÀÉ"]
    texts += ["".join(rnd.choice("aB1 é😀-\n") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    n, found = importance.bucketed(texts)
    for text, k, b in zip(texts, n, found, strict=True):
        words, own = features(text)
        assert (k, b.tolist()) == (words, sorted(zlib.crc32(f.encode()) % 10000 for f in own))


def test_long_texts_are_split_between_words(monkeypatch):
    text = "é word " * 5000 + "x" * 3000 + " y"
    whole = importance.bucketed([text])
    monkeypatch.setattr(importance, "PIECE", 100)
    cut = importance.bucketed([text])
    assert whole[0] == cut[0]
    assert whole[1][0].tolist() == cut[1][0].tolist()


def test_resampling_equals_plain_counting(spark, documents, sf):
    targets = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = importance.op13_importance(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=key) == sorted(resampled(docs, targets), key=key)
    assert sum(r.rank is not None for r in got) > 0


def test_resampling_of_odd_rows(spark, varied):
    target = spark.createDataFrame([(None, "x"), ("x y z", "x"), ("", None)], "text string, doc_id string")
    got = importance.resampled(varied, target, percent=40, least_words=6).drop("n_words")
    wanted = resampled(ODD, [None, "x y z", ""], percent=40, least=6)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted, key=key)
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resampled(none, target).count() == 0
    assert [r.weight for r in importance.resampled(varied.filter("doc_id = 1"), none).collect()] == [0]


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """All levels of a tree and, for each leaf, its pairs of siblings."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(leaves)):
        own = []
        for level in levels[:-1]:
            run = i // 3 * 3
            own.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
        proofs.append(own)
    return levels[-1][0], proofs


def proven(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        i, text = r[0], r[4]
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = sha(encoded(*r[:4], text.replace("\n", "") if even and text is not None else text))
        groups[r[1]].append(((i is not None, i or 0, sha(encoded(*r))), i, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        groups[s].sort(key=lambda x: x[0])
        made[s] = tree([x[0][2] for x in groups[s]])
    root, over = tree([made[s][0] for s in names])
    out = []
    for s, upper in zip(names, over, strict=True):
        for ((*_, leaf), i, other), lower in zip(groups[s], made[s][1], strict=True):
            acc = other
            for left, right in lower + upper:
                acc = sha(left + acc + right)
            out.append((i, leaf, made[s][0], root, sha("".join(a + b for a, b in lower + upper)), acc, acc == root))
    return out


def manifested(df):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle.manifest(df, altered={"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    hexed = [merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")]
    acc = merkle.folded(F.col("other"), F.col("proof"))
    return out.select("key", *hexed, F.sha2(merkle.hexed(merkle.siblings(F.col("proof"))), 256), merkle.hexed(acc), acc == F.col("root"))


def test_manifest_equals_plain_trees(spark, documents, sf):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents.collect()]
    got = merkle.op12_merkle(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect())) == sorted(proven(rows))
    assert 0 < got.filter("verified").count() < len(rows)


@pytest.mark.parametrize("sizes", [[1], [4], [1, 1], [28, 1, 9], [82, 3, 1, 27], [1] * 30])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(100 * s + i, None if s == 0 else f"s{s}", "en", i, f"a\n{i}") for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, manifested(df).collect())) == sorted(proven(rows))


def test_manifest_of_odd_rows(spark, varied):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in varied.collect()]
    got = sorted(map(tuple, manifested(varied).collect()), key=key)
    assert got == sorted(proven(rows), key=key)
    assert manifested(varied.filter("false")).count() == 0


def test_languages_are_recognised_on_held_out_documents(spark, documents, sf):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.op11_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(spark, varied):
    labelled = varied.filter("lang IS NOT NULL")
    rows = langid.identified(varied, labelled).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.lang_pred in ("en", "", "de", "xx", "und")
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 8)] == ["und", "und", "und", "en"]
    assert {r.lang_pred for r in langid.identified(varied, labelled.filter("false")).collect()} == {"und"}
    assert langid.identified(varied.filter("false"), labelled).count() == 0


def test_grams_stay_inside_words():
    h, doc = langid.grams(["ab", "", "a-b", "é"], (3,))
    assert Counter(doc.tolist()) == {0: 2, 2: 2, 3: 1}
    assert len(set(h.tolist())) == 5
    assert langid.grams(["AB"], (3,))[0].tolist() == h[:2].tolist()


def test_filter_has_every_language_of_a_gram_and_few_others(spark):
    """More than 64 languages; each has a word of its own, all share one."""
    letters = "abcdefghij"
    own = lambda i: letters[i // 10] + letters[i % 10] + "qxzw"
    rows = [(2 * i + j, f"{own(i)} common", f"l{i:02d}") for i in range(70) for j in range(2)]
    names, slices = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(names) == 70 and slices.shape[1] == 2
    h, doc = langid.grams([own(i) for i in range(70)] + ["common"])
    hits = langid.counts_by_language(h, doc, 71, slices, 70)
    number = [int(x[1:]) for x in names]
    assert all(hits[number[k], k] == (doc == number[k]).sum() for k in range(70))
    assert (hits[70] == (doc == 70).sum()).all()


@pytest.mark.parametrize("name", ["op12_merkle", "op13_importance"])
def test_sql(spark, name):
    same(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.ORACLES[name])
