"""Language identification by n-gram filters that answer for all languages at once.

Letters of a text (lower case, everything else a word boundary) give n-grams inside words, boundaries
included. A Bloom filter with one bit slice for each language has, at each position, the bits of all
languages: the conjunction of an n-gram's ``HASHES`` positions is the set of languages that contain it,
or seem to. Over a text the bits are counted for each language, what false positives alone would give
(the slice's share of set bits to the power ``HASHES``) is taken off, and the highest count decides.

A language contains an n-gram if at least two of its sample's documents have it (one, if the sample has
one) and the share that has it is at least ``SHARE`` of the highest such share of any language. The
filter is fitted on a seeded sample of about ``sample`` labelled documents of each language, a documented
bound; Spark counts the n-grams by document, and the bits are combined by position before the driver gets
them, so it never holds more than ``POSITIONS`` rows for every 64 languages. Every text is read whole.

``und`` with score 0.0 stands for a null text, one without a letter, and any text if nothing could be
learned. If no n-gram is known, the language with most labelled documents is named, with score 0.0; it
also wins ties (then the lower name). A null id is never held out. Rows are judged one by one, so
repeated rows get equal results. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, groups, join_by_source, table, texts

LENGTHS = (3, 4)
POSITIONS, HASHES = 1 << 20, 3
SAMPLE, SHARE, SEED = 2000, 0.2, 5
UNKNOWN = "und"
#: Texts are handled in groups of about so many characters.
GROUP = 1 << 17

_U = np.uint64


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(group: list[str], lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, and the index of the text of each, by length and in order."""
    lowered = [f" {t.lower()} " for t in group]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(group)), [len(t) for t in lowered])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    at = np.flatnonzero(keep)
    letter, doc = letter[at], doc[at]
    codes = np.where(letter, codes[at], 0).astype(_U)
    inside = np.concatenate([[0], np.cumsum(letter)])
    hashes, docs, h = [], [], codes
    for n in range(2, max(lengths) + 1):
        h = h[:-1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in lengths and len(h):
            i = np.flatnonzero(inside[n - 1 : -1] - inside[1 : len(h) + 1] == n - 2)
            hashes.append(tk.mix(h[i] + _U(n)))
            docs.append(doc[i + 1])
    return np.concatenate(hashes or [np.zeros(0, _U)]), np.concatenate(docs or [np.zeros(0, np.int64)])


def positions(hashes: np.ndarray, size: int = POSITIONS) -> Iterator[np.ndarray]:
    """The places of each n-gram in the filter, whose size is a power of two, one hash function after the other."""
    step = (hashes >> _U(32)) | _U(1)
    for i in range(HASHES):
        yield ((hashes + _U(i) * step) & _U(size - 1)).view(np.int64)


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Text and language of about sample documents of each language by a seeded hash, and the languages: most documents first."""
    counts = labelled.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    known = labelled.filter("lang IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    rows = join_by_source(known, counts, "lang").filter(share * F.col("n") < sample)
    languages = counts.orderBy(F.desc("n"), "lang").collect()  # one row for each language
    return rows.select("text", "lang"), [(r["lang"], r["n"]) for r in languages]


def counted(rows: DataFrame) -> DataFrame:
    """lang, gram, n: in how many of the language's documents each n-gram occurs; gram 0 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, group in groups(batch.column("text"), GROUP):
                h, doc = grams(group)
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(1, len(group)))
                own = [np.append(np.unique(x), _U(0)) for x in np.split(h[order], ends)]
                langs = np.array(batch.column("lang")[part].to_pylist(), object)
                for lang in sorted(set(langs)):
                    found, n = np.unique(np.concatenate([own[i] for i in np.flatnonzero(langs == lang)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fitted(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages, and the filter: for each position, bits of all languages in words of 64."""
    rows, languages = sampled(labelled, sample)
    names = [x[0] for x in languages]
    number = {lang: i for i, lang in enumerate(names)}
    slices = np.zeros((POSITIONS, max(1, -(-len(names) // 64))), _U)
    counts = cut(counted(rows), "gram-counts")
    documents = counts.filter("gram = 0").select("lang", F.col("n").alias("all"))
    rates = join_by_source(counts.filter("gram != 0"), documents, "lang").withColumn("rate", F.col("n") / F.col("all"))
    highest = rates.groupBy(F.col("gram").alias("_gram")).agg(F.max("rate").alias("most"))
    known = rates.join(highest, F.col("gram") == F.col("_gram")).filter((F.col("rate") >= SHARE * F.col("most")) & (F.col("n") >= F.least(F.lit(2), "all")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for at in positions(batch.column("gram").to_numpy().view(_U)):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang // 64), pa.array(np.int64(1) << (lang % 64))], names=["at", "word", "bit"])

    for at, word, bits in known.select("lang", "gram").mapInArrow(run, "at long, word long, bit long").groupBy("at", "word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        slices[at, word] = np.int64(bits).view(_U)
    return names, slices


def counts_by_language(hashes: np.ndarray, doc: np.ndarray, n: int, slices: np.ndarray, languages: int) -> np.ndarray:
    """For each text and language the n-grams whose bits are all set."""
    out = np.zeros((n, languages))
    for w in range(slices.shape[1]):
        mask = np.full(len(hashes), _U(0xFFFFFFFFFFFFFFFF))
        for at in positions(hashes):
            mask &= slices[at, w]
        some = np.flatnonzero(mask)
        mask, of = mask[some], doc[some]
        for i in range(64 * w, min(languages, 64 * w + 64)):
            out[:, i] = np.bincount(of[(mask >> _U(i % 64)) & _U(1) == 1], minlength=n)
    return out


def identified(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred and score of every document; the filter is fitted on labelled (doc_id, text, lang). The score is the share of the named language in all corrected counts."""
    names, slices = fitted(labelled, sample)
    set_bits = np.array([np.count_nonzero((slices[:, i // 64] >> _U(i % 64)) & _U(1)) for i in range(len(names))])
    by_chance = (set_bits / POSITIONS) ** HASHES
    sent = documents.sparkSession.sparkContext.broadcast((names, slices, by_chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, slices, by_chance = sent.value
        for batch in batches:
            for part, group in groups(batch.column("text"), GROUP):
                h, doc = grams(group)
                total = np.bincount(doc, minlength=len(group))
                pred, score = np.full(len(group), UNKNOWN, object), np.zeros(len(group))
                if names:
                    hits = counts_by_language(h, doc, len(group), slices, len(names))
                    hits = np.maximum(0, (hits - total[:, None] * by_chance) / np.maximum(1 - by_chance, 1e-9))
                    best, everything = hits.argmax(axis=1), hits.sum(axis=1)
                    known = total > 0
                    pred[known] = np.array(names, object)[best[known]]
                    score = np.where(everything > 0, hits[np.arange(len(group)), best] / np.maximum(everything, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return texts(documents).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, docs.filter(~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
