"""Passages that repeat across documents, by sparse suffix arrays.

A position of a text is retained if the 5 words there are the minimiser (least hash) of one of the
windows of ``W`` such positions around it, so equal passages retain the same positions. Each retained
suffix is keyed by a hash of its first ``T = least + 1 - W`` words; equal keys in one document make
one row. The suffixes of all documents are sorted by (key, document), in ranges that split even
one key over many tasks, and those with a neighbour of equal key in another document are marked.

A run of ``least`` words has a minimiser among its first ``W`` positions whose ``T`` words lie inside
it. So a run that another document has begins at most ``W - 1`` words before a marked position, which
is its minimiser. All suffixes that begin there are sorted in the same way by all their first ``least``
words: those with an equal neighbour in another document are the repeated runs, and which documents
share only a part of a run has no influence. Runs that overlap or touch are merged to passages.

A text of fewer than ``least`` words (null: none) has no passage. Words are maximal runs of what is
not ASCII white space. Equal rows count as one document, rows of one doc_id with different texts as
different ones; so are rows without doc_id, whose passages have a null doc_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, table, texts

LEAST, GRAM, W = 50, 5, 16


def _sliding(v: np.ndarray, w: int, better: np.ufunc) -> np.ndarray:
    """better over v[i : i + w] for each i that has so many, by doubling."""
    width = 1
    while 2 * width <= w:
        v = better(v[:-width], v[width:])
        width *= 2
    return better(v[: len(v) - (w - width)], v[w - width :]) if width < w else v


def minimisers(b: tk.Batch, hashes: np.ndarray, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the GRAM words at each word, and the least of the w from each word on (0 where they leave the text)."""
    n = len(hashes)
    end = np.repeat(b.first[1:], b.n_words)
    at = np.arange(n)
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    gram[: n - GRAM + 1] = tk.Sums(hashes)(at[: n - GRAM + 1], at[GRAM - 1 :] + 1) | tk.U(1)
    least = _sliding(gram, w, np.minimum)
    # A window that leaves its text chooses nothing: no gram hashes to 0.
    least[at[: len(least)] + w + GRAM - 1 > end[: len(least)]] = 0
    return gram, least


def retained(b: tk.Batch, hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Indexes of the words where retained suffixes begin."""
    n = len(hashes)
    if n < w + GRAM:
        return np.zeros(0, np.int64)
    gram, least = minimisers(b, hashes, w)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, w, np.maximum)[:n] == gram)


SUFFIXES = "key long, doc_id long, part int, pos int, more array<int>"


def keyed(batch: pa.RecordBatch, b: tk.Batch, hashes: np.ndarray, pos: np.ndarray, length: int) -> pa.RecordBatch:
    """One row for each key of each text, the hash of the words from one of the positions on, with its first position; further ones in a list."""
    doc = b.doc
    key = tk.Sums(hashes)(pos, pos + length)
    both = tk.mix(key ^ (doc[pos].astype(tk.U) * tk.U(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    place = (pos - b.first[doc[pos]]).astype(np.int32)
    count = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
    further = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    more = pa.ListArray.from_arrays(further, pa.array(place[order[~new]]), mask=pa.array(count == 0))
    # In the order of the texts, which packs better on its way to the sort.
    back = np.argsort(order[new])
    at, more = order[new][back], more.take(pa.array(back))
    own = pa.array(doc[pos[at]] + b.rows.start)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[at].view(np.int64)), batch.column("doc_id").take(own), batch.column("part").take(own), pa.array(place[at]), more],
        names=["key", "doc_id", "part", "pos", "more"],
    )


def suffixes(documents: DataFrame, least: int = LEAST, w: int = W) -> DataFrame:
    """(key, doc_id, part, pos, more) of the retained suffixes; part tells texts of one doc_id apart."""
    t = least + 1 - w

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for b in tk.batches(batch.column("text")):
                hashes = tk.word_hashes(b)
                pos = retained(b, hashes, w)
                pos = pos[pos + t <= b.first[1:][b.doc[pos]]]
                if len(pos):
                    yield keyed(batch, b, hashes, pos, t)

    return documents.mapInArrow(run, SUFFIXES)


def whole(documents: DataFrame, least: int = LEAST, w: int = W) -> DataFrame:
    """The same of all suffixes of least words whose minimiser is one of the text's ``marks``, keyed by all of these words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for b in tk.batches(batch.column("text")):
                hashes = tk.word_hashes(b)
                gram, first = minimisers(b, hashes, w)
                marks = batch.column("marks").slice(b.rows.start, b.rows.stop - b.rows.start)
                at = marks.flatten().to_numpy() + np.repeat(b.first[:-1], marks.value_lengths().to_numpy())
                marked = np.full(len(gram), np.iinfo(np.uint64).max, np.uint64)
                marked[at] = gram[at]
                pos = np.flatnonzero(_sliding(marked, w, np.minimum) == first)
                pos = pos[pos + least <= b.first[1:][b.doc[pos]]]
                if len(pos):
                    yield keyed(batch, b, hashes, pos, least)

    return documents.mapInArrow(run, SUFFIXES)


#: Stands for a null doc_id while documents are compared; with the text's hash beside it, it keeps different texts apart.
NO_ID = (1 << 63) - 1
MATCH = "edge boolean, key long, doc_id long, part int, pos int, more array<int>, other long"


def neighbours(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted suffixes: each one whose neighbour has the same key in another document, with that neighbour.

    The first and last row of the range are also given as edges, for ranges that cut a key.
    """
    names, types = ("key", "doc_id", "part", "pos", "more"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    before: list[pa.Array] | None = None  # the last row so far
    waiting = False  # whether that row has no match yet

    def out(edge: bool, x: list[pa.Array], y: list[pa.Array] | None) -> pa.RecordBatch:
        n = len(x[0])
        other = y[1] if y is not None else pa.nulls(n, types[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, edge)), *x, other], names=["edge", *names, "other"])

    for batch in rows:
        if not batch.num_rows:
            continue
        x = [batch.column(k).cast(t) for k, t in zip(names, types, strict=True)]
        if before is None:
            yield out(True, [c[:1] for c in x], None)
        else:
            x = [pa.concat_arrays([c, d]) for c, d in zip(before, x, strict=True)]
        key, doc, part = (c.to_numpy() for c in x[:3])
        match = (key[1:] == key[:-1]) & ((doc[1:] != doc[:-1]) | (part[1:] != part[:-1]))
        previous, following = np.concatenate([[False], match]), np.concatenate([match, [False]])
        report = previous | following
        if before is not None:  # a row of the batch before was reported there if it had a match there
            report[0] = following[0] and waiting
        at = np.flatnonzero(report)
        if len(at):
            partner = pa.array(np.where(previous[at], at - 1, at + 1))
            yield out(False, [c.take(pa.array(at)) for c in x], [c.take(partner) for c in x])
        waiting = not previous[-1] and (len(key) > 1 or before is None or waiting)
        before = [c[-1:] for c in x]
    if before is not None:
        yield out(True, before, None)


def matches(rows: DataFrame) -> DataFrame:
    """The suffixes with an equal key in another text: doc_id, part, pos, more, and other, a document that has it."""
    ordered = rows.repartitionByRange("key", "doc_id", "part", "pos").sortWithinPartitions("key", "doc_id", "part", "pos")
    found = cut(ordered.mapInArrow(neighbours, MATCH), "suffixes")
    # Two edges for each range. Of those with one key, each has the first or else the last of the key's texts as another.
    edges = found.filter("edge").select("key", "doc_id", "part", "pos", "more").distinct()
    own = F.struct("doc_id", "part")
    ends = edges.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo <> hi")
    met = edges.join(ends, "key").select("doc_id", "part", "pos", "more", F.when(own != F.col("lo"), F.col("lo.doc_id")).otherwise(F.col("hi.doc_id")).alias("other"))
    both = found.filter("NOT edge").select("doc_id", "part", "pos", "more", "other").unionByName(met)
    # What holds for the first position of a key in a text holds for the further ones.
    return both.select("doc_id", "part", F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<int>"))).alias("places"), "other")


def passages(documents: DataFrame, least: int = LEAST, w: int = W) -> DataFrame:
    """One row for each passage: doc_id, its first word, the word after its last, and a document that has a part of it too."""
    docs = texts(documents).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("part", F.hash("text"))
    # A text has no more marks than words.
    marks = cut(matches(suffixes(docs, least, w)).groupBy("doc_id", "part").agg(F.flatten(F.collect_list("places")).alias("marks")), "marks")
    around = docs.join(marks, ["doc_id", "part"]).select("doc_id", "part", "text", "marks")
    found = matches(whole(around, least, w)).select("doc_id", "part", F.explode("places").alias("start"), "other")
    by = Window.partitionBy("doc_id", "part").orderBy("start")
    found = found.withColumn("_new", F.coalesce((F.col("start") - F.lag("start").over(by) > least).cast("int"), F.lit(1)))
    found = found.withColumn("_passage", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = found.groupBy("doc_id", "part", "_passage").agg(F.min("start").alias("start"), (F.max("start") + least).alias("stop"), F.min("other").alias("other_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select(known("doc_id"), "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), known("other_id"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
