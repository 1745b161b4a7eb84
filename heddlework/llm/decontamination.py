"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents may be long. The items are put into partitions by size: partition
``p`` holds items of ``2**(p-1)`` to ``2**p`` shingles. For each partition every document is looked
at through overlapping windows of twice the partition's upper size, so that the Jaccard similarity
of an item and a window that holds it has a lower bound which does not depend on the length of the
document (0.19 at the threshold for items of four shingles or more, so 64 values miss one with 1e-6). An
item and a window are a candidate pair if one of ``hashes`` MinHash values agrees. Items of fewer than
``FEW`` shingles would share too little with any window: all their shingles are looked up. Each
candidate is then verified exactly: the share of the item's shingles, by their 64-bit hashes, which the
whole document has. An item whose shingles lie scattered over more than a window is not looked for.

The items of a pass travel to the executors in a broadcast of at most ``max_shingles`` shingles. A
larger benchmark takes several passes over the documents, each with the next block of items, so the
documents are never shuffled, and no task holds more than a batch of documents and one block.

Empty inputs: a document or item that is null, empty or only white space has no shingles and takes
no part. Text with fewer than ``n`` words is one shingle. Repeated document rows give repeated
results; items with equal text are all reported, and those without id with a null item_id. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table, texts

#: Windows are made of blocks of so many shingles.
BLOCK = 8
#: Items of fewer shingles than this are found by any shingle.
FEW = 4
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


class Index:
    """The items of one pass, by size partition; small enough to send to each executor."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], hashes: int):
        self.ids, self.hashes = ids, hashes
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.shingles, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        #: Which shingle is in which item, sorted by shingle.
        order = np.argsort(inverse, kind="stable")
        self.of = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.of_first = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.shingles)))])
        values = np.concatenate(sets)
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        signatures = tk.minhash(values, first, hashes)
        #: By level: window size in blocks, for each function a filter of bits, and the sorted (value, item) of its items.
        self.levels = []
        level = np.maximum(np.ceil(np.log2(np.maximum(self.sizes, 1) / BLOCK)).astype(int), 0)
        #: The (shingle, item) of small items, sorted, and a filter of bits for them.
        few = self.sizes[self.of] < FEW
        self.few = np.repeat(self.shingles, np.diff(self.of_first))[few], self.of[few]
        self.few_seen = np.zeros(1 << 20, bool)
        self.few_seen[(self.few[0] & tk.U((1 << 20) - 1)).astype(np.int64)] = True
        for p in np.unique(level[self.sizes >= FEW]):
            own = np.flatnonzero((level == p) & (self.sizes >= FEW))
            tables = []
            for i in range(hashes):
                v = signatures[own, i]
                order = np.argsort(v, kind="stable")
                tables.append((v[order], own[order]))
            bits = max(12, int(np.ceil(np.log2(len(own)))) + 7)
            seen = np.zeros((hashes, 1 << bits), bool)
            for i in range(hashes):
                seen[i, tables[i][0] & np.uint32((1 << bits) - 1)] = True
            self.levels.append((2 * (1 << int(p)), bits, seen, tables))

    def search(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Candidate pairs as document * items + item, for documents with the given shingles in order."""
        found: list[np.ndarray] = []
        count = np.diff(first)
        blocks = -(-count // BLOCK)
        at = np.concatenate([[0], np.cumsum(blocks)])
        if not at[-1]:
            return np.zeros(0, np.int64)
        if len(self.few[0]):
            hit = np.flatnonzero(self.few_seen[(values & tk.U((1 << 20) - 1)).astype(np.int64)])
            a0, a1 = np.searchsorted(self.few[0], values[hit], "left"), np.searchsorted(self.few[0], values[hit], "right")
            times = a1 - a0
            which = np.repeat(a0 - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            found.append(np.unique(np.repeat(np.searchsorted(first, hit, "right") - 1, times) * len(self.ids) + self.few[1][which]))
        if not self.levels:
            return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        # Each document's shingles are filled up to whole blocks with its last one, which changes no minimum.
        doc = np.repeat(np.arange(len(count)), blocks * BLOCK)
        place = np.arange(at[-1] * BLOCK) - np.repeat(at[:-1] * BLOCK, blocks * BLOCK)
        full = values[first[:-1][doc] + np.minimum(place, count[doc] - 1)]
        # One row for each place in a block, so that the minimum over blocks runs along whole rows.
        low = np.ascontiguousarray((full >> tk.U(16)).astype(np.uint32).reshape(-1, BLOCK).T)
        v, spare = np.empty_like(low), np.empty_like(low)
        doc, place = doc[::BLOCK], place[::BLOCK] // BLOCK
        left = blocks[doc] - place  # blocks from here to the document's end
        widths = [1 << j for j in range(self.levels[-1][0].bit_length() - 1)]
        #: What takes blocks beyond the document's end out of a minimum.
        beyond = {w: np.where(left > w, 0, 0xFFFFFFFF).astype(np.uint32) for w in widths}
        step = np.empty(len(doc), np.uint32)
        for i, (x, a) in enumerate(zip(*tk.seeds(self.hashes), strict=True)):
            least, width = tk.permuted(low, x, a, v, spare).min(axis=0), 1
            for wide, bits, seen, tables in self.levels:
                while width < wide:  # the minimum over twice as many blocks, within the document
                    cut = min(width, len(step))
                    step[: len(step) - cut] = least[cut:]
                    step[len(step) - cut :] = 0xFFFFFFFF
                    np.maximum(step, beyond[width], out=step)
                    np.minimum(least, step, out=least)
                    width *= 2
                hit = np.flatnonzero(seen[i][least & np.uint32((1 << bits) - 1)])
                if len(hit):
                    sorted_values, items = tables[i]
                    a0, a1 = np.searchsorted(sorted_values, least[hit], "left"), np.searchsorted(sorted_values, least[hit], "right")
                    times = a1 - a0
                    if times.any():
                        which = np.repeat(a0 - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                        found.append(np.unique(np.repeat(doc[hit], times) * len(self.ids) + items[which]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def verify(self, pairs: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each candidate, how many of the item's shingles the document has."""
        n = len(self.ids)
        shared = np.zeros(len(pairs), np.int64)
        for doc in np.unique(pairs // n):
            own = np.unique(values[first[doc] : first[doc + 1]])
            at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
            at = at[self.shingles[at] == own]
            counts = np.zeros(n, np.int64)
            for a in at:
                counts[self.of[self.of_first[a] : self.of_first[a + 1]]] += 1
            here = slice(*np.searchsorted(pairs, [doc * n, doc * n + n]))
            shared[here] = counts[pairs[here] % n]
        return shared


def item_blocks(items: DataFrame, n: int, hashes: int, max_shingles: int) -> Iterator[Index]:
    """The benchmark in blocks of at most max_shingles shingles; an item larger than that is a block of its own.

    The driver reads the items one Spark partition after the other and builds one block at a time; each
    block is then sent to the executors, which keep it on disk where memory is short.
    """
    ids: list[int | None] = []
    sets: list[np.ndarray] = []
    size = 0
    for row in items.toLocalIterator():
        for b in tk.batches(pa.array([row["text"]], pa.string())):
            values = np.unique(tk.shingles(b, n)[0])
        if not len(values):
            continue
        if sets and size + len(values) > max_shingles:
            yield Index(np.array(ids, object), sets, hashes)
            ids, sets, size = [], [], 0
        ids.append(row["item_id"])
        sets.append(values)
        size += len(values)
    if sets:
        yield Index(np.array(ids, object), sets, hashes)


def held(index: Index, texts: pa.Array, n: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the texts, items that they contain to the threshold or more, and how many of their shingles."""
    for b in tk.batches(texts):
        values, first = tk.shingles(b, n)
        pairs = index.search(values, first)
        if not len(pairs):
            continue
        shared = index.verify(pairs, values, first)
        doc, item = pairs // len(index.ids), pairs % len(index.ids)
        keep = shared >= threshold * index.sizes[item] - 1e-9
        yield doc[keep] + b.rows.start, item[keep], shared[keep]


def contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, hashes: int = 64, max_shingles: int = 1 << 20) -> DataFrame:
    """One row for each document and benchmark item that it contains to the threshold or more."""
    spark = documents.sparkSession
    docs = texts(documents)
    out = None
    for index in item_blocks(texts(benchmark, "item_id"), n, hashes, max_shingles):
        sent = spark.sparkContext.broadcast(index)

        def look(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in rows:
                for doc, item, shared in held(index, batch.column("text"), n, threshold):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc)), pa.array(index.ids[item], pa.int64()), pa.array(shared), pa.array(index.sizes[item]), pa.array(shared / index.sizes[item])],
                        names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        part = docs.mapInArrow(look, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def cleaned(documents: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, hashes: int = 64, max_shingles: int = 1 << 20) -> DataFrame:
    """The documents, with all their columns, that contain no benchmark item to the threshold."""
    schema = documents.schema
    for index in item_blocks(texts(benchmark, "item_id"), n, hashes, max_shingles):
        sent = documents.sparkSession.sparkContext.broadcast(index)

        def look(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                stays = np.ones(batch.num_rows, bool)
                for doc, _, _ in held(sent.value, batch.column("text"), n, threshold):
                    stays[doc] = False
                yield batch.filter(pa.array(stays))

        documents = documents.mapInArrow(look, schema)
    return documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents which contain a benchmark item go. Each row is judged by its own text, so null and repeated ids do not matter."""
    return cleaned(docs, table(spark, sf_dir, "benchmark"))
