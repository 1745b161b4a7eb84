"""N-gram Jaccard join with Bayesian pruning of candidates.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more.

1. Equal texts become one node. Each node gets a signature of 96 MinHash values.
2. Nodes that agree in one of 24 bands of 4 values share a bucket (a pair at the threshold does with
   probability 1 - 3e-6). Within buckets, signatures are compared a step of 16 values at a time; a
   pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches
   the threshold falls below ``tolerance``. What is left connects nodes to candidate components.
3. Within candidate components the same incremental comparison runs over all pairs, and those left
   are verified exactly on their sets. Links are counted and reduced to a spanning forest in the task.
4. Connected components of the links are the classes.

No step writes a row for each pair: buckets and components of more than ``BLOCK`` nodes or ``BYTES`` of
text are cut into blocks, each pair of blocks is a group of its own, and a task returns counts and a
forest, so rows grow with the nodes. A text moves once, or as often as its component has blocks: the
links of every text are counted, and a component of N different texts that are all alike has N * N / 2
of them to verify, however the work is dealt.

A text with fewer than five words has one shingle, all its words. Null and empty texts and such of
white space alone have none: each class of them is the equal texts. ``class_id`` is the least doc_id
of the class (null only if all are); ``n_links`` counts the other documents that a document is
linked to, equal texts included, ``n_text_links`` the other texts. Repeated rows count as copies. Other
columns are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, table, texts
from .components import components

HASHES, BAND, STEP = 96, 4, 16
BLOCK, BYTES = 1024, 64 << 20
THRESHOLD, TOLERANCE = 0.8, 1e-6


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """After each step, the fewest equal values with which P(similarity >= threshold) is still at least the tolerance.

    With a uniform prior and m of n values equal the posterior is Beta(1 + m, 1 + n - m); its upper
    tail at t is the chance that a binomial of n + 1 trials with probability t is m or less.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the other signatures are not pruned against one, comparing a step of values at a time."""
    alive, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for s, need in enumerate(least):
        part = slice(s * STEP, (s + 1) * STEP)
        equal = equal + (others[alive, part] == one[part]).sum(axis=1)
        keep = equal >= need
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, node, sig, bytes): node is a digest of the text, sig null for a text without shingles, bytes the text's length."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[bytes | None] = []
            sizes: list[np.ndarray] = []
            for b in tk.batches(batch.column("text")):
                values, first = tk.shingles(b, n)
                sigs = tk.minhash(values, first, HASHES).astype(np.uint16)
                out += [s.tobytes() if full else None for s, full in zip(sigs, first[:-1] < first[1:], strict=True)]
                sizes.append(np.diff(b.offsets))
            size = pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(out, pa.binary()), size], names=["doc_id", "node", "sig", "bytes"])

    return documents.mapInArrow(run, "doc_id long, node binary, sig binary, bytes long")


def banded(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for each band of each signature."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            keys = sigs.reshape(len(sigs), -1, BAND).copy().view(np.uint64)[:, :, 0]
            keys = tk.mix(tk.mix(keys) + np.arange(1, keys.shape[1] + 1, dtype=tk.U) * tk.U(0x9E3779B97F4A7C15))
            which = pa.array(np.repeat(np.arange(len(sigs)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("node").take(which)], names=["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node binary")


def block_pairs(members: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """Adds ``lo``, ``hi`` and ``part``: a group of more than block rows is cut into blocks, and each row goes to each pair with its block."""
    n = F.ceil(F.col(size) / block).cast("int")
    members = members.withColumn("part", F.pmod(F.xxhash64("node", group), n).cast("int"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return members.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_other", size)


def grouped(rows: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by the keys, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= np.asarray([a != b for a, b in zip(c[1:].to_pylist(), c[:-1].to_pylist(), strict=True)], bool) if pa.types.is_binary(c.type) else np.diff(c.to_numpy()) != 0
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(starts, starts[1:], strict=False):
            if a == z:
                continue
            key = tuple(c[a].as_py() for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _signature_matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)


EDGES = "a binary, b binary"


def candidate_edges(rows: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    """For each bucket (or pair of its blocks) a spanning forest of the pairs that are not pruned: breadth-first, each node compared with those not reached yet."""
    for t in grouped(rows, ["bucket", "lo", "hi"]):
        sigs, names = _signature_matrix(t), t.column("node").to_pylist()
        left = np.arange(len(names))
        a, b = [], []
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = surviving(sigs[at], sigs[left], least)
                a += [names[at]] * len(near)
                b += [names[i] for i in left[near]]
                queue += left[near].tolist()
                left = np.delete(left, near)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


LINKS = "node binary, other binary, n_text_links long, n_links long"


def verified_links(rows: Iterator[pa.RecordBatch], least: list[int], threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    """For each candidate component (or pair of its blocks): link counts of its nodes, and a spanning forest of the links."""
    for t in grouped(rows, ["root", "lo", "hi"]):
        names = t.column("node").to_pylist()
        unique = [i for i, x in enumerate(names) if names.index(x) == i] if len(set(names)) < len(names) else range(len(names))
        t = t.take(pa.array(list(unique))) if len(unique) < len(names) else t
        names = t.column("node").to_pylist()
        sigs, part = _signature_matrix(t), t.column("part").to_numpy()
        copies = t.column("copies").to_numpy()
        sets = []
        for b in tk.batches(t.column("text")):
            values, first = tk.shingles(b, n)
            sets += [np.unique(values[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
        sizes = np.array([len(s) for s in sets])
        universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(universe), np.int32)
        one_block = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        text_links, links = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        root = np.arange(len(names))
        a, b = [], []

        def top(i: int, root: np.ndarray = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(names)):
            others = np.arange(i + 1, len(names))
            if not one_block:
                others = others[part[others] != part[i]]
            others = others[np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]) - 1e-9]
            others = others[surviving(sigs[i], sigs[others], least)]
            if not len(others):
                continue
            own = ids[first[i] : first[i + 1]]
            mark[own] = 1
            if len(others) > len(names) // 4 and len(others) > 8:
                shared = np.add.reduceat(mark[ids], first[:-1])[others]
            else:
                shared = np.array([mark[ids[first[j] : first[j + 1]]].sum() for j in others])
            mark[own] = 0
            others = others[shared >= threshold * (sizes[others] + sizes[i] - shared) - 1e-9]
            text_links[i] += len(others)
            text_links[others] += 1
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for j in others:
                x, y = top(i), top(int(j))
                if x != y:
                    root[y] = x
                    a.append(names[i])
                    b.append(names[j])
        linked = np.flatnonzero(text_links)
        if len(linked):
            none = [None] * len(linked)
            zero = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in linked] + a, pa.binary()), pa.array(none + b, pa.binary()), pa.array(np.concatenate([text_links[linked], zero])), pa.array(np.concatenate([links[linked], zero]))],
                names=["node", "other", "n_text_links", "n_links"],
            )


def classes(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = 5) -> DataFrame:
    """One row for each document: doc_id, node, root (the class by a node of it), class_id, n_links, n_text_links, n_copies."""
    least = least_matches(threshold, tolerance)
    docs = texts(documents).withColumn("node", F.unhex(F.md5("text")))
    signed = cut(signatures(docs, n), "signatures")
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes")), "nodes")
    full = nodes.filter("sig IS NOT NULL")

    bands = banded(full)
    buckets = cut(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = bands.join(buckets, "bucket").join(full.select("node", "sig"), "node")
    members = block_pairs(members, "bucket", "size").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    near = members.select("bucket", "lo", "hi", "node", "sig").mapInArrow(lambda rows: candidate_edges(rows, least), EDGES)
    candidates = cut(components(near), "candidates")

    members = cut(candidates.join(full, "node"), "candidate-nodes")
    # In nodes; a component of long texts counts as more of them.
    size = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("bytes") / BYTES * BLOCK).cast("long"))
    members = cut(members.join(members.groupBy("root").agg(size.alias("size")), "root"), "members")
    # The text of one document of each node; the same row given twice is one node again in the task.
    held = docs.join(members.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("rep"))).drop("_node")
    held = block_pairs(held, "root", "size").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    held = held.select("root", "lo", "hi", "part", "node", "copies", "sig", "text")
    links = cut(held.mapInArrow(lambda rows: verified_links(rows, least, threshold, n), LINKS), "links")

    found = cut(components(links.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))), "classes")
    counts = links.groupBy("node").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("n_links").alias("n_links"))
    ids = cut(found.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id")), "class_ids")
    info = nodes.select("node", "rep", "copies").join(found.join(ids, "root").select("node", "root", "class_id"), "node", "left").join(counts, "node", "left")
    zero = F.lit(0).cast("long")
    info = cut(info.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("n_links", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"), F.col("copies").alias("n_copies")), "info")
    return signed.select("doc_id", "node").join(info, "node")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least doc_id stays, one without only if all are (of rows given twice, one)."""
    # By root: unrelated texts that share a doc_id may have equal class_ids.
    first = classes(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x")).select("x.doc_id", "x.node")
    first = cut(first.select(F.col("doc_id").alias("_id"), F.col("node").alias("_kept")), "kept")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), node.alias("_node"), F.col("doc_id").cast("long").alias("_row"))
    rows = rows.join(first, (F.col("_node") == F.col("_kept")) & F.col("_row").eqNullSafe(F.col("_id")))
    return rows.dropDuplicates(["_node", "_id"]).select(*(F.col(n).alias(c) for c, n in names.items()))
