"""Language-model scores: masked pseudo-likelihood with a bidirectional window network.

1. Word counts over all documents: counted in each task, summed by a shuffle into a table of every
   word, so what is gathered grows with the corpus. The ``VOCABULARY`` most frequent words are known
   to the network, all others fall into ``BUCKETS`` by hash.
2. The network sees the ``SIDE`` words on either side of a masked word (an embedding for each known
   word and each bucket, one hidden layer) and gives the probability of the word's class by a
   hierarchical softmax: one of ``GROUPS`` groups of classes, then one of the ``INSIDE`` classes of the
   group. Classes go by frequency: all but the last ``HASHED`` hold one word each; those hold the
   others, known or not, by hash. It is trained in ``ROUNDS`` passes over all documents; pass k masks
   every word whose hash and place give k modulo ``ROUNDS``, so each position is a target once.
   Each task trains its own copy on its documents; copies, with their step sizes, are averaged by
   masked words: sums of slices, first in parts and then whole. Only the averages, whose number
   is fixed, reach the driver.
3. Every word of every text is then predicted from both sides: log p(class | both sides) + log
   p(word | class), the latter from the counts of all words. Those of words that the network does
   not know are joined from the table of counts. A document's score is the sum over its words.

A null or empty text has no words: score 0 and no mean. Repeated rows count as often as they occur
and get equal scores. Of words that occur equally often those of lower hashes are known. A word without a count (only in texts that were not counted) stands for one
occurrence. Other columns are ignored. Scores depend a little on how files are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import cut, table, texts

VOCABULARY, BUCKETS = 8192, 1024
GROUPS, INSIDE, HASHED = 32, 32, 64
CLASSES, EDGE = GROUPS * INSIDE, VOCABULARY + BUCKETS
SIDE, EMBED, HIDDEN = 3, 8, 16
ROUNDS, RATE, BATCH, SLICE, PARTS = 2, 0.01, 8192, 4096, 32


class Vocabulary:
    """Known words in order of their counts, and log p(word | class) for them; ``total`` counts the words of each class."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, others: dict[int, int]):
        self.known, self.ids = np.sort(hashes), np.argsort(hashes).astype(np.int32)
        total = np.zeros(CLASSES)
        np.add.at(total, self.classes(hashes, np.arange(len(hashes))), counts)
        for c, n in others.items():
            total[c] += n
        self.total = np.maximum(total, 1)
        self.log_total = np.log(self.total)
        self.log_count = np.append(np.log(np.maximum(counts, 1)), 0.0)

    @staticmethod
    def classes(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Classes by frequency, the last ones by hash."""
        return np.where(ids < CLASSES - HASHED, ids, CLASSES - HASHED + (hashes % tk.U(HASHED)).astype(np.int64)).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The network's input for each word (its rank, or a bucket), and its class."""
        ids = (VOCABULARY + hashes % tk.U(BUCKETS)).astype(np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            ids = np.where(self.known[at] == hashes, self.ids[at], ids)
        return ids, self.classes(hashes, ids)

    def log_p(self, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log p(word | class); for words that are not known, as if they had occurred once."""
        return self.log_count[np.minimum(ids, len(self.log_count) - 1)] - self.log_total[classes]


class Network:
    """Embeddings of the words around, a hidden layer, and the hierarchical softmax over classes."""

    SHAPES = ((EDGE + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, INSIDE), (GROUPS, INSIDE))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray):
        """From all parameters in one array, followed by the sums of squares that set their steps."""
        self.parts, self.squares, at = [], [], 0
        for held in (self.parts, self.squares):
            for shape in self.SHAPES:
                n = int(np.prod(shape))
                held.append(flat[at : at + n].astype(np.float32).reshape(shape))
                at += n

    @classmethod
    def start(cls, total: np.ndarray) -> Network:
        r = np.random.default_rng(5)
        p = (total + 1).reshape(GROUPS, INSIDE)
        parts = [r.normal(0, 0.3, cls.SHAPES[0]), r.normal(0, 0.1, cls.SHAPES[1]), np.zeros(HIDDEN), r.normal(0, 0.1, cls.SHAPES[3]), np.log(p.sum(axis=1) / p.sum()), r.normal(0, 0.1, cls.SHAPES[5]), np.log(p / p.sum(axis=1, keepdims=True))]
        return cls(np.concatenate([*(x.ravel() for x in parts), np.full(cls.SIZE, 1e-6)]))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.parts, *self.squares)])

    @staticmethod
    def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised probabilities of each row, and their sums. The hidden layer is bounded, so no row needs its maximum taken out."""
        e = np.exp(np.clip(z, -60, 60, out=z))
        return e, e @ np.ones(e.shape[1], np.float32)

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.parts[0][around].reshape(len(around), -1)
        return x, np.tanh(x @ self.parts[1] + self.parts[2])

    def log_p(self, around: np.ndarray, classes: np.ndarray) -> np.ndarray:
        v, c, u, d = self.parts[3:]
        h = self.hidden(around)[1]
        group, inside = np.divmod(classes, INSIDE)
        rows = np.arange(len(h))
        e, total = self._softmax(h @ v + c)
        out = np.log(e[rows, group] / total)
        order = np.argsort(group, kind="stable")
        h, inside = h[order], inside[order]
        ends = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for g in np.flatnonzero(np.diff(ends)):
            own = slice(ends[g], ends[g + 1])
            e, total = self._softmax(h[own] @ u[g] + d[g])
            out[order[own]] += np.log(e[rows[: len(e)], inside[own]] / total)
        return out

    def learn(self, around: np.ndarray, classes: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad on a batch."""
        e, w, b, v, c, u, d = self.parts
        n = len(classes)
        group, inside = np.divmod(classes, INSIDE)
        order = np.argsort(group, kind="stable")
        around, group, inside = around[order], group[order], inside[order]
        x, h = self.hidden(around)
        p, total = self._softmax(h @ v + c)
        p /= total[:, None]
        p[np.arange(n), group] -= 1
        p /= n
        dh = p @ v.T
        du, dd = np.zeros_like(u), np.zeros_like(d)
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in np.flatnonzero(np.diff(ends)):
            own = slice(ends[g], ends[g + 1])
            q, total = self._softmax(h[own] @ u[g] + d[g])
            q /= total[:, None]
            q[np.arange(len(q)), inside[own]] -= 1
            q /= n
            du[g], dd[g] = h[own].T @ q, q.sum(axis=0)
            dh[own] += q @ u[g].T
        dh *= 1 - h * h
        dx = np.ascontiguousarray((dh @ w.T).reshape(-1, EMBED).T)
        flat = around.ravel()
        de = np.empty_like(e)
        for j in range(EMBED):
            de[:, j] = np.bincount(flat, dx[j], EDGE + 1)
        for part, square, g in zip(self.parts, self.squares, (de, x.T @ dh, dh.sum(axis=0), h.T @ p, p.sum(axis=0), du, dd), strict=True):
            square += g * g
            part -= rate * g / np.sqrt(square)


def around(ids: np.ndarray, b: tk.Batch, at: np.ndarray) -> np.ndarray:
    """The words on both sides of the given ones; beyond a text's ends the edge."""
    doc = np.searchsorted(b.first, at, "right") - 1
    steps = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
    place = at[:, None] + steps
    inside = (place >= b.first[doc][:, None]) & (place < b.first[doc + 1][:, None])
    return np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], EDGE)


def count_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        parts = [np.unique(tk.word_hashes(b), return_counts=True) for b in tk.batches(batch.column("text"))]
        if parts:
            words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the corpus, by its hash."""
    return cut(docs.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    rows = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()  # at most VOCABULARY
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    hashes, n = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.float64)
    known = counts.sparkSession.createDataFrame([(r["word"],) for r in rows], "word long")
    # HASHED divides 2**64, so the remainder of a signed number is that of the unsigned one.
    rest = counts.join(F.broadcast(known), "word", "left_anti").groupBy(F.pmod("word", F.lit(HASHED)).alias("c")).agg(F.sum("n").alias("n")).collect()  # at most HASHED
    return Vocabulary(hashes, n, {CLASSES - HASHED + r["c"]: r["n"] for r in rest})


SLICES = "slice int, part int, value binary, weight double"


def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices of arrays and their weights; what is held grows with the number of slices alone."""
    sums: dict[tuple[int, int], list] = {}
    for batch in rows:
        for s, part, value, weight in zip(*(batch.column(k).to_pylist() for k in ("slice", "part", "value", "weight")), strict=True):
            held = sums.setdefault((s, part), [0.0, 0.0])
            held[0] = held[0] + np.frombuffer(value, np.float64)
            held[1] += weight
    if sums:
        keys, values = zip(*sums.items(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([v[0].tobytes() for v in values], pa.binary()), pa.array([v[1] for v in values], pa.float64())], names=["slice", "part", "value", "weight"])


def trained(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS, batch_words: int = BATCH, rate: float = RATE) -> np.ndarray:
    context = docs.sparkSession.sparkContext
    network = Network.start(words.total).flat()
    for k in range(rounds):
        sent = context.broadcast((words, network.astype(np.float32)))

        def run(rows: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            words, flat = sent.value
            net, seen, held, waiting, part = Network(flat), 0, [], 0, 0
            for batch in rows:
                for b in tk.batches(batch.column("text")):
                    hashes = tk.word_hashes(b)
                    if not seen and not waiting and len(hashes):
                        part = int(hashes[0]) % PARTS
                    ids, classes = words(hashes)
                    place = np.arange(len(hashes)) - np.repeat(b.first[:-1], b.n_words)
                    at = np.flatnonzero(tk.mix(hashes + place.astype(tk.U)) % tk.U(ROUNDS) == tk.U(k % ROUNDS))
                    held.append((around(ids, b, at), classes[at]))
                    waiting += len(at)
                    if waiting >= batch_words:
                        x, y = (np.concatenate(z) for z in zip(*held, strict=True))
                        whole = waiting - waiting % batch_words
                        for i in range(0, whole, batch_words):
                            net.learn(x[i : i + batch_words], y[i : i + batch_words], rate)
                        seen += whole
                        held, waiting = [(x[whole:], y[whole:])], waiting - whole
            if waiting:
                net.learn(*(np.concatenate(z) for z in zip(*held, strict=True)), rate)
                seen += waiting
            if seen:
                out = net.flat().astype(np.float64) * seen
                n = -(-len(out) // SLICE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, part, np.int32)), pa.array([out[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(n)], pa.binary()), pa.array(np.full(n, float(seen)))], names=["slice", "part", "value", "weight"]
                )

        parts = docs.select("text").mapInArrow(run, SLICES).repartition("slice", "part").mapInArrow(added, SLICES).withColumn("part", F.lit(0))
        rows = sorted(parts.repartition("slice").mapInArrow(added, SLICES).collect(), key=lambda r: r["slice"])  # slices of one network
        if rows:
            network = np.concatenate([np.frombuffer(r["value"], np.float64) / r["weight"] for r in rows])
    return network


def scored_by(documents: DataFrame, counts: DataFrame, words: Vocabulary, network: np.ndarray) -> DataFrame:
    """doc_id, number of words, summed log-probability and its mean for a word, by a trained network and counts."""
    docs = texts(documents).withColumn("row", F.monotonically_increasing_id())
    sent = documents.sparkSession.sparkContext.broadcast((words, network.astype(np.float32)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = sent.value
        net = Network(flat)
        for batch in rows:
            n, score, other, times, sizes = [], [], [], [], []
            for b in tk.batches(batch.column("text")):
                hashes = tk.word_hashes(b)
                ids, classes = words(hashes)
                log = words.log_p(ids, classes)
                for i in range(0, len(classes), BATCH):
                    at = np.arange(i, min(i + BATCH, len(classes)))
                    log[at] += net.log_p(around(ids, b, at), classes[at])
                total = np.concatenate([[0.0], np.cumsum(log)])
                n.append(b.n_words.astype(np.int64))
                score.append(total[b.first[1:]] - total[b.first[:-1]])
                # The words that the network does not know, by text and in order, with how often they occur.
                doc, rare = b.doc, np.flatnonzero(ids >= VOCABULARY)
                order = rare[np.lexsort((hashes[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                first = np.flatnonzero(new)
                other.append(hashes[order[first]].view(np.int64))
                times.append(np.diff(np.append(first, len(order))).astype(np.int32))
                sizes.append(np.bincount(doc[order[first]], minlength=len(b.n_words)))
            if n:
                ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(score)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(other))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times)))],
                    names=["row", "doc_id", "n_words", "log_p", "other", "times"],
                )

    first = cut(docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, log_p double, other array<long>, times array<int>"), "scores")
    # Counts of 1 add nothing. No word beyond the vocabulary is frequent enough to be a hot key.
    rare = first.select("row", F.explode(F.arrays_zip("other", "times")).alias("x")).select("row", F.col("x.other").alias("word"), "x.times")
    more = rare.join(counts.filter("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    out = first.select("row", "doc_id", "n_words", "log_p").join(more, "row", "left").withColumn("log_p", F.col("log_p") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_p", F.when(F.col("n_words") > 0, F.col("log_p") / F.col("n_words")).alias("mean_log_p"))


def scored(documents: DataFrame, rounds: int = ROUNDS, batch_words: int = BATCH, rate: float = RATE) -> DataFrame:
    """doc_id, number of words, summed log-probability and its mean for a word; network and counts come from the same documents."""
    docs = texts(documents)
    counts = counted(docs)
    words = vocabulary(counts)
    return scored_by(documents, counts, words, trained(docs, words, rounds, batch_words, rate))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
