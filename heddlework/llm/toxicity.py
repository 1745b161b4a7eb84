"""Toxicity by a chain of linear classifiers.

The label columns are predicted one after the other. Each category's model is a logistic regression
on the presence of hashed words and word beginnings, scaled by their log-count ratio between the
classes, and on the probabilities of the earlier categories. While a later model is trained these
probabilities are out-of-fold predictions, so that it sees them as wrong as they will be on new text.

Models are trained on at most ``sample`` labelled documents (half of them positive for the last
category, where there are as many), chosen by a seeded hash of their ids. Probabilities are corrected
from the sample's share of positives to that among all labels. Every document is scored
on its whole text. A null or empty text has no features and gets the models' constants. Labels for
missing documents, null labels and further columns are ignored; of several labels for one document
the highest counts. Without labelled documents of both classes a category's probability is the share
of positives (0.0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table, texts

BITS = 18
BEGINNINGS = (4, 5, 6)  # in bytes
SAMPLE, FOLDS, SEED = 4000, 3, 11


def features(b: tk.Batch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, and where each text's begin."""
    sums = tk.Sums(b.data)
    hashes = [sums(b.starts, b.ends)]
    doc = [b.doc]
    for i, n in enumerate(BEGINNINGS, 1):
        longer = b.ends - b.starts >= n
        hashes.append(tk.mix(sums(b.starts[longer], b.starts[longer] + n) + tk.U(i)))
        doc.append(b.doc[longer])
    key = np.unique((np.concatenate(doc) << BITS) | (np.concatenate(hashes) >> tk.U(64 - BITS)).astype(np.int64))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(b.first)))


class Linear:
    """Logistic regression on sparse 0/1 features and some dense columns."""

    def __init__(self) -> None:
        self.weights, self.dense, self.constant = np.zeros(1 << BITS, np.float32), np.zeros(0), -20.0

    def fit(self, ids: np.ndarray, first: np.ndarray, dense: np.ndarray, y: np.ndarray, rounds: int = 40, decay: float = 1e-4) -> Linear:
        n, size = len(y), np.diff(first)
        self.dense = np.zeros(dense.shape[1])
        if not 0 < y.sum() < n:
            self.constant = float(np.clip(np.log((y.sum() + 1e-9) / (n - y.sum() + 1e-9)), -20, 20)) if n else -20.0
            return self
        row = np.repeat(np.arange(n), size)
        yes, no = (np.bincount(ids[(y == c)[row]], minlength=1 << BITS) for c in (1, 0))
        ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / (n - y.sum() + 2))
        ratio[yes + no < 3] = 0  # what is this rare tells nothing
        use = ratio[ids] != 0
        ids, row = ids[use], row[use]
        x = ratio[ids]
        w, step, self.constant = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0
        d_step, c_step = np.zeros(dense.shape[1]), 0.0
        for _ in range(rounds):
            z = np.bincount(row, x * w[ids], n) + dense @ self.dense + self.constant
            error = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / n
            g = np.bincount(ids, x * error[row], 1 << BITS) - decay * w
            step += g * g
            w += 0.3 * g / (np.sqrt(step) + 1e-6)
            g = dense.T @ error - decay * self.dense
            d_step += g * g
            self.dense += 0.3 * g / (np.sqrt(d_step) + 1e-6)
            c_step += error.sum() ** 2
            self.constant += 0.3 * error.sum() / (np.sqrt(c_step) + 1e-6)
        self.weights = (w * ratio).astype(np.float32)
        return self

    def __call__(self, ids: np.ndarray, first: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        z = total[first[1:]] - total[first[:-1]] + dense @ self.dense + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[which]
    return np.concatenate([ids[first[i] : first[i + 1]] for i in which] or [ids[:0]]), np.concatenate([[0], np.cumsum(size)])


def train(ids: np.ndarray, first: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model for each column of labels, in order."""
    n = len(labels)
    dense, models = np.zeros((n, 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(Linear().fit(ids, first, dense, y))
        if c + 1 == labels.shape[1]:
            break
        ahead = np.zeros(n)
        for k in range(folds):
            out = np.arange(n) % folds == k
            inside = Linear().fit(*_rows(ids, first, np.flatnonzero(~out)), dense[~out], y[~out])
            ahead[out] = inside(*_rows(ids, first, np.flatnonzero(out)), dense[out])
        dense = np.column_stack([dense, ahead])
    return models


def chain(models: list[Linear], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities of the categories, of shape (texts, categories)."""
    p = np.zeros((len(first) - 1, 0))
    for m in models:
        p = np.column_stack([p, m(ids, first, p)])
    return p


def odds(sample: np.ndarray, share: float | None) -> float:
    """By which factor the sample's odds of a positive are above those among all labels."""
    inside = sample.mean() if len(sample) else 0.0
    return inside / (1 - inside) * (1 - share) / share if 0 < inside < 1 and share else 1.0


def corrected(p: np.ndarray, factors: list[float]) -> np.ndarray:
    """Probabilities by the share of positives among all labels, from those of models trained on the balanced sample."""
    return p / (p + (1 - p) * np.array(factors))


def sampled(documents: DataFrame, labels: DataFrame, categories: list[str], sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Features and labels of at most sample labelled documents, and the share of positives among all labels."""
    last = categories[-1]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in categories)).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    picked = known.filter(f"{last} = 1").orderBy(F.xxhash64("doc_id", F.lit(SEED))).limit(sample // 2).unionByName(known.filter(f"{last} = 0").orderBy(F.xxhash64("doc_id", F.lit(SEED))).limit(sample // 2))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for b in tk.batches(batch.column("text"), tk.NOT_ALNUM, lower=True):
                ids, first = features(b)
                out += [ids[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in categories), pa.array(out, pa.binary())], names=["doc_id", *categories, "ids"])

    # The sample has a fixed bound, and so has what is broadcast. Of several texts of one id the least by its features counts.
    held = texts(documents).join(F.broadcast(picked), "doc_id")
    held = held.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} int" for c in categories) + ", ids binary")
    rows = held.groupBy("doc_id", *categories).agg(F.min("ids").alias("ids")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), np.int32)
    first = np.concatenate([[0], np.cumsum([len(r["ids"]) // 4 for r in rows])]).astype(np.int64)
    share = known.agg(*(F.avg(F.col(c)).alias(c) for c in categories)).first()
    return ids, first, np.array([[r[c] for c in categories] for r in rows], np.int64).reshape(-1, len(categories)), [share[c] for c in categories]


def scored(documents: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> DataFrame:
    """doc_id and, for each category, its probability ``p_<category>`` and the verdict ``is_<category>``: whether it is likelier than not in the sample, where half are positive if there are as many."""
    ids, first, known, shares = sampled(documents, labels, categories, sample)
    sent = documents.sparkSession.sparkContext.broadcast((train(ids, first, known), [odds(known[:, i], x) for i, x in enumerate(shares)]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = [chain(sent.value[0], *features(b)) for b in tk.batches(batch.column("text"), tk.NOT_ALNUM, lower=True)]
            if parts:
                p = np.concatenate(parts)
                true = corrected(p, sent.value[1])
                columns = [*(pa.array(true[:, i]) for i in range(p.shape[1])), *(pa.array(p[:, i] >= 0.5) for i in range(p.shape[1]))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(f"p_{c}" for c in categories), *(f"is_{c}" for c in categories)])

    return texts(documents).mapInArrow(run, "doc_id long, " + ", ".join([*(f"p_{c} double" for c in categories), *(f"is_{c} boolean" for c in categories)]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is toxic; the chain's first link, quality, informs the second."""
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return out.select("doc_id", F.col("p_toxic").alias("toxicity"), F.col("is_toxic").alias("toxic"), F.col("p_quality").alias("quality"))
