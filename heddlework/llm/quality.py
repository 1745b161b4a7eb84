"""Quality rules by document and by host.

Every text is measured whole: words, symbols, repeated lines, and words inside 8-word windows that
occur more than once. Rules on these measures give failures for each document. For each host (the
document's source) and rule the rate of failures is shrunk towards all hosts' mean with a beta prior
whose parameters come from the rates' mean and variance over hosts. From the posterior's mean and
standard deviation follow two verdicts, which are joined back to the host's documents:

* a host with a rate of surely ``REJECT`` or more (two deviations below the mean still reach it) is
  rejected: all its documents go;
* a host with a rate surely above the average (one deviation) is held to that rule: its documents
  that fail the rule go, base rule or not. Elsewhere a failure of symbols or lines alone is let pass.

A null text has no words and fails. A null source is a host of its own. Repeated rows count as often
as they occur, and hosts with equal rates and sizes get equal verdicts. The operator ignores further
columns, the stage keeps them, whatever their names. Hosts are few columns and few rows; a host with a third of all documents is summed in
parts before the shuffle, and the verdicts are broadcast or dealt out by size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import cut, join_by_source, table

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host is rejected if its shrunk rate of failures, less so many standard deviations, reaches this share.
REJECT, WIDE = 0.5, 2.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which (key, doc) occur more than once."""
    full = tk.mix(keys ^ (doc.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)))
    order = np.argsort(full)
    same = full[order][1:] == full[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(b: tk.Batch) -> list[np.ndarray]:
    """The MEASURES of each text."""
    n, doc = len(b.offsets) - 1, b.doc
    word_char = ~tk.SPACE[b.data] & ((b.data & 0xC0) != 0x80)
    # Lines end at \n or with the text; those without a word do not count.
    breaks = np.flatnonzero(b.data == 10)
    starts = np.unique(np.concatenate([b.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(b.data)]
    # A group of empty texts has neither bytes nor lines.
    ends = np.append(starts[1:], len(b.data))[: len(starts)]
    ends = ends - (b.data[ends - 1] == 10)
    line_doc = np.searchsorted(b.offsets, starts, "right") - 1
    full = np.searchsorted(b.starts, starts) < np.searchsorted(b.starts, ends)
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    lines = tk.mix(tk.Sums(b.data)(starts, ends) ^ (line_doc.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)))
    distinct = np.unique(lines, return_index=True)[1]
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[distinct], minlength=n)
    # Words inside repeated windows.
    hashes = tk.word_hashes(b)
    begin = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= np.repeat(b.first[1:], b.n_words))
    begin = begin[_repeats(tk.Sums(hashes)(begin, begin + WINDOW), doc[begin])] if len(begin) else begin
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.subtract.at(cover, begin + WINDOW, 1)
    repeated = np.cumsum(cover)[:-1] > 0
    return [b.n_words.astype(np.int64), _sums(word_char, b.offsets), _sums(_SYMBOL[b.data], b.offsets), dup_lines.astype(np.int64), _sums(repeated, b.first)]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            columns = [np.concatenate(x) for x in zip(*(measure(b) for b in tk.batches(batch.column("text"))), strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *map(pa.array, columns)], names=["doc_id", "source", *MEASURES])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES))


#: By name, when a document fails; the first two are the base rules.
RULES = {"short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > n_words"}
BASE_FAILED = f"({RULES['short']} OR {RULES['repeats']})"


def host_verdicts(measures: DataFrame, reject: float = REJECT) -> DataFrame:
    """source, ``host_rejected`` and ``strict_<rule>`` of the hosts with any verdict against them."""
    hosts = measures.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(f"CAST({rule} AS LONG)")).alias(k) for k, rule in RULES.items()))
    hosts = cut(hosts, "hosts")
    prior = hosts.agg(*(F.avg(F.col(k) / F.col("n")).alias(f"m_{k}") for k in RULES), *(F.var_pop(F.col(k) / F.col("n")).alias(f"v_{k}") for k in RULES))
    both = hosts.crossJoin(F.broadcast(prior))  # prior is one row
    rejected, strict = F.lit(False), {}
    for k in RULES:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        # Moments of a beta distribution; hosts that all fail alike (no variance) keep the mean.
        strength = m * (1 - m) / v - 1
        rate = F.when(v > 0, (F.col(k) + m * strength) / (F.col("n") + strength)).otherwise(m)
        spread = F.when(v > 0, F.sqrt(F.greatest(F.lit(0.0), rate * (1 - rate)) / (F.col("n") + strength + 1))).otherwise(F.lit(0.0))
        rejected = rejected | (rate - WIDE * spread >= reject)
        strict[k] = rate - spread > m + 1e-9
    both = both.select("source", rejected.alias("host_rejected"), *(x.alias(f"strict_{k}") for k, x in strict.items()))
    return both.filter(" OR ".join(["host_rejected", *(f"strict_{k}" for k in RULES)]))


def verdicts(measures: DataFrame, reject: float = REJECT) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``."""
    out = join_by_source(measures, host_verdicts(measures, reject), "source").withColumn("base_failed", F.expr(BASE_FAILED))
    bad = F.coalesce(F.expr(" OR ".join(["host_rejected", *(f"(strict_{k} AND {rule})" for k, rule in RULES.items())])), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("host_rejected", *(f"strict_{k}" for k in RULES))


def judged(documents: DataFrame, reject: float = REJECT) -> DataFrame:
    """One row for each document: its measures, whether it fails the base rules, and the verdict."""
    return verdicts(cut(measured(documents), "measures"), reject).select("doc_id", *MEASURES, "base_failed", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail the base rules, or by a verdict on their host, go.

    Texts are measured once: the measures are written beside the columns of documents, whatever these are called.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names).withColumns({"source": F.col(names[docs.columns.index("source")]).cast("string"), "_t": F.coalesce(F.col(names[docs.columns.index("text")]).cast("string"), F.lit(""))})
    schema = T.StructType([*held.drop("_t").schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = [measure(b) for b in tk.batches(batch.column("_t"))]
            if parts:
                kept = [batch.column(c) for c in (*names, "source")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], names=[*names, "source", *MEASURES])

    out = verdicts(cut(held.mapInArrow(run, schema), "measured")).filter("kept")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c ON c.rid = d.rid),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (n_words < 20) AS f1, count(*) FILTER (100 * n_repeat_words > 30 * n_words) AS f2,
         count(*) FILTER (10 * n_symbols > n_words) AS f3, count(*) FILTER (10 * n_dup_lines > n_words) AS f4
  FROM f GROUP BY source),
u AS (SELECT source, n, k, x FROM (SELECT source, n, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS x FROM h)),
p AS (SELECT k, avg(x / n) AS m, var_pop(x / n) AS v FROM u GROUP BY k),
s AS (SELECT source, u.k, n, m, v, CASE WHEN v > 0 THEN (x + m * (m * (1 - m) / v - 1)) / (n + m * (1 - m) / v - 1) ELSE m END AS q FROM u JOIN p ON p.k = u.k),
b AS (SELECT source, k, q, m, CASE WHEN v > 0 THEN sqrt(greatest(0.0, q * (1 - q)) / (n + m * (1 - m) / v)) ELSE 0.0 END AS z FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM f.source AND (q - 2 * z >= 0.5 OR q - z > m + 1e-9 AND
         CASE k WHEN 1 THEN n_words < 20 WHEN 2 THEN 100 * n_repeat_words > 30 * n_words WHEN 3 THEN 10 * n_symbols > n_words ELSE 10 * n_dup_lines > n_words END)) AS kept
FROM f
"""
