"""Importance resampling of documents towards the distribution of a target corpus.

Texts have A-Z lower-cased and are split by an untrained pre-tokeniser of the ``tokenizers`` library,
which returns the words with their offsets. Windows over pairs of offsets (start of the first word, end
of the last) are the features: all runs of 1 to ``longest`` words, joined by one space. The bucket of a
feature is its CRC-32 modulo ``buckets``. The CRC of a run follows from those of its words, as appending
``n`` bytes to a text shifts its CRC linearly, so no feature is ever put together.

Every text is split once: its buckets are written, sorted, in two bytes each, and both the histogram of
the corpus and the sums of gains are taken from there. Histograms are summed by task before they are
shuffled; the gains (one number for each bucket) are all that is sent to the tasks. The draw ranks
narrow rows in ranges, so its size may grow with the corpus.

A null or empty text has no words, no features and weight 0. Documents of fewer than ``least_words`` words
are not drawn. A null id is hashed as an empty one, and among equal scores it comes last. Repeated rows
count and are drawn one by one. Without target texts, or without documents, the missing counts are 0.
Further columns are ignored. A text is split in pieces between words, so its length is not bounded.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import cut, groups, table, texts

BUCKETS, LONGEST, LEAST_WORDS, SEED = 10_000, 3, 20, "42"
#: Percent of the eligible documents that are drawn.
PERCENT = 5
#: A word: ASCII digits, lower-case ASCII letters, and whatever is not ASCII.
WORD, NOT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Texts are split in pieces of about so many characters, and handled in groups of about so many.
PIECE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint32
_FULL = _U(0xFFFFFFFF)
#: Words up to this length have a table of their own for the shift by their length.
_SHORT = 64


@cache
def _byte_table() -> np.ndarray:
    """The CRC register after one byte, by its lowest byte before."""
    c = np.arange(256, dtype=_U)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ _U(0xEDB88320), c >> 1).astype(_U)
    return c


def _stepped(c: np.ndarray, byte: np.ndarray | int = 0) -> np.ndarray:
    return _byte_table()[(c ^ _U(byte) if isinstance(byte, int) else c ^ byte) & _U(0xFF)] ^ (c >> _U(8))


def _apply(tables: np.ndarray, c: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """Registers through linear maps: tables has shape (maps, 4, 256), at the map of each register."""
    flat, at = tables.reshape(-1), np.asarray(at) * 1024
    return flat[at + (c & _U(255))] ^ flat[at + 256 + ((c >> _U(8)) & _U(255))] ^ flat[at + 512 + ((c >> _U(16)) & _U(255))] ^ flat[at + 768 + (c >> _U(24))]


@cache
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """The maps for 0 to 63 zero bytes, and for 64, 128, 256, ... of them."""
    one = np.arange(256, dtype=_U)[None, :] << (np.arange(4, dtype=_U) * _U(8))[:, None]
    short = [one]
    for _ in range(_SHORT):
        short.append(_stepped(short[-1]))
    powers = [short[_SHORT]]
    for _ in range(30):
        powers.append(_apply(powers[-1][None], powers[-1], 0))
    return np.stack(short[:_SHORT]), np.stack(powers)


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after n zero bytes each."""
    short, powers = _shift_tables()
    out = _apply(short, c, n % _SHORT)
    if n.size and n.max() >= _SHORT:
        blocks = n // _SHORT
        for i in range(int(blocks.max()).bit_length()):
            odd = np.flatnonzero((blocks >> i) & 1)
            out[odd] = _apply(powers, out[odd], i)
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC register of each slice, begun at zero."""
    size = ends - starts
    out = np.zeros(len(starts), _U)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_SHORT) :]  # those of at most _SHORT bytes, longest first
    at, left = starts[order], size[order]
    c = np.zeros(len(order), _U)
    for j in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left, -j)  # longer than j
        c[:n] = _stepped(c[:n], data[at[:n] + j])
    out[order] = c
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


@cache
def splitter() -> Callable[[str], list[tuple[str, tuple[int, int]]]]:
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str


def offsets(text: str) -> np.ndarray:
    """Start and end of each word of a lowered text, in code points; one row for each word."""
    parts, begin = [], 0
    while begin < len(text):
        gap = NOT_WORD.search(text, begin + PIECE) if begin + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        found = splitter()(text[begin:end] if begin or gap else text)
        parts.append(np.array([x for _, pair in found for x in pair], np.int64) + begin)
        begin = end
    return np.concatenate(parts).reshape(-1, 2) if parts else np.zeros((0, 2), np.int64)


def bucketed(group: list[str], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text, and its features' buckets in ascending order."""
    lowered = [t.encode().translate(_LOWER).decode() for t in group]
    pairs = [offsets(t) for t in lowered]
    words = np.array([len(p) for p in pairs], np.int64)
    front = np.cumsum([0, *map(len, lowered)])
    pair = np.concatenate([p + x for p, x in zip(pairs, front[:-1], strict=True)] or [np.zeros((0, 2), np.int64)])
    data = np.frombuffer("".join(lowered).encode(), np.uint8)
    if len(data) != front[-1]:  # code points to bytes
        pair = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[pair]
    own = registers(data, pair[:, 0], pair[:, 1])
    size = pair[:, 1] - pair[:, 0]
    doc = np.repeat(np.arange(len(group)), words)
    c, length, kind, found = own, size, np.uint16 if buckets <= 1 << 16 else np.uint32, []
    for n in range(1, longest + 1):
        if n > 1:  # a space and one more word
            c = shifted(_stepped(c[:-1], 0x20), size[n - 1 :]) ^ own[n - 1 :]
            length = length[:-1] + 1 + size[n - 1 :]
        inside = np.flatnonzero(doc[: len(c)] == doc[n - 1 :])
        crc = c[inside] ^ shifted(np.full(len(inside), _FULL), length[inside]) ^ _FULL
        cuts = np.cumsum(np.maximum(words - n + 1, 0))[:-1]
        found.append(np.split((crc % _U(buckets)).astype(kind), cuts))
    return words, [np.sort(np.concatenate(x)) for x in zip(*found, strict=True)]


def featured(documents: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and the sorted buckets of all features of each text, as bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, group in groups(batch.column("text"), PIECE):
                words, found = bucketed(group, buckets, longest)
                arrays = [batch.column("doc_id")[part], pa.array(words), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "buckets"])

    return texts(documents).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features are in each bucket; one row for each bucket and task is shuffled, one for each bucket collected."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in rows:
            for x in batch.column("buckets"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of each bucket: the floor of a thousand times the log ratio of its smoothed shares."""
    t_all, s_all, k = int(target.sum()), int(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + float(k)) / ((s + 1.0) * (t_all + float(k))))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Adds ``weight``, the sum of the gains of a document's features, in place of the buckets."""
    kind, sent = np.uint16 if len(gain) <= 1 << 16 else np.uint32, features.sparkSession.sparkContext.broadcast(gain)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sums = [int(sent.value[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score (weight plus seeded Gumbel noise) and rank; the rank is null for documents that are not drawn.

    Of both tables the column ``text`` is read. Drawn are the highest scores among documents of at least least_words words.
    """
    features = cut(featured(documents, buckets, longest), "features")
    aimed = histogram(featured(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scores = cut(weighted(features, gains(aimed, histogram(features, buckets))).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * scores.filter(fit).count() // 100
    out = ranked(scores, F.when(fit, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), name="_place")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(fit & (F.col("_place") < drawn), F.col("_place") + 1).cast("long").alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The CRC is linear: it is the sum over the bytes of what each one contributes at its distance from the end.
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT n::BIGINT AS byte, n::BIGINT AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT byte, c FROM steps WHERE k = 8),
split AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark),
words AS MATERIALIZED (SELECT side, r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
runs AS (SELECT side, r, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY side, r ORDER BY i)),
features AS MATERIALIZED (SELECT side, r, a AS f FROM runs UNION ALL SELECT side, r, a || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT side, r, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
own AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
longest AS (SELECT coalesce(max(length(h)) // 2, 0) AS n FROM own),
shifts AS (SELECT byte, c AS v, 0 AS d FROM crc_table
  UNION ALL SELECT s.byte, xor(s.v >> 8, t.c), s.d + 1 FROM shifts s JOIN crc_table t ON t.byte = s.v & 255, longest WHERE s.d < longest.n),
begun AS (SELECT 4294967295::BIGINT AS v, 0 AS d
  UNION ALL SELECT xor(s.v >> 8, t.c), s.d + 1 FROM begun s JOIN crc_table t ON t.byte = s.v & 255, longest WHERE s.d < longest.n),
bytes AS (SELECT f, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS i, h FROM own),
sums AS (SELECT f, n, bit_xor(s.v) AS v FROM bytes JOIN shifts s ON s.byte = ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AND s.d = n - 1 - i GROUP BY f, n),
buckets AS MATERIALIZED (SELECT f, xor(xor(s.v, b.v), 4294967295) % {BUCKETS} AS bucket FROM sums s JOIN begun b ON b.d = s.n),
counted AS MATERIALIZED (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM counted) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM counted) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM counted),
weights AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS weight FROM features JOIN buckets USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) >= {LEAST_WORDS} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST) AS place, {PERCENT} * (SELECT count(*) FROM scored WHERE fit) // 100 AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n THEN place END AS rank FROM placed
"""
