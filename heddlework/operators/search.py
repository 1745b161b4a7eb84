"""Word search from a stored index: one row for each place of a word, sorted by word, and ranked retrieval.

Words are runs of letters and digits in small letters. The index is in segments of texts, each sorted by word, as
search engines keep it: texts are dealt out before they are split, so places are never shuffled, and a word is
found in each segment by the statistics of its pages. A segment has a bounded amount of text, so there are as many
as the texts need; nothing is grouped while it is built. Rows without key are left out; rows with one key count
as one text. Texts are whole; a null one has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BETWEEN = r"[^\p{L}\p{N}]+"

#: Bytes of text in a segment of the index, on average.
SEGMENT = 16_000_000


def words(*columns: str) -> Column:
    """Words of some columns in order; nulls are left out."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), _BETWEEN), lambda w: w != "")


def write_index(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Writes ``path/places`` (word, key, place, length of the text in words) and ``path/sizes`` (texts, words)."""
    texts = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.concat_ws(" ", *columns).alias("text"))
    n_texts, size = texts.agg(F.count_distinct("key"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    segments = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SEGMENT))
    listed = texts.repartition(segments, "key", "text").select("key", words("text").alias("_w"))
    # With a plain posexplode Spark would split each text before it is dealt out as well, to see whether it has words.
    places = listed.select("key", F.size("_w").alias("length"), F.posexplode_outer("_w").alias("place", "word")).filter("word IS NOT NULL")
    places.select("word", "key", "place", "length").sortWithinPartitions("word", "key", "place").write.parquet(f"{path}/places")
    stored = df.sparkSession.read.schema("word string").parquet(f"{path}/places")
    stored.agg(F.lit(n_texts).alias("n_texts"), F.count(F.lit(1)).alias("n_words")).write.parquet(f"{path}/sizes")


def _terms(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms if t))


def search(spark: SparkSession, path: str, terms: list[str], saturation: float = 1.2, by_length: float = 0.75) -> DataFrame:
    """(key, n_terms, score): texts with at least one of the words, how many of them, and Okapi's BM25 sum over them.

    Only the words' own rows are read. Counts are partial before the shuffle, so a word that all texts have is no hot key.
    """
    places = spark.read.parquet(f"{path}/places").filter(F.col("word").isin(*_terms(terms)))
    counts = places.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    with_word = counts.groupBy("word").agg(F.count(F.lit(1)).alias("n_with"))  # one row for each term
    sizes = spark.read.parquet(f"{path}/sizes")  # one row
    rare = F.log(1 + (F.col("n_texts") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5))
    norm = saturation * (1 - by_length + by_length * F.col("length") * F.col("n_texts") / F.col("n_words"))
    scored = counts.join(F.broadcast(with_word), "word").crossJoin(F.broadcast(sizes)).withColumn("s", rare * F.col("n") * (saturation + 1) / (F.col("n") + norm))
    return scored.groupBy("key").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("s").alias("score"))


def phrase(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(key, n): texts that have the words side by side in this order, and how often; an empty phrase is nowhere."""
    terms = [t.lower() for t in terms]
    wanted = F.array(*(F.struct(F.lit(t).alias("w"), F.lit(i).alias("o")) for i, t in enumerate(terms)))
    places = spark.read.parquet(f"{path}/places")
    if not terms:
        return places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("false")
    # A place less the word's offset is where the phrase would begin.
    starts = places.filter(F.col("word").isin(*set(terms))).select("key", "word", "place", F.explode(wanted).alias("t")).filter("t.w = word")
    whole = starts.groupBy("key", (F.col("place") - F.col("t.o")).alias("at")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms))
    return whole.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
