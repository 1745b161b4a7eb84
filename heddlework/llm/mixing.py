"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The sources, in the order of their code points with null last, weigh 3, 1, 2, repeating, and share
``share`` times all words by weight; no target exceeds ``cap`` times its source's words, and what is
above is shared again by weight among the others. The words of the mix are cut into blocks of equal
size. Sainte-Lague apportionment gives blocks to sources, then each source's blocks to its shards:
every block goes to the highest quotient ``votes / (2 * blocks so far + 1)``. Shards hold about
``shard_documents`` documents of one source each, in a seeded order, so no task gets a whole source.
A shard's blocks are numbered along that order. With a quota of ``q`` and ``n`` blocks, each block
is taken ``q // n`` times and the first ``q % n`` once more; a document takes the words of its blocks.

A null text has size 0. Documents that are equal in id, source and text are interchangeable; those that
are more than a shard are numbered and dealt one by one, so a row repeated a third of the time, or an id that
a third of all rows have, is spread over shards as others are. With no words at all every target is 0.
Reruns agree: the order depends on ids, sources, texts and the seed alone. Other columns are ignored by the operator and
kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked, within
from .common import WORD, cut, join_by_source, table


def row_key() -> Column:
    """A digest of id, source and text, nulls apart: rows with equal keys are interchangeable."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")), F.col("text").cast("string"))))


def hot_copies(df: DataFrame, key: str, most: int) -> DataFrame:
    """Adds ``_copy``: 1, 2, 3... for rows whose key more than ``most`` rows have, 0 for all others.

    Keys are counted in parts before the shuffle, and the rows of hot ones numbered in ranges that cut a key.
    """
    hot = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(key, F.lit(True).alias("_hot")), "hot")
    if not hot.limit(1).count():
        return df.withColumn("_copy", F.lit(0).cast("long"))
    marked = join_by_source(df, hot, key)
    many = cut(marked.filter("_hot").withColumn("_row", F.monotonically_increasing_id()), "copies")
    numbered = within(many, [key], F.col("_row"), name="_copy").withColumn("_copy", (F.col("_copy") + 1).cast("long")).drop("_row")
    return marked.filter("_hot IS NULL").withColumn("_copy", F.lit(0).cast("long")).unionByName(numbered).drop("_hot")


def apportioned(df: DataFrame, group: str, item: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: within each group, its seats to the highest quotients votes / (2 * i + 1), i = 0, 1, ...

    Ties go to the lower item. A quota is within one part in 2 * seats / items of its exact share, or
    half a seat; so all but a few seats of each item are certain, and only those few are ranked, in
    ranges that may cut a group. Sums by group are partial before the shuffle.
    """
    whole = df.groupBy(group).agg(F.sum(votes).alias("_all"), F.count(F.lit(1)).alias("_n"))
    df = join_by_source(df, whole, group)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all") * F.col(seats)).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_n") / F.col(seats)).otherwise(F.lit(0.0))
    df = df.withColumn("_low", F.greatest(F.lit(0), F.floor(share * (1 - slack)) - 1)).withColumn("_high", F.when(F.col(votes) > 0, F.floor(share * (1 + slack)) + 2).otherwise(F.lit(0)))
    df = cut(df, "shares")
    seat = df.filter("_high > _low").select(group, item, votes, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_i"))
    seat = cut(ranked(seat, F.col(group), F.desc(F.col(votes) / (2 * F.col("_i") + 1)), F.col(item), name="_place"), "seats")
    # A group's seats that are still open, and the rank of its first.
    still = df.groupBy(group).agg((F.first(seats) - F.sum("_low")).alias("_open")).join(seat.groupBy(F.col(group).alias("_g")).agg(F.min("_place").alias("_first")), F.col(group) == F.col("_g")).drop("_g")
    won = join_by_source(seat, still, group).filter("_place - _first < _open").groupBy(group, item).agg(F.count(F.lit(1)).alias("_won"))
    return df.join(won, [group, item], "left").withColumn("quota", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long")).drop("_all", "_n", "_low", "_high", "_won")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: rank, size, documents, weight and target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight), "sources")
    most = F.col("source_size") * cap
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words for a weight of 1
    while True:  # each round caps at least one more source, or ends
        above = F.col("weight") * level > most
        full, free = sources.agg(F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (full or 0)) / free if free else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(most, F.col("weight") * level))


def mixed(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64, shard_documents: int = 2048, seed: int = 7) -> DataFrame:
    """One row for each document: its size, its source's size and target, and how many of its words the mix takes; node is its row_key."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_key().alias("node")), "sizes")
    sources = cut(targets(sizes, weights, share, cap), "targets")
    words, n = sources.agg(F.sum("target"), F.count(F.lit(1))).first()
    # Small mixes have smaller blocks, about a thousand for each source.
    block = max(1, min(block, int((words or 0) / (1024 * max(n, 1)))))
    sources = sources.withColumn("blocks", F.lit(round((words or 0) / block)).cast("long")).withColumn("all", F.lit(0))
    sources = apportioned(sources, "all", "rank", "target", "blocks").withColumn("shards", F.ceil(F.col("n_docs") / shard_documents).cast("long"))
    sources = cut(sources.select("source", "rank", "source_size", "target", "shards", F.col("quota").alias("source_quota")), "quotas")

    docs = join_by_source(hot_copies(sizes, "node", shard_documents), sources, "source")
    dealt = lambda s: F.xxhash64(F.lit(s), "node", "_copy")
    docs = docs.withColumn("shard", F.pmod(dealt(seed), "shards")).withColumn("order", dealt(seed + 1))
    shards = docs.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = apportioned(cut(shards, "shards"), "rank", "shard", "shard_size", "source_quota").select("rank", "shard", "shard_size", "quota")

    upto = F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("order", "node", "_copy").rowsBetween(Window.unboundedPreceding, 0))
    docs = docs.withColumn("upto", upto).join(shards, ["rank", "shard"])
    n_blocks = F.ceil(F.col("shard_size") / block)
    quota = F.least(F.col("quota"), n_blocks * int(cap))
    docs = docs.withColumn("times", F.when(n_blocks > 0, F.floor(quota / n_blocks)).otherwise(0)).withColumn("more", F.when(n_blocks > 0, quota % n_blocks).otherwise(0) * block)
    once_more = F.greatest(F.lit(0), F.least("upto", "more") - (F.col("upto") - F.col("size")))
    return docs.select("doc_id", "size", "source", "source_size", "target", (F.col("times") * F.col("size") + once_more).cast("long").alias("taken"), "node")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("node")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shard_documents: int = 2048) -> DataFrame:
    """Pipeline stage, the last: the documents of which the mix takes words, with ``size``, ``target`` and ``taken``, which replace columns of these names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    # Of equal rows, which may have different takes, each gets one: the copies are numbered, and each take has a range of numbers.
    taken = mixed(docs, shard_documents=shard_documents).filter("taken > 0").groupBy("node", "size", "target", "taken").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("node").orderBy("taken").rowsBetween(Window.unboundedPreceding, 0))
    taken = taken.withColumn("_to", upto)
    rows = hot_copies(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), row_key().alias("_key")), "_key", shard_documents)
    few = F.row_number().over(Window.partitionBy("_key", "_copy").orderBy(F.lit(0)))
    rows = rows.withColumn("_copy", F.when(F.col("_copy") > 0, F.col("_copy")).otherwise(few))
    out = rows.join(taken, (F.col("_key") == F.col("node")) & F.col("_copy").between(F.col("_to") - F.col("_n") + 1, F.col("_to")))
    return out.select(*(F.col(n).alias(c) for c, n in names.items() if c not in ("size", "target", "taken")), "size", "target", "taken")
