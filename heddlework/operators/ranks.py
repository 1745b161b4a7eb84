"""Ranks and running sums over whole tables, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut


def ranked(df: DataFrame, *order: Column, name: str = "rank", total: str | None = None, running: str = "running") -> DataFrame:
    """Adds a rank, from 0, and, of the column ``total``, the sum up to and with each row.

    Rows are sorted in ranges; what is in front of a range comes from one row for each partition.
    Ties in the order get ranks as they come, so the order should end with a key.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), (F.sum(total) if total else F.lit(0)).alias("_s"))
    front = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.sum("_n").over(front).alias("_n"), F.sum("_s").over(front).alias("_s"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(before), "_part").withColumn(name, F.coalesce("_n", F.lit(0)) + F.row_number().over(own) - 1)
    if total:
        out = out.withColumn(running, F.coalesce("_s", F.lit(0)) + F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_part", "_n", "_s")


def within(df: DataFrame, keys: list[str], *order: Column, name: str = "place", total: str | None = None, running: str = "running") -> DataFrame:
    """As ``ranked`` within each key: places from 0 and, of ``total``, the sum up to and with each row. Null keys are a key.

    A key's rows may lie in several ranges, so one key may hold them all. What is in front of a key comes from one row for each key.
    """
    rows = cut(ranked(df, *(F.col(k) for k in keys), *order, name="_rank", total=total, running="_upto"), "within")
    before = F.min_by(F.col("_upto") - F.col(total), "_rank") if total else F.lit(0)
    front = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("_rank").alias("_first"), before.alias("_before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(front, same).withColumn(name, F.col("_rank") - F.col("_first"))
    if total:
        out = out.withColumn(running, F.col("_upto") - F.col("_before"))
    return out.drop("_rank", "_upto", "_first", "_before", *(f"_k{i}" for i in range(len(keys))))


def percentile_within(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The exact percentile of each key, between two values by their distance; no key's values are held together. Nulls don't count."""
    placed = cut(within(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, F.col(value)), "placed")
    sizes = placed.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg((F.lit(share) * (F.max("place"))).alias("_at"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ends = placed.join(sizes, same).filter("place IN (floor(_at), ceil(_at))")
    part = F.max("_at") - F.floor(F.max("_at"))
    return ends.groupBy(*keys).agg((F.min(value) * (1 - part) + F.max(value) * part).alias(name))
