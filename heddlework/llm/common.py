"""Reading tables, cutting lineage and fixing odd inputs, for every operator of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut, shared_folder

__all__ = ["WORD", "cut", "groups", "join_by_source", "shared_folder", "table", "texts"]

#: A word of a whole text: what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator works on; a null text counts as empty, other columns are left out."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def groups(column: pa.Array, size: int) -> Iterator[tuple[slice, list[str]]]:
    """Texts of an Arrow column in groups of about so many bytes, with their rows; a longer text is a group of its own."""
    begin, upto = 0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + size)))
        yield slice(begin, end), column[begin:end].to_pylist()
        begin = end


def join_by_source(rows: DataFrame, small: DataFrame, on: str, most: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join of rows to one row for each value of ``on``, nulls equal to nulls, when a value may hold a third of all rows.

    A small side of at most ``most`` rows, which is counted first, is broadcast. A larger one is
    copied ``salts`` times, and the rows of each value are dealt over the copies.
    """
    rest = [c for c in small.columns if c != on]
    small = small.select(F.col(on).alias("_on"), *rest)
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), rows[on].eqNullSafe(small["_on"]), "left").drop("_on")
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_dealt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return rows.join(small, rows[on].eqNullSafe(small["_on"]) & (rows["_dealt"] == small["_salt"]), "left").drop("_on", "_salt", "_dealt")
