"""Statistics of tables and columns, computed exactly over the data."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import cut
from .ranks import ranked


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def table_statistics(df: DataFrame, partition_by: list[str] | None = None, size: bool = False) -> DataFrame:
    """One row: row_count, partition_count and, for a file source, size_bytes of the files read."""
    parts = F.count_distinct(F.struct(*partition_by)) if partition_by else F.lit(0)
    out = df.agg(F.count(F.lit(1)).alias("row_count"), parts.cast("long").alias("partition_count"))
    if size:
        files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
        out = out.crossJoin(files.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("size_bytes")))  # one row each
    return out


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) for each cell, values as text."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, value)")


#: Quartiles, as hundredths.
QUARTILES = (25, 50, 75)


def _counted(t: T.DataType) -> str:
    """The type that a column's values are counted in: whole numbers as long, others as double, times as they are, all else as text."""
    if isinstance(t, T.IntegralType):
        return "bigint"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    return t.simpleString() if isinstance(t, (T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def value_counts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(i, number, n): a row for each value that is not null in each column, by the column's place, with the double next to it if it is a number, and how often it occurs.

    Columns of one type are counted in one pass, in that type, so no number or time is written out as text.
    """
    kinds: dict[str, list[int]] = {}
    for i, f in enumerate(fields):
        kinds.setdefault(_counted(f.dataType), []).append(i)
    out = None
    for kind, places in kinds.items():
        cells = ", ".join(f"{i}, CAST(`{fields[i].name}` AS {kind})" for i in places)
        part = df.selectExpr(f"stack({len(places)}, {cells}) AS (i, value)").filter("value IS NOT NULL").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
        number = F.col("value").cast("double") if _numeric(fields[places[0]].dataType) else F.lit(None).cast("double")
        part = part.select("i", number.alias("number"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Parts of equal width that a column's numbers are counted in before its quartiles are looked for.
PARTS = 4096


def quartiles(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(i, p25, p50, p75) of counted numbers, by linear interpolation.

    Numbers are summed up in parts of equal width, and only the parts that hold a quartile are sorted: in order of
    column and size, numbered in ranges, so no column is one task even where one part has all its numbers.
    totals is (i, total, lo, hi), one row for each column: how many numbers, and the least and greatest finite one.
    """
    # Halves, as the width of all doubles is none. Infinities and NaN have parts of their own.
    lo, hi, width = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(0.0)), F.col("hi") / 2 - F.col("lo") / 2
    part = F.when(F.col("number") < lo, -1).when(F.col("number") > hi, PARTS + 1).when(width > 0, F.floor((F.col("number") / 2 - F.col("lo") / 2) / width * PARTS).cast("int")).otherwise(0)
    numbers = counts.filter("number IS NOT NULL").join(F.broadcast(totals), "i").select("i", "total", "number", "n", part.alias("part"))
    sums = numbers.groupBy("i", "total", "part").agg(F.sum("n").alias("n"))
    sides = [side((F.col("total") - 1) * q / 100.0) for q in QUARTILES for side in (F.floor, F.ceil)]
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    placed = sums.withColumn("upto", upto).withColumn("front", F.col("upto") - F.col("n"))
    holding = cut(placed.filter(functools.reduce(Column.__or__, ((F.col("front") <= s) & (s < F.col("upto")) for s in sides))).select("i", "part", "front"), "quartile-parts")  # at most six for each column
    inside = numbers.join(F.broadcast(holding), ["i", "part"]).groupBy("i", "total", "part", "front", "number").agg(F.sum("n").alias("n"))
    inside = ranked(inside, F.col("i"), F.col("number"), total="n", running="upto")
    first = inside.groupBy("i", "part").agg(F.min(F.col("upto") - F.col("n")).alias("first"))
    at = inside.join(F.broadcast(first), ["i", "part"]).withColumn("upto", F.col("upto") - F.col("first") + F.col("front"))
    found = [F.max(F.when((F.col("upto") - F.col("n") <= s) & (s < F.col("upto")), F.col("number"))) for s in sides]
    near = at.groupBy("i", "total").agg(*(f.alias(f"_{k}") for k, f in enumerate(found)))
    between = lambda k, q: F.col(f"_{2 * k}") + (F.col(f"_{2 * k + 1}") - F.col(f"_{2 * k}")) * ((F.col("total") - 1) * q / 100.0 - F.floor((F.col("total") - 1) * q / 100.0))
    return near.select("i", *(between(k, q).alias(f"p{q}") for k, q in enumerate(QUARTILES)))


def column_statistics(df: DataFrame, columns: list[str] | None = None, exact: bool = True, quantiles: bool = True) -> DataFrame:
    """One row for each column: counts, least and greatest value as text, mean, deviation and quartiles.

    Counts, extremes and moments come from one pass, extremes of texts from another. Exact distinct counts and quartiles come from
    one for each type that counts equal values before it shuffles; quartiles are then read from the few
    values around them, numbered in ranges. ``exact=False`` estimates both in the first pass.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    texts: list[Column] = []  # extremes of variable length keep a whole aggregation from being compiled, so they have their own
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"v{i}"))
        (aggs if _counted(f.dataType) != "string" else texts).extend([F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")])
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        if _numeric(f.dataType):
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
            if quantiles and not exact:
                aggs.append(F.percentile_approx(c.cast("double"), [q / 100 for q in QUARTILES], 10000).alias(f"q{i}"))
    one = df.agg(*aggs)
    if texts:
        one = one.crossJoin(F.broadcast(df.agg(*texts)))  # one row each
    none, rows = "CAST(NULL AS DOUBLE)", []
    for i, f in enumerate(fields):
        number = _numeric(f.dataType)
        q = [f"q{i}[{k}]" if number and quantiles and not exact else none for k in range(3)]
        rows.append(f"{i}, '{f.name}', '{f.dataType.simpleString()}', n, n - v{i}, {f'd{i}' if not exact else 'CAST(NULL AS LONG)'}, lo{i}, hi{i}, {f'm{i}' if number else none}, {f's{i}' if number else none}, {', '.join(q)}")
    out = one.selectExpr(f"stack({len(fields)}, {', '.join(rows)}) AS (i, column_name, data_type, row_count, null_count, distinct_count, min_value, max_value, avg_value, stddev_value, p25, p50, p75)")
    if exact:
        counts = cut(value_counts(df, fields), "value-counts")
        finite = F.when(F.abs("number") < float("inf"), F.col("number"))
        found = counts.groupBy("i").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("total"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
        found = cut(found, "distinct-counts")  # one row for each column, as what is broadcast here
        out = out.drop("distinct_count").join(F.broadcast(found.select("i", "distinct_count")), "i", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)).cast("long"))
        if quantiles:
            out = out.drop("p25", "p50", "p75").join(F.broadcast(quartiles(counts, found.filter("total > 0").select("i", "total", "lo", "hi"))), "i", "left")
    return out.select("column_name", "data_type", "row_count", "null_count", "distinct_count", "min_value", "max_value", "avg_value", "stddev_value", "p25", "p50", "p75")


def top_values(df: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The n most frequent values of each column with their rank; ties by value."""
    counts = unpivoted(df, columns or df.columns).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def part_statistics(parts: DataFrame) -> DataFrame:
    """Rows and bytes of the active parts of each table partition."""
    return parts.filter("active = 1").groupBy("partition_id").agg(F.sum("rows").alias("row_count"), F.sum("bytes").alias("size_bytes"), F.count(F.lit(1)).alias("part_count"))


def allocated_size(partitions: DataFrame, units: DataFrame, page_bytes: int = 8192) -> DataFrame:
    """Rows and bytes of each table; the allocation units are summed before the join, so rows count once."""
    pages = units.groupBy("partition_id").agg(F.sum("pages").alias("pages"))
    return partitions.join(pages, "partition_id", "left").groupBy("table_name").agg(F.sum("rows").alias("row_count"), (F.coalesce(F.sum("pages"), F.lit(0)) * page_bytes).alias("size_bytes"))


def assembled_indexes(rows: DataFrame) -> DataFrame:
    """One row for each index: its columns in order, joined by commas, and whether it is unique."""
    columns = F.transform(F.array_sort(F.collect_list(F.struct("seq", "column_name"))), lambda x: x["column_name"])
    return rows.groupBy("index_name").agg(F.array_join(columns, ",").alias("columns"), (F.max("non_unique") == 0).alias("is_unique"), F.count(F.lit(1)).alias("n_columns"))


def listed_partitions(rows: DataFrame) -> DataFrame:
    """Partitions by name, each once (the first by ordinal), without blank names."""
    kept = rows.filter("partition_name IS NOT NULL AND partition_name <> ''")
    return kept.groupBy("table_name", "partition_name").agg(F.min("ordinal").alias("ordinal"))


def topic_statistics(offsets: DataFrame, message_bytes: int = 1024) -> DataFrame:
    """Messages of each topic from its partitions' offsets; partitions with a missing offset do not count."""
    known = F.col("latest").isNotNull() & F.col("earliest").isNotNull()
    n = F.coalesce(F.sum(F.when(known, F.col("latest") - F.col("earliest"))), F.lit(0))
    return offsets.groupBy("topic").agg(n.cast("long").alias("message_count"), (n * message_bytes).cast("long").alias("size_estimate"), F.count(F.lit(1)).alias("partition_count"))


def counts_by(df: DataFrame, *keys: str, totals: bool = False) -> DataFrame:
    """Rows of each combination of keys; with totals also of each subset of the keys (null stands for all)."""
    return (df.cube(*keys) if totals else df.groupBy(*keys)).agg(F.count(F.lit(1)).alias("n"))


def status_summary(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row: all rows, and those of each status."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == v).alias(v.lower()) for v in values))


def duration_histogram(df: DataFrame, duration: str, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative counts at each upper bound (null: all), as rows."""
    sums = [F.count_if(F.col(duration) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*sums, F.count(duration).alias("all_n"))
    rows = ", ".join(f"CAST({b} AS DOUBLE), b{i}" for i, b in enumerate(bounds))
    return wide.selectExpr(*(f"`{k}`" for k in keys), f"stack({len(bounds) + 1}, {rows}, CAST(NULL AS DOUBLE), all_n) AS (le, n)")


def histogram_quantile(histogram: DataFrame, q: float, *keys: str) -> DataFrame:
    """The q-quantile of each key by linear interpolation in its bucket; in the last bucket the greatest finite bound."""
    w = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    rows = histogram.withColumns({"below": F.coalesce(F.lag("n").over(w), F.lit(0)), "from": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "target": F.max("n").over(Window.partitionBy(*keys)) * q})
    rows = rows.filter("n >= target AND below < target")
    at = F.col("from") + (F.col("le") - F.col("from")) * (F.col("target") - F.col("below")) / (F.col("n") - F.col("below"))
    return rows.select(*keys, F.when(F.col("le").isNull(), F.col("from")).otherwise(at).alias("quantile"))


def batch_result(df: DataFrame, error: Column) -> DataFrame:
    """One row: total, success and failed items; error is null for a success."""
    return df.select(error.alias("e")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("e").isNull()).alias("success"), F.count("e").alias("failed"))


#: Error codes that are worth a second try. Fixed values.
RETRYABLE = ("NETWORK_ERROR", "TIMEOUT", "DEADLINE_EXCEEDED")


def error_counts(errors: DataFrame, *keys: str) -> DataFrame:
    """Errors by key and code, with whether the code is worth a second try."""
    return errors.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n")).withColumn("retryable", F.col("code").isin(*RETRYABLE))


def merged_counters(df: DataFrame, counters: str, *keys: str) -> DataFrame:
    """Maps of counters, summed by counter name."""
    return df.select(*keys, F.explode(counters).alias("counter", "v")).groupBy(*keys, "counter").agg(F.sum("v").alias("total"))


def exact_distinct_by_bitmap(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Distinct non-negative integers by bitmaps that can be merged: one for each bucket of values, then the sum of their counts."""
    maps = df.groupBy(*keys, F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(value))).alias("bits"))
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))


def distinct_by_sketch(df: DataFrame, value: str, part: str, *keys: str) -> DataFrame:
    """Distinct values by sketches of each part, merged by key."""
    sketches = df.groupBy(*keys, part).agg(F.hll_sketch_agg(value, 14).alias("s"))
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n_distinct"))
