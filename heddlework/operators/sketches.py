"""Profiles of tables that can be stored and merged: an increment is profiled by itself and added to what is there.

One row for each column holds counts, extremes and moments, which merge exactly (moments but for
rounding), and two sketches: HyperLogLog for distinct values, KLL for quantiles. Making a profile shuffles one
row of partial aggregates for each task, never the values. Exact quartiles come from a profile's
quantiles as brackets and one counting pass over the table, which shuffles only the values in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import cut
from .ranks import ranked

#: Size of the quantile sketches; their ranks are off by about a thousandth.
KLL_SIZE = 2048
QUARTILES = (0.25, 0.5, 0.75)


def sketched(df: DataFrame) -> DataFrame:
    """A profile: column_name, row_count, null_count, min_text, max_text, and of numbers min, max, total, squares, with both sketches.

    Extremes of columns that are no numbers are those of their text. NaN counts as null for numbers.
    """
    cells = []
    for f in df.schema.fields:
        c, text = F.col(f"`{f.name}`"), F.col(f"`{f.name}`").cast("string")
        number = isinstance(f.dataType, T.NumericType)
        if number:
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            text = F.when(c.isNotNull(), text)
        none, blank = F.lit(None).cast("double"), F.lit(None).cast("binary")
        cells.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(text.isNull()).alias("null_count"),
                (F.lit(None).cast("string") if number else F.min(text)).alias("min_text"),
                (F.lit(None).cast("string") if number else F.max(text)).alias("max_text"),
                (F.min(c) if number else none).alias("min"),
                (F.max(c) if number else none).alias("max"),
                (F.sum(c) if number else none).alias("total"),
                (F.sum(c * c) if number else none).alias("squares"),
                F.hll_sketch_agg(text).alias("distinct_sketch"),
                (F.kll_sketch_agg_double(c, KLL_SIZE) if number else blank).alias("quantile_sketch"),
            )
        )
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def merged(*profiles: DataFrame) -> DataFrame:
    """One profile of several; columns that only some have are kept."""
    rows = profiles[0]
    for p in profiles[1:]:
        rows = rows.unionByName(p)
    adds = [F.sum(c).alias(c) for c in ("row_count", "null_count")]
    ends = [F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"), F.min("min").alias("min"), F.max("max").alias("max")]
    sketches = [F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch")]
    out = rows.groupBy("column_name").agg(*adds, *ends, F.sum("total").alias("total"), F.sum("squares").alias("squares"), *sketches)
    return out.withColumn("quantile_sketch", F.when(F.col("min").isNotNull(), F.col("quantile_sketch"))).select(*profiles[0].columns)


def described(profile: DataFrame) -> DataFrame:
    """What a profile says: counts, extremes, mean, sample deviation, and estimates of distinct values and quartiles."""
    n = F.col("row_count") - F.col("null_count")
    mean = F.col("total") / F.nullif(n, F.lit(0))
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * mean) / (n - 1))))
    quantile = lambda q: F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)))
    quartiles = [quantile(q).alias(f"about_p{round(100 * q)}") for q in QUARTILES]
    return profile.select("column_name", "row_count", "null_count", "min_text", "max_text", "min", "max", mean.alias("mean"), spread.alias("stddev"), F.hll_sketch_estimate("distinct_sketch").alias("about_distinct"), *quartiles)


def exact_quartiles(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(column_name, p25, p50, p75) of the numbers of df, by linear interpolation, with its profile for brackets.

    A quartile is bracketed by the sketch's quantiles a few thousandths to either side. One pass counts
    what is below each bracket and each value inside it. Where a sketch was so far off that a bracket
    misses its quartile, it is widened fourfold and counted again; the widest has all values.
    """
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    known = cut(profile.filter("min IS NOT NULL").withColumn("n", F.col("row_count") - F.col("null_count")), "bracket-profile")
    todo = known.select("column_name", "n", "min", "max", "quantile_sketch", F.explode(F.array(*(F.lit(q) for q in QUARTILES))).alias("q"))
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in numbers)
    found, slack = None, 0.004
    while todo.limit(1).count():
        lo, hi = F.col("min"), F.col("max")
        for q in QUARTILES:  # a rank has to be a literal
            of = lambda x: F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(x))
            lo = F.when((F.col("q") == q) & F.lit(q > slack), of(max(0.0, q - slack))).otherwise(lo)
            hi = F.when((F.col("q") == q) & F.lit(q < 1 - slack), of(min(1.0, q + slack))).otherwise(hi)
        brackets = cut(todo.select("column_name", "q", "n", lo.alias("lo"), hi.alias("hi")), "brackets")
        # Three rows for each column of the schema.
        cells = df.selectExpr(f"stack({len(numbers)}, {pairs}) AS (column_name, v)").filter("v IS NOT NULL AND NOT isnan(v)")
        cells = cells.join(F.broadcast(brackets), "column_name").filter("v <= hi")
        counts = cut(cells.groupBy("column_name", "q", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("k")), "bracketed")
        below = counts.filter("v IS NULL").select("column_name", "q", F.col("k").alias("below"))
        upto = ranked(counts.filter("v IS NOT NULL"), F.col("column_name"), F.col("q"), F.col("v"), total="k", running="upto")
        front = upto.groupBy("column_name", "q").agg(F.min(F.col("upto") - F.col("k")).alias("front"))
        at = upto.join(F.broadcast(front), ["column_name", "q"]).join(F.broadcast(below), ["column_name", "q"], "left")
        at = at.withColumn("last", F.col("upto") - F.col("front") + F.coalesce("below", F.lit(0)))
        place = (F.col("n") - 1) * F.col("q")
        holds = lambda r: F.max(F.when((F.col("last") - F.col("k") <= r) & (r < F.col("last")), F.col("v")))
        got = at.groupBy("column_name", "q", "n").agg(holds(F.floor(place)).alias("a"), holds(F.ceil(place)).alias("b"))
        got = cut(got.filter("a IS NOT NULL AND b IS NOT NULL").select("column_name", "q", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("value")), "quartiles")
        found = got if found is None else found.unionByName(got)
        todo = todo.join(got.select("column_name", "q"), ["column_name", "q"], "left_anti")
        slack *= 4
    if found is None:
        return known.select("column_name", *(F.lit(None).cast("double").alias(f"p{p}") for p in (25, 50, 75)))
    return found.groupBy("column_name").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{round(100 * q)}") for q in QUARTILES))
