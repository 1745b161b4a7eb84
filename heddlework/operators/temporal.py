"""Joins on time, ranks, running values, funnels and limits over event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import cut
from . import ranks


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, version: str, values: list[str], bin_seconds: int = 7 * 86_400) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time; left outer.

    Both sides are put on one time line, cut into bins, and the last version is carried along within
    each bin, so a key with many rows is many groups. What a bin begins with is the last version of
    the bins before it, from one row for each key and bin. A version of the same instant counts as
    visible; of several versions of one instant any may be the latest. A left row without time has no version.
    """
    bin_of = F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (bin_seconds * 1_000_000))
    kind = _struct(right, values)
    line = left.withColumns({"_t": F.col(time), "_kind": F.lit(1), "_v": F.lit(None).cast(kind)}).withColumn("_bin", bin_of)
    other = right.select(F.col(key), F.col(version).alias("_t"), F.lit(0).alias("_kind"), F.struct(*values).alias("_v")).filter("_t IS NOT NULL").withColumn("_bin", bin_of)
    lasts = other.groupBy(key, "_bin").agg(F.max_by("_v", "_t").alias("_last"))
    bins = lasts.unionByName(line.select(key, "_bin", F.lit(None).cast(kind).alias("_last")).distinct()).groupBy(key, "_bin").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(F.col(key).alias("_key"), F.col("_bin").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_first")).filter("_first IS NOT NULL")
    both = line.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key, "_bin").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1")
    out = out.join(carried, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_b")), "left").withColumn("_v", F.coalesce("_v", "_first"))
    return out.select(*left.columns, *(F.when(F.col(time).isNotNull(), F.col("_v")[v]).alias(v) for v in values))


def _struct(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"{v}:{df.schema[v].dataType.simpleString()}" for v in values) + ">"


def within(left: DataFrame, right: DataFrame, key: str, time: str, other_time: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right time is in the seconds up to the left time.

    The time line is cut into bins of that length, so rows meet in their own and the previous bin
    only, and a key with many rows is spread over its bins.
    """
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    a = left.withColumn("_bin", F.explode(F.array(bin_of(time), bin_of(time) - 1)))
    b = right.withColumn("_bin", bin_of(other_time))
    near = (F.col(other_time) <= F.col(time)) & (F.col(other_time) >= F.col(time) - F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, [key, "_bin"]).filter(near).drop("_bin")


def funnel(df: DataFrame, key: str, time: str, tie: str, event: str, steps: list[str], seconds: int) -> DataFrame:
    """(key, level): for each key with any of the steps the most of them done in order within the seconds after a first one.

    A walk is no longer than the seconds, so each event stands in the time bin of that length in which a
    walk may begin and in the one before, and a key with all rows is as many groups as its time line has bins. In
    a bin each event of step i gets the latest time at which a walk began whose step i - 1 is in front of
    it: one window after the other over the same order. One event can be one step of a walk only.
    Events without time take no part.
    """
    span = seconds * 1_000_000
    rows = df.filter(F.col(event).isin(*steps)).select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(tie).alias("i"), F.col(event).alias("e")).filter("t IS NOT NULL")
    own = F.floor(F.col("t") / span).cast("long") if span else F.col("t")
    rows = rows.withColumn("own", own).withColumn("bin", F.explode(F.array("own", F.col("own") - 1)))
    before = Window.partitionBy("k", "bin").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s0", F.when((F.col("e") == steps[0]) & (F.col("own") == F.col("bin")), F.col("t")))
    for n in range(1, len(steps)):
        began = F.max(f"s{n - 1}").over(before)
        rows = rows.withColumn(f"s{n}", F.when((F.col("e") == steps[n]) & (F.col("t") - began <= span), began))
    level = F.lit(0)
    for n in range(len(steps)):
        level = F.when(F.col(f"s{n}").isNotNull(), n + 1).otherwise(level)
    return rows.groupBy(F.col("k").alias(key)).agg(F.max(level).cast("long").alias("level"))


def paths(df: DataFrame, key: str, time: str, tie: str, event: str, first: str, middle: str, last: str, least: int, most: int) -> DataFrame:
    """(key, n_matches): matches of ``first middle* last`` in a key's events, least to most seconds long, for keys with any; matches do not overlap.

    What decides is the event in front of the last one that is no middle one. It is at most the seconds
    away, so each event stands in its own time bin of that length and in the next one, and a key with
    all rows is many groups. Events without time take no part.
    """
    span = most * 1_000_000
    rows = df.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(tie).alias("i"), F.col(event).alias("e")).filter("t IS NOT NULL")
    own = F.floor(F.col("t") / span).cast("long") if span else F.col("t")
    rows = rows.withColumn("own", own).withColumn("bin", F.explode(F.array("own", F.col("own") + 1)))
    before = Window.partitionBy("k", "bin").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    decides = (F.col("e") == first) | ~F.col("e").eqNullSafe(middle)
    rows = rows.withColumn("x", F.last(F.when(decides, F.struct("e", "t")), ignorenulls=True).over(before))
    long = F.col("t") - F.col("x.t")
    found = rows.filter((F.col("e") == last) & (F.col("own") == F.col("bin")) & (F.col("x.e") == first) & long.between(least * 1_000_000, span))
    return found.groupBy(F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("n_matches"))


def latest(df: DataFrame, key: str, order: str, tie: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order), tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def actions(status: Column) -> Column:
    """What may be done with a task of a status."""
    return F.when(status.isin("inactive", "paused", "failed"), "start").when(status.isin("active", "running"), "pause,stop").otherwise("")


def running_gauge(df: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """How many are under way at each start and end; at one instant ends come after starts. Changes are summed by instant first, and a key's instants are sorted in ranges."""
    change = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*keys, "x.*")
    steps = change.filter("t IS NOT NULL").groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    return ranks.within(steps, list(keys), F.col("t"), total="d").select(*keys, "t", "running")


def ready(dependencies: DataFrame, executions: DataFrame, today: Column, now_hour: int, weekday: int) -> DataFrame:
    """Workflows with whether all their dependencies hold, else the reason of the first that does not.

    A dependency is on a workflow (its latest execution must have the expected status and end today)
    or on a window of hours [from_hour, to_hour) and a list of weekdays, Sunday being 0.
    """
    last = latest(executions, "workflow", "start_time", "execution_id").select(F.col("workflow").alias("needs"), "status", "end_time")
    d = dependencies.join(last, "needs", "left")
    on_workflow = F.when(F.col("status").isNull(), "no execution").when(F.col("status") != F.coalesce("expected", F.lit("completed")), "status").when(F.to_date("end_time") != today, "not today")
    on_time = F.when(~((F.col("from_hour") <= now_hour) & (now_hour < F.col("to_hour"))), "hour").when(F.col("weekdays").isNotNull() & ~F.array_contains(F.split("weekdays", ","), str(weekday)), "weekday")
    reason = F.when(F.col("needs").isNotNull(), on_workflow).otherwise(on_time)
    return d.withColumn("_reason", reason).groupBy("workflow").agg((F.count("_reason") == 0).alias("ready"), F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("place"))).alias("reason"))


def _binned(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """Adds ``_t`` (microseconds) and ``_bin``, the number of its stretch of that many seconds."""
    return df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_bin", F.floor(F.col("_t") / (seconds * 1_000_000)).cast("long"))


def sliding_decisions(df: DataFrame, client: str, time: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """Adds ``allowed``: fewer than limit allowed requests of the client in the seconds before, the window open at its start.

    A decision depends on earlier ones, so it is not a window function. But where two bins of the
    window's length in a row have no more requests than the limit, all requests of the second are
    allowed, whatever was before: there a client's requests are cut, and each piece begins with the bin in front of
    it, known to be allowed. Pieces are sorted within partitions and read as a stream; what is held
    is the allowed times of one window. Only a client that goes on above its limit without such a pause is one task's work.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])
    rows = _binned(df, time, seconds)
    bins = rows.groupBy(F.col(client).alias("_c"), F.col("_bin").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_c").orderBy("_b")
    one, two = F.lag("_b").over(order), F.lag("_b", 2).over(order)
    n1, n2 = F.lag("_n").over(order), F.lag("_n", 2).over(order)
    # Requests in the bin in front, and in the one before that; bins without any are not there.
    near = F.when(one == F.col("_b") - 1, n1 + F.when(two == F.col("_b") - 2, n2).otherwise(0)).otherwise(0)
    bins = bins.withColumn("_cut", F.coalesce(near, F.lit(0)) <= limit)
    bins = bins.withColumn("_piece", F.max(F.when(F.col("_cut"), F.col("_b"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.join(bins.select("_c", "_b", "_piece"), F.col(client).eqNullSafe(F.col("_c")) & (F.col("_bin") == F.col("_b"))).drop("_c", "_b").withColumn("_warm", F.lit(False))
    starts = bins.filter("_cut").select("_c", F.col("_b").alias("_piece"))
    warm = rows.join(starts, F.col(client).eqNullSafe(F.col("_c")) & (F.col("_bin") == F.col("_piece") - 1)).drop("_c").withColumn("_warm", F.lit(True))
    columns = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        piece, held = None, deque()
        for pdf in parts:
            out = []
            for c, p, t, known in zip(pdf[client], pdf["_piece"], pdf["_t"], pdf["_warm"], strict=True):
                if (c, p) != piece:
                    piece, held = (c, p), deque()
                while held and t - held[0] >= seconds * 1_000_000:
                    held.popleft()
                ok = known or len(held) < limit
                if ok:
                    held.append(t)
                out.append(ok)
            yield pdf.assign(allowed=out)[~pdf["_warm"]][[*columns, "allowed"]]

    return own.unionByName(warm).repartition(client, "_piece").sortWithinPartitions(client, "_piece", "_t", tie).mapInPandas(run, schema)


def window_starts(rows: DataFrame, client: str, seconds: int) -> DataFrame:
    """(_c, _bin, _start): the starts of fixed windows, each the first request at or after the end of the window before; rows are ``_binned``.

    Starts are as far apart as a window is long, so a bin has one at most, and after an empty bin the
    first request is one. From there on each request points to the first one a window later; the
    table of pointers is joined to itself, so the starts that are known double in each round.
    """
    span = seconds * 1_000_000
    times = cut(rows.select(F.col(client).alias("_c"), "_bin", "_t").distinct(), "times")
    order = Window.partitionBy("_c").orderBy("_bin")
    bins = times.groupBy("_c", "_bin").agg(F.min("_t").alias("_lo")).withColumn("_new", ~F.coalesce(F.lag("_bin").over(order) == F.col("_bin") - 1, F.lit(False)))
    bins = cut(bins.withColumn("_run", F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))), "bins")
    probes = times.select("_c", (F.col("_bin") + 1).alias("_bin"), (F.col("_t") + span).alias("_x"), F.col("_t").alias("_from"))
    line = times.select("_c", "_bin", F.col("_t").alias("_x"), F.lit(None).cast("long").alias("_from")).unionByName(probes)
    down = Window.partitionBy("_c", "_bin").orderBy(F.desc("_x"), F.col("_from").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_to", F.last(F.when(F.col("_from").isNull(), F.col("_x")), ignorenulls=True).over(down)).filter("_from IS NOT NULL")
    after = bins.select(F.col("_c").alias("_d"), (F.col("_bin") - 1).alias("_e"), "_lo")
    jumps = line.join(after, F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_bin") == F.col("_e")), "left").select("_c", "_from", F.coalesce("_to", "_lo").alias("_to")).filter("_to IS NOT NULL")
    starts = bins.filter("_new").select("_c", F.col("_lo").alias("_start"))
    longest = bins.groupBy("_c", "_run").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        jumps = cut(jumps, "jumps")
        far = jumps.select(F.col("_c").alias("_d"), F.col("_from").alias("_f"), F.col("_to").alias("_next"))
        more = starts.join(far, F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_start") == F.col("_f"))).select("_c", F.col("_next").alias("_start"))
        starts = cut(starts.unionByName(more).distinct(), "starts")
        jumps = jumps.join(far, F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_to") == F.col("_f"))).select("_c", "_from", F.col("_next").alias("_to"))
    return starts.select("_c", F.floor(F.col("_start") / span).cast("long").alias("_b"), "_start")


def bucket_decisions(df: DataFrame, client: str, time: str, tie: str, limit: int, burst: int, seconds: int) -> DataFrame:
    """Adds ``allowed``: a fixed window that begins with a client's first request, and a bucket of burst tokens.

    A request at or after the window's end opens a new one with a full bucket. Within it, tokens come
    back as whole numbers of elapsed * limit / seconds since the last refill, up to burst. Windows are
    found first (``window_starts``); each is decided by itself, so a client is as many groups as it has windows.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])
    rows = _binned(df, time, seconds)
    starts = cut(window_starts(rows, client, seconds), "window-starts")
    for name, back in (("_here", 0), ("_front", 1)):
        at = starts.select(F.col("_c").alias("_d"), (F.col("_b") + back).alias("_e"), F.col("_start").alias(name))
        rows = rows.join(at, F.col(client).eqNullSafe(F.col("_d")) & (F.col("_bin") == F.col("_e")), "left").drop("_d", "_e")
    rows = rows.withColumn("_began", F.when(F.col("_here") <= F.col("_t"), F.col("_here")).otherwise(F.col("_front")))
    columns = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window, refilled, count, tokens = None, 0, 0, 0
        for pdf in parts:
            out = []
            for c, began, t in zip(pdf[client], pdf["_began"], pdf["_t"], strict=True):
                if (c, began) != window:
                    window, refilled, count, tokens = (c, began), t, 0, burst
                else:
                    more = int((t - refilled) / 1e6 * limit / seconds)
                    if more > 0:
                        tokens, refilled = min(burst, tokens + more), t
                ok = count < limit and tokens > 0
                if ok:
                    count, tokens = count + 1, tokens - 1
                out.append(ok)
            yield pdf.assign(allowed=out)[[*columns, "allowed"]]

    return rows.repartition(client, "_began").sortWithinPartitions(client, "_began", "_t", tie).mapInPandas(run, schema)


# Bounds of the scores 5, 4, 3 and 2, and segments in the order in which they are tried.
RECENCY, FREQUENCY, MONETARY = (7, 14, 30, 60), (10, 5, 3, 2), (10_000, 5_000, 1_000, 500)
SEGMENTS = [
    ("r_score >= 4 AND f_score >= 4 AND m_score >= 4", "高价值用户"),
    ("r_score >= 4 AND f_score >= 4", "重要保持用户"),
    ("r_score >= 4 AND m_score >= 4", "重要发展用户"),
    ("f_score >= 4 AND m_score >= 4", "重要挽留用户"),
    ("r_score >= 4", "新用户"),
    ("f_score >= 4", "一般保持用户"),
    ("m_score >= 4", "一般发展用户"),
]
NO_SEGMENT = "流失用户"


def segments(orders: DataFrame, customer: str, order: str, time: str, amount: str, as_of_date: str) -> DataFrame:
    """Recency, frequency (distinct orders) and monetary scores from 1 to 5, their sum, and the customer's segment."""
    g = orders.groupBy(customer).agg(F.datediff(F.lit(as_of_date).cast("date"), F.max(F.to_date(time))).alias("recency_days"), F.count_distinct(order).alias("frequency"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("monetary"))
    g = g.withColumns({"r_score": _score(F.col("recency_days"), RECENCY, True), "f_score": _score(F.col("frequency"), FREQUENCY, False), "m_score": _score(F.col("monetary"), MONETARY, False)})
    segment = F.lit(NO_SEGMENT)
    for condition, name in reversed(SEGMENTS):
        segment = F.when(F.expr(condition), name).otherwise(segment)
    return g.withColumns({"rfm_score": F.col("r_score") + F.col("f_score") + F.col("m_score"), "user_segment": segment})


def _score(c: Column, bounds: tuple, less: bool) -> Column:
    out = F.lit(1)
    for points, b in reversed(list(zip((5, 4, 3, 2), bounds, strict=True))):
        out = F.when(c <= b if less else c >= b, points).otherwise(out)
    return out


def ranking(df: DataFrame, kind: str, name: str, amount: str, n: int) -> DataFrame:
    """The n names with the greatest sums; only those are numbered."""
    top = df.groupBy(F.col(name).cast("string").alias("name")).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("total")).orderBy(F.desc("total"), "name").limit(n)
    return top.select(F.lit(kind).alias("kind"), "name", "total", F.row_number().over(Window.orderBy(F.desc("total"), "name")).alias("place"))
