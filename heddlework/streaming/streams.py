"""Streams of events: the same functions take a batch or a streaming DataFrame.

Event times are timestamps with a time zone, as watermarks need; ``event_stream`` casts them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.storage import shared_folder

#: Messages of a topic, and of a queue, where nothing else is known of them. Fixed values.
MESSAGE = "key binary, value binary, timestamp timestamp, partition int, offset long"
QUEUE_MESSAGE = "routing_key string, payload string, properties map<string,string>, timestamp timestamp, exchange string"


def event_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, time: str = "ts", delay: str = "5 seconds") -> DataFrame:
    """Files of a folder as a stream with a watermark."""
    fields = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in schema.fields])
    stream = spark.readStream.schema(fields).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def tumbling(df: DataFrame, time: str, size: str, *keys: str, user: str = "user_id", exact: bool = False) -> DataFrame:
    """Views and users in windows one after the other; users are estimated or, in append mode only, counted.

    Counted users are rows of the state, one for each window and user, which a second aggregation adds up
    when the watermark closes the window; no row holds a window's users.
    """
    if exact:
        by_user = df.groupBy(F.window(time, size), *keys, user).agg(F.count(F.lit(1)).alias("n"))
        return _flat(by_user.groupBy("window", *keys).agg(F.sum("n").alias("pv"), F.count(user).alias("uv")))
    return _flat(df.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("pv"), F.approx_count_distinct(user, 0.01).alias("uv")))


def hopping(df: DataFrame, time: str, size: str, slide: str, *keys: str) -> DataFrame:
    return _flat(df.groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n")))


def sessions(df: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Sessions that end after a gap: number of events and duration in seconds from the first to the last."""
    g = df.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return _flat(g.withColumn("seconds", F.unix_timestamp("last") - F.unix_timestamp("first")).drop("first", "last"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, other_time: str, interval: str) -> DataFrame:
    """Pairs of one key with the right time in the interval up to the left one; both sides with watermarks keep bounded state."""
    a, b = left.alias("a"), right.alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{other_time}") <= F.col(f"a.{time}")) & (F.col(f"b.{other_time}") >= F.col(f"a.{time}") - F.expr(f"INTERVAL {interval}"))
    return a.join(b, near)


def alerts(events: DataFrame, counts: DataFrame, amount: str, most: float, n: str, most_n: int) -> DataFrame:
    """High amounts and high counts as one table of messages."""
    high = events.filter(F.col(amount) > most).select(F.lit("high_value").alias("kind"), F.concat(F.lit("value "), F.col(amount).cast("string")).alias("message"))
    many = counts.filter(F.col(n) > most_n).select(F.lit("abnormal").alias("kind"), F.concat(F.lit("count "), F.col(n).cast("string")).alias("message"))
    return high.unionByName(many)


def audited(events: DataFrame, detail: str) -> DataFrame:
    """Audit events with defaults, secrets redacted, and their severity, in that order."""
    from ..functions.text import redacted_json, severity

    filled = events.withColumns({"audit_id": F.md5(F.concat_ws(":", "event_id", "action")), detail: F.coalesce(detail, F.lit("{}"))})
    return filled.withColumn(detail, redacted_json(F.col(detail))).withColumn("severity", severity(F.col("action")))


#: Keeps the state of the processors below in RocksDB, outside the heap, with changes alone in a checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Limiter(StatefulProcessor):
    """Sliding-window limits of one client: a list of the allowed times of its window, and a timer that clears it."""

    def __init__(self, client: str, time: str, limit: int, seconds: int) -> None:
        self.client, self.time, self.limit, self.span = client, time, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.held.get()] if self.held.exists() else []
        parts = list(rows)
        pdf = pd.concat(parts).sort_values(self.time, kind="stable") if len(parts) > 1 else parts[0].sort_values(self.time, kind="stable")
        allowed = []
        for t in _micros(pdf[self.time]):
            held = [x for x in held if t - x < self.span]
            allowed.append(len(held) < self.limit)
            if allowed[-1]:
                held.append(t)
        self.held.put([(x,) for x in held])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        last = max(held, default=0) // 1000 + 2 * self.span // 1000
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({self.client: [key[0]] * len(pdf), self.time: pdf[self.time].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, client: str, time: str, limit: int, seconds: int) -> DataFrame:
    """Sliding-window limits on a stream with a watermark: (client, time, allowed).

    State is the allowed times of a client's window, in RocksDB (the session's state store is set to it); it goes when the watermark is two windows past them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = stream.schema[client].dataType.simpleString()
    return stream.select(client, time).groupBy(client).transformWithStateInPandas(Limiter(client, time, limit, seconds), f"`{client}` {kind}, `{time}` timestamp, allowed boolean", "Append", "EventTime")


def _packed(pdf: pd.DataFrame) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    batch = pa.Table.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_table(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(chunk).read_all().to_pandas()


class Versions(StatefulProcessor):
    """The versions of one bucket's keys by event time, and the rows that wait until the watermark has passed them.

    State is read and written in chunks of rows, as a call for each row or key costs more than all the rest.
    A bucket has one timer, at its first waiting row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getListState("versions", "chunk binary")
        self.waiting = handle.getListState("waiting", "chunk binary")

    def _wake(self, at: int, mark: int) -> None:
        # A timer that is due is still listed, but goes when it has been handled.
        at, timers = max(at // 1000 + 1, mark + 1), [t for t in self.handle.listTimers() if t > mark]
        if all(at < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            version = pdf["row"].isna()
            new, own = pdf.loc[version, ["k", "at", "version"]], pdf.loc[~version, ["k", "at", "row"]]
            if len(new):
                self.versions.appendValue(_packed(new))
            if len(own):
                self.waiting.appendValue(_packed(own))
                first = min(x for x in (first, int(own["at"].min())) if x is not None)
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        known = [_unpacked(x[0]) for x in self.versions.get()] if self.versions.exists() else []
        known = pd.concat(known) if known else pd.DataFrame({"k": [], "at": pd.Series([], dtype="int64"), "version": []})
        known = known.sort_values("version", kind="stable").drop_duplicates(["k", "at"], keep="last")
        known = known.sort_values("at", kind="stable", ignore_index=True)
        # Keys are compared as numbers of this call, whatever their type.
        number = {k: i for i, k in enumerate(known["k"].unique())}
        right = pd.DataFrame({"n": known["k"].map(number).astype("int64"), "at": known["at"], "version": known["version"]})
        later = []
        for chunk in list(self.waiting.get()) if self.waiting.exists() else []:
            pdf = _unpacked(chunk[0])
            due = pdf["at"] < mark
            if not due.all():
                later.append(pdf[~due])
            if due.any():
                left = pdf[due].sort_values("at", kind="stable", ignore_index=True)
                left["n"] = left["k"].map(number).fillna(-1).astype("int64")
                out = pd.merge_asof(left, right, on="at", by="n")
                texts = {c: out[c].astype(object).where(out[c].notna(), None) for c in ("row", "version")}
                yield pd.DataFrame({"k": out["k"] if out["k"].dtype.kind in "iufb" else out["k"].astype(object), **texts})
        if later:
            self.waiting.put([_packed(x) for x in later])
        else:
            self.waiting.clear()
        # Of a key's versions that the watermark has passed only the last can still hold for a row.
        past = known["at"] <= mark
        left_over = pd.concat([known[past].drop_duplicates("k", keep="last"), known[~past]])
        if len(left_over):
            self.versions.put([_packed(left_over[i : i + 10_000]) for i in range(0, len(left_over), 10_000)])
        if later:
            self._wake(min(int(x["at"].min()) for x in later), mark // 1000)

    def close(self) -> None:
        pass


def versioned(stream: DataFrame, versions: DataFrame, key: str, time: str, since: str, values: list[str], buckets: int = 512) -> DataFrame:
    """Rows of a stream with the values of the latest version of their key at or before their time, as a stream.

    Both sides are streams with watermarks. A row waits until the watermark has passed its time, so
    versions that come late, but within the watermark's delay, count; then it goes out, and versions
    older than the last one in front of the watermark go from the state. Of several versions of one
    instant the greatest as JSON holds. Rows and versions without time or key are left out.

    Keys share ``buckets`` of state, each of which a task joins at once when its timer is due: it holds the
    bucket's versions and waiting rows, not those of others.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rest = [c for c in stream.columns if c != key]
    kind = stream.schema[key].dataType.simpleString()
    json = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = stream.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("t"), F.lit(None).cast("string").alias("version"), json(rest).alias("row"))
    other = versions.select(F.col(key).cast(kind).alias("k"), F.col(since).cast("timestamp").alias("t"), json(values).alias("version"), F.lit(None).cast("string").alias("row"))
    line = rows.unionByName(other).filter("k IS NOT NULL AND t IS NOT NULL").withColumns({"at": F.unix_micros("t"), "bucket": F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")})
    out = line.groupBy("bucket").transformWithStateInPandas(Versions(), f"k {kind}, row string, version string", "Append", "EventTime")
    schema = lambda df, columns: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    parsed = out.select(F.col("k").alias(key), F.from_json("row", schema(stream, rest)).alias("_r"), F.from_json("version", schema(versions, values)).alias("_v"))
    return parsed.select(key, *(F.col("_r")[c].alias(c) for c in rest), *(F.col("_v")[c].alias(c) for c in values))


def upsert_sink(stream: DataFrame, keys: list[str], mode: str = "update", order: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Runs the stream over what is there and gives the last row of each key; batches are files in the shared folder.

    With a ``path``, its state and rows are kept there, and the next call goes on with what has come since.

    The last row is that of the latest batch, within it the greatest by the columns of ``order``, and
    of rows that are equal in these the greatest by all columns as text.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/number={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("_batch", T.IntegerType())).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if not keys:
        return rows.drop("_batch", "number")
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"), *(F.desc(c) for c in order or []), F.desc(F.to_json(F.struct(*stream.columns))))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch", "number")
