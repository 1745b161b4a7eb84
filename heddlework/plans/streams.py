"""Queries that run events as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.temporal import paths
from ..sources.storage import shared_folder
from ..streaming import streams as S
from .common import table


def _events(spark, sf):
    return S.event_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)


def _text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def r2(spark, sf):
    events = _with_end(spark, sf, "events", ["user_id", "event_type", "ts"], "user_id", "ts")
    out = S.upsert_sink(S.tumbling(events, "ts", "1 hour", "event_type", exact=True), [], "append")
    return _text(out, "window_start", "window_end")


def r3(spark, sf):
    out = S.upsert_sink(S.hopping(_events(spark, sf), "ts", "6 hours", "1 hour", "event_type"), ["window_start", "event_type"])
    return _text(out, "window_start", "window_end")


def r4(spark, sf):
    """Session windows are not allowed in update mode; complete mode gives all of them."""
    out = S.upsert_sink(S.sessions(_events(spark, sf), "ts", "2 hours", "user_id"), ["window_start", "user_id"], "complete")
    return _text(out.filter("n >= 2"), "window_start", "window_end").drop("window_end")


def r5(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = S.upsert_sink(_events(spark, sf).join(users, "user_id", "left").select("event_id", "c_mktsegment"), [], "append")
    return out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def r6(spark, sf):
    buys = _events(spark, sf).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), "ts")
    clicks = _events(spark, sf).filter("event_type = 'click'").select(F.col("user_id"), F.col("event_id").alias("click"), F.col("ts").alias("click_ts"))
    j = S.interval_join(buys, clicks, "user_id", "ts", "click_ts", "1 DAY").select("buy", "click")
    return S.upsert_sink(j, [], "append")


def r8(spark, sf):
    e = table(spark, sf, "events")
    counts = S.upsert_sink(S.tumbling(_events(spark, sf), "ts", "1 hour"), ["window_start"])
    return S.alerts(e.filter("value > 150").withColumn("value", F.floor("value")), counts, "value", 150.0, "pv", 15)


def r9(spark, sf):
    from pyspark.sql import Window

    daily = S.upsert_sink(S.hopping(_events(spark, sf), "ts", "1 day", "1 day", "event_type"), ["window_start", "event_type"])
    w = Window.partitionBy("window_start").orderBy(F.desc("n"), "event_type")
    return _text(daily.withColumn("place", F.row_number().over(w)).drop("window_end"), "window_start")


def r11(spark, sf):
    return paths(table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", "view", "click", "purchase", 60, 1_000_000)


def r1(spark, sf):
    """Every fiftieth event comes two batches after most others: in windows that the watermark had passed a batch before it is dropped."""
    path = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("event_id % 50 > 1", "event_id % 50 = 1", "event_id % 50 = 0"):
        e.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "5 seconds")
    return _text(S.upsert_sink(S.hopping(stream, "ts", "1 hour", "1 hour", "event_type"), ["window_start", "event_type"]), "window_start", "window_end")


def _with_end(spark, sf, name, columns, key, time):
    """A table as a stream whose last row, with a key that is none, is later than all others: so all waiting rows go out."""
    schema = table(spark, sf, name).select(*columns).schema
    path = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    end = {key: F.lit(-1), time: F.lit("2200-01-01").cast("timestamp")}
    spark.range(1).select(*(end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(path)
    rows = spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf).select(*columns)
    both = rows.unionByName(spark.readStream.schema(schema).parquet(path))
    return both.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, "1 day")


def r5_versions(spark, sf):
    """Events with the version of their user's row that held at their time: orders of the user change the status. One streaming query over both."""
    events = _with_end(spark, sf, "events", ["event_id", "user_id", "ts"], "user_id", "ts")
    orders = _with_end(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_orderstatus"], "o_custkey", "o_orderdate").toDF("user_id", "since", "status")
    out = S.upsert_sink(S.versioned(events, orders, "user_id", "ts", "since", ["status"]), [], "append")
    return out.select("event_id", "status")


def r12(spark, sf):
    e = _events(spark, sf).select("user_id", "ts")
    out = S.upsert_sink(S.limited(e, "user_id", "ts", 3, 86_400), [], "append")
    return out.groupBy("user_id", "allowed").agg(F.count(F.lit(1)).alias("n"))


def r14(spark, sf):
    action = F.when(F.col("event_type") == "error", "login_failed").when(F.col("event_type") == "purchase", "config_change").otherwise("login")
    e = _events(spark, sf).select("event_id", action.alias("action"), F.when(F.col("event_id") % 2 == 0, F.lit('{"token": "x"}')).alias("details"))
    return S.upsert_sink(S.audited(e, "details"), [], "append").select("event_id", "audit_id", "action", "details", "severity")


QUERIES = {"r2_tumbling": r2, "r3_hopping": r3, "r4_sessions": r4, "r5_stream_dimension": r5, "r6_stream_interval": r6, "r8_alerts": r8, "r9_live_ranking": r9, "r11_paths": r11, "r14_audit": r14, "r1_late_rows": r1, "r5_versions": r5_versions, "r12_stream_limiter": r12}

_F = "'%Y-%m-%d %H:%M:%S'"
_SEQ = "e AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events)"
ORACLES = {
    "r11_paths": f"""
WITH RECURSIVE {_SEQ},
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS began, CAST(0 AS BIGINT) AS n FROM e WHERE k = 1
  UNION ALL SELECT r.user_id, e.k, CASE event_type WHEN 'view' THEN t WHEN 'click' THEN began END, n + (event_type = 'purchase' AND began IS NOT NULL AND t - began BETWEEN 60000000 AND 1000000000000)::INT FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, max(n) AS n_matches FROM r GROUP BY 1 HAVING max(n) > 0""",
    "r12_stream_limiter": f"""
WITH RECURSIVE {_SEQ},
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BOOLEAN) AS allowed FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END, len(h) < 3 FROM (SELECT e.user_id, e.k, e.t, list_filter(r.held, lambda x: e.t - x < 86400000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, allowed, count(*) AS n FROM r WHERE k > 0 GROUP BY 1, 2""",
    "r1_late_rows": f"WITH w AS (SELECT *, date_trunc('hour', ts) AS s, (SELECT max(ts) FROM events WHERE event_id % 50 > 1) - INTERVAL 5 SECOND AS mark FROM events) SELECT strftime(s, {_F}) AS window_start, strftime(s + INTERVAL 1 HOUR, {_F}) AS window_end, event_type, count(*) AS n FROM w WHERE event_id % 50 <> 0 OR s + INTERVAL 1 HOUR > mark GROUP BY ALL",
    "r5_versions": "WITH o AS (SELECT o_custkey AS u, o_orderdate AS since, max(o_orderstatus) AS status FROM orders GROUP BY 1, 2) SELECT event_id, (SELECT arg_max(status, since) FROM o WHERE u = user_id AND since <= ts) AS status FROM events",
    "r2_tumbling": f"SELECT strftime(date_trunc('hour', ts), {_F}) AS window_start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, {_F}) AS window_end, event_type, count(*) AS pv, count(DISTINCT user_id) AS uv FROM events GROUP BY ALL",
    "r3_hopping": f"SELECT strftime(s, {_F}) AS window_start, strftime(s + INTERVAL 6 HOUR, {_F}) AS window_end, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(k) AS s FROM events, (SELECT unnest(range(0, 6)) AS k)) GROUP BY ALL",
    "r4_sessions": f"WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, strftime(min(ts), {_F}) AS window_start, count(*) AS n, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM b GROUP BY user_id, g HAVING count(*) >= 2",
    "r5_stream_dimension": "SELECT c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1",
    "r6_stream_interval": "SELECT a.event_id AS buy, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'click'",
    "r8_alerts": "SELECT 'high_value' AS kind, 'value ' || CAST(floor(value) AS BIGINT) AS message FROM events WHERE value > 150 AND floor(value) > 150 UNION ALL SELECT 'abnormal', 'count ' || n FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('hour', ts)) WHERE n > 15",
    "r9_live_ranking": f"SELECT window_start, event_type, n, CAST(row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS INTEGER) AS place FROM (SELECT strftime(date_trunc('day', ts), {_F}) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)",
    "r14_audit": """SELECT event_id, md5(event_id || ':' || action) AS audit_id, action, CASE WHEN event_id % 2 = 0 THEN '{"token": "[REDACTED]"}' ELSE '{}' END AS details, CASE action WHEN 'login_failed' THEN 'warning' WHEN 'config_change' THEN 'critical' ELSE 'info' END AS severity FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'purchase' THEN 'config_change' ELSE 'login' END AS action FROM events)""",
}
