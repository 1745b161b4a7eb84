"""Queries for joins, windows, sets, functions, logs and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import temporal as T
from ..operators.ranks import percentile_within
from .common import table


def j19(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 200000")
    j = c.filter("c_nationkey < 12").join(o, F.col("c_custkey") == F.col("o_custkey"), "full")
    return j.groupBy(F.col("c_custkey").isNull().alias("no_customer"), F.col("o_orderkey").isNull().alias("no_order")).agg(F.count(F.lit(1)).alias("n"))


def j19_using(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return s.join(n, "k", "right").groupBy("n_name").agg(F.count("s_name").alias("n"))


def j20(spark, sf):
    o = table(spark, sf, "orders")
    big = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(big, "o_orderkey", "left_semi").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


def j21(spark, sf):
    s = table(spark, sf, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("one"), F.col("b.s_suppkey").alias("other"))


def j22(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    v = table(spark, sf, "events").filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("valid_from")).agg(F.max("value").alias("price"))
    return T.as_of(e, v, "user_id", "ts", "valid_from", ["price"]).select("event_id", "price")


def j23(spark, sf):
    e = table(spark, sf, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), "ts")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("click_ts"))
    return T.within(buys, clicks, "user_id", "ts", "click_ts", 86_400).select("buy", "click")


def j24(spark, sf):
    """The dearest order of each customer: one aggregate, no sort of all orders."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", F.col("o_orderkey"))).alias("x"))
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_totalprice").alias("o_totalprice"))


def j25(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "word"))


def j26(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("heddlework_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM heddlework_orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM heddlework_orders i WHERE i.o_custkey = o.o_custkey) AND o_totalprice > (SELECT avg(o_totalprice) FROM heddlework_orders)")


def w1(spark, sf):
    return T.latest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place")


def w4(spark, sf):
    o = T.latest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("deleted")
    return o.select("o_custkey", status.alias("status"), T.actions(status).alias("actions"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("next_run"))


def w5(spark, sf):
    d = T.sliding_decisions(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 86_400)
    return d.select("event_id", "allowed")


def w6(spark, sf):
    d = T.bucket_decisions(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 5, 2, 86_400)
    return d.select("event_id", "allowed")


def w7(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(w).alias("row"), F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.round(F.percent_rank().over(w), 9).alias("percent"), F.ntile(4).over(w).alias("quarter"))


def w8(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("running"), F.count(F.lit(1)).over(w).alias("n"))


def w9(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    before = F.lag("ts").over(w)
    return e.select("event_id", F.timestamp_diff("SECOND", before, F.col("ts")).alias("seconds"), F.lead("event_type").over(w).alias("next"))


def w10(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = table(spark, sf, "orders").withColumn("g", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate"))))
    groups = Window.partitionBy("o_custkey").orderBy("g").rangeBetween(-1, 0)  # GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW
    return ranked.select("o_orderkey", F.count(F.lit(1)).over(by.rowsBetween(-2, 2)).alias("n_rows"), F.expr("count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW)").alias("n_range"), F.count(F.lit(1)).over(groups).alias("n_groups"))


def w11(spark, sf):
    l = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice").join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    r = T.ranking(l, "product", "p_partkey", "l_extendedprice", 100).unionByName(T.ranking(l, "brand", "p_brand", "l_extendedprice", 50)).unionByName(T.ranking(l, "type", "p_type", "l_extendedprice", 50))
    return r.withColumn("total", F.col("total").cast("double"))


def t1(spark, sf):
    return table(spark, sf, "customer").orderBy("c_name", "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


def t4(spark, sf):
    return table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


def u1(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    both = c.intersect(s).withColumn("op", F.lit("intersect"))
    return both.unionByName(c.exceptAll(s).withColumn("op", F.lit("except all"))).unionByName(s.union(c).distinct().withColumn("op", F.lit("union"))).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


def f1(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.upper("c_mktsegment").alias("u"), F.concat(F.trim(F.lit("  a ")), "c_name").alias("c"), F.repeat(F.left("c_mktsegment", F.lit(1)), 3).alias("r"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("n"))


def f2(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")).alias("days"), F.year("o_orderdate").cast("long").alias("year"), F.date_sub(F.to_date("o_orderdate"), 7).cast("string").alias("week_before"), F.extract(F.lit("DOY"), "o_orderdate").cast("long").alias("doy"))


def f3(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", (k * 3 - 1).alias("a"), (k % 7).alias("m"), (-k).alias("neg"), k.bitwiseAND(12).alias("band"), k.bitwiseOR(3).alias("bor"), k.bitwiseXOR(5).alias("bxor"), F.bitwise_not(k).alias("bnot"))


def f4(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("value").cast("int").alias("i"), F.col("event_type").try_cast("int").alias("none"), F.col("user_id").cast("string").alias("s"))


def f6(spark, sf):
    a = F.split("p_type", " ")
    sizes = F.transform(a, lambda x: F.length(x))
    return table(spark, sf, "part").select("p_partkey", a[0].alias("first"), F.aggregate(sizes, F.lit(0), lambda x, y: x + y).alias("letters"), F.size(F.filter(a, lambda x: F.length(x) > 5)).alias("long_words"), F.exists(a, lambda x: x == "BRASS").alias("brass"))


def f7(spark, sf):
    s = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    m = F.create_map(F.lit("a"), F.col("p_size"), F.lit("b"), F.col("p_size") * 2)
    return table(spark, sf, "part").select("p_partkey", s["brand"].alias("brand"), m["b"].alias("b"), F.size(m).alias("n"))


def a36(spark, sf):
    return T.funnel(table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", ["view", "click", "purchase"], 7 * 86_400)


def a39(spark, sf):
    return T.segments(table(spark, sf, "orders").withColumn("amount", F.floor(F.col("o_totalprice") / 100)), "o_custkey", "o_orderkey", "o_orderdate", "amount", "2001-12-31").withColumn("monetary", F.col("monetary").cast("double"))


def a40(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "c_mktsegment").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))


def g10(spark, sf):
    c = table(spark, sf, "customer")
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"), F.col("o_orderkey").alias("execution_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    on = c.select(F.col("c_custkey").alias("workflow"), F.lit(0).alias("place"), (F.col("c_custkey") + 1).alias("needs"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("int").alias("from_hour"), F.lit(None).cast("int").alias("to_hour"), F.lit(None).cast("string").alias("weekdays"))
    hours = c.select(F.col("c_custkey").alias("workflow"), F.lit(1).alias("place"), F.lit(None).cast("long").alias("needs"), F.lit(None).cast("string").alias("expected"), F.lit(0).alias("from_hour"), (F.col("c_custkey") % 24).cast("int").alias("to_hour"), F.lit("1,2,3").alias("weekdays"))
    return T.ready(on.unionByName(hours), runs, F.lit("2001-11-11").cast("date"), 9, 2)


def r13(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    g = e.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).join(percentile_within(e, ["hour"], "value", 0.95, "p95"), "hour", "left")
    return g.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", "errors", F.round("p95", 6).alias("p95"), (F.col("errors") / 3600.0 > 0.001).alias("error_alert"), (F.col("p95") > 100).alias("slow_alert"))


def r15(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("done"))
    return T.running_gauge(e, "ts", "done", "event_type").groupBy("event_type").agg(F.max("running").alias("most"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "j19_full_join": j19, "j19_using": j19_using, "j20_semi_anti": j20, "j21_self_join": j21, "j22_as_of": j22, "j23_interval": j23, "j24_lateral_top": j24, "j25_unnest": j25, "j26_scalar_subqueries": j26, "w1_latest": w1, "w4_task_status": w4, "w5_sliding_limiter": w5,
    "w6_token_bucket": w6, "w7_ranks": w7, "w8_running": w8, "w9_lag_lead": w9, "w10_frames": w10, "w11_rankings": w11, "t1_page": t1, "t4_top": t4, "u1_set_operations": u1, "f1_strings": f1, "f2_dates": f2, "f3_arithmetic": f3, "f4_casts": f4, "f6_arrays": f6, "f7_maps_structs": f7,
    "a36_funnel": a36, "a39_segments": a39, "a40_daily_summary": a40, "g10_readiness": g10, "r13_rates": r13, "r15_running_gauge": r15,
}


def _rank(kind: str, name: str, n: int) -> str:
    return f"SELECT * FROM (SELECT '{kind}' AS kind, name, CAST(total AS DOUBLE) AS total, CAST(row_number() OVER (ORDER BY total DESC, name) AS INTEGER) AS place FROM (SELECT CAST({name} AS VARCHAR) AS name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)) WHERE place <= {n}"


_SEQ = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events)"

ORACLES = {
    # The walks over a user's events, one event of each user in a step.
    "a36_funnel": """
WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events WHERE event_type IN ('view', 'click', 'purchase')),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c FROM e WHERE k = 1
  UNION ALL SELECT r.user_id, e.k, CASE event_type WHEN 'view' THEN t ELSE a END,
    CASE WHEN event_type = 'click' AND t - a <= 604800000000 THEN greatest(a, coalesce(b, a)) ELSE b END, CASE WHEN event_type = 'purchase' AND t - b <= 604800000000 THEN greatest(b, coalesce(c, b)) ELSE c END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, CAST(max((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS BIGINT) AS level FROM r GROUP BY 1""",
    "w5_sliding_limiter": f"""
WITH RECURSIVE {_SEQ},
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END, event_id, len(h) < 3 FROM (SELECT e.user_id, e.k, e.t, e.event_id, list_filter(r.held, lambda x: e.t - x < 86400000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id, allowed FROM r WHERE k > 0""",
    "w6_token_bucket": f"""
WITH RECURSIVE {_SEQ},
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS refilled, 0 AS count, CAST(0 AS BIGINT) AS tokens, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, began, refilled, count + ok::INT, tokens - ok::INT, event_id, ok FROM (
    SELECT *, count < 5 AND tokens > 0 AS ok FROM (
      SELECT user_id, k, event_id, CASE WHEN fresh THEN t ELSE began END AS began, CASE WHEN fresh OR more > 0 THEN t ELSE refilled END AS refilled, CASE WHEN fresh THEN 0 ELSE count END AS count, CASE WHEN fresh THEN 2 WHEN more > 0 THEN least(2, tokens + more) ELSE tokens END AS tokens
      FROM (SELECT e.user_id, e.k, e.t, e.event_id, r.began, r.refilled, r.count, r.tokens, r.began IS NULL OR e.t - r.began >= 86400000000 AS fresh, CAST((e.t - r.refilled) * 5 // 86400000000 AS BIGINT) AS more FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))
SELECT event_id, allowed FROM r WHERE k > 0""",
    "j19_full_join": "SELECT c_custkey IS NULL AS no_customer, o_orderkey IS NULL AS no_order, count(*) AS n FROM (SELECT * FROM customer WHERE c_nationkey < 12) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey GROUP BY 1, 2",
    "j19_using": "SELECT n_name, count(s_name) AS n FROM (SELECT s_nationkey AS k, s_name FROM supplier) RIGHT JOIN (SELECT n_nationkey AS k, n_name FROM nation) USING (k) GROUP BY 1",
    "j20_semi_anti": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "j21_self_join": "SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "j22_as_of": "SELECT event_id, price FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT user_id, ts AS valid_from, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) v ON e.user_id = v.user_id AND e.ts >= v.valid_from",
    "j23_interval": "SELECT a.event_id AS buy, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 86400 SECONDS WHERE a.event_type = 'purchase' AND b.event_type = 'click'",
    "j24_lateral_top": "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)",
    "j25_unnest": "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS i, w[i] AS word FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part))",
    "j26_scalar_subqueries": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "w1_latest": "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3",
    "w4_task_status": "SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'deleted' END AS status, CASE o_orderstatus WHEN 'F' THEN 'start' WHEN 'O' THEN 'pause,stop' ELSE '' END AS actions, o_orderdate + INTERVAL 1 DAY AS next_run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "w7_ranks": "SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS row, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense, round(percent_rank() OVER w, 9) AS percent, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "w8_running": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS running, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)",
    "w9_lag_lead": "SELECT event_id, CAST(trunc(epoch_us(ts - lag(ts) OVER w) / 1000000) AS BIGINT) AS seconds, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "w10_frames": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n_rows, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n_range, count(*) OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n_groups FROM orders",
    "w11_rankings": " UNION ALL ".join((_rank("product", "p_partkey", 100), _rank("brand", "p_brand", 50), _rank("type", "p_type", 50))),
    "t1_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40",
    "t4_top": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25",
    "u1_set_operations": "WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier) SELECT op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k, 'intersect' AS op FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT k, 'except all' FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) UNION ALL SELECT k, 'union' FROM (SELECT k FROM s UNION SELECT k FROM c)) GROUP BY 1",
    "f1_strings": "SELECT c_custkey, upper(c_mktsegment) AS u, trim('  a ') || c_name AS c, repeat(left(c_mktsegment, 1), 3) AS r, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS n FROM customer",
    "f2_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS days, year(o_orderdate) AS year, CAST(CAST(o_orderdate AS DATE) - 7 AS VARCHAR) AS week_before, dayofyear(o_orderdate) AS doy FROM orders",
    "f3_arithmetic": "SELECT p_partkey, p_partkey * 3 - 1 AS a, p_partkey % 7 AS m, -p_partkey AS neg, p_partkey & 12 AS band, p_partkey | 3 AS bor, xor(p_partkey, 5) AS bxor, ~p_partkey AS bnot FROM part",
    "f4_casts": "SELECT event_id, CAST(trunc(value) AS INTEGER) AS i, CAST(NULL AS INTEGER) AS none, CAST(user_id AS VARCHAR) AS s FROM events",
    "f6_arrays": "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, CAST(length(replace(p_type, ' ', '')) AS INTEGER) AS letters, CAST(len([x for x in string_split(p_type, ' ') if length(x) > 5]) AS INTEGER) AS long_words, list_contains(string_split(p_type, ' '), 'BRASS') AS brass FROM part",
    "f7_maps_structs": "SELECT p_partkey, p_brand AS brand, p_size * 2 AS b, 2 AS n FROM part",
    "a39_segments": """
WITH g AS (SELECT o_custkey, CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-12-31') AS INTEGER) AS recency_days, count(DISTINCT o_orderkey) AS frequency, sum(CAST(floor(o_totalprice / 100) AS DECIMAL(18,2))) AS monetary FROM orders GROUP BY 1),
s AS (SELECT *, CASE WHEN recency_days <= 7 THEN 5 WHEN recency_days <= 14 THEN 4 WHEN recency_days <= 30 THEN 3 WHEN recency_days <= 60 THEN 2 ELSE 1 END AS r_score, CASE WHEN frequency >= 10 THEN 5 WHEN frequency >= 5 THEN 4 WHEN frequency >= 3 THEN 3 WHEN frequency >= 2 THEN 2 ELSE 1 END AS f_score,
  CASE WHEN monetary >= 10000 THEN 5 WHEN monetary >= 5000 THEN 4 WHEN monetary >= 1000 THEN 3 WHEN monetary >= 500 THEN 2 ELSE 1 END AS m_score FROM g)
SELECT o_custkey, recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary, r_score, f_score, m_score, r_score + f_score + m_score AS rfm_score,
  CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN '高价值用户' WHEN r_score >= 4 AND f_score >= 4 THEN '重要保持用户' WHEN r_score >= 4 AND m_score >= 4 THEN '重要发展用户' WHEN f_score >= 4 AND m_score >= 4 THEN '重要挽留用户' WHEN r_score >= 4 THEN '新用户' WHEN f_score >= 4 THEN '一般保持用户' WHEN m_score >= 4 THEN '一般发展用户' ELSE '流失用户' END AS user_segment FROM s""",
    "a40_daily_summary": "SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2",
    "g10_readiness": "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1), d AS (SELECT c_custkey AS workflow, CASE WHEN o_orderkey IS NULL THEN 'no execution' WHEN o_orderstatus <> 'F' THEN 'status' WHEN CAST(o_orderdate AS DATE) <> DATE '2001-11-11' THEN 'not today' END AS a, CASE WHEN NOT 9 < c_custkey % 24 THEN 'hour' END AS b FROM customer LEFT JOIN l ON l.o_custkey = c_custkey + 1) SELECT workflow, a IS NULL AND b IS NULL AS ready, coalesce(a, b) AS reason FROM d",
    "r13_rates": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (event_type = 'error') / 3600.0 > 0.001 AS error_alert, quantile_cont(value, 0.95) > 100 AS slow_alert FROM events GROUP BY date_trunc('hour', ts)",
    "r15_running_gauge": "SELECT event_type, CAST(max(r) AS BIGINT) AS most, count(*) AS n FROM (SELECT event_type, t, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS r FROM (SELECT event_type, t, sum(d) AS d FROM (SELECT event_type, ts AS t, 1 AS d FROM events UNION ALL SELECT event_type, ts + INTERVAL 1 HOUR, -1 FROM events) GROUP BY 1, 2)) GROUP BY 1",
}
