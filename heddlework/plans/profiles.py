"""Queries for the statistics of tables and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import sketches as K
from ..sources.storage import cut
from .common import table

_LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


def a1(spark, sf):
    return P.table_statistics(table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), ["l_returnflag", "month"])


def a2(spark, sf):
    return P.column_statistics(table(spark, sf, "lineitem")).withColumns({c: F.round(c, 4) for c in ("avg_value", "stddev_value", "p25", "p50", "p75")})


def _a2_sql():
    out = []
    for c, t in _LINEITEM.items():
        number = t not in ("string", "timestamp_ntz")
        f = lambda x, number=number: f"round({x}, 4)" if number else "CAST(NULL AS DOUBLE)"
        out.append(
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
            f"{f(f'avg({c})')} AS avg_value, {f(f'stddev_samp({c})')} AS stddev_value, {f(f'quantile_cont({c}, 0.25)')} AS p25, {f(f'quantile_cont({c}, 0.5)')} AS p50, {f(f'quantile_cont({c}, 0.75)')} AS p75 FROM lineitem"
        )
    return " UNION ALL ".join(out)


def a2_approx(spark, sf):
    """Estimated distinct counts are within a tenth of the exact ones."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    near = P.column_statistics(df, exact=False, quantiles=False).select("column_name", F.col("distinct_count").alias("near"))
    exact = P.column_statistics(df, quantiles=False).select("column_name", "distinct_count")
    return exact.join(near, "column_name").select("column_name", "distinct_count", (F.abs(F.col("near") - F.col("distinct_count")) <= 0.1 * F.col("distinct_count") + 1).alias("within"))


def a3(spark, sf):
    return P.top_values(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"), 5)


def _parts(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("partition_id"), F.month("l_shipdate").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    return x.withColumns({"bytes": F.col("rows") * 100 + F.col("part"), "active": F.col("part") % 2})


def a4(spark, sf):
    return P.part_statistics(_parts(spark, sf))


def a5(spark, sf):
    o = table(spark, sf, "orders").withColumn("partition_id", F.year("o_orderdate"))
    partitions = o.groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.when(F.col("partition_id") < 1995, "old").otherwise("new"))
    units = o.groupBy("partition_id", "o_orderpriority").agg(F.count(F.lit(1)).alias("pages")).select("partition_id", "pages")
    return P.allocated_size(partitions, units)


def a6(spark, sf):
    """Orders as indexes of their lines."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("index_name"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("column_name"), (F.col("l_partkey") % 2).alias("non_unique"))
    return P.assembled_indexes(l)


def a7(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("table_name"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.date_format("l_shipdate", "yyyyMM")).alias("partition_name"), F.col("l_linenumber").alias("ordinal"))
    return P.listed_partitions(p)


def _offsets(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition")).agg(F.min("event_id").alias("earliest"), (F.max("event_id") + 1).alias("latest"))
    return e.withColumn("latest", F.when(F.col("partition") == 3, None).otherwise(F.col("latest")))


def a8(spark, sf):
    return P.topic_statistics(_offsets(spark, sf))


def a20(spark, sf):
    return P.counts_by(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", totals=True)


def a21(spark, sf):
    return P.status_summary(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"])


def a22(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("value") > 50, "success").otherwise("failure").alias("status"))
    return P.counts_by(e, "event_type", "status")


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def a23(spark, sf):
    return P.duration_histogram(table(spark, sf, "events"), "value", _BOUNDS, "event_type")


def a23_quantile(spark, sf):
    return P.histogram_quantile(a23(spark, sf), 0.95, "event_type").select("event_type", F.round("quantile", 6).alias("p95"))


def a24(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("task"), F.create_map(F.lit("records"), F.col("event_id") % 7, F.lit("errors"), F.col("event_id") % 2, F.lit("warnings"), F.col("event_id") % 3).alias("stats"))
    return P.merged_counters(e, "stats", "task")


def a25(spark, sf):
    return P.batch_result(table(spark, sf, "customer"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("negative balance: "), "c_name")))


def a26(spark, sf):
    runs = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("success"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"), F.count_distinct("o_custkey").alias("tables"))
    return runs.withColumn("tables_per_second", F.round(F.col("tables") / (F.col("success") + F.col("failed")), 6))


def a27(spark, sf):
    code = F.element_at(F.array(*(F.lit(x) for x in ("TIMEOUT", "NETWORK_ERROR", "AUTH_ERROR", "DEADLINE_EXCEEDED", "NOT_FOUND", "RATE_LIMITED"))), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return P.error_counts(table(spark, sf, "lineitem").withColumn("code", code).withColumnRenamed("l_returnflag", "category"), "category")


def a32(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.count(F.lit(1)).alias("n"))
    return g.filter("n > 10")


def a33(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    r = o.rollup("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    return r.select(F.col("year").cast("int").alias("year"), "o_orderstatus", "n", "level")


def a34(spark, sf):
    return P.exact_distinct_by_bitmap(table(spark, sf, "events"), "user_id", "event_type")


def a35(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    near = P.distinct_by_sketch(e, "user_id", "day", "event_type").withColumnRenamed("n_distinct", "near")
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_distinct"))
    return exact.join(near, "event_type").select("event_type", "n_distinct", (F.abs(F.col("near") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct") + 1).alias("within"))


def a37(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return l.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")).select(F.col("year").cast("int").alias("year"), F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


def a38(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice)").alias("median"))
    return g.withColumn("median", F.round("median", 4))


def a2_merged(spark, sf):
    """The profile of all lines but a tenth, stored, and an increment merged into it; quartiles are made exact in one pass over all."""
    lines = table(spark, sf, "lineitem")
    late = F.coalesce(F.col("l_orderkey") % 10 == 0, F.lit(False))
    stored = cut(K.sketched(lines.filter(~late)), "profile")
    profile = cut(K.merged(stored, K.sketched(lines.filter(late))), "profile")
    exact = K.described(profile).select("column_name", "row_count", "null_count", "min", "max", "mean")
    return exact.join(K.exact_quartiles(lines, profile), "column_name")


QUERIES = {"a2_merged_profile": a2_merged, 
    "a1_table_statistics": a1, "a2_column_statistics": a2, "a2_distinct_estimates": a2_approx, "a3_top_values": a3, "a4_part_statistics": a4, "a5_allocated_size": a5, "a6_index_assembly": a6, "a7_partition_listing": a7,
    "a8_topic_statistics": a8, "a20_counts_with_totals": a20, "a21_status_summary": a21, "a22_operation_counters": a22, "a23_duration_histogram": a23, "a23_histogram_quantile": a23_quantile, "a24_result_summary": a24, "a25_batch_result": a25,
    "a26_run_summary": a26, "a27_error_counts": a27, "a32_group_having": a32, "a33_rollup": a33, "a34_bitmap_distinct": a34, "a35_sketch_distinct": a35, "a37_pivot": a37, "a38_ordered_set_aggregates": a38,
}

_PARTS = "(SELECT p AS partition_id, m AS part, n AS rows, n * 100 + m AS bytes, m % 2 AS active FROM (SELECT year(l_shipdate) AS p, month(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY ALL))"
_HISTOGRAM = " UNION ALL ".join(f"SELECT event_type, {b} AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" if b else "SELECT event_type, CAST(NULL AS DOUBLE) AS le, count(value) AS n FROM events GROUP BY event_type" for b in [*(f"CAST({b} AS DOUBLE)" for b in _BOUNDS), None])

ORACLES = {
    "a2_merged_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, "
        + ", ".join(f"quantile_cont({c}::DOUBLE, {q / 100}) AS p{q}" for q in (25, 50, 75))
        + " FROM lineitem"
        for c, kind in _LINEITEM.items()
        if kind in ("bigint", "int", "double")
    ),
    "a1_table_statistics": "SELECT count(*) AS row_count, count(DISTINCT l_returnflag || strftime(l_shipdate, '%Y-%m')) AS partition_count FROM lineitem",
    "a2_column_statistics": _a2_sql(),
    "a2_distinct_estimates": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, true AS within FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
    "a3_top_values": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS place FROM (SELECT column_name, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")) + ") GROUP BY ALL)) WHERE place <= 5",
    "a4_part_statistics": f"SELECT CAST(partition_id AS INTEGER) AS partition_id, CAST(sum(rows) AS BIGINT) AS row_count, CAST(sum(bytes) AS BIGINT) AS size_bytes, count(*) AS part_count FROM {_PARTS} WHERE active = 1 GROUP BY partition_id",
    "a5_allocated_size": "SELECT CASE WHEN year(o_orderdate) < 1995 THEN 'old' ELSE 'new' END AS table_name, count(*) AS row_count, count(*) * 8192 AS size_bytes FROM orders GROUP BY 1",
    "a6_index_assembly": "SELECT l_orderkey AS index_name, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS columns, max(l_partkey % 2) = 0 AS is_unique, count(*) AS n_columns FROM lineitem GROUP BY 1",
    "a7_partition_listing": "SELECT l_returnflag AS table_name, strftime(l_shipdate, '%Y%m') AS partition_name, min(l_linenumber) AS ordinal FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2",
    "a8_topic_statistics": "SELECT topic, CAST(sum(CASE WHEN p <> 3 THEN latest - earliest ELSE 0 END) AS BIGINT) AS message_count, CAST(sum(CASE WHEN p <> 3 THEN latest - earliest ELSE 0 END) * 1024 AS BIGINT) AS size_estimate, count(*) AS partition_count FROM (SELECT event_type AS topic, user_id % 4 AS p, min(event_id) AS earliest, max(event_id) + 1 AS latest FROM events GROUP BY 1, 2) GROUP BY topic",
    "a20_counts_with_totals": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "a21_status_summary": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders",
    "a22_operation_counters": "SELECT event_type, CASE WHEN value > 50 THEN 'success' ELSE 'failure' END AS status, count(*) AS n FROM events GROUP BY 1, 2",
    "a23_duration_histogram": _HISTOGRAM,
    "a23_histogram_quantile": f"WITH h AS ({_HISTOGRAM}), r AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0.0) AS f, 0.95 * max(n) OVER (PARTITION BY event_type) AS t FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le ASC NULLS LAST)) SELECT event_type, round(CASE WHEN le IS NULL THEN f ELSE f + (le - f) * (t - below) / (n - below) END, 6) AS p95 FROM r WHERE n >= t AND below < t",
    "a24_result_summary": "SELECT user_id % 50 AS task, counter, CAST(sum(v) AS BIGINT) AS total FROM (SELECT user_id, unnest(['records', 'errors', 'warnings']) AS counter, unnest([event_id % 7, event_id % 2, event_id % 3]) AS v FROM events) GROUP BY ALL",
    "a25_batch_result": "SELECT count(*) AS total, count(*) FILTER (c_acctbal >= 0 OR c_acctbal IS NULL) AS success, count(*) FILTER (c_acctbal < 0) AS failed FROM customer",
    "a26_run_summary": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(DISTINCT o_custkey) AS tables, round(count(DISTINCT o_custkey) / count(*), 6) AS tables_per_second FROM orders GROUP BY 1",
    "a27_error_counts": "SELECT l_returnflag AS category, ['TIMEOUT', 'NETWORK_ERROR', 'AUTH_ERROR', 'DEADLINE_EXCEEDED', 'NOT_FOUND', 'RATE_LIMITED'][l_linenumber % 6 + 1] AS code, count(*) AS n, l_linenumber % 6 IN (0, 1, 3) AS retryable FROM lineitem GROUP BY l_returnflag, l_linenumber % 6",
    "a32_group_having": "SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS n_orders, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10",
    "a33_rollup": "SELECT CAST(y AS INTEGER) AS year, o_orderstatus, count(*) AS n, CAST(grouping_id(y, o_orderstatus) AS INTEGER) AS level FROM (SELECT year(o_orderdate) AS y, o_orderstatus FROM orders) GROUP BY ROLLUP (y, o_orderstatus)",
    "a34_bitmap_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY 1",
    "a35_sketch_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_distinct, true AS within FROM events GROUP BY 1",
    "a37_pivot": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, " + ", ".join(f"CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag = '{x}') AS DOUBLE) AS {x.lower()}" for x in "ANR") + " FROM lineitem GROUP BY 1",
    "a38_ordered_set_aggregates": "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY 1",
}
