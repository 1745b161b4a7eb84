"""Queries for stored catalogs, messages and dependencies, over rows of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import matching as M
from ..operators import profile as P
from ..sources import storage as S
from .common import table


def _folder(spark, name):
    return f"{S.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def j2(spark, sf):
    """Lines as columns of their order, which is a table of its customer's schema in the catalog of the nation."""
    catalogs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("catalog_id"), F.col("n_name").alias("catalog_name"))
    schemas = table(spark, sf, "customer").select(F.col("c_custkey").alias("schema_id"), F.col("c_nationkey").alias("catalog_id"), F.col("c_name").alias("schema_name"))
    tables = table(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("schema_id"), F.col("o_orderpriority").alias("table_name"))
    columns = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_partkey").alias("column_name"), F.col("l_linenumber").alias("ordinal_position"), F.col("l_returnflag").alias("data_type"))
    return C.column_view(catalogs, schemas, tables, columns).select("table_id", "catalog_name", "schema_name", "table_name", "column_name", "ordinal_position", "data_type")


def j6(spark, sf):
    """Indexes of a nation's orders by customer, each with its lines' parts as columns."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index_name"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 2).alias("non_unique"))
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("index_name"), F.col("o_custkey").alias("owner"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", F.lit("-"), F.col("l_suppkey").cast("string")).alias("column_name"))
    return P.assembled_indexes(C.index_columns(o, l))


def g11(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(
        k, F.element_at(F.array(*(F.lit(x) for x in ("workflow", "time", "time", "event"))), (k % 4 + 1).cast("int")).alias("type"), F.when(k % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("workflow_id"),
        F.when(k % 5 != 0, k % 27 - 1).alias("start_hour"), F.when(k % 5 != 0, k % 28).alias("end_hour"),
    )
    return M.dependency_errors(d).groupBy("type", "error").agg(F.count(F.lit(1)).alias("n"))


def s10(spark, sf):
    """Lines as an information schema's columns: every fifth order is a table of the system."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_returnflag").alias("f"))
    of = lambda *names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("p") % len(names) + 1).cast("int"))
    name = {"table_schema": F.when(F.col("l_orderkey") % 5 == 0, "sys").otherwise("shop"), "table_name": F.concat(F.lit("t"), F.col("l_orderkey").cast("string")), "column_name": F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))}
    rows = l.withColumns(name).withColumns({"ordinal_position": F.col("l_linenumber"), "data_type": of("int", "varchar(20)", "decimal(10,2)", "geometry"), "is_nullable": F.when(F.col("f") == "N", "NO").otherwise("YES"), "column_default": F.when(F.col("f") == "A", "0"), "extra": F.when(F.col("l_linenumber") == 1, "auto_increment"), "column_comment": F.lit(None).cast("string")})
    return C.snapshot_columns(rows, rows.filter("ordinal_position = 1"), "mysql")


def s11(spark, sf):
    """Orders as partitioned tables: lines are DESCRIBE rows, the fourth opens the partition columns; events of the day are partitions."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").dropDuplicates(["l_orderkey", "l_linenumber"])
    rows = l.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 4, "# Partition Information").otherwise(F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).alias("name"), F.lit("string").alias("type"), F.lit("").alias("comment"))
    parts = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, "junk").otherwise(F.concat(F.lit("dt="), F.date_format("l_shipdate", "yyyy-MM"))).alias("spec"))
    return C.described_table(rows, parts, "l_orderkey", "l_linenumber", "name", "type", "comment").groupBy("is_partition", "n_partitions").agg(F.count(F.lit(1)).alias("n"))


def s12(spark, sf):
    """Topics are kinds of events; those with clicks in their name have a registered schema."""
    topics = table(spark, sf, "events").select(F.col("event_type").alias("name"))
    return S.message_columns(topics, "topic", topics.filter("name LIKE '%click%'"))


def s13(spark, sf):
    return S.message_columns(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")), "queue")


def s14(spark, sf):
    """Tables by schema and name, stored twice: of equal names the last stays, and the second write adds and replaces."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("schema_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("updated_at"))
    path = _folder(spark, "catalog")
    C.stored({"tables": rows.filter("updated_at % 2 = 0"), "connectors": table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit(1).alias("updated_at"))}, path)
    return C.stored({"tables": rows.filter("updated_at % 2 = 1")}, path)["tables"]


def s15(spark, sf):
    l = table(spark, sf, "lineitem")
    edges = l.select(F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_suppkey").alias("source_node_id"), F.col("l_partkey").alias("target_node_id"), F.when(F.col("l_partkey") % 2 == 0, 0.5).alias("confidence"), F.lit(0).alias("updated_at"))
    return C.stored({"lineage_edges": edges}, _folder(spark, "lineage"))["lineage_edges"].select("id", "source_node_id", "target_node_id", F.col("confidence").cast("double").alias("confidence"))


def _columns(spark, sf):
    return table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, "").otherwise("DW").alias("database"), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("table"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("data_type"), (F.col("l_returnflag") == "N").alias("nullable"), (F.col("l_linenumber") == 1).alias("primary_key"), F.lit("x").alias("comment"))


def s18(spark, sf):
    """Schemas written as JSON and read again: one text for each table, lists for every other one."""
    text = S.schemas_to_json(_columns(spark, sf)).select(F.when(F.hash("table") % 2 == 0, F.concat(F.lit("["), "json", F.lit("]"))).otherwise(F.col("json")).alias("text"))
    return S.schemas_from_json(text, "text")


def t2(spark, sf):
    page, total, _ = M.listed(table(spark, sf, "customer"), ["c_name", "c_custkey"], None, 25, c_mktsegment="BUILDING")
    return page.select("c_custkey", "c_name")


def t5(spark, sf):
    """Databases, tables and columns in order of name, name and ordinal, numbered by table."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("database", "table").orderBy("ordinal"))
    return _columns(spark, sf).withColumn("place", place).orderBy("database", "table", "ordinal").select("database", "table", "name", "place")


def f5(spark, sf):
    searched = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 50000, "middle").otherwise("low")
    simple = F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END")
    return table(spark, sf, "orders").select("o_orderkey", searched.alias("searched"), simple.alias("simple"))


def s20(spark, sf):
    """Orders and lines in buckets by order: the join needs no shuffle."""
    name = f"heddlework_{uuid.uuid4().hex}"
    S.save_bucketed(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), f"{name}_o", 8, "o_orderkey")
    S.save_bucketed(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), f"{name}_l", 8, "o_orderkey")
    return spark.table(f"{name}_o").join(spark.table(f"{name}_l"), "o_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def s22(spark, sf):
    """A sample of a hundred events: how many there are, and how many of them are events of the table."""
    e = table(spark, sf, "events")
    s = S.sampled(e.withColumn("_id", F.col("event_id")), 100, seed=3)
    return s.join(e.select("event_id"), "event_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_known")).withColumn("has_id", F.lit("_id" in s.columns))


QUERIES = {
    "j2_column_view": j2, "j6_index_columns": j6, "g11_dependency_errors": g11, "s10_snapshot": s10, "s11_described_tables": s11, "s12_message_columns": s12, "s13_queue_columns": s13, "s14_catalog_sink": s14, "s15_lineage_sink": s15, "s18_catalog_json": s18, "t2_page": t2, "t5_listings": t5, "f5_case": f5, "s20_buckets": s20, "s22_document_sample": s22,
}

_C = "(SELECT CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'DW' END AS d, 'T' || l_orderkey AS t, l_linenumber AS ordinal, 'c' || l_linenumber AS name, l_returnflag AS data_type, l_returnflag = 'N' AS nullable, l_linenumber = 1 AS primary_key FROM lineitem)"
ORACLES = {
    "j2_column_view": "SELECT l_orderkey AS table_id, n_name AS catalog_name, c_name AS schema_name, o_orderpriority AS table_name, l_partkey AS column_name, l_linenumber AS ordinal_position, l_returnflag AS data_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "j6_index_columns": "SELECT o_orderkey AS index_name, string_agg(l_returnflag || '-' || l_suppkey, ',' ORDER BY l_linenumber, l_returnflag || '-' || l_suppkey) AS columns, o_orderkey % 2 = 0 AS is_unique, count(*) AS n_columns FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "g11_dependency_errors": """
WITH d AS (SELECT o_orderkey % 4 AS q, o_orderkey % 3 = 0 AS blank, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 27 - 1 END AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 28 END AS e FROM orders)
SELECT ['workflow', 'time', 'time', 'event'][q + 1] AS type, CASE q WHEN 0 THEN CASE WHEN blank THEN 'workflow dependency requires workflow_id' END WHEN 3 THEN 'unknown dependency type: event'
  ELSE CASE WHEN s IS NULL THEN 'time dependency requires time_window' WHEN s < 0 OR s > 23 THEN 'invalid start_hour: ' || s WHEN e > 24 THEN 'invalid end_hour: ' || e WHEN s >= e THEN 'start_hour must be less than end_hour' END END AS error, count(*) AS n FROM d GROUP BY 1, 2""",
    "s10_snapshot": """
SELECT 'shop' AS table_schema, 't' || l_orderkey AS table_name, 'c' || l_linenumber AS column_name, l_linenumber AS ordinal_position, ['INTEGER', 'STRING', 'DECIMAL', 'GEOMETRY'][k] AS data_type, ['int', 'varchar(20)', 'decimal(10,2)', 'geometry'][k] AS source_type, CASE k WHEN 2 THEN 20 END AS length, CASE k WHEN 3 THEN 10 END AS precision, CASE k WHEN 3 THEN 2 END AS scale,
  f <> 'N' AS is_nullable, CASE f WHEN 'A' THEN '0' END AS default_value, l_linenumber = 1 AS is_auto_increment, l_linenumber = 1 AS is_primary_key, '' AS comment
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) % 4 + 1 AS k, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) WHERE l_orderkey % 5 <> 0""",
    "s11_described_tables": "WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS i FROM lineitem), p AS (SELECT l_orderkey AS o, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1) SELECT i > 4 AND EXISTS (SELECT 1 FROM r x WHERE x.o = r.o AND x.i = 4) AS is_partition, coalesce(p.n, 0) AS n_partitions, count(*) AS n FROM r LEFT JOIN p ON p.o = r.o WHERE i <> 4 GROUP BY 1, 2",
    "s12_message_columns": "SELECT name, CAST(i AS INTEGER) AS ordinal_position, ['key', 'value', 'timestamp', 'partition', 'offset'][i] AS column_name, ['bytes', 'bytes', 'timestamp', 'int', 'long'][i] AS data_type, ['bytes', 'bytes', 'timestamp', 'int32', 'int64'][i] AS source_type, i < 3 AS nullable, ['Message key', 'Message value', 'Message timestamp', 'Partition number', 'Message offset'][i] AS comment FROM (SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT LIKE '%click%'), (SELECT unnest(range(1, 6)) AS i)",
    "s13_queue_columns": "SELECT name, CAST(i AS INTEGER) AS ordinal_position, ['routing_key', 'payload', 'properties', 'timestamp', 'exchange'][i] AS column_name, ['string', 'bytes', 'object', 'timestamp', 'string'][i] AS data_type, ['string', 'bytes', 'object', 'timestamp', 'string'][i] AS source_type, true AS nullable, ['Message routing key', 'Message payload', 'Message properties', 'Message timestamp', 'Source exchange'][i] AS comment FROM (SELECT DISTINCT c_mktsegment AS name FROM customer), (SELECT unnest(range(1, 6)) AS i)",
    "s14_catalog_sink": "SELECT o_custkey AS schema_id, o_orderpriority AS name, coalesce(max(o_orderkey) FILTER (o_orderkey % 2 = 1), max(o_orderkey)) AS updated_at FROM orders GROUP BY 1, 2",
    "s15_lineage_sink": "SELECT DISTINCT l_suppkey || '-' || l_partkey AS id, l_suppkey AS source_node_id, l_partkey AS target_node_id, CASE WHEN l_partkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM lineitem",
    "s18_catalog_json": f"SELECT CASE d WHEN '' THEN 'default' ELSE 'dw' END AS database, lower(t) AS table, CAST(row_number() OVER (PARTITION BY t ORDER BY ordinal, name, data_type, nullable) AS INTEGER) AS ordinal, name, data_type, nullable, primary_key, 'x' AS comment FROM {_C}",
    "t2_page": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name, c_custkey LIMIT 25",
    "t5_listings": f"SELECT d AS database, t AS table, name, CAST(row_number() OVER (PARTITION BY d, t ORDER BY ordinal, name) AS INTEGER) AS place FROM {_C}",
    "f5_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS searched, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS simple FROM orders",
    "s20_buckets": "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "s22_document_sample": "SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_known, false AS has_id FROM events",
}
