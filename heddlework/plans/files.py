"""Queries that write rows of the tables to files in the shared folder and read them back, and collection runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import collection as C
from ..operators import inference as I
from ..sources import storage as S
from .common import table


def _folder(spark) -> str:
    return f"{S.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def s1(spark, sf):
    path = _folder(spark)
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.csv(path, header=True)
    return I.inferred_text(S.csv_text(spark, path))


def s1_skip(spark, sf):
    path = _folder(spark)
    rows = table(spark, sf, "nation").select(F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    rows.coalesce(1).write.text(path)
    return S.csv_text(spark, path, sep=";", header=False, skip_rows=3).agg(F.count(F.lit(1)).alias("n"))


def s2(spark, sf):
    path = _folder(spark)
    table(spark, sf, "customer").select("c_custkey", "c_name").write.json(path)
    return S.json_documents(spark, path, lines=True).select(F.get_json_object("doc", "$.c_custkey").cast("long").alias("c_custkey"), F.get_json_object("doc", "$.c_name").alias("c_name"))


def s3(spark, sf):
    return S.parquet_columns(spark, f"{sf}/orders.parquet").select("ordinal", "name", "data_type")


def s6(spark, sf):
    return S.object_listing(spark, sf).select(F.element_at(F.split("object_name", "/"), -1).alias("object_name"), "size")


def s16(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    return S.exported(r, "json").withColumn("form", F.lit("json")).unionByName(S.exported(r, "csv").withColumn("form", F.lit("csv")))


def s17(spark, sf):
    line = F.when(F.col("c_custkey") % 7 == 0, "{oops").when(F.col("c_custkey") % 5 == 0, '{"name": "x"}').otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    good, bad = S.imported(table(spark, sf, "customer").select(line.alias("line")), "line", "id long, name string", ["id"])
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select("error").withColumnRenamed("error", "kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def s19(spark, sf):
    path = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    S.overwrite_partitions(o, path, "o_orderstatus")
    S.overwrite_partitions(o.filter("o_orderstatus = 'F' AND o_orderkey % 2 = 0"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def s21(spark, sf):
    """A sample of about a tenth of the rows: the feature is the sample."""
    return table(spark, sf, "orders").sample(0.1, seed=3).select("o_orderkey")


def s21_bounds(spark, sf):
    """Samples by share, by rows and by bucket: whether their sizes are what was asked for, and all their rows are the table's."""
    o = table(spark, sf, "orders").select("o_orderkey")
    o.createOrReplaceTempView("heddlework_sampled")
    total = o.agg(F.count(F.lit(1)).alias("n"))
    sizes = None
    for how, low, high in (("10 PERCENT", 0.05, 0.15), ("BUCKET 1 OUT OF 4", 0.2, 0.3)):
        rows = spark.sql(f"SELECT o_orderkey FROM heddlework_sampled TABLESAMPLE ({how}) REPEATABLE (3)")
        hit = rows.join(o.withColumn("known", F.lit(True)), "o_orderkey", "left").agg(F.count(F.lit(1)).alias("k"), F.count("known").alias("known"))
        one = hit.crossJoin(total).select(F.lit(how).alias("how"), F.col("k").between(F.col("n") * low, F.col("n") * high).alias("within"), (F.col("k") == F.col("known")).alias("known"))  # one row each
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes


def s23(spark, sf):
    t = {n: table(spark, sf, n) for n in ("customer", "orders", "nation", "supplier")}
    run = C.collected(t, "full", exclude=["supp*"])
    return C.execution(*run)


def s23_incremental(spark, sf):
    t = {n: table(spark, sf, n) for n in ("customer", "events")}
    return C.collected(t, "incremental", since={"events": ("event_id", 100), "customer": ("c_custkey", 50)})[1].select("table_name", "row_count")


QUERIES = {"s1_csv": s1, "s1_csv_skip": s1_skip, "s2_json": s2, "s3_parquet_columns": s3, "s6_listing": s6, "s16_export": s16, "s17_import": s17, "s19_partition_overwrite": s19, "s21_sample": s21, "s21_bounds": s21_bounds, "s23_collection": s23, "s23_incremental": s23_incremental}
ORACLES = {
    "s21_bounds": "SELECT unnest(['10 PERCENT', 'BUCKET 1 OUT OF 4']) AS how, true AS within, true AS known",
    "s1_csv": "SELECT i AS ordinal, ['s_suppkey', 's_name', 's_nationkey'][i] AS path, ['integer', 'string', 'integer'][i] AS data_type, ['BIGINT', 'TEXT', 'BIGINT'][i] AS sql_type, false AS nullable, (SELECT count(*) FROM supplier) AS n FROM (SELECT unnest([1, 2, 3]) AS i)",
    "s1_csv_skip": "SELECT count(*) - 3 AS n FROM nation",
    "s2_json": "SELECT c_custkey, c_name FROM customer",
    "s3_parquet_columns": "SELECT i AS ordinal, ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'][i] AS name, ['bigint', 'bigint', 'string', 'double', 'timestamp_ntz', 'string'][i] AS data_type FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)",
    "s16_export": """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS text, 'json' AS form FROM region UNION ALL SELECT r_regionkey || ',' || r_name, 'csv' FROM region""",
    "s17_import": "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'malformed' WHEN c_custkey % 5 = 0 THEN 'missing id' ELSE 'good' END AS kind, count(*) AS n FROM customer GROUP BY 1",
    "s19_partition_overwrite": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1",
    "s23_collection": "SELECT CAST(3 AS BIGINT) AS tables, CAST(14 AS BIGINT) AS columns, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) AS records, CAST(0 AS BIGINT) AS errors",
    "s23_incremental": "SELECT 'customer' AS table_name, count(*) AS row_count FROM customer WHERE c_custkey > 50 UNION ALL SELECT 'events', count(*) FROM events WHERE event_id > 100",
}
