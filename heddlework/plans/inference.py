"""Queries for schema inference over documents, text, keys and object names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import file_format
from ..operators import inference as I
from .common import table


def _documents(spark, sf):
    """Orders as nested JSON with a field that is at times null, one of two kinds, and an array."""
    o = table(spark, sf, "orders")
    mixed = F.when(F.col("o_orderkey") % 4 == 0, F.to_json(F.struct(F.col("o_custkey").alias("x")))).otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("x"))))
    inner = F.concat(F.lit('{"id":'), F.col("o_custkey").cast("string"), F.lit(',"tag":'), F.when(F.col("o_orderkey") % 3 == 0, "null").otherwise('"t"'), F.lit("}"))
    return o.select("o_orderkey", F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit(',"customer":'), inner, F.lit(',"mixed":'), F.regexp_extract(mixed, r"^\{\"x\":(.*)\}$", 1), F.lit(',"list":[1,2]'), F.when(F.col("o_orderkey") % 2 == 0, ',"even":true').otherwise(""), F.lit("}")).alias("doc"))


def a9(spark, sf):
    return I.inferred_documents(_documents(spark, sf), "doc", "o_orderkey")


def a9_events(spark, sf):
    return I.inferred_documents(table(spark, sf, "events"), "props", "event_id")


def a10(spark, sf):
    return I.merged_types(I.document_values(_documents(spark, sf), "doc", "o_orderkey"), "union")


def a12(spark, sf):
    s = table(spark, sf, "supplier")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", (F.col("s_nationkey") % 2).cast("string"), F.when(F.col("s_suppkey") % 5 == 0, "NA").otherwise(F.format_string("%.2f", "s_acctbal")), F.lit("x"))
    return I.inferred_text(I.delimited(s.select(line.alias("line")), "line", ["key", "name", "flag", "balance", "rest"]))


def _keys(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.element_at(F.array(F.lit("user:"), F.lit("session-"), F.lit("cache/item/")), (F.col("event_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(":"), "event_type")).otherwise("")).alias("key"))


def a13(spark, sf):
    return I.key_patterns(_keys(spark, sf), "key", I.key_pattern(F.col("key")))


def a14(spark, sf):
    k = table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.concat(F.lit("abc"), (F.col("event_id") % 900 + 100).cast("string"))).alias("key"))
    return I.key_patterns(k, "key", I.store_key_pattern(F.col("key")), 10).drop("samples")


def a15(spark, sf):
    return _keys(spark, sf).select(F.when(F.col("key").startswith("user"), "string").when(F.col("key").startswith("session"), "hash").otherwise("list").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def a17(spark, sf):
    return I.pattern_columns(a13(spark, sf))


def a18(spark, sf):
    return I.subjects(table(spark, sf, "part").select(F.concat("p_brand", F.element_at(F.array(F.lit("-key"), F.lit("-value"), F.lit("")), (F.col("p_size") % 3 + 1).cast("int"))).alias("subject")), "subject")


def _versions(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", None).otherwise(F.when(F.col("o_orderstatus") == "O", "JSON").otherwise("PROTOBUF")).alias("type"))


def w2(spark, sf):
    """The latest version of each subject; a missing type is AVRO."""
    return _versions(spark, sf).groupBy("subject").agg(F.max("version").alias("version"), F.coalesce(F.max_by(F.struct("type"), "version")["type"], F.lit("AVRO")).alias("type"))


def a19(spark, sf):
    n = _versions(spark, sf).agg(F.count(F.lit(1)).alias("n_versions"))
    return w2(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n_subjects")).crossJoin(F.broadcast(n))  # one row


def _objects(spark, sf):
    p = table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return p.select(F.concat(path, F.element_at(F.array(F.lit(".csv"), F.lit(".JSON"), F.lit(".bin")), (F.col("page_id") % 3 + 1).cast("int"))).alias("key"), F.length("html").cast("long").alias("size"))


def s5(spark, sf):
    o = _objects(spark, sf).withColumns({"prefix": F.substring_index("key", "/", 1), "format": file_format(F.col("key"))})
    return I.first_structured(o, "key", "prefix", "format").select("prefix", "key", "format")


def s7(spark, sf):
    return I.prefixes(_objects(spark, sf), "key")


def s9(spark, sf):
    o = _objects(spark, sf).select(F.concat(F.lit("web/"), "key").alias("key"))
    return I.prefix_partitions(o, "key", "web")


def f8(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("v"))


def f9(spark, sf):
    s = F.concat(F.lit('{"type":"record","name":"r","fields":[{"name":"id","type":"long"},{"name":"'), "n_name", F.lit('","type":["null","string"]},{"name":"tags","type":{"type":"array","items":"string"}}]}'))
    return I.avro_fields(table(spark, sf, "nation").select("n_nationkey", s.alias("schema")), "schema", "n_nationkey")


def f10(spark, sf):
    s = F.concat(F.lit('{"properties":{"id":{"type":"keyword"},"body":{},"'), "n_name", F.lit('":{"properties":{"a":{"type":"date"},"b":{"type":"nested","properties":{"c":{"type":"long"}}}}}}}'))
    return I.mapping_columns(table(spark, sf, "nation").select("n_nationkey", s.alias("mapping")), "mapping", "n_nationkey")


def f11(spark, sf):
    s = F.concat(F.lit("# Keyspace\r\ndb"), F.col("n_regionkey").cast("string"), F.lit(":keys="), F.col("n_nationkey").cast("string"), F.lit(",expires=3,avg_ttl=0\r\nused_memory:"), F.col("n_nationkey").cast("string"))
    return I.keyspace(table(spark, sf, "nation").select("n_nationkey", s.alias("info")), "info", "n_nationkey")


def f13(spark, sf):
    s = F.concat(F.lit('{"index":{"number_of_shards":"'), F.col("n_regionkey").cast("string"), F.lit('","codec":"'), "n_name", F.lit('"}}'))
    return I.selected_settings(table(spark, sf, "nation").select("n_nationkey", s.alias("settings")), "settings", "n_nationkey", {"shards": "$.index.number_of_shards", "codec": "$.index.codec", "none": "$.index.none"})


QUERIES = {
    "a9_document_inference": a9, "a9_event_properties": a9_events, "a10_type_union": a10, "a12_text_inference": a12, "a13_key_patterns": a13, "a14_store_key_patterns": a14, "a15_key_types": a15, "a17_pattern_columns": a17, "a18_subjects": a18, "a19_registry_metrics": a19,
    "w2_latest_version": w2, "s5_first_structured": s5, "s7_prefixes": s7, "s9_prefix_partitions": s9, "f8_json_extract": f8, "f9_avro_fields": f9, "f10_mapping_columns": f10, "f11_keyspace": f11, "f13_settings": f13,
}

_FIELDS = """(
  SELECT 'key' AS path, 'integer' AS kind FROM orders UNION ALL SELECT 'customer', 'object' FROM orders UNION ALL SELECT 'customer.id', 'integer' FROM orders
  UNION ALL SELECT 'customer.tag', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE 'string' END FROM orders UNION ALL SELECT 'mixed', CASE WHEN o_orderkey % 4 = 0 THEN 'integer' ELSE 'string' END FROM orders
  UNION ALL SELECT 'list', 'array' FROM orders UNION ALL SELECT 'even', 'boolean' FROM orders WHERE o_orderkey % 2 = 0)"""
_SQL = "CASE data_type WHEN 'boolean' THEN 'BOOLEAN' WHEN 'integer' THEN 'BIGINT' WHEN 'number' THEN 'DOUBLE' WHEN 'array' THEN 'JSON' WHEN 'object' THEN 'JSON' ELSE 'TEXT' END"


def _inferred(fields: str, docs: str) -> str:
    return f"""
WITH c AS (SELECT path, kind, count(*) AS n FROM {fields} GROUP BY 1, 2),
t AS (SELECT path, (list(kind ORDER BY n DESC, kind))[1] AS data_type, sum(n) AS n, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS kinds, coalesce(sum(n) FILTER (kind <> 'null'), 0) AS n_some FROM c GROUP BY path)
SELECT path, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS ordinal, data_type, {_SQL} AS sql_type, n_some < (SELECT count(*) FROM {docs}) AS nullable, round(n * 100.0 / (SELECT count(*) FROM {docs}), 4) AS coverage, kinds FROM t"""


_K = "(SELECT event_id, event_id % 3 AS m, ['user:', 'session-', 'cache/item/'][event_id % 3 + 1] || user_id || CASE WHEN event_id % 3 = 0 THEN ':' || event_type ELSE '' END AS key, CASE event_id % 3 WHEN 0 THEN 'user:*:' || event_type WHEN 1 THEN 'session-*' ELSE 'cache/item/*' END AS pattern FROM events)"
_PATTERNS = f"SELECT CAST(row_number() OVER w AS INTEGER) AS place, pattern, n, round(sum(n) OVER w * 100.0 / sum(n) OVER (), 4) AS coverage, samples FROM (SELECT pattern, count(*) AS n, array_to_string((list(DISTINCT key ORDER BY key))[1:5], ',') AS samples FROM {_K} GROUP BY 1) WINDOW w AS (ORDER BY n DESC, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LATEST = "(SELECT o_custkey AS subject, max(o_orderkey) AS version, coalesce(arg_max(CASE o_orderstatus WHEN 'O' THEN 'JSON' WHEN 'P' THEN 'PROTOBUF' ELSE 'AVRO' END, o_orderkey)) AS type FROM orders GROUP BY 1)"
_O = "(SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || ['.csv', '.JSON', '.bin'][page_id % 3 + 1] AS key, page_id % 3 AS m, length(html) AS size FROM pages)"

ORACLES = {
    "a9_document_inference": _inferred(_FIELDS, "orders"),
    "a9_event_properties": _inferred("(SELECT 'k' AS path, 'integer' AS kind FROM events WHERE props IS NOT NULL)", "events"),
    "a10_type_union": f"SELECT path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS data_type, count(*) AS n FROM {_FIELDS} GROUP BY 1",
    "a12_text_inference": f"""
WITH v AS (SELECT 1 AS ordinal, 'key' AS path, CAST(s_suppkey AS VARCHAR) AS v FROM supplier UNION ALL SELECT 2, 'name', s_name FROM supplier UNION ALL SELECT 3, 'flag', CAST(s_nationkey % 2 AS VARCHAR) FROM supplier
  UNION ALL SELECT 4, 'balance', CASE WHEN s_suppkey % 5 = 0 THEN 'NA' ELSE printf('%.2f', s_acctbal) END FROM supplier UNION ALL SELECT 5, 'rest', 'x' FROM supplier),
k AS (SELECT ordinal, path, CASE WHEN lower(v) IN ('', 'null', 'na') THEN 'null' WHEN lower(v) IN ('true', 'false', 'yes', 'no', '1', '0') THEN 'boolean' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS kind FROM v),
t AS (SELECT ordinal, path, (list(kind ORDER BY n DESC, kind))[1] AS data_type, sum(n) AS n, bool_or(kind = 'null') AS nullable FROM (SELECT ordinal, path, kind, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1, 2)
SELECT CAST(ordinal AS INTEGER) AS ordinal, path, data_type, {_SQL} AS sql_type, nullable, CAST(n AS BIGINT) AS n FROM t""",
    "a13_key_patterns": _PATTERNS,
    "a14_store_key_patterns": "SELECT CAST(row_number() OVER w AS INTEGER) AS place, pattern, n, round(sum(n) OVER w * 100.0 / sum(n) OVER (), 4) AS coverage FROM (SELECT event_type || ':*:*' AS pattern, count(*) AS n FROM events GROUP BY 1) WINDOW w AS (ORDER BY n DESC, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "a15_key_types": "SELECT ['string', 'hash', 'list'][event_id % 3 + 1] AS type, count(*) AS n FROM events GROUP BY 1",
    "a17_pattern_columns": f"SELECT 'pattern_' || place AS column_name, 'TEXT' AS data_type, 'Pattern: ' || pattern || ', count: ' || n AS comment FROM ({_PATTERNS})",
    "a18_subjects": "SELECT p_brand AS topic, string_agg(DISTINCT ['key', 'value', 'unknown'][p_size % 3 + 1], ',' ORDER BY ['key', 'value', 'unknown'][p_size % 3 + 1]) AS parts FROM part GROUP BY 1",
    "w2_latest_version": f"SELECT * FROM {_LATEST}",
    "a19_registry_metrics": f"SELECT type, count(*) AS n_subjects, (SELECT count(*) FROM orders) AS n_versions FROM {_LATEST} GROUP BY 1",
    "s5_first_structured": f"SELECT prefix, min(key) AS key, arg_min(f, key) AS format FROM (SELECT split_part(key, '/', 1) AS prefix, key, CASE m WHEN 0 THEN 'csv' WHEN 1 THEN 'json' END AS f FROM {_O}) WHERE f IS NOT NULL GROUP BY 1",
    "s7_prefixes": f"SELECT split_part(key, '/', 1) AS prefix, count(*) AS n_objects, CAST(sum(size) AS BIGINT) AS size_bytes FROM {_O} GROUP BY 1",
    "s9_prefix_partitions": f"SELECT 'prefix-' || (row_number() OVER (ORDER BY prefix) - 1) AS name, 'prefix = ''web/' || prefix || '/''' AS expression, n_objects FROM (SELECT split_part(key, '/', 1) AS prefix, count(*) AS n_objects FROM {_O} GROUP BY 1)",
    "f8_json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events",
    "f9_avro_fields": "SELECT n_nationkey, CAST(i AS INTEGER) AS ordinal, [ 'id', n_name, 'tags'][i + 1] AS name, ['long', 'string', 'array'][i + 1] AS type, i = 1 AS nullable FROM nation, (SELECT unnest([0, 1, 2]) AS i)",
    "f10_mapping_columns": "SELECT n_nationkey, [ 'id', 'body', n_name, n_name || '.a', n_name || '.b', n_name || '.b.c'][i] AS path, ['keyword', 'text', 'object', 'date', 'nested', 'long'][i] AS type FROM nation, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)",
    "f11_keyspace": "SELECT n_nationkey, CAST(n_regionkey AS INTEGER) AS db, CAST(n_nationkey AS BIGINT) AS keys, CAST(3 AS BIGINT) AS expires FROM nation",
    "f13_settings": "SELECT n_nationkey, 'shards' AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 'codec', n_name FROM nation",
}
