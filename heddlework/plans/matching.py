"""Queries for filters, names, types, validation and access rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import types as Y
from ..operators import matching as M
from ..operators import search as R
from ..sources.storage import shared_folder
from .common import table


def p1(spark, sf):
    return M.filtered(table(spark, sf, "part"), "p_name", {"include": ["*a[a-m]*", "?o*"], "exclude": [], "kind": "glob"}).select("p_partkey", "p_name")


def p2(spark, sf):
    return table(spark, sf, "part").filter(X.matches_regex(F.col("p_type"), "brass|^promo", case_sensitive=False)).select("p_partkey", "p_type")


def p3(spark, sf):
    return M.filtered(table(spark, sf, "part"), "p_brand", {"include": ["Brand#[1-3]?"], "exclude": ["*#1[2-4]", "Brand#22"]}).select("p_partkey", "p_brand")


def p3_table(spark, sf):
    n = table(spark, sf, "nation")
    rules = n.filter("n_nationkey % 5 = 0").select(F.concat(F.right("n_name", F.lit(1)), F.lit("$")).alias("pattern"), (F.col("n_nationkey") % 10 == 0).alias("exclude"))
    return M.filtered_by_table(n, "n_name", rules).select("n_nationkey", "n_name")


def p4(spark, sf):
    return M.filtered(table(spark, sf, "customer"), "c_name", {"include": ["Customer*"], "exclude": ["*7"]}, {"include": ["[0-4]$"], "exclude": [], "kind": "regex"}).select("c_custkey", "c_name")


def _keys(spark, sf):
    return table(spark, sf, "events").select("event_id", F.concat_ws(":", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("key"))


def p5(spark, sf):
    return _keys(spark, sf).filter(X.matches_glob(F.col("key"), "user:1*:cl?ck")).agg(F.count(F.lit(1)).alias("n"))


#: Databases, schemas and users as sources list them, some of the system's own among them.
LISTED = {
    "mysql": ["mysql", "shop", "sys", "information_schema", "Sys"],
    "postgres": ["public", "pg_catalog", "pg_temp_3", "pg_toast_temp_1", "pgbench"],
    "oracle": ["XDB", "HR", "XS$NULL", "PUBLIC", "sys"],
    "sqlserver": ["dbo", "guest", "sys", "INFORMATION_SCHEMA", "sales"],
    "clickhouse": ["default", "system", "INFORMATION_SCHEMA", "systems", "logs"],
}


def _of(names, i):
    return F.element_at(F.array(*(F.lit(x) for x in names)), (i % len(names) + 1).cast("int"))


def p6(spark, sf):
    c = table(spark, sf, "customer")
    listed = None
    for dialect, names in LISTED.items():
        own = c.select("c_custkey", F.lit(dialect).alias("dialect"), _of(names, F.col("c_custkey")).alias("name"))
        own = own.filter(~Y.is_system(F.col("name"), dialect))
        listed = own if listed is None else listed.unionByName(own)
    return listed


def p6_engines(spark, sf):
    engine = _of(["MergeTree", "View", "MaterializedView", "Dictionary", "Log"], F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", engine.alias("engine")).filter(Y.is_table_engine(F.col("engine"), "clickhouse"))


#: Types as each dialect spells them.
SPELLED = {
    "mysql": ["int", "TINYINT", "double", "decimal", "varchar", "longtext", "date", "datetime", "blob", "bit", "enum", "json"],
    "postgres": ["int4", "bigint", "double precision", "numeric", "character varying", "text", "time with time zone", "timestamp without time zone", "bytea", "jsonb", "uuid", "money"],
    "hive": ["tinyint", "bigint", "double precision", "decimal(10,2)", "varchar(20)", "array<int>", "map<string,int>", "struct<a:int>", "uniontype<int,string>", "timestamp with local time zone", "interval_day_time", "BINARY"],
    "clickhouse": ["Int8", "Nullable(Int32)", "UInt64", "Float32", "Nullable(Decimal(10, 2))", "FixedString(16)", "DateTime64(3)", "Date", "Array(String)", "Map(String, Int8)", "Enum8('a'=1)", "Nullable(Bool)"],
    "doris": ["tinyint", "smallint", "INT", "largeint", "float", "decimalv3(9,2)", "varchar(20)", "text", "datetimev2", "boolean", "map<int,int>", "bitmap"],
    "sqlserver": ["nvarchar", "INT", "money", "real", "bit", "datetime2", "image", "uniqueidentifier", "xml", "geography", "date", "numeric"],
    "elasticsearch": ["keyword", "long", "integer", "short", "byte", "half_float", "scaled_float", "date", "nested", "geo_shape", "ip", "flattened"],
    "avro": ["null", "long", "bytes", "com.acme.Money", '["null", "long"]', '{"type": "record", "name": "r"}', '{"type": "enum"}', '["null", {"type": "array", "items": "int"}]', '{"type": "map"}', '{"type": "fixed"}', '{"name": 1}', '["null"]'],
}


def _types(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *(_of(names, F.col("p_partkey")).alias(d) for d, names in SPELLED.items()))


def p7(spark, sf):
    return _types(spark, sf).select("p_partkey", *(Y.canonical(d, F.col(d)).alias(d) for d in SPELLED))


def p8(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", _of(["varchar(20)", "decimal(10,2)", "int", "character varying(7)", "DECIMAL(9, 0)", "numeric(5)", "char(3)", "text"], F.col("p_partkey")).alias("t"))
    a, b, c = Y.type_parameters(F.col("t"))
    return t.select("p_partkey", a.alias("length"), b.alias("precision"), c.alias("scale"))


def p9(spark, sf):
    kind = _of(["BASE TABLE", "view", "MATERIALIZED VIEW", "foreign table", "SEQUENCE", "EXTERNAL_TABLE", "VIRTUAL_VIEW", "SYSTEM VIEW", "MANAGED_TABLE"], F.col("o_orderkey"))
    return table(spark, sf, "orders").select(kind.alias("kind"), *(Y.table_type(kind, d).alias(d) for d in Y.TABLE_TYPES)).groupBy("kind", *Y.TABLE_TYPES).agg(F.count(F.lit(1)).alias("n"))


def p10(spark, sf):
    cls = F.concat(F.lit("org.apache.hadoop."), _of(["hive.ql.io.orc.OrcInputFormat", "hive.ql.io.parquet.MapredParquetInputFormat", "mapred.TextInputFormat", "mapred.SequenceFileInputFormat", "hive.ql.io.RCFileInputFormat", "hive.ql.io.avro.AvroContainerInputFormat", "json.JsonInput", "Other"], F.col("p_partkey")))
    return table(spark, sf, "part").select(Y.storage_format(cls).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def p11(spark, sf):
    spec = F.concat(F.lit("dt="), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/status="), "o_orderstatus", F.lit("/junk"))
    m = X.partition_values(spec)
    return table(spark, sf, "orders").select("o_orderkey", m["dt"].alias("dt"), m["status"].alias("status"), F.size(m).alias("n"))


def p13(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "YES").otherwise("NO").alias("is_nullable"), F.when(F.col("p_size") % 4 == 0, "auto_increment").otherwise("").alias("extra"))
    return p.select("p_partkey", (F.upper("is_nullable") == "YES").alias("nullable"), F.lower("extra").contains("auto_increment").alias("auto_increment"))


def p14(spark, sf):
    kind = _of(["mysql", "starrocks", "mongodb", "etcd", "rocketmq", "s3", "oss", "Hive", "other"], F.col("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", Y.category(kind).alias("category"))
    return c.withColumn("valid", Y.is_category(F.col("category")))


def _requests(spark, sf):
    e = table(spark, sf, "events")
    path = F.when(F.col("event_type") == "click", F.concat(F.lit("/api/v1/tasks/"), F.col("user_id").cast("string"), F.lit("/start"))).when(F.col("event_type") == "view", F.concat(F.lit("/api/v1/tasks/"), F.col("user_id").cast("string"))).otherwise(F.lit("/api/v1/health"))
    return e.select("event_id", "user_id", "ts", "event_type", path.alias("path"), F.when(F.col("user_id") % 3 == 0, "admin").when(F.col("user_id") % 3 == 1, "operator").otherwise("viewer").alias("role"))


def _templates(spark, sf):
    """Rules derived from the regions, as a service would land them."""
    r = table(spark, sf, "region")
    return r.filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "/api/v1/tasks/*/start").otherwise("/api/v1/tasks/*").alias("template"), F.when(F.col("r_regionkey") == 0, "task:start").otherwise("task:read").alias("permission"))


def p15(spark, sf):
    return M.with_template(_requests(spark, sf), _templates(spark, sf)).groupBy("event_type", "template").agg(F.count(F.lit(1)).alias("n"))


def p16(spark, sf):
    roles = _templates(spark, sf).select(F.when(F.col("permission") == "task:start", "operator").otherwise("viewer").alias("role"), "permission")
    return M.access_decisions(_requests(spark, sf), _templates(spark, sf), roles).groupBy("role", "permission", "allowed").agg(F.count(F.lit(1)).alias("n"))


def p17(spark, sf):
    return _requests(spark, sf).select(X.normal_path(F.col("path")).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def p18(spark, sf):
    c = M.validated(table(spark, sf, "customer"), [("c_name", F.length("c_name") > 0, "is required"), ("c_acctbal", F.col("c_acctbal") >= 0, "must not be negative"), ("c_mktsegment", F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), "is not supported")])
    return c.select("c_custkey", F.size("errors").alias("n_errors"), F.array_join(F.transform("errors", lambda x: F.concat(x["field"], F.lit(": "), x["message"])), "; ").alias("errors"))


def p19(spark, sf):
    """Documents in JSON of depth 1 to 20 around secrets, some in lists, with one key in three written with an escape."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 20).cast("int").alias("depth"), (F.col("doc_id") % 2 == 0).alias("listed"), (F.col("doc_id") % 3 == 0).alias("escaped"), "lang", "text")
    quoted = F.col("text")
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(written))
    secret = F.concat(F.when(F.col("escaped"), '{"pass\\u0077ord": ').otherwise('{"password": '), F.lit('{"a": [{"b": "}"}, 5]}, "k": "'), quoted, F.lit('", "token": "'), F.col("lang"), F.lit('"}'))
    opening, closing = F.when(F.col("listed"), '{"a": [').otherwise('{"a": '), F.when(F.col("listed"), ', 1]}').otherwise("}")
    return d.select("doc_id", X.redacted_json(F.concat(F.repeat(opening, F.col("depth")), secret, F.repeat(closing, F.col("depth")))).alias("details"))


def p19_map(spark, sf):
    m = F.create_map(F.lit("access_key"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("credentials"), "c_name", F.lit("refresh_token"), "c_name")
    r = X.redacted_map(m)
    return table(spark, sf, "customer").select("c_custkey", *(r[k].alias(k) for k in ("access_key", "segment", "credentials", "refresh_token")))


def p20(spark, sf):
    m = X.masked_config(F.create_map(F.lit("password"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")), F.lit("access_key"), "c_name", F.lit("secret_key"), "c_name", F.lit("token"), "c_name", F.lit("host"), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", *(m[k].alias(k) for k in ("password", "access_key", "secret_key", "token", "host")), X.masked(F.col("c_name"), 3).alias("name"))


def p21(spark, sf):
    action = _of(["login_failed", "task_delete", "config_change", "login", "password_change", "datasource_delete", "template_delete", "token_refresh"], F.col("event_id"))
    return table(spark, sf, "events").select(action.alias("action")).withColumn("severity", X.severity(F.col("action"))).groupBy("action", "severity").agg(F.count(F.lit(1)).alias("n"))


def p22(spark, sf):
    page, _, _ = M.listed(table(spark, sf, "orders"), ["o_orderkey"], None, 50, o_orderstatus="F", o_orderpriority="")
    return page.select("o_orderkey", "o_orderstatus")


def p23(spark, sf):
    return R.search(spark, _index(spark, sf), ["the", "license", "idiot"]).select(F.col("key").alias("doc_id"), F.col("n_terms").cast("int").alias("score"))


def _index(spark, sf):
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    R.write_index(table(spark, sf, "documents"), "doc_id", ["text"], path)
    return path


def p23_ranked(spark, sf):
    return R.search(spark, _index(spark, sf), ["the", "license", "idiot"]).select(F.col("key").alias("doc_id"), "n_terms", F.round("score", 6).alias("score"))


def p23_phrase(spark, sf):
    return R.phrase(spark, _index(spark, sf), ["of", "the"]).select(F.col("key").alias("doc_id"), "n")


def p24(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_totalprice").between(1000, 200000) & (F.col("o_orderstatus").isin("F", "O") | F.col("o_orderpriority").ilike("%urgent%")) & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_totalprice")


def p24_quantified(spark, sf):
    """At least one line above 45 pieces (ANY), and none without discount (ALL)."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    some = o.join(l.filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return some.join(l.filter("l_discount = 0"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def p25(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).distinct()


def p26(spark, sf):
    new, _ = M.past(table(spark, sf, "events").withColumn("event_id", F.col("event_id")), "event_id", 500)
    return new.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_value"))


def p27(spark, sf):
    """Executions as log lines: a start, an end if there is one, and an error if it failed."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    line = lambda level, text: F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))
    lines = F.filter(F.array(line("INFO", "started"), F.when(F.col("o_orderstatus") != "P", line("INFO", "ended")), F.when(F.col("o_orderstatus") == "O", line("ERROR", "failed"))), lambda x: x.isNotNull())
    return o.select("o_orderkey", F.posexplode(lines).alias("line", "x")).select("o_orderkey", "line", "x.level", "x.message")


def f12(spark, sf):
    name = F.concat(F.lit("`"), "n_name", F.lit("`"))
    return table(spark, sf, "nation").select("n_nationkey", X.unquoted(name).alias("name"), X.node_id(F.lit("DB"), F.lit(" "), F.col("n_name")).alias("node"), X.hashed_id(F.lit("t"), F.col("n_name")).alias("id"))


def s4(spark, sf):
    path = F.concat(F.lit("/data/"), "p_name", F.element_at(F.array(*(F.lit(x) for x in (".csv", ".JSON", ".parquet", ".txt"))), (F.col("p_size") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select(X.file_format(path).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "p1_glob": p1, "p2_regex": p2, "p3_rules": p3, "p3_rule_table": p3_table, "p4_two_stages": p4, "p5_key_scan": p5, "p6_system_objects": p6, "p6_table_engines": p6_engines, "p7_canonical_types": p7, "p8_type_parameters": p8, "p9_table_types": p9, "p10_storage_formats": p10,
    "p11_partition_specs": p11, "p13_flags": p13, "p14_categories": p14, "p15_path_templates": p15, "p16_access": p16, "p17_normal_paths": p17, "p18_validation": p18, "p19_redacted_json": p19, "p19_redacted_map": p19_map, "p20_masking": p20,
    "p21_severity": p21, "p22_list_filter": p22, "p23_word_search": p23, "p23_ranked_search": p23_ranked, "p23_phrase": p23_phrase, "p24_predicates": p24, "p24_quantified": p24_quantified, "p25_distinct": p25, "p26_incremental": p26, "p27_log_lines": p27, "f12_identifiers": f12, "s4_file_format": s4,
}

_R = "(SELECT event_id, user_id, event_type, CASE event_type WHEN 'click' THEN '/api/v1/tasks/' || user_id || '/start' WHEN 'view' THEN '/api/v1/tasks/' || user_id ELSE '/api/v1/health' END AS path, CASE user_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' ELSE 'viewer' END AS role FROM events)"
_P = "CASE event_type WHEN 'click' THEN 'task:start' WHEN 'view' THEN 'task:read' END"


def _sql_list(names):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + "]"


# What each type of SPELLED must become, by the sources' own rules.
_CANONICAL = {
    "mysql": ["INTEGER", "INTEGER", "FLOAT", "DECIMAL", "STRING", "STRING", "DATE", "TIMESTAMP", "BINARY", "BIT", "ENUM", "JSON"],
    "postgres": ["INTEGER", "INTEGER", "FLOAT", "DECIMAL", "STRING", "STRING", "TIME", "TIMESTAMP", "BINARY", "JSON", "UUID", "MONEY"],
    "hive": ["INTEGER", "INTEGER", "FLOAT", "DECIMAL", "STRING", "ARRAY", "MAP", "STRUCT", "UNION", "TIMESTAMP", "INTERVAL_DAY_TIME", "BINARY"],
    "clickhouse": ["TINYINT", "INTEGER", "BIGINT", "REAL", "DECIMAL", "CHAR", "TIMESTAMP", "DATE", "ARRAY", "TEXT", "ENUM", "BOOLEAN"],
    "doris": ["TINYINT", "SMALLINT", "INTEGER", "BIGINT", "REAL", "DECIMAL", "VARCHAR", "TEXT", "TIMESTAMP", "BOOLEAN", "MAP", "BLOB"],
    "sqlserver": ["TEXT", "INTEGER", "NUMERIC", "DOUBLE", "BOOLEAN", "TIMESTAMP", "BLOB", "UUID", "XML", "TEXT", "TIMESTAMP", "NUMERIC"],
    "elasticsearch": ["string", "bigint", "int", "smallint", "tinyint", "float", "decimal", "timestamp", "object", "geometry", "string", "string"],
    "avro": ["null", "bigint", "bytes", "com.acme.Money", "bigint", "record", "enum", "array", "map", "complex", "object", "union"],
}
_LISTED = {d: _sql_list(names) for d, names in LISTED.items()}
ORACLES = {
    "p6_table_engines": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'MergeTree' ELSE 'Log' END AS engine FROM part WHERE p_partkey % 5 IN (0, 4)",
    "p1_glob": "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*a[a-m]*' OR p_name GLOB '?o*'",
    "p2_regex": "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)brass|^promo')",
    "p3_rules": "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3].$') AND NOT regexp_matches(p_brand, '#1[2-4]$') AND p_brand <> 'Brand#22'",
    "p3_rule_table": "SELECT n_nationkey, n_name FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_nationkey % 10 = 0 AND right(b.n_name, 1) = right(a.n_name, 1)) AND EXISTS (SELECT 1 FROM nation b WHERE b.n_nationkey % 10 = 5 AND right(b.n_name, 1) = right(a.n_name, 1))",
    "p4_two_stages": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer%' AND c_name NOT LIKE '%7' AND regexp_matches(c_name, '[0-4]$')",
    "p5_key_scan": "SELECT count(*) AS n FROM events WHERE regexp_matches('user:' || user_id || ':' || event_type, '^user:1.*:cl.ck$')",
    "p6_system_objects": "SELECT c_custkey, dialect, name FROM (" + " UNION ALL ".join(f"SELECT c_custkey, '{d}' AS dialect, {x}[c_custkey % 5 + 1] AS name FROM customer" for d, x in _LISTED.items()) + ") WHERE (dialect, name) IN (('mysql', 'shop'), ('mysql', 'Sys'), ('postgres', 'public'), ('postgres', 'pgbench'), ('oracle', 'HR'), ('oracle', 'sys'), ('sqlserver', 'dbo'), ('sqlserver', 'sales'), ('clickhouse', 'default'), ('clickhouse', 'systems'), ('clickhouse', 'logs'))",
    "p7_canonical_types": "SELECT p_partkey, " + ", ".join(f"{_sql_list(names)}[p_partkey % 12 + 1] AS {d}" for d, names in _CANONICAL.items()) + " FROM part",
    "p8_type_parameters": "SELECT p_partkey, [20, NULL, NULL, 7, NULL, NULL, 3, NULL][p_partkey % 8 + 1] AS length, [NULL, 10, NULL, NULL, 9, 5, NULL, NULL][p_partkey % 8 + 1] AS precision, [NULL, 2, NULL, NULL, 0, NULL, NULL, NULL][p_partkey % 8 + 1] AS scale FROM part",
    "p9_table_types": "SELECT ['BASE TABLE', 'view', 'MATERIALIZED VIEW', 'foreign table', 'SEQUENCE', 'EXTERNAL_TABLE', 'VIRTUAL_VIEW', 'SYSTEM VIEW', 'MANAGED_TABLE'][i] AS kind, ['TABLE', 'VIEW', 'TABLE', 'TABLE', 'TABLE', 'TABLE', 'TABLE', 'TABLE', 'TABLE'][i] AS mysql, ['TABLE', 'VIEW', 'MATERIALIZED_VIEW', 'EXTERNAL_TABLE', 'TABLE', 'TABLE', 'TABLE', 'TABLE', 'TABLE'][i] AS postgres, ['TABLE', 'VIEW', 'TABLE', 'TABLE', 'TABLE', 'EXTERNAL_TABLE', 'VIEW', 'TABLE', 'TABLE'][i] AS hive, count(*) AS n FROM (SELECT o_orderkey % 9 + 1 AS i FROM orders) GROUP BY i",
    "p10_storage_formats": "SELECT ['orc', 'parquet', 'text', 'sequencefile', 'rcfile', 'avro', 'json', ''][p_partkey % 8 + 1] AS format, count(*) AS n FROM part GROUP BY 1",
    "p11_partition_specs": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dt, o_orderstatus AS status, 2 AS n FROM orders",
    "p13_flags": "SELECT p_partkey, p_size % 3 = 0 AS nullable, p_size % 4 = 0 AS auto_increment FROM part",
    "p14_categories": "SELECT c_custkey, category, category <> '' AS valid FROM (SELECT c_custkey, ['RDBMS', 'DataWarehouse', 'DocumentDB', 'KeyValue', 'MessageQueue', 'ObjectStorage', 'ObjectStorage', '', ''][c_custkey % 9 + 1] AS category FROM customer)",
    "p15_path_templates": "SELECT event_type, CASE event_type WHEN 'click' THEN '/api/v1/tasks/*/start' WHEN 'view' THEN '/api/v1/tasks/*' END AS template, count(*) AS n FROM events GROUP BY 1, 2",
    "p16_access": f"SELECT role, permission, permission IS NULL OR role = 'admin' OR (role = 'operator' AND permission = 'task:start') OR (role = 'viewer' AND permission = 'task:read') AS allowed, count(*) AS n FROM (SELECT *, {_P} AS permission FROM {_R}) GROUP BY 1, 2, 3",
    "p17_normal_paths": f"SELECT regexp_replace(path, '/[0-9]+', '/:id') AS route, count(*) AS n FROM {_R} GROUP BY 1",
    "p18_validation": "SELECT c_custkey, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, '; ') AS errors FROM (SELECT c_custkey, [x for x in [CASE WHEN length(c_name) > 0 THEN NULL ELSE 'c_name: is required' END, CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'c_acctbal: must not be negative' END, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN NULL ELSE 'c_mktsegment: is not supported' END] if x IS NOT NULL] AS e FROM customer)",
    "p19_redacted_json": '''SELECT doc_id, repeat(CASE WHEN doc_id % 2 = 0 THEN '{"a": [' ELSE '{"a": ' END, doc_id % 20)
  || CASE WHEN doc_id % 3 = 0 THEN '{"pass\\u0077ord": ' ELSE '{"password": ' END || '"[REDACTED]", "k": "'
  || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '", "token": "[REDACTED]"}'
  || repeat(CASE WHEN doc_id % 2 = 0 THEN ', 1]}' ELSE '}' END, doc_id % 20) AS details FROM documents''',
    "p19_redacted_map": "SELECT c_custkey, '[REDACTED]' AS access_key, c_mktsegment AS segment, '[REDACTED]' AS credentials, c_name AS refresh_token FROM customer",
    "p20_masking": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '********' END AS password, '********' AS access_key, '********' AS secret_key, c_name AS token, c_mktsegment AS host, left(c_name, 3) || '****' || right(c_name, 3) AS name FROM customer",
    "p21_severity": "SELECT ['login_failed', 'task_delete', 'config_change', 'login', 'password_change', 'datasource_delete', 'template_delete', 'token_refresh'][i] AS action, ['warning', 'critical', 'critical', 'info', 'warning', 'critical', 'info', 'info'][i] AS severity, count(*) AS n FROM (SELECT event_id % 8 + 1 AS i FROM events) GROUP BY i",
    "p22_list_filter": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50",
    "p23_ranked_search": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS texts, sum(len(w)) AS words FROM d),
n AS (SELECT doc_id, len(w) AS length, t, len(list_filter(w, lambda x: x = t)) AS n FROM d, (SELECT unnest(['the', 'license', 'idiot']) AS t)),
f AS (SELECT t, count(*) AS having_it FROM n WHERE n > 0 GROUP BY 1)
SELECT doc_id, count(*) AS n_terms, round(sum(ln(1 + (texts - having_it + 0.5) / (having_it + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length * texts / words))), 6) AS score FROM n JOIN f USING (t), s WHERE n > 0 GROUP BY 1""",
    "p23_phrase": r"WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, len([1 for i in range(1, len(w)) if w[i] = 'of' and w[i + 1] = 'the']) AS n FROM d) SELECT * FROM n WHERE n > 0",
    "p23_word_search": r"SELECT doc_id, CAST(score AS INTEGER) AS score FROM (SELECT doc_id, len(list_intersect(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['the', 'license', 'idiot'])) AS score FROM documents) WHERE score > 0",
    "p24_predicates": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND (o_orderstatus IN ('F', 'O') OR o_orderpriority ILIKE '%urgent%') AND o_custkey IS NOT NULL",
    "p24_quantified": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)",
    "p25_distinct": "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "p26_incremental": "SELECT count(*) AS n, max(event_id) AS last_value FROM events WHERE event_id > 500",
    "p27_log_lines": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY k) - 1 AS INTEGER) AS line, ['INFO', 'INFO', 'ERROR'][k] AS level, ['started', 'ended', 'failed'][k] AS message FROM (SELECT o_orderkey, o_orderstatus, unnest([1, 2, 3]) AS k FROM orders) WHERE k = 1 OR (k = 2 AND o_orderstatus <> 'P') OR (k = 3 AND o_orderstatus = 'O')",
    "f12_identifiers": "SELECT n_nationkey, n_name AS name, 'db.' || lower(n_name) AS node, md5('t:' || n_name) AS id FROM nation",
    "s4_file_format": "SELECT CASE p_size % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'parquet' END AS format, count(*) AS n FROM part GROUP BY 1",
}
