"""Queries for lineage. Statements and facts are derived from the rows of part, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import selects
from .common import table


def _scripts(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("-- job "), "p_name", F.lit("\nCREATE TABLE IF NOT EXISTS dw.t"), k, F.lit(" (id BIGINT PRIMARY KEY, amount DECIMAL(10,2) NOT NULL DEFAULT 0, note VARCHAR(20) COMMENT 'free, text');\n"), F.lit("INSERT INTO dw.t"), k, F.lit(" WITH c AS (SELECT id FROM ods.base"), k,
        F.lit(") SELECT c.id, o.amount FROM c JOIN `ods`.`Orders` o ON c.id = o.id;\n ;SET x = 1;\nSELECT * FROM dw.t"), k, F.lit(";"),
    )
    return p.select("p_partkey", text.alias("script"))


def _stmts(spark, sf):
    return L.statements(_scripts(spark, sf), "p_partkey", "script")


def l1(spark, sf):
    return _stmts(spark, sf).select("p_partkey", F.col("pos").cast("int").alias("pos"), F.length("sql").alias("length"))


def l2(spark, sf):
    return _stmts(spark, sf).select(L.statement_kind(F.col("sql")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def l3(spark, sf):
    return L.table_lineage(_stmts(spark, sf), "p_partkey")


def l4(spark, sf):
    return L.ddl_columns(_stmts(spark, sf), "p_partkey")[0]


def _facts(spark, sf):
    """Orders as statements: each of its lines is an output column, from one or two tables; every fourth is a union of two branches."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt_id"), "o_custkey")
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stmt_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"))
    l = l.withColumn("pos", F.col("pos") - 1)
    branches = F.when(F.col("stmt_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    column = F.concat(F.lit("col"), (F.col("part") % 6).cast("string"))
    items = l.withColumn("branch", F.explode(branches)).select("stmt_id", "branch", "pos", F.when(F.col("flag") == "A", F.concat(F.lit("a"), F.col("pos").cast("string"))).alias("alias"), F.when(F.col("flag") == "N", column).alias("column_name"), F.when(F.col("flag") == "R", F.concat(F.lit("SUM("), column, F.lit(")"))).otherwise(column).alias("expr"))
    refs = l.withColumn("branch", F.explode(branches)).select("stmt_id", "branch", "pos", F.lit(0).alias("ref_pos"), F.when(F.col("part") % 3 == 0, "o").when(F.col("part") % 3 == 1, "zz").alias("qualifier"), column.alias("column_name"))
    tables = o.withColumn("branch", F.explode(branches)).select("stmt_id", "branch", F.posexplode(F.when(F.col("stmt_id") % 2 == 0, F.array(F.lit("Orders"))).otherwise(F.array(F.lit("Orders"), F.lit("customer")))).alias("from_pos", "table_name")).withColumn("alias", F.when(F.col("table_name") == "Orders", "o"))
    catalog = table(spark, sf, "region").filter("r_regionkey < 4").select(F.when(F.col("r_regionkey") < 2, "orders").otherwise("customer").alias("table_name"), F.concat(F.lit("col"), F.col("r_regionkey").cast("string")).alias("column_name"), F.col("r_regionkey").alias("ordinal"))
    inserts = l.filter("stmt_id % 3 = 0 AND pos < 2").select("stmt_id", "pos", F.concat(F.lit("into"), F.col("pos").cast("string")).alias("column_name"))
    return items, refs, tables, catalog, inserts


def _lineage(spark, sf):
    return L.column_lineage(*_facts(spark, sf))


def l5(spark, sf):
    return _lineage(spark, sf)


def j14(spark, sf):
    _, refs, tables, catalog, _ = _facts(spark, sf)
    return L.bound(refs, tables, catalog).groupBy("qualifier", "table_name").agg(F.count(F.lit(1)).alias("n"))


def j16(spark, sf):
    _, _, tables, catalog, _ = _facts(spark, sf)
    stars = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt_id"), F.lit(0).alias("branch"), F.lit(0).alias("pos"), F.when(F.col("o_orderkey") % 5 == 0, "o").alias("qualifier"))
    return L.expanded_stars(stars, tables, catalog)


def j18(spark, sf):
    """A chain of views: column k of part comes from column k / 2 while that is a whole number."""
    p = table(spark, sf, "part")
    edges = p.filter("p_partkey % 2 = 0 AND p_partkey > 0").select(F.concat(F.lit("v."), F.col("p_partkey").cast("string")).alias("target"), F.concat(F.lit("v."), (F.col("p_partkey") / 2).cast("long").cast("string")).alias("source"))
    return L.to_base(edges)


def a28(spark, sf):
    return L.table_rollup(L.table_lineage(_stmts(spark, sf), "p_partkey"))


def a29(spark, sf):
    e = L.table_lineage(_stmts(spark, sf), "p_partkey")
    n = _stmts(spark, sf).agg(F.count(F.lit(1)).alias("n_statements"))
    return e.agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"), F.count(F.lit(1)).alias("n_edges")).crossJoin(n)  # one row each


def a30(spark, sf):
    """Complexity counts outputs and sources and reads no target, so the names of insert columns are not joined; every output is there without them."""
    return L.complexity(L.column_lineage(*_facts(spark, sf)[:4]))


def a31(spark, sf):
    """Expressions with stream functions around them, some spelled in small letters, which do not count."""
    around = lambda name: F.concat(F.lit(name), F.lit("("), "operator", F.lit(")"))
    operator = F.when(F.col("pos") == 0, around("TUMBLE")).when(F.col("pos") == 1, around("DATE_FORMAT")).when(F.col("pos") == 2, around("date_format")).when(F.col("pos") == 3, F.concat(F.lit("WATERMARK FOR event_time AS "), "operator")).when(F.col("pos") == 4, F.concat(F.lit("DENSE_RANK() OVER "), "operator"))
    return L.stream_features(_lineage(spark, sf).withColumn("operator", F.coalesce(operator, "operator")))


def l8(spark, sf):
    return L.graph_edges(_lineage(spark, sf)).groupBy("source_id", "type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge_id").alias("n_ids"))


def _sql(key, *parts):
    """A text with a column's value in place of each None."""
    return F.concat(*(F.col(key).cast("string") if x is None else F.lit(x) for x in parts))


def _no_catalog(spark):
    return spark.createDataFrame([], "table_name string, column_name string, ordinal int")


def l6(spark, sf):
    """Sources inside nested calls, CASE, OVER, common table expressions, scalar subqueries and set operations."""
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 4
    size = "p_size"
    text = (
        F.when(k == 0, _sql(size, "SELECT SUM(CASE WHEN o.c1 > ", None, " THEN o.c2 ELSE o.c3 * o.c2 END) AS total, UPPER(TRIM(name)) n, COUNT(*) FROM ods.orders o WHERE o.c9 = 1"))
        .when(k == 1, _sql(size, "INSERT INTO dw.t", None, " (x, y) SELECT ROW_NUMBER() OVER (PARTITION BY u.k", None, " ORDER BY u.ts DESC), CAST(v.w AS DECIMAL(10,2)) FROM dim.users u LEFT JOIN `dim`.`v` AS v ON u.id = v.id"))
        .when(k == 2, _sql(size, "WITH c AS (SELECT id, a + b AS ab FROM base", None, ") SELECT COALESCE(ab, 'x;,(') AS v, (SELECT MAX(d) FROM dim WHERE dim.id = c.id) FROM c"))
        .otherwise(_sql(size, "CREATE VIEW w", None, " AS SELECT IF(d.a IS NULL, 0, d.a) AS z, 1 one -- last\nFROM (SELECT a1 AS a FROM t", None, " UNION ALL SELECT a2 FROM s) d"))
    )
    return selects.text_lineage(p.select("p_partkey", text.alias("sql")), "p_partkey", _no_catalog(spark))[0]


def l7(spark, sf):
    """Every statement with its error or the number of its outputs."""
    k = F.col("p_partkey") % 6
    p = table(spark, sf, "part")
    texts = ["SELECT a, b FROM t", "SELECT a FROM t WHERE n = 'open", "SELECT f(a FROM t", "DROP TABLE t", "SELECT a, FROM t", "SELECT a FROM"]
    text = F.element_at(F.array(*(F.lit(x) for x in texts)), k.cast("int") + 1)
    rows = p.select("p_partkey", text.alias("sql"))
    found, errors = selects.text_lineage(rows, "p_partkey", _no_catalog(spark))
    n = found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_outputs"))
    return rows.select("p_partkey").join(errors, "p_partkey", "left").join(n, "p_partkey", "left").withColumn("n_outputs", F.coalesce("n_outputs", F.lit(0)))


def l10(spark, sf):
    """A pipeline of three statements for each part, from its script down to base columns."""
    k = "p_partkey"
    script = _sql(
        k, "-- daily\nCREATE OR REPLACE TEMPORARY VIEW detail", None, " AS SELECT o.id, CONCAT(u.first, ';', u.last) AS name, o.pay FROM ods.orders o JOIN dim.users u ON o.uid = u.id;\nINSERT OVERWRITE TABLE dws.rfm", None, " SELECT id, name, COUNT(DISTINCT pay) AS freq FROM detail", None,
        " GROUP BY id, name;\nINSERT INTO ads.seg", None, " WITH r AS (SELECT *, NTILE(5) OVER (ORDER BY freq DESC) AS score FROM dws.rfm", None, ") SELECT id, CASE WHEN score > 3 THEN name ELSE 'none; yet' END AS label FROM r;",
    )
    s = L.statements(table(spark, sf, "part").select(k, script.alias("script")), k, "script").withColumn("stmt", F.concat_ws("/", k, "pos"))
    catalog = table(spark, sf, "part").select(F.concat(F.lit("dws.rfm"), F.col(k).cast("string")).alias("table_name"), F.posexplode(F.array(*(F.lit(c) for c in ("id", "name", "freq")))).alias("ordinal", "column_name"))
    return selects.base_lineage(selects.text_lineage(s.select("stmt", "sql"), "stmt", catalog)[0])


QUERIES = {"l6_function_sources": l6, "l7_batch_errors": l7, "l10_pipeline_lineage": l10, "l1_statements": l1, "l2_kinds": l2, "l3_table_lineage": l3, "l4_ddl_columns": l4, "l5_column_lineage": l5, "j14_binding": j14, "j16_stars": j16, "j18_base_columns": j18, "a28_table_rollup": a28, "a29_lineage_report": a29, "a30_complexity": a30, "a31_stream_features": a31, "l8_graph_edges": l8}

_F = """
l AS (SELECT l_orderkey AS stmt_id, l_linenumber - 1 AS pos, max(l_returnflag) AS flag, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, 'col' || (part % 6) AS c, CASE part % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'zz' END AS q, CASE WHEN stmt_id % 4 = 0 THEN 2 ELSE 1 END AS branches FROM l),
t AS (SELECT *, CASE q WHEN 'o' THEN 'orders' WHEN 'zz' THEN 'zz' ELSE CASE WHEN stmt_id % 2 = 0 THEN 'orders' WHEN part % 6 < 2 THEN 'orders' WHEN part % 6 < 4 THEN 'customer' ELSE '' END END AS tab FROM b),
x AS (SELECT stmt_id, pos, CASE WHEN stmt_id % 3 = 0 AND pos < 2 THEN 'into' || pos WHEN flag = 'A' THEN 'a' || pos WHEN flag = 'N' THEN c ELSE '_col' || pos END AS target, CASE tab WHEN '' THEN c ELSE tab || '.' || c END AS s, branches, CASE flag WHEN 'R' THEN 'SUM(' || c || ')' ELSE c END AS operator FROM t),
y AS (SELECT stmt_id, pos, target, CASE branches WHEN 2 THEN s || ',' || s ELSE s END AS sources, CAST(branches AS BIGINT) AS n_sources, operator FROM x)"""
_ONE = "CREATE TABLE IF NOT EXISTS dw.t (id BIGINT PRIMARY KEY, amount DECIMAL(10,2) NOT NULL DEFAULT 0, note VARCHAR(20) COMMENT ''free, text'')"
_EDGES = "(SELECT p_partkey, p_size, unnest(['ods.base' || p_size, 'ods.orders', 'dw.t' || p_size]) AS source, unnest(['dw.t' || p_size, 'dw.t' || p_size, 'RESULT_SET']) AS target FROM part)"
ORACLES = {
    "l6_function_sources": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'dw.t' || p_size WHEN 3 THEN 'w' || p_size ELSE 'RESULT_SET' END AS target_table, CAST(i - 1 AS INTEGER) AS pos, t[i] AS target, s[i] AS sources, CASE s[i] WHEN '' THEN 0 ELSE len(string_split(s[i], ',')) END AS n_sources, e[i] AS operator FROM (
  SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT p_partkey, p_size,
    CASE p_partkey % 4 WHEN 0 THEN ['total', 'n', '_col2'] WHEN 1 THEN ['x', 'y'] WHEN 2 THEN ['v', '_col1'] ELSE ['z', 'one'] END AS t,
    CASE p_partkey % 4 WHEN 0 THEN ['ods.orders.c1,ods.orders.c2,ods.orders.c3,ods.orders.c2', 'ods.orders.name', ''] WHEN 1 THEN ['dim.users.k' || p_size || ',dim.users.ts', 'dim.v.w'] WHEN 2 THEN ['base' || p_size || '.a,base' || p_size || '.b', 'dim.d'] ELSE ['s.a2,t' || p_size || '.a1,s.a2,t' || p_size || '.a1', ''] END AS s,
    CASE p_partkey % 4 WHEN 0 THEN ['SUM(CASE WHEN o.c1 > ' || p_size || ' THEN o.c2 ELSE o.c3 * o.c2 END)', 'UPPER(TRIM(name))', 'COUNT(*)'] WHEN 1 THEN ['ROW_NUMBER() OVER (PARTITION BY u.k' || p_size || ' ORDER BY u.ts DESC)', 'CAST(v.w AS DECIMAL(10,2))'] WHEN 2 THEN ['COALESCE(ab, ''x;,('')', 'subquery'] ELSE ['IF(d.a IS NULL, 0, d.a)', '1'] END AS e FROM part))""",
    "l7_batch_errors": "SELECT p_partkey, [NULL, 'unclosed quote', 'unbalanced brackets', 'no SELECT', 'missing output', 'missing table'][p_partkey % 6 + 1] AS error, CASE p_partkey % 6 WHEN 0 THEN 2 ELSE 0 END AS n_outputs FROM part",
    "l10_pipeline_lineage": "SELECT t[1] || p_partkey || '.' || t[2] AS target, t[3] AS source FROM (SELECT p_partkey, unnest([['detail', 'id', 'ods.orders.id'], ['detail', 'name', 'dim.users.first'], ['detail', 'name', 'dim.users.last'], ['detail', 'pay', 'ods.orders.pay'], ['dws.rfm', 'id', 'ods.orders.id'], ['dws.rfm', 'name', 'dim.users.first'], ['dws.rfm', 'name', 'dim.users.last'], ['dws.rfm', 'freq', 'ods.orders.pay'], ['ads.seg', 'id', 'ods.orders.id'], ['ads.seg', 'label', 'ods.orders.pay'], ['ads.seg', 'label', 'dim.users.first'], ['ads.seg', 'label', 'dim.users.last']]) AS t FROM part)",
    "l1_statements": f"SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS length FROM (SELECT p_partkey, unnest([0, 1, 4]) AS pos, unnest([length('{_ONE}') + length(p_size::VARCHAR), length('INSERT INTO dw.t WITH c AS (SELECT id FROM ods.base) SELECT c.id, o.amount FROM c JOIN `ods`.`Orders` o ON c.id = o.id') + 2 * length(p_size::VARCHAR), length('SELECT * FROM dw.t') + length(p_size::VARCHAR)]) AS n FROM part)",
    "l2_kinds": "SELECT unnest(['create', 'insert', 'select']) AS kind, count(*) AS n FROM part",
    "l3_table_lineage": f"SELECT p_partkey, target, source FROM {_EDGES}",
    "l4_ddl_columns": "SELECT p_partkey, 'dw.t' || p_size AS table_name, CAST(i AS INTEGER) AS ordinal, ['id', 'amount', 'note'][i] AS name, ['BIGINT', 'DECIMAL(10,2)', 'VARCHAR(20)'][i] AS data_type, i = 3 AS nullable, i = 1 AS primary_key, CASE i WHEN 2 THEN '0' END AS default_value, CASE i WHEN 3 THEN 'free, text' ELSE '' END AS comment FROM part, (SELECT unnest([1, 2, 3]) AS i)",
    "l5_column_lineage": f"WITH {_F} SELECT * FROM y",
    "j14_binding": f"WITH {_F} SELECT q AS qualifier, tab AS table_name, CAST(sum(branches) AS BIGINT) AS n FROM t GROUP BY 1, 2",
    "j16_stars": "WITH c AS (SELECT CASE WHEN r_regionkey < 2 THEN 'orders' ELSE 'customer' END AS table_name, 'col' || r_regionkey AS column_name, r_regionkey AS k FROM region WHERE r_regionkey < 4) SELECT o_orderkey AS stmt_id, 0 AS branch, 0 AS pos, table_name, column_name, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS INTEGER) AS place FROM orders, c WHERE table_name = 'orders' OR (o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0)",
    "j18_base_columns": "WITH RECURSIVE r AS (SELECT p_partkey AS k, p_partkey // 2 AS s FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0 UNION ALL SELECT k, s // 2 FROM r WHERE s % 2 = 0) SELECT 'v.' || k AS target, 'v.' || min(s) AS source FROM r GROUP BY k",
    "a28_table_rollup": f"SELECT target, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources FROM {_EDGES} GROUP BY 1",
    "a29_lineage_report": f"SELECT count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets, count(*) AS n_edges, 3 * (SELECT count(*) FROM part) AS n_statements FROM {_EDGES}",
    "a30_complexity": f"WITH {_F} SELECT stmt_id, count(*) AS n_columns, CAST(sum(n_sources) AS BIGINT) AS n_sources, max(n_sources) AS max_sources, round(avg(n_sources), 6) AS avg_sources, count(*) FILTER (operator LIKE 'SUM%') AS n_operators, CAST(count(*) + 0.5 * sum(n_sources) + 2.0 * count(*) FILTER (operator LIKE 'SUM%') AS DOUBLE) AS score FROM y GROUP BY 1",
    "a31_stream_features": f"WITH {_F} SELECT count(*) FILTER (pos IN (1, 3)) AS n_time, count(*) FILTER (pos IN (0, 4)) AS n_window, count(*) FILTER (pos = 3) AS n_watermark FROM y",
    "l8_graph_edges": f"WITH {_F} SELECT s AS source_id, 'derived_from' AS type, CAST(1.0 AS DOUBLE) AS confidence, CAST(sum(branches) AS BIGINT) AS n, count(DISTINCT target || ':' || stmt_id) AS n_ids FROM x GROUP BY 1",
}
