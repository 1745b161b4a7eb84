"""Queries for catalog tables and graphs, over the hierarchy region, nation, customer, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import graph as G
from .common import table


def j1(spark, sf):
    r, n, c, o = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))
    connectors = r.select(F.col("r_regionkey").alias("connector_id"), F.col("r_name").alias("connector"))
    catalogs = n.select(F.col("n_nationkey").alias("catalog_id"), F.col("n_regionkey").alias("connector_id"), F.col("n_name").alias("catalog"))
    schemas = c.select(F.col("c_custkey").alias("schema_id"), F.col("c_nationkey").alias("catalog_id"), F.col("c_name").alias("schema"))
    tables = o.select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("schema_id"))
    return C.table_view(connectors, catalogs, schemas, tables).select("table_id", "schema", "catalog", "connector")


def _nodes(spark, sf):
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    node = lambda df, kind, key, name: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
    return node(r, "r", "r_regionkey", "r_name").unionByName(node(n, "n", "n_nationkey", "n_name")).unionByName(node(c, "c", "c_custkey", "c_name"))


def _edges(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    key = lambda kind, k: F.concat(F.lit(f"{kind}:"), F.col(k).cast("string"))
    return G.containment([(n.select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b")), "a", "b"), (c.select(key("n", "c_nationkey").alias("a"), key("c", "c_custkey").alias("b")), "a", "b")])


def j3(spark, sf):
    return C.edge_view(_edges(spark, sf), _nodes(spark, sf)).select("source_id", "source_name", "source_type", "target_id", "target_name", "target_type")


def j4(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"))
    keys = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"))
    comments = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_linestatus").alias("comment"))
    return C.enriched(l, keys, comments, ["k", "i"]).groupBy("is_key", "comment").agg(F.count(F.lit(1)).alias("n"))


def j7(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("fk"), F.col("c_custkey").cast("string")).alias("constraint_name"), F.lit("customer").alias("table_name"), F.col("c_name").alias("column_name"), F.lit(1).alias("position"), F.concat(F.lit("pk"), F.col("c_nationkey").cast("string")).alias("refers_to"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("pk"), F.col("n_nationkey").cast("string")), F.lit("nation"), "n_name", F.lit(1), F.lit(None).cast("string"))
    return C.foreign_keys(c.union(n))


def j8(spark, sf):
    """Partitions with their boundary values; the last has none."""
    l = table(spark, sf, "lineitem")
    parts = l.groupBy(F.year("l_shipdate").alias("number")).agg(F.count(F.lit(1)).alias("n"))
    bounds = parts.filter("number % 2 = 0").select("number", (F.col("number") + 1).cast("string").alias("boundary"))
    return parts.join(bounds, "number", "left").select(F.col("number").cast("int").alias("number"), "n", "boundary")


def j9(spark, sf):
    e = table(spark, sf, "events")
    latest = e.groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 8).alias("partition")).agg(F.max("event_id").alias("latest"))
    committed = e.filter("event_id % 3 <> 0").groupBy((F.col("user_id") % 5).alias("group"), F.col("event_type").alias("topic"), (F.col("user_id") % 8).alias("partition")).agg((F.max("event_id") - 3).alias("committed"))
    return C.consumer_lag(latest, committed)


def j10(spark, sf):
    """Queues with their bindings and exchanges, those without a binding too."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return n.join(s.filter("s_acctbal > 0"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n_bindings"))


def j11(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return C.deletable(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


def j13(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("template_id"), F.lit("old").alias("type"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("config"))
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("template_id"), F.col("n_name").alias("type"), F.lit("default").alias("config"))
    return C.applied_template(c, t).select("c_custkey", "type", "config")


def j27(spark, sf):
    old = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("M").alias("o_orderstatus"), "o_custkey")
    return C.merged(old, new, "o_orderkey", F.col("o_custkey") % 10 == 0)


def j28(spark, sf):
    """UPDATE ... FROM as a rewritten table: orders of a nation's customers get its name as their status."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_nationkey = 3").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderstatus").alias("o_orderstatus"))


def j29(spark, sf):
    ids = table(spark, sf, "events").select((F.col("event_id") * 3).alias("o_orderkey"))
    return C.bulk_result(table(spark, sf, "orders"), ids, "o_orderkey").groupBy("success", "message").agg(F.count(F.lit(1)).alias("n"))


def l9(spark, sf):
    tables = table(spark, sf, "customer").select(F.concat(F.lit("DB"), F.col("c_nationkey").cast("string")).alias("database"), F.col("c_name").alias("table"), F.col("c_custkey").alias("table_id"))
    refs = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("db"), (F.col("o_orderkey") % 40).cast("string")).alias("database"), F.format_string("CUSTOMER#%09d", "o_custkey").alias("table"))
    return C.looked_up(refs, tables).select("o_orderkey", "table_id")


def p12(spark, sf):
    """Lines of an order as DESCRIBE rows: the first is data, the fourth and sixth open sections."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 4, "# Partition Information").when(F.col("l_linenumber") == 6, "# Detailed Table Information").when(F.col("l_linenumber") == 5, "# col_name").otherwise(F.col("l_returnflag")).alias("name"), F.lit("string").alias("type"), F.lit("").alias("comment"))
    return C.described(l, "l_orderkey", "l_linenumber", "name", "type", "comment").groupBy("section", "is_partition").agg(F.count(F.lit(1)).alias("n"))


def u2(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("version"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_orderkey").alias("version"))
    return C.upserted(old, new, ["c_custkey"], "version")


def u2_duplicates(spark, sf):
    return C.duplicates(table(spark, sf, "orders"), ["o_custkey"])


def u3(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind")).union(c.select("c_nationkey", F.lit("customer"))).distinct()


def g2(spark, sf):
    starts = _nodes(spark, sf).filter("type = 'c'").select("node_id")
    return G.reached(_edges(spark, sf), starts, reverse=True)


def g3(spark, sf):
    starts = _nodes(spark, sf).filter("type = 'r'").select("node_id")
    return G.reached(_edges(spark, sf), starts, depth=2)


def g4(spark, sf):
    """Around all nations of two regions: their region above them and their customers below."""
    starts = table(spark, sf, "nation").filter("n_regionkey IN (1, 3)").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return G.subgraph(_edges(spark, sf), starts)[1]


def g6(spark, sf):
    return _edges(spark, sf)


def g7(spark, sf):
    return G.rolled_up(_edges(spark, sf), _nodes(spark, sf).select("node_id", F.col("type").alias("group")))


def g8(spark, sf):
    """Customers linked by consecutive orders: from the customer of an order to that of the next key."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next"))
    return G.cyclic_nodes(o.join(n, "o_orderkey").select(F.col("o_custkey").alias("source_id"), F.col("next").alias("target_id")).filter("source_id <> target_id"))


def _customer_edges(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next"))
    return o.join(n, "o_orderkey").select(F.col("o_custkey").alias("source_id"), F.col("next").alias("target_id"))


def g8_all(spark, sf):
    """Every edge between customers, loops too, with whether it is on a cycle."""
    e = _customer_edges(spark, sf).distinct()
    return G.closes_cycle(e, e).select("source_id", "target_id", "closes")


def g8_components(spark, sf):
    return G.components(_customer_edges(spark, sf))


def g8_closing(spark, sf):
    e = _edges(spark, sf)
    candidates = _nodes(spark, sf).filter("type = 'n'").select(F.col("node_id").alias("source_id"), F.lit("r:1").alias("target_id"))
    return G.closes_cycle(e, candidates).select("source_id", "target_id", "closes")


def g9(spark, sf):
    return G.adjacency(_nodes(spark, sf).select("node_id"), _edges(spark, sf))


def g9_blocks(spark, sf):
    return G.adjacency_blocks(_edges(spark, sf), 8).select("node_id", "block", F.array_join("targets", ",").alias("targets"))


def g1(spark, sf):
    gone = _nodes(spark, sf).filter("type = 'n' AND node_id LIKE '%2'").select("node_id")
    return G.without_nodes(_nodes(spark, sf), _edges(spark, sf), gone)[1]


def g12(spark, sf):
    e = _edges(spark, sf).withColumn("confidence", F.pmod(F.length("target_id"), F.lit(3)) / 2.0)
    return e.filter("confidence >= 0.5 AND source_id LIKE 'n%'")


def g13(spark, sf):
    """The hierarchy below each region by a recursive query, to three levels."""
    _edges(spark, sf).createOrReplaceTempView("heddlework_edges")
    return spark.sql("WITH RECURSIVE h AS (SELECT DISTINCT source_id AS root, source_id AS node_id, 0 AS level FROM heddlework_edges WHERE source_id LIKE 'r%' UNION ALL SELECT root, e.target_id, level + 1 FROM h JOIN heddlework_edges e ON e.source_id = h.node_id WHERE level < 3) SELECT root, level, count(*) AS n FROM h GROUP BY root, level")


QUERIES = {
    "j1_table_view": j1, "j3_edge_view": j3, "j4_enrichment": j4, "j7_foreign_keys": j7, "j8_boundaries": j8, "j9_consumer_lag": j9, "j10_bindings": j10, "j11_delete_safety": j11, "j13_templates": j13, "j27_merge": j27, "j28_update_from": j28, "j29_bulk_result": j29,
    "l9_catalog_lookup": l9, "p12_describe": p12, "u2_upsert": u2, "u2_duplicates": u2_duplicates, "u3_union_listing": u3, "g1_node_removal": g1, "g2_upstream": g2, "g3_downstream": g3, "g4_subgraph": g4, "g6_containment": g6, "g7_rollup": g7, "g8_cyclic_nodes": g8,
    "g8_cycle_test": g8_closing, "g8_edges_on_cycles": g8_all, "g8_components": g8_components, "g9_adjacency": g9, "g9_adjacency_blocks": g9_blocks, "g12_edge_filter": g12, "g13_recursive_hierarchy": g13,
}

_N = "(SELECT 'r:' || r_regionkey AS node_id, r_name AS name, 'r' AS type FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'n' FROM nation UNION ALL SELECT 'c:' || c_custkey, c_name, 'c' FROM customer)"
_E = "(SELECT 'r:' || n_regionkey AS source_id, 'n:' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer)"

ORACLES = {
    "j1_table_view": 'SELECT o_orderkey AS table_id, c_name AS "schema", n_name AS "catalog", r_name AS connector FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey',
    "j3_edge_view": f"SELECT source_id, a.name AS source_name, a.type AS source_type, target_id, b.name AS target_name, b.type AS target_type FROM {_E} e JOIN {_N} a ON a.node_id = source_id JOIN {_N} b ON b.node_id = target_id",
    "j4_enrichment": "SELECT is_key, comment, CAST(sum(w) AS BIGINT) AS n FROM (SELECT bool_or(l_returnflag = 'R') OVER g AS is_key, CASE WHEN f.l_orderkey IS NULL THEN '' ELSE 'F' END AS comment, 1 AS w FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') f USING (l_orderkey, l_linenumber) WINDOW g AS (PARTITION BY l.l_orderkey, l.l_linenumber)) GROUP BY 1, 2",
    "j7_foreign_keys": "SELECT 'fk' || c_custkey AS constraint_name, 1 AS position, 'customer' AS table_name, c_name AS column_name, 'nation' AS parent_table, n_name AS parent_column FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "j8_boundaries": "SELECT CAST(year(l_shipdate) AS INTEGER) AS number, count(*) AS n, CASE WHEN year(l_shipdate) % 2 = 0 THEN CAST(year(l_shipdate) + 1 AS VARCHAR) END AS boundary FROM lineitem GROUP BY year(l_shipdate)",
    "j9_consumer_lag": 'WITH l AS (SELECT event_type AS topic, user_id % 8 AS p, max(event_id) AS latest FROM events GROUP BY 1, 2), c AS (SELECT user_id % 5 AS g, event_type AS topic, user_id % 8 AS p, max(event_id) - 3 AS committed FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3) SELECT g AS "group", topic, CAST(sum(greatest(latest - committed, 0)) AS BIGINT) AS lag, count(*) AS n_partitions FROM c JOIN l USING (topic, p) GROUP BY 1, 2',
    "j10_bindings": "SELECT n_name, count(s_suppkey) AS n_bindings FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey GROUP BY 1",
    "j11_delete_safety": "SELECT c_custkey AS k, count(o_orderkey) AS n_tasks, count(o_orderkey) = 0 AS can_delete FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "j13_templates": "SELECT c_custkey, n_name AS type, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'default' END AS config FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "j27_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE (o_orderkey % 2 = 0 AND o_custkey % 10 <> 0) OR (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0)",
    "j28_update_from": "SELECT o_orderkey, coalesce(c_mktsegment, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 3) ON o_custkey = c_custkey",
    "j29_bulk_result": "SELECT success, CASE WHEN NOT success THEN 'not found' END AS message, count(*) AS n FROM (SELECT DISTINCT event_id * 3 AS k, (event_id * 3) IN (SELECT o_orderkey FROM orders) AS success FROM events) GROUP BY 1, 2",
    "l9_catalog_lookup": "WITH t AS (SELECT 'db' || c_nationkey AS d, lower(c_name) AS t, c_custkey AS id FROM customer), r AS (SELECT o_orderkey, 'db' || (o_orderkey % 40) AS d, lower('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS t FROM orders) SELECT o_orderkey, coalesce((SELECT max(id) FROM t WHERE t.d = r.d AND t.t = r.t), CASE WHEN r.d NOT IN (SELECT d FROM t) THEN (SELECT arg_min(id, d) FROM t WHERE t.t = r.t) END) AS table_id FROM r",
    "p12_describe": "SELECT section, section = 'partition' AS is_partition, count(*) AS n FROM (SELECT l_linenumber, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING), 'columns') AS section FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 4 THEN 'partition' WHEN 6 THEN 'detail' END AS m FROM lineitem)) WHERE l_linenumber NOT IN (4, 5, 6) GROUP BY 1",
    "u2_upsert": "SELECT c_custkey, coalesce('order ' || max(o_orderkey), max(c_name)) AS c_name, coalesce(max(o_orderkey), 0) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "u2_duplicates": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "u3_union_listing": "SELECT s_nationkey AS k, 'supplier' AS kind FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer",
    "g1_node_removal": f"SELECT * FROM {_E} WHERE NOT (source_id LIKE 'n%2' OR target_id LIKE 'n%2')",
    "g2_upstream": "WITH c AS (SELECT 'c:' || c_custkey AS s, 'n:' || c_nationkey AS n, 'r:' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT s AS start_id, s AS node_id, 0 AS depth FROM c UNION ALL SELECT s, n, 1 FROM c UNION ALL SELECT s, r, 2 FROM c",
    "g3_downstream": "SELECT 'r:' || r_regionkey AS start_id, 'r:' || r_regionkey AS node_id, 0 AS depth FROM region UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r:' || n_regionkey, 'c:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "g4_subgraph": "SELECT 'r:' || n_regionkey AS source_id, 'n:' || n_nationkey AS target_id FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT DISTINCT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)",
    "g6_containment": f"SELECT DISTINCT * FROM {_E}",
    "g7_rollup": "SELECT 'r' AS source_group, 'n' AS target_group, count(*) AS n FROM nation UNION ALL SELECT 'n', 'c', count(*) FROM customer",
    "g8_cyclic_nodes": "WITH RECURSIVE g AS MATERIALIZED (SELECT DISTINCT o.o_custkey AS s, p.o_custkey AS t FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey + 1 WHERE o.o_custkey <> p.o_custkey), f AS (SELECT s, t FROM g UNION SELECT f.s, g.t FROM f JOIN g ON g.s = f.t), c AS (SELECT DISTINCT s FROM f WHERE s = t), a AS (SELECT s AS v FROM c UNION SELECT t FROM f WHERE s IN (FROM c)), b AS (SELECT s AS v FROM c UNION SELECT s FROM f WHERE t IN (FROM c)) SELECT v AS node_id FROM a INTERSECT SELECT v FROM b",
    "g8_edges_on_cycles": "WITH RECURSIVE g AS MATERIALIZED (SELECT DISTINCT o.o_custkey AS s, p.o_custkey AS t FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey + 1), f AS (SELECT s, t FROM g UNION SELECT f.s, g.t FROM f JOIN g ON g.s = f.t) SELECT g.s AS source_id, g.t AS target_id, g.s = g.t OR EXISTS (SELECT 1 FROM f WHERE f.s = g.t AND f.t = g.s) AS closes FROM g",
    "g8_components": "WITH RECURSIVE g AS MATERIALIZED (SELECT DISTINCT o.o_custkey AS s, p.o_custkey AS t FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey + 1), f AS (SELECT s, t FROM g UNION SELECT f.s, g.t FROM f JOIN g ON g.s = f.t) SELECT a.s AS node_id, min(a.t) AS component FROM f a JOIN f b ON a.s = b.t AND a.t = b.s GROUP BY a.s HAVING count(*) > 1",
    "g8_cycle_test": "SELECT 'n:' || n_nationkey AS source_id, 'r:1' AS target_id, n_regionkey = 1 AS closes FROM nation",
    "g9_adjacency_blocks": f"SELECT node_id, (place - 1) // 8 AS block, string_agg(target_id, ',' ORDER BY target_id) AS targets FROM (SELECT source_id AS node_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS place FROM (SELECT DISTINCT source_id, target_id FROM {_E})) GROUP BY 1, 2",
    "g9_adjacency": f"SELECT node_id, coalesce(string_agg(DISTINCT target_id, ',' ORDER BY target_id), '') AS targets FROM {_N} LEFT JOIN {_E} e ON e.source_id = node_id GROUP BY 1",
    "g12_edge_filter": f"SELECT *, (length(target_id) % 3) / 2.0 AS confidence FROM {_E} WHERE source_id LIKE 'n%' AND (length(target_id) % 3) / 2.0 >= 0.5",
    "g13_recursive_hierarchy": f"SELECT 'r:' || r_regionkey AS root, 0 AS level, 1 AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'r:' || n_regionkey, 1, count(*) FROM nation GROUP BY 1 UNION ALL SELECT 'r:' || n_regionkey, 2, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
}
