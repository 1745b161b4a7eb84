"""Lineage from the text of statements: a table of texts and what each output reads."""

import pytest

from heddlework.operators import lineage, selects
from heddlework.plans.catalog import QUERIES

TEXTS = {
    "SELECT a, b AS x, t.c y, COUNT(*) n FROM db.t t": [("a", "db.t.a"), ("x", "db.t.b"), ("y", "db.t.c"), ("n", "")],
    "SELECT SUM(CASE WHEN s = 'it''s, (x' THEN amt ELSE -fee END) FROM t": [("_col0", "t.s,t.amt,t.fee")],
    "SELECT DISTINCT TIMESTAMPDIFF(DAY, p, q) AS d, DATE '2020-01-01' AS k FROM t FOR SYSTEM_TIME AS OF o.pt AS u": [("d", "t.p,t.q"), ("k", "")],
    "SELECT u.n FROM o JOIN dim FOR SYSTEM_TIME AS OF o.pt AS u ON o.id = u.id": [("n", "dim.n")],
    "SELECT ts + INTERVAL '1' DAY, EXTRACT(YEAR FROM ts) AS y, x::int z FROM t": [("_col0", "t.ts"), ("y", "t.ts"), ("z", "t.x")],
    "SELECT *, w + 1 AS v FROM cat": [("ts", "cat.ts"), ("w", "cat.w"), ("v", "cat.w")],
    "SELECT x.* FROM (SELECT a AS q, 7 AS r FROM t) x": [("q", "t.a"), ("r", "")],
    "SELECT a + a AS d FROM t": [("d", "t.a,t.a")],
    "SELECT (SELECT MAX(k) FROM (SELECT i AS k FROM deep) z) + o.m AS s FROM o": [("s", "deep.i,o.m")],
    "WITH RECURSIVE r AS (SELECT id, n FROM t UNION ALL SELECT c.id, r.n FROM c JOIN r ON c.up = r.id) SELECT id, n FROM r": [("id", "c.id,t.id"), ("n", "t.n")],
    "WITH a AS (SELECT x FROM t), b AS (SELECT x AS y FROM a) SELECT y FROM b": [("y", "t.x")],
    "SELECT window_start, COUNT(DISTINCT p) uv FROM TABLE(TUMBLE(TABLE ev, DESCRIPTOR(ts), INTERVAL '1' HOUR))": [("window_start", "ev.window_start"), ("uv", "ev.p")],
    "SELECT TOP 5 a FROM t": [("a", "t.a")],
    "SELECT a IS DISTINCT FROM b AS d, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY v) AS m FROM t": [("d", "t.a,t.b"), ("m", "t.v")],
}
BROKEN = {"SELECT a FROM t WHERE 'x": "unclosed quote", "SELECT f(a FROM t": "unbalanced brackets", "SELECT a) FROM t (": "unbalanced brackets", "SELECT a, FROM t": "missing output", "SELECT FROM t": "missing output", "DROP TABLE t": "no SELECT", "": "no SELECT", "SELECT a FROM WHERE b": "missing table", "SELECT a FROM t WHERE": "unfinished"}


@pytest.fixture(scope="module")
def found(spark):
    texts = [*TEXTS, *BROKEN, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, sql string")
    catalog = spark.createDataFrame([("cat", "ts", 0), ("cat", "w", 1)], "table_name string, column_name string, ordinal int")
    good, errors = selects.text_lineage(rows, "k", catalog)
    by = {}
    for r in good.orderBy("k", "pos").collect():
        by.setdefault(texts[r.k], []).append((r.target, r.sources))
    return by, {texts[r.k]: r.error for r in errors.collect()}


@pytest.mark.parametrize("text", TEXTS)
def test_sources(found, text):
    assert found[0].get(text) == TEXTS[text]


def test_errors_stay_with_their_statement(found):
    assert found[1] == {**BROKEN, None: "no SELECT"}
    assert not set(BROKEN) & set(found[0])


def test_semicolons_in_literals(spark):
    rows = spark.createDataFrame([(1, "SELECT ';' FROM a;; INSERT INTO t SELECT 'b;c' FROM d;\n SELECT 'open; x")], "k int, s string")
    assert [r.sql for r in lineage.statements(rows, "k", "s").orderBy("pos").collect()] == ["SELECT ';' FROM a", "INSERT INTO t SELECT 'b;c' FROM d", "SELECT 'open"]


def test_no_statements(spark):
    rows = spark.createDataFrame([], "k int, sql string")
    good, errors = selects.text_lineage(rows, "k", spark.createDataFrame([], "table_name string, column_name string, ordinal int"))
    assert good.count() == errors.count() == 0


@pytest.mark.parametrize(("query", "forms"), [("l10_pipeline_lineage", 3), ("l6_function_sources", 4), ("l7_batch_errors", 6)])
def test_statements_of_one_form_are_read_once(spark, sf, monkeypatch, query, forms):
    read, whole = [], selects.token_table

    def counted(stmts, *args):
        read.append(stmts.count())
        return whole(stmts, *args)

    monkeypatch.setattr(selects, "token_table", counted)
    QUERIES[query](spark, sf)
    assert read == [forms]


def test_names_come_back_as_each_statement_spells_them(spark):
    """One form: names in small and capital letters, words that are also names, and columns of other tables."""
    texts = ["SELECT u.Id, U.id AS i, Year, * FROM t1 u", "select v.Key, V.key as k, Year, * from  t2 v -- x", 'SELECT "w"."Id", W.id AS i, Year, * FROM t2 w']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, sql string")
    catalog = spark.createDataFrame([("t1", "Id", 0), ("T2", "Key", 0)], "table_name string, column_name string, ordinal int")
    got = {}
    for r in selects.text_lineage(rows, "k", catalog)[0].orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.target, r.sources, r.operator))
    assert got[0] == [("Id", "t1.Id", "u.Id"), ("i", "t1.id", "U.id"), ("Year", "t1.Year", "Year"), ("Id", "t1.Id", "Id")]
    assert got[1] == [("Key", "t2.Key", "v.Key"), ("k", "t2.key", "V.key"), ("Year", "t2.Year", "Year"), ("Key", "t2.Key", "Key")]
    assert got[2] == [("Id", "t2.Id", '"w"."Id"'), ("i", "t2.id", "W.id"), ("Year", "t2.Year", "Year"), ("Key", "t2.Key", "Key")]
