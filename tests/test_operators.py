"""Behaviour that the driver's tables do not show: odd inputs, limits and order."""

import json
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddlework.functions.text import REDACTED_KEYS, glob_regex, masked, matches_regex, normal_path, partition_values, redacted_json
from heddlework.operators import catalog, graph, inference, lineage, matching, profile, ranks, sketches, temporal
from heddlework.sources import storage
from heddlework.streaming import streams
from heddlework.streaming.streams import audited


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("a*c", ["ac", "abc", "a\nc"], ["abd", "xac"]), ("a?c", ["abc"], ["ac"]), ("[abc]x", ["ax"], ["dx"]), ("[a-c]", ["b"], ["d"]), ("[!a]b", ["cb"], ["ab"]), ("[^a]b", ["cb"], ["ab"]), ("[]]x", ["]x"], ["x"]), ("[ab", [], ["[ab", "a", ""]), ("a.b", ["a.b"], ["axb"]), ("", [""], ["a"])],
)
def test_globs(pattern, yes, no):
    for x in yes:
        assert re.search(glob_regex(pattern), x), x
    for x in no:
        assert not re.search(glob_regex(pattern), x), x


@given(st.text(alphabet="ab*?", max_size=8), st.text(alphabet="ab", max_size=8))
@settings(max_examples=200, deadline=None)
def test_globs_by_definition(pattern, value):
    def match(p, v):
        if not p:
            return not v
        if p[0] == "*":
            return match(p[1:], v) or (bool(v) and match(p, v[1:]))
        return bool(v) and (p[0] == "?" or p[0] == v[0]) and match(p[1:], v[1:])

    assert bool(re.search(glob_regex(pattern), value)) == match(pattern, value)


def test_rules(spark):
    df = spark.createDataFrame([("users",), ("orders",), ("tmp_users",)], "n string")
    names = lambda **r: sorted(x.n for x in matching.filtered(df, "n", r).collect())
    assert names(include=[], exclude=[]) == ["orders", "tmp_users", "users"]
    assert names(include=["*users"], exclude=["tmp*"]) == ["users"]
    assert names(include=["USERS"], exclude=[], case_sensitive=False) == ["users"]
    with pytest.raises(re.error):
        matches_regex(F.col("n"), "(")


def test_text_functions(spark):
    row = spark.range(1).select(
        normal_path(F.lit("/a/12/b/123e4567-e89b-12d3-a456-426614174000")).alias("p"), masked(F.lit("secretvalue"), 2).alias("m"), masked(F.lit("abc"), 2).alias("s"), partition_values(F.lit("dt=2023-01-01/x/region=a=b")).alias("v"), redacted_json(F.lit('{"a": {"password": "x\\"y", "n": 1}}')).alias("j")
    ).first()
    assert (row.p, row.m, row.s) == ("/a/:id/b/:id", "se****ue", "****")
    assert row.v == {"dt": "2023-01-01", "region": "a=b"}
    assert row.j == '{"a": {"password": "[REDACTED]", "n": 1}}'


def test_statistics_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a int, b string")
    rows = {r.column_name: r for r in profile.column_statistics(df).collect()}
    assert rows["a"].null_count == 2 and rows["a"].distinct_count == 0 and rows["a"].min_value is None
    empty = profile.column_statistics(df.filter("false")).collect()
    assert {r.row_count for r in empty} == {0}
    assert profile.table_statistics(df.filter("false")).first().row_count == 0
    assert profile.top_values(df, 3).count() == 0


@pytest.mark.parametrize("odd", [[], [1e300], [float("inf"), float("-inf"), float("nan")], [1.7e308, -1.7e308], [5e-324]])
def test_quartiles_sort_only_the_parts_that_hold_them(spark, monkeypatch, odd):
    """Numbers far from a quartile are counted but not sorted; outliers, infinities and whole numbers beyond a double change no result."""
    sizes = []

    def counted(df, *order, **more):
        sizes.append(df.count())
        return ranks.ranked(df, *order, **more)

    monkeypatch.setattr(profile, "ranked", counted)
    values = [float(x * x % 10007) for x in range(3000)] + odd
    rows = [(v, 2**60 + i % 7, f"t{i % 5}", i % 9) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v double, k long, t string, m int")
    got = {r.column_name: r for r in profile.column_statistics(df).collect()}
    ordered = sorted(values, key=lambda x: (math.isnan(x), x))
    for name, numbers in (("v", ordered), ("k", sorted(float(r[1]) for r in rows)), ("m", sorted(float(r[3]) for r in rows))):
        for q in (25, 50, 75):
            at = (len(numbers) - 1) * q / 100
            a, b = numbers[math.floor(at)], numbers[math.ceil(at)]
            assert got[name][f"p{q}"] == a + (b - a) * (at - math.floor(at))
    assert [got[c].distinct_count for c in "vktm"] == [len(set(map(str, values))), 7, 5, 9]
    assert (got["t"].min_value, got["t"].max_value) == ("t0", "t4")
    if not odd:
        assert sizes and sizes[0] < 60


def test_document_inference(spark):
    docs = [(1, '{"a": {"b": {"c": 1}}, "x": 1}'), (2, '{"a": {"b": 2}, "x": "s"}'), (3, "not json"), (4, None), (5, "[1]"), (6, '{"x": null}')]
    df = spark.createDataFrame(docs, "id int, doc string")
    out = {r.path: r for r in inference.inferred_documents(df, "doc", "id").collect()}
    assert set(out) == {"a", "a.b", "a.b.c", "x"}
    assert out["x"].kinds == "integer=1,null=1,string=1" and out["x"].data_type == "integer" and out["x"].nullable
    assert {r.path for r in inference.document_values(df, "doc", "id", max_depth=1).collect()} == {"a", "x"}
    assert inference.inferred_documents(df.filter("false"), "doc", "id").count() == 0


def test_text_kinds(spark):
    values = {"": "null", "NA": "null", "1": "boolean", "yes": "boolean", "12": "integer", "-3": "integer", "1.5": "number", "1e3": "number", "99999999999999999999": "number", "x": "string", " 7 ": "integer"}
    df = spark.createDataFrame([(k, v) for k, v in values.items()], "v string, k string")
    assert [r.v for r in df.withColumn("g", inference.text_kind(F.col("v"))).filter("g <> k").collect()] == []


@pytest.mark.parametrize(("key", "pattern"), [("user:123", "user:*"), ("order:2023:01:15:123", "order:*:*:*:*"), ("cache:user:123:profile", "cache:user:*:profile"), ("plain", "plain"), ("a-5-b", "a-*-b")])
def test_key_patterns(spark, key, pattern):
    assert spark.range(1).select(inference.key_pattern(F.lit(key)).alias("p")).first().p == pattern


def test_graph_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "source_id string, target_id string")
    start = spark.createDataFrame([("a",)], "node_id string")
    assert {(r.node_id, r.depth) for r in graph.reached(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node_id for r in graph.reached(e, start, 1).collect()} == {"a", "b"}
    assert {r.node_id for r in graph.cyclic_nodes(e).collect()} == {"a", "b", "c", "e"}
    closing = {(r.source_id, r.target_id): r.closes for r in graph.closes_cycle(e, spark.createDataFrame([("d", "a"), ("d", "e")], "source_id string, target_id string")).collect()}
    assert closing == {("d", "a"): True, ("d", "e"): False}
    assert graph.reached(e, start.filter("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_by_definition(spark, seed):
    """Nodes on a cycle, or on a way from one to another; and candidates, whose source is reached from their target."""
    r = random.Random(seed)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(32)}
    reach = {v: {v} for v in range(30)}
    for _ in range(30):
        for a, b in edges:
            reach[a] |= reach[b]
    on = {a for a, b in edges if a in reach[b]}
    wanted = {v for v in range(30) if reach[v] & on and any(v in reach[c] for c in on)}
    frame = spark.createDataFrame(sorted(edges), "source_id int, target_id int")
    assert {x.node_id for x in graph.cyclic_nodes(frame).collect()} == wanted
    candidates = [(r.randrange(30), r.randrange(30)) for _ in range(20)]
    found = graph.closes_cycle(frame, spark.createDataFrame(candidates, "source_id int, target_id int")).collect()
    assert sorted((x.source_id, x.target_id, x.closes) for x in found) == sorted((a, b, a in reach[b]) for a, b in candidates)


@pytest.mark.parametrize("ring", [False, True])
def test_long_chains_take_few_rounds(spark, monkeypatch, ring):
    """A chain of 10 000 edges, and the same with an edge back: tables written grow with its logarithm."""
    written, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: written.append(1) or kept(df))
    chain = spark.range(10_000).selectExpr("id AS source_id", "id + 1 AS target_id")
    if ring:
        chain = chain.unionByName(spark.sql("SELECT 10000L AS source_id, 5L AS target_id"))
    found = graph.components(chain)
    assert (found.count(), found.filter("component <> 5").count()) == ((9_996, 0) if ring else (0, 0))
    assert len(written) <= 40


def test_components_by_definition(spark):
    """Chains into rings, rings of runs, double ways between nodes."""
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 6), (8, 8), (9, 1), (7, 10), (10, 11), (12, 13), (13, 14), (14, 12), (12, 15), (15, 14), (20, 21), (21, 22), (22, 20)]
    found = graph.components(spark.createDataFrame(edges, "source_id int, target_id int"))
    assert {r.node_id: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 12: 12, 13: 12, 14: 12, 15: 12, 20: 20, 21: 20, 22: 20}


def test_lineage_of_statements(spark):
    scripts = spark.createDataFrame([(1, "-- c\nINSERT INTO a.b SELECT x FROM c JOIN D ON 1=1; nonsense; SELECT * FROM e")], "id int, t string")
    s = lineage.statements(scripts, "id", "t")
    assert {(r.target, r.source) for r in lineage.table_lineage(s, "id").collect()} == {("a.b", "c"), ("a.b", "d"), ("RESULT_SET", "e")}
    bad = spark.createDataFrame([(1, "CREATE TABLE broken")], "id int, sql string")
    good, errors = lineage.ddl_columns(bad, "id")
    assert good.count() == 0 and errors.count() == 1


def test_views_with_a_loop_are_an_error(spark):
    edges = spark.createDataFrame([("v", "w"), ("w", "v"), ("x", "base")], "target string, source string")
    with pytest.raises(ValueError, match="come from themselves"):
        lineage.to_base(edges, rounds=3)
    assert [tuple(r) for r in lineage.to_base(edges.filter("target = 'x'"), rounds=3).collect()] == [("x", "base")]


def _times(spark, rows):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, c, t0 + timedelta(seconds=s)) for i, (c, s) in enumerate(rows)], "id int, c string, t timestamp")


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=25))
@settings(max_examples=6, deadline=None, phases=[Phase.generate])
def test_sliding_limit_by_definition(spark, rows):
    got = {r.id: r.allowed for r in temporal.sliding_decisions(_times(spark, rows), "c", "t", "id", 2, 10).collect()}
    allowed = []
    for i, (c, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        ok = sum(1 for d, u in allowed if d == c and s - u < 10) < 2
        assert got[i] == ok
        if ok:
            allowed.append((c, s))


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 90)), min_size=1, max_size=40))
@settings(max_examples=5, deadline=None, phases=[Phase.generate])
def test_bucket_limit_by_definition(spark, rows):
    got = {r.id: r.allowed for r in temporal.bucket_decisions(_times(spark, rows), "c", "t", "id", 4, 2, 10).collect()}
    state = {}
    for i, (c, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        began, refilled, count, tokens = state.get(c, (None, None, 0, 0))
        if began is None or s - began >= 10:
            began, refilled, count, tokens = s, s, 0, 2
        elif int((s - refilled) * 4 / 10) > 0:
            tokens, refilled = min(2, tokens + int((s - refilled) * 4 / 10)), s
        ok = count < 4 and tokens > 0
        assert got[i] == ok
        state[c] = (began, refilled, count + ok, tokens - ok)


def test_one_client_is_many_groups(spark):
    """One client has all requests, three in four seconds without a pause: its walks, pieces and windows are dealt over many tasks."""
    n = 3000
    df = spark.range(n).selectExpr("CAST(id AS int) AS id", "'a' AS c", "timestamp_seconds(1700000000 + id * 4 DIV 3) AS t", "element_at(array('v', 'c', 'p'), CAST(id % 3 + 1 AS int)) AS e")
    sliding = temporal.sliding_decisions(df, "c", "t", "id", 20, 10)
    bucket = temporal.bucket_decisions(df, "c", "t", "id", 4, 2, 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (sliding, bucket):
            sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()]
            assert sum(sizes) == n and max(sizes) < n / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert temporal.funnel(df, "c", "t", "id", "e", ["v", "c", "p"], 10).first().level == 3
    assert temporal.paths(df, "c", "t", "id", "e", "v", "c", "p", 0, 10).first().n_matches == n // 3


@pytest.mark.parametrize("seed", [1, 2])
def test_funnels_and_paths_by_definition(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3]), r.choice("vcpx"), r.randrange(120), i) for i in range(150)]
    df = spark.createDataFrame([(k, e, datetime(2024, 1, 1) + timedelta(seconds=s), i) for k, e, s, i in rows], "k int, e string, t timestamp, i int")
    for steps in (["v", "c", "p"], ["v", "v", "c"], ["c"]):
        best = {}
        for k in {x[0] for x in rows if x[1] in steps}:
            events = sorted((s, i, e) for a, e, s, i in rows if a == k)
            began, level = [None] * len(steps), 0
            for s, _, e in events:
                for n in range(len(steps) - 1, -1, -1):
                    first = s if n == 0 else began[n - 1]
                    if steps[n] == e and first is not None and s - first <= 10:
                        began[n] = max(first, began[n] or first)
                        level = max(level, n + 1)
            best[k] = level
        assert {x.k: x.level for x in temporal.funnel(df, "k", "t", "i", "e", steps, 10).collect()} == best
    counts = {}
    for k in (1, 2, 3):
        began = None
        for s, _, e in sorted((s, i, e) for a, e, s, i in rows if a == k):
            if e == "p" and began is not None and 2 <= s - began <= 15:
                counts[k] = counts.get(k, 0) + 1
            began = s if e == "v" else began if e == "c" else None
    assert {x.k: x.n_matches for x in temporal.paths(df, "k", "t", "i", "e", "v", "c", "p", 2, 15).collect()} == counts


def test_bucket_limit(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), ("a", 5), ("a", 11), ("a", 11), ("a", 11)]
    got = [r.allowed for r in temporal.bucket_decisions(_times(spark, rows), "c", "t", "id", 4, 2, 10).orderBy("id").collect()]
    assert got == [True, True, False, True, True, True, False]


def test_stream_limit_equals_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 1), ("a", 2), ("b", 2), ("a", 12), ("a", 13)]
    _times(spark, rows).write.parquet(f"{tmp_path}/in/x.parquet")
    stream = spark.readStream.schema("id int, c string, t timestamp").parquet(f"{tmp_path}/in/x.parquet").withWatermark("t", "1 minute")
    got = streams.upsert_sink(streams.limited(stream, "c", "t", 2, 10), [], "append")
    batch = temporal.sliding_decisions(_times(spark, rows), "c", "t", "id", 2, 10)
    assert sorted((r.c, r.t, r.allowed) for r in got.collect()) == sorted((r.c, r.t, r.allowed) for r in batch.collect())


def test_many_rules_are_looked_up(spark):
    """100 000 rules, with and without plain characters, against the same by Python; no nested loop in the plan."""
    names = [f"table_{i:04d}_{'abc'[i % 3]}" for i in range(300)] + ["ab", "x.y", "", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    few = ["^table_00.*", "_02[0-4]._b$", "tab?le_01", "(0105|0106)_", r"x\\.y", "^ab$", "table_029[^5]", "zzz+", "0{3}1_"]
    many = spark.range(100_000).selectExpr("concat('^other_', id, '$') AS pattern", "id % 2 = 0 AS exclude")
    plain = spark.createDataFrame([(p, i % 3 == 1) for i, p in enumerate(few)], "pattern string, exclude boolean")
    got = [r.name for r in matching.filtered_by_table(df, "name", plain.unionByName(many)).collect()]
    hit = lambda n, x: any(re.search(p.replace("\\\\", "\\"), n) for i, p in enumerate(few) if (i % 3 == 1) == x)
    assert sorted(got) == sorted(n for n in names if n is not None and not hit(n, True) and hit(n, False))
    out = matching.filtered_by_table(df, "name", many.unionByName(plain.filter("pattern LIKE '^table%'")))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_templates_by_trie(spark):
    paths = ["/a/b", "/a/b/c", "/a/x/c", "/a/", "/", "", "a", "/a/*/c", "/q/b/c", None, "/a//c"]
    templates = [("/a/*/c", 1), ("/a/b/c", 2), ("/*/b", 3), ("/a", 4), ("", 5), ("/*/*/*", 6), ("/a/b.c", 7)]
    df = matching.with_template(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(templates, "template string, code int"))
    fits = lambda t, p: len(t.split("/")) == len(p.split("/")) and all(x == y or (x == "*" and y) for x, y in zip(t.split("/"), p.split("/"), strict=True))
    for r in df.collect():
        best = min((("*" in t, t, c) for t, c in templates if r.path is not None and fits(t, r.path)), default=None)
        assert r.code == (best and best[2]), r


def _appended(stream, path):
    """Runs a stream over the files that are there, from its checkpoint on, and gives all rows written so far."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").collect()


def test_stream_limit_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [("a", 0), ("a", 1), ("b", 2), ("a", 3), ("a", 11), ("b", 12), ("a", 12), ("b", 13)]
    wanted = sorted((r.c, r.t, r.allowed) for r in temporal.sliding_decisions(_times(spark, rows), "c", "t", "id", 2, 10).collect())
    for half in ("id < 4", "id >= 4"):
        _times(spark, rows).filter(half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id int, c string, t timestamp").parquet(f"{tmp_path}/in").withWatermark("t", "1 minute")
        got = _appended(streams.limited(stream, "c", "t", 2, 10), tmp_path)
        assert len(got) in (4, 8)
    assert sorted((r.c, r.t, r.allowed) for r in got) == wanted


def test_stream_takes_late_versions_and_goes_on(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    events = [[(1, "a", at(10)), (2, "a", at(40)), (3, "b", at(5))], [(4, "a", at(60)), (5, "b", at(70)), (6, "c", at(65))], [(9, "x", at(10_000))]]
    versions = [[("a", at(0), "v0"), ("a", at(50), "v50"), ("b", at(6), "w6")], [("a", at(30), "v30"), ("a", at(50), "v51")], [("x", at(10_000), "end")]]
    for e, v in zip(events, versions, strict=True):
        spark.createDataFrame(e, "id int, k string, t timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        spark.createDataFrame(v, "k string, since timestamp, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/v")
        left = spark.readStream.schema("id int, k string, t timestamp").parquet(f"{tmp_path}/e").withWatermark("t", "30 seconds")
        right = spark.readStream.schema("k string, since timestamp, v string").parquet(f"{tmp_path}/v").withWatermark("since", "30 seconds")
        got = {r.id: r.v for r in _appended(streams.versioned(left, right, "k", "t", "since", ["v"]), tmp_path)}
    assert got == {1: "v0", 2: "v30", 3: None, 4: "v51", 5: "w6", 6: None}


def test_stream_versions_take_few_state_calls(spark, tmp_path):
    """Keys share chunks of state: 400 keys of 20 rows each write no more of them than there are buckets."""
    t0 = datetime(2024, 1, 1)
    rows = spark.range(8_000).selectExpr("CAST(id AS INT) AS id", "concat('k', id % 400) AS k", f"TIMESTAMP '{t0}' + make_dt_interval(0, 0, 0, id) AS t")
    rows.write.parquet(f"{tmp_path}/e")
    rows.selectExpr("k", "t + INTERVAL 1 SECOND AS since", "CAST(id AS STRING) AS v").write.parquet(f"{tmp_path}/v")
    for name, time in (("e", "id int, k string, t timestamp"), ("v", "k string, since timestamp, v string")):
        spark.createDataFrame([(-1, "end", datetime(2025, 1, 1))] if name == "e" else [("end", datetime(2025, 1, 1), "")], time).write.mode("append").parquet(f"{tmp_path}/{name}")
    left = spark.readStream.schema("id int, k string, t timestamp").parquet(f"{tmp_path}/e").withWatermark("t", "30 seconds")
    right = spark.readStream.schema("k string, since timestamp, v string").parquet(f"{tmp_path}/v").withWatermark("since", "30 seconds")
    stream = streams.versioned(left, right, "k", "t", "since", ["v"], buckets=8).select("id", "v")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.id: r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: str(i - 400) if i >= 400 else None for i in range(8_000)}
    assert max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) <= 100


def test_funnel_takes_the_best_walk(spark):
    rows = [(1, "v", 0), (1, "v", 50), (1, "c", 55), (1, "p", 58), (2, "c", 0), (2, "v", 5), (3, "v", 0), (3, "c", 100)]
    df = spark.createDataFrame([(k, e, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, e, s in rows], "k int, e string, t timestamp")
    assert {r.k: r.level for r in temporal.funnel(df, "k", "t", "e", "e", ["v", "c", "p"], 10).collect()} == {1: 3, 2: 1, 3: 1}


def test_as_of_sees_the_same_instant(spark):
    t = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, t, "x"), (2, t, "y")], "k int, t timestamp, n string")
    right = spark.createDataFrame([(1, t, 5), (1, t - timedelta(days=1), 4)], "k int, since timestamp, price int")
    assert {r.n: r.price for r in temporal.as_of(left, right, "k", "t", "since", ["price"]).collect()} == {"x": 5, "y": None}


def test_pages(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    page, token, total = matching.listed(df, ["k"], "20", 10)
    assert [r.k for r in page.collect()] == [20, 21, 22, 23, 24] and token is None and total == 25
    page, token, _ = matching.listed(df, ["k"], "bad", 10)
    assert page.count() == 10 and token == "10"
    assert [r.k for r in matching.numbered_page(df, ["k"], 2, 10).collect()] == list(range(10, 20))


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert {r.k: r.v for r in catalog.upserted(old, new, ["k"], "n").collect()} == {1: "a", 2: "y", 3: "z"}


def test_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text("skip me\nname,age\nx,1\nbroken\ny,2\n")
    got = storage.csv_text(spark, f"{tmp_path}/c", skip_rows=1)
    assert got.columns == ["name", "age"] and sorted(r.name for r in got.collect()) == ["x", "y"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/one.json").write_text('{"a": 1}')
    (tmp_path / "j/many.json").write_text('[{"a": 2}, {"a": 3}]')
    assert storage.json_documents(spark, f"{tmp_path}/j").count() == 3
    assert storage.object_listing(spark, f"{tmp_path}/j").count() == 2
    spark.createDataFrame([(1, (2, "x"))], "a int, b struct<c:int,d:string>").write.parquet(f"{tmp_path}/p")
    assert [r.name for r in storage.parquet_columns(spark, f"{tmp_path}/p").collect()] == ["a", "b", "b.c", "b.d"]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, d string")
    storage.overwrite_partitions(df, f"{tmp_path}/o", "d")
    storage.overwrite_partitions(spark.createDataFrame([(9, "y")], "k int, d string"), f"{tmp_path}/o", "d")
    assert {(r.k, r.d) for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {(1, "x"), (9, "y")}


def test_export_and_import(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert [r.text for r in storage.exported(df, "json").collect()] == ['{"id":1,"name":"a"}', '{"id":2}']
    assert storage.exported(df, "yaml").first().text == '- id: "1"\n  name: "a"'
    lines = spark.createDataFrame([('{"id": 1, "name": "a"}',), ("{bad",), ('{"name": "b"}',)], "line string")
    good, bad = storage.imported(lines, "line", "id int, name string", ["id"])
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["malformed", "missing id"]


def test_quoted_fields_stay_whole(spark, tmp_path):
    lines = ['id,name', '1,"Doe, Jane"', '2,plain', '3,one,too many', '4', '5,"a ""b"", c"']
    df = spark.createDataFrame([(x,) for x in lines[1:]], "line string")
    assert sorted(tuple(r) for r in inference.delimited(df, "line", ["id", "name"]).collect()) == [("1", "Doe, Jane"), ("2", "plain"), ("5", 'a "b", c')]
    assert sorted(r.malformed for r in inference.parsed_lines(df, "line", ["id", "name"]).filter("malformed IS NOT NULL").collect()) == ["3,one,too many", "4"]
    (tmp_path / "a.csv").write_text("\n".join(["skipped", *lines]))
    rows = storage.csv_text(spark, str(tmp_path / "a.csv"), skip_rows=1)
    assert rows.columns == ["id", "name"] and sorted(tuple(r) for r in rows.collect()) == [("1", "Doe, Jane"), ("2", "plain"), ("5", 'a "b", c')]


def test_ranks_over_ranges(spark):
    from heddlework.operators.ranks import ranked

    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), (F.col("id") % 3).alias("n")).repartition(6)
    rows = sorted(ranked(df, F.desc("k"), total="n").collect(), key=lambda r: -r.k)
    assert [r["rank"] for r in rows] == list(range(500))
    total = 0
    for r in rows:
        total += r.n
        assert r.running == total
    assert ranked(df.filter("false"), F.col("k")).count() == 0


def redacted(v):
    if isinstance(v, dict):
        return {k: "[REDACTED]" if k in REDACTED_KEYS else redacted(x) for k, x in v.items()}
    return [redacted(x) for x in v] if isinstance(v, list) else v


def nested(rnd, depth):
    kind = rnd.random()
    if depth and kind < 0.5:
        return {rnd.choice([*REDACTED_KEYS, "a", 'k"q', "pass\\word", "x y"]): nested(rnd, depth - 1) for _ in range(rnd.randint(0, 4))}
    if depth and kind < 0.7:
        return [nested(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([1, -2.5, True, None, "token", 'a}"]{[,:\\', "é😀", "", '"password": "x"'])


def test_secrets_are_redacted_at_any_depth(spark):
    rnd = random.Random(4)
    deep = {"password": {"deep": ["LEAK"]}}
    docs = [nested(rnd, 6) for _ in range(300)] + [{"credentials": [[[[["LEAK"]]]]]}, [{"k": i, "token": [i]} for i in range(2000)]]
    for i in range(30):
        docs.append(deep)
        deep = {"a": deep} if i % 2 else [deep, 1]
    texts = [json.dumps(d, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5) for d in docs]
    texts = [t.replace('"password"', '"pass\\u0077ord"') if i % 3 == 0 else t for i, t in enumerate(texts)]
    odd = {None: None, "": "", "plain text": "plain text", "5": "5", '"token"': '"token"', '{"password": "x': "[REDACTED]", "{'password': 'x'}": "[REDACTED]", '{"a": "u, "secret": "x"}': "[REDACTED]"}
    df = spark.createDataFrame(list(enumerate([*texts, *odd])), "i int, t string")
    got = {r.i: r.r for r in df.select("i", redacted_json(F.col("t")).alias("r")).collect()}
    assert all(json.loads(got[i]) == redacted(d) for i, d in enumerate(docs))
    assert [got[len(docs) + i] for i in range(len(odd))] == list(odd.values())


def test_audit_hides_a_deep_secret(spark):
    deep = '{"a": [' * 9 + '{"token": {"x": ["LEAK"]}}' + "]}" * 9
    row = audited(spark.createDataFrame([(1, "login", deep)], "event_id long, action string, details string"), "details").first()
    assert "LEAK" not in row.details and "[REDACTED]" in row.details


def test_merged_profiles(spark, monkeypatch):
    """Two halves make the profile of the whole, exactly where that is exact; quartiles are exact even with useless brackets."""
    rows = [(i, float(i % 97) if i % 5 else None, f"k{i % 13}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double, k string, e double").repartition(4)
    exact = ["column_name", "row_count", "null_count", "min_text", "max_text", "min", "max"]
    whole, both = sketches.sketched(df), sketches.merged(sketches.sketched(df.filter("id < 1000")), sketches.sketched(df.filter("id >= 1000")))
    assert sorted(map(tuple, whole.select(exact).collect()), key=str) == sorted(map(tuple, both.select(exact).collect()), key=str)
    said = {r.column_name: r for r in sketches.described(both).collect()}
    assert abs(said["id"].about_distinct - 3000) < 200 and said["k"].about_distinct == 13
    assert abs(said["id"].mean - 1499.5) < 1e-9 and abs(said["id"].stddev - 866.1697294) < 1e-6 and abs(said["id"].about_p50 - 1500) < 30
    wanted = {c: tuple(round(x, 9) for x in np.percentile([r[i] for r in rows if r[i] is not None], (25, 50, 75))) for i, c in ((0, "id"), (1, "v"))}
    for profile in (both, sketches.sketched(df.filter("id >= 2900")).withColumn("row_count", F.lit(3000)).withColumn("null_count", F.when(F.col("column_name") == "v", 600).when(F.col("column_name") == "id", 0).otherwise(3000))):
        bounds = profile.withColumn("min", F.when(F.col("min").isNotNull(), F.lit(0.0))).withColumn("max", F.when(F.col("column_name") == "id", 2999.0).when(F.col("column_name") == "v", 96.0))
        got = {r.column_name: tuple(round(x, 9) for x in r[1:]) for r in sketches.exact_quartiles(df, bounds).collect()}
        assert got == wanted
    assert sketches.described(sketches.sketched(df.filter("false"))).count() == 4


def test_places_and_percentiles_of_one_hot_key(spark):
    """One key and a null key have nearly all rows: they lie in several partitions, and places and sums are by key."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + [None, "b"]), float(rng.randrange(500)), i) for i in range(3000)] + [("c", None, 3000), ("one", 7.0, 3001)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(6)
    got = ranks.within(df, ["k"], F.col("i"), total="i").withColumn("p", F.spark_partition_id()).collect()
    by = {}
    for k, _, i in rows:
        by.setdefault(k, []).append(i)
    for r in got:
        assert r.place == by[r.k].index(r.i) and r.running == sum(by[r.k][: r.place + 1])
    assert len(got) == len(rows)
    found = {r.k: r.p for r in ranks.percentile_within(df, ["k"], "v", 0.95, "p").collect()}
    values = {k: [v for k2, v, _ in rows if k2 == k and v is not None] for k in by}
    assert found.keys() == {k for k, v in values.items() if v}
    for k, p in found.items():
        assert p == pytest.approx(np.percentile(values[k], 95))


def test_adjacency_in_blocks(spark):
    edges = spark.createDataFrame([("hub", f"t{i:04}") for i in range(2500)] * 2 + [("a", "b")], "source_id string, target_id string")
    got = {(r.node_id, r.block): r.targets for r in graph.adjacency_blocks(edges).collect()}
    assert {k: len(v) for k, v in got.items()} == {("hub", 0): 1024, ("hub", 1): 1024, ("hub", 2): 452, ("a", 0): 1}
    assert [t for b in range(3) for t in got[("hub", b)]] == [f"t{i:04}" for i in range(2500)]


def test_complexity_sorts_no_names(spark, sf):
    """Outputs and their counted sources are all that is joined: one table of insert columns less is sorted in a task."""
    from heddlework.plans.lineages import a30

    assert a30(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
