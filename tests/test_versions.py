"""Tables in versions: failures, overtaking, what an upsert touches, old versions and their removal."""

import pytest
from pyspark.sql import functions as F

from heddlework.operators.catalog import stored, upserted
from heddlework.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v string")


def put(df, path, change=None, **more):
    return versions.commit(df, path, ["id"], change or (lambda old, new: upserted(old, new, ["id"])), **more)


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    put(frame(spark, [(i, "a") for i in range(200)]), path, buckets=8)
    before = versions._manifest(spark, path, 1)["folders"]
    assert len(before) == 8
    put(frame(spark, [(7, "b")]), path)
    after = versions._manifest(spark, path, 2)["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows(versions.at_version(spark, path)) == sorted([(i, "b" if i == 7 else "a") for i in range(200)])
    assert rows(versions.at_version(spark, path, 1)) == [(i, "a") for i in range(200)]


def test_a_write_that_dies_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    put(frame(spark, [(i, "a") for i in range(50)]), path, buckets=4)
    dies = lambda old, new: upserted(old, new, ["id"]).withColumn("v", F.when(F.col("id") == 40, F.raise_error(F.lit("lost")).cast("string")).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        put(frame(spark, [(i, "b") for i in range(50)]), path, dies)
    assert versions.versions(spark, path) == [1]
    assert rows(versions.at_version(spark, path)) == [(i, "a") for i in range(50)]


def test_overtaken_commits_start_again(spark, tmp_path):
    path = str(tmp_path / "t")
    put(frame(spark, [(1, "a"), (2, "a")]), path, buckets=1)
    first = []

    def change(old, new):
        if not first:
            first.append(put(frame(spark, [(2, "other")]), path))
        return upserted(old, new, ["id"])

    assert put(frame(spark, [(1, "mine")]), path, change) == 3
    assert rows(versions.at_version(spark, path)) == [(1, "mine"), (2, "other")]
    with pytest.raises(versions.Overtaken):
        versions._publish(spark, path, 3, {})


def test_rows_may_go_and_vacuum_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path / "t")
    put(frame(spark, [(i, "a") for i in range(20)]), path, buckets=4)
    put(frame(spark, [(i, "x") for i in range(20)]), path, lambda old, new: old.join(new, "id", "left_anti"))
    assert rows(versions.at_version(spark, path)) == []
    put(frame(spark, [(3, "c")]), path)
    versions.vacuum(spark, path, keep=2)
    assert versions.versions(spark, path) == [2, 3]
    assert rows(versions.at_version(spark, path, 2)) == [] and rows(versions.at_version(spark, path)) == [(3, "c")]
    with pytest.raises(ValueError):
        versions.at_version(spark, path, 1)
    assert len([p for p in (tmp_path / "t/data").iterdir() if p.is_dir()]) == 1


def test_stored_edges_and_empty_tables(spark, tmp_path):
    edges = spark.createDataFrame([("e", "a", "b", None, 1), ("e", "a", "c", 0.5, 2), (None, "n", "n", 0.25, 1)], "id string, source_id string, target_id string, confidence double, updated_at int")
    got = stored({"lineage_edges": edges, "lineage_nodes": spark.createDataFrame([], "id string, updated_at int")}, str(tmp_path))
    assert [(r.id, r.target_id, float(r.confidence)) for r in got["lineage_edges"].orderBy("updated_at", "id").collect()] == [(None, "n", 0.25), ("e", "c", 0.5)]
    assert rows(got["lineage_nodes"]) == []
