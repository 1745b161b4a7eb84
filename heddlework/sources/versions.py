"""Tables in versions: new files first, then one pointer; a reader sees a whole version, an old one until it is vacuumed.

``path/data/<run>/_bucket=<n>`` has the rows of a bucket as one commit wrote them, ``path/versions/<n>.json`` the
folder of every bucket in version n. A commit writes the buckets that its keys fall into, then renames
its list into place. What fails before that leaves files that no version names. The rename has to be
refused where the name is taken, as HDFS does; a commit that comes second then starts again on the newer version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import cut


class Overtaken(RuntimeError):
    """Another commit has taken the version."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, in order."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version}.json", wholetext=True).first()[0])


def _read(spark: SparkSession, path: str, schema: StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{f}" for f in folders))


def at_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows, the newest by default."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {'at all' if version is None else version} below {path}")
    m = _manifest(spark, path, known[-1] if version is None else version)
    return _read(spark, path, StructType.fromJson(m["schema"]), list(m["folders"].values()))


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{path}/versions"))
    waiting, name = at(f"{path}/versions/.{uuid.uuid4().hex}"), at(f"{path}/versions/{version}.json")
    out = fs.create(waiting, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(name) or not fs.rename(waiting, name):
        fs.delete(waiting, False)
        raise Overtaken(f"version {version} of {path} is taken")


def commit(df: DataFrame, path: str, keys: list[str], change, buckets: int = 64, tries: int = 5) -> int:
    """Makes the next version of a table and returns its number: ``change(old, new)`` gives the rows of the buckets that the new rows' keys fall into.

    All other buckets stay as they are, so a commit reads and writes in proportion to what it touches. The number
    of buckets and the columns are those of the first version. Lists on the driver are as long as there are buckets.
    """
    spark = df.sparkSession
    for left in range(tries, 0, -1):
        known = versions(spark, path)
        last = _manifest(spark, path, known[-1]) if known else {"schema": json.loads(df.schema.json()), "buckets": buckets, "folders": {}}
        schema = StructType.fromJson(last["schema"])
        bucket = F.pmod(F.xxhash64(*keys), F.lit(last["buckets"])).cast("int")
        new = cut(df.select(*schema.names).withColumn("_bucket", bucket), "new")
        touched = {str(r[0]) for r in new.select("_bucket").distinct().collect()}
        old = _read(spark, path, schema, [f for b, f in last["folders"].items() if b in touched])
        run = uuid.uuid4().hex
        change(old, new.drop("_bucket")).withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{run}")
        fs, at = _files(spark, path)
        written = {b: f"{run}/_bucket={b}" for b in touched if fs.exists(at(f"{path}/data/{run}/_bucket={b}"))}
        folders = {b: f for b, f in last["folders"].items() if b not in touched} | written
        version = (known[-1] if known else 0) + 1
        try:
            _publish(spark, path, version, {**last, "folders": folders})
            return version
        except Overtaken:
            if left == 1:
                raise
    raise AssertionError


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all but the last versions and the files that only others have; no commit may be under way."""
    known = versions(spark, path)
    fs, at = _files(spark, path)
    named = {f for v in known[-keep:] for f in _manifest(spark, path, v)["folders"].values()}
    for v in known[:-keep]:
        fs.delete(at(f"{path}/versions/{v}.json"), False)
    for run in fs.listStatus(at(f"{path}/data")):
        name = run.getPath().getName()
        for part in fs.listStatus(run.getPath()):
            if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in named:
                fs.delete(part.getPath(), True)
        if not any(f.startswith(f"{name}/") for f in named):
            fs.delete(run.getPath(), True)
