"""Files: listings, scans for inference, sinks, and the folder that all executors share."""

from __future__ import annotations

import atexit
import csv
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below the one named in ``spark.checkpoint.dir``; only a session in one local process may do without that setting.

    What operators write there is read by the DataFrames they return; ``release`` removes it all.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(shared_folder, "own", None)
        if named is None:
            named = shared_folder.own = tempfile.mkdtemp(prefix="heddlework-")
            atexit.register(shutil.rmtree, named, True)
    return f"{named.rstrip('/')}/heddlework-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later stages depend on its files alone."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what this session's operators wrote into the shared folder, once no DataFrame of theirs is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a path: name, size and time of change; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("object_name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def csv_text(spark: SparkSession, path: str, sep: str = ",", header: bool = True, skip_rows: int = 0) -> DataFrame:
    """Delimited files as columns of text, malformed rows left out; without a header column_1 to column_n.

    Skipped rows are the first lines of each file, which stand in the file's first block.
    """
    if not skip_rows:
        df = spark.read.csv(path, sep=sep, escape='"', header=header, mode="DROPMALFORMED", inferSchema=False)
        return df if header else df.toDF(*(f"column_{i + 1}" for i in range(len(df.columns))))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    first = lines.filter("_b = 0").withColumn("_r", F.row_number().over(Window.partitionBy("_f").orderBy("_i")))
    head = first.filter(F.col("_r") == skip_rows + 1).select("value").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "column_1 string")
    names = next(csv.reader([head[0][0]], delimiter=sep))
    names = [c.strip() for c in names] if header else [f"column_{i + 1}" for i in range(len(names))]
    rows = first.filter(F.col("_r") > skip_rows + header).select("value").unionByName(lines.filter("_b > 0").select("value"))
    # Fields are counted by the parser, so a separator in quotes counts as none.
    schema = ", ".join(f"`{n}` STRING" for n in names) + ", `_malformed` STRING"
    x = F.from_csv("value", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    return rows.select(x.alias("x")).filter("x._malformed IS NULL").select(*(F.col("x")[n].alias(n) for n in names))


def json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON files of one object or an array of objects (or one object to a line) as rows of text."""
    if lines:
        return spark.read.text(path).select(F.col("value").alias("doc"))
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    array = F.schema_of_variant("v").startswith("ARRAY")
    parts = spark.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("item"))
    many = whole.filter(array).lateralJoin(parts).select(F.to_json("item").alias("doc"))
    return whole.filter("v IS NOT NULL").filter(~array).select(F.to_json("v").alias("doc")).unionByName(many)


def parquet_columns(spark: SparkSession, path: str) -> DataFrame:
    """Columns of Parquet files, nested ones by dotted name."""
    rows: list[tuple] = []

    def walk(fields, prefix: str) -> None:
        for f in fields:
            rows.append((len(rows) + 1, prefix + f.name, f.dataType.simpleString(), f.nullable))
            if hasattr(f.dataType, "fields"):
                walk(f.dataType.fields, f"{prefix}{f.name}.")

    walk(spark.read.parquet(path).schema.fields, "")
    return spark.createDataFrame(rows, "ordinal int, name string, data_type string, nullable boolean")


def exported(df: DataFrame, form: str) -> DataFrame:
    """Rows as text: json, csv or yaml (flat)."""
    if form == "json":
        return df.select(F.to_json(F.struct(*df.columns)).alias("text"))
    if form == "csv":
        return df.select(F.to_csv(F.struct(*df.columns)).alias("text"))
    items = [F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit('[""]'))) for i, c in enumerate(df.columns)]
    return df.select(F.regexp_replace(F.concat_ws("\n", *items), r': \[(.*)\](?=\n|$)', ": $1").alias("text"))


def imported(lines: DataFrame, column: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON lines as rows: the good ones, and the others with the reason."""
    parsed = lines.select(F.col(column).alias("line"), F.from_json(column, f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    missing = F.concat_ws(",", *(F.when(F.col(f"x.{c}").isNull(), F.lit(c)) for c in required))
    reason = F.when(F.col("x").isNull() | F.col("x._corrupt").isNotNull(), "malformed").when(missing != "", F.concat(F.lit("missing "), missing))
    judged = parsed.withColumn("error", reason)
    return judged.filter("error IS NULL").select("x.*").drop("_corrupt"), judged.filter("error IS NOT NULL").select("line", "error")


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that the rows are in and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, *by: str) -> None:
    """A table in buckets, so that joins and groups on the columns need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)


def sampled(df: DataFrame, size: int, seed: int = 0, first: bool = False, drop: tuple[str, ...] = ("_id",)) -> DataFrame:
    """At most size rows, at random or the first that come, without generated ids."""
    df = df.drop(*drop)
    return df.limit(size) if first else df.orderBy(F.rand(seed)).limit(size)


#: Columns of a topic's messages and of a queue's, where no schema is registered (name, type, type of the source, nullable, comment).
MESSAGE_COLUMNS = {
    "topic": [("key", "bytes", "bytes", True, "Message key"), ("value", "bytes", "bytes", True, "Message value"), ("timestamp", "timestamp", "timestamp", False, "Message timestamp"), ("partition", "int", "int32", False, "Partition number"), ("offset", "long", "int64", False, "Message offset")],
    "queue": [("routing_key", "string", "string", True, "Message routing key"), ("payload", "bytes", "bytes", True, "Message payload"), ("properties", "object", "object", True, "Message properties"), ("timestamp", "timestamp", "timestamp", True, "Message timestamp"), ("exchange", "string", "string", True, "Source exchange")],
}


def message_columns(names: DataFrame, kind: str, registered: DataFrame | None = None) -> DataFrame:
    """Column records of topics or queues (name): the default ones for each that has no registered columns."""
    rows = F.array(*(F.struct(F.lit(i + 1).alias("ordinal_position"), *(F.lit(x).alias(k) for k, x in zip(("column_name", "data_type", "source_type", "nullable", "comment"), c, strict=True))) for i, c in enumerate(MESSAGE_COLUMNS[kind])))
    names = names.select("name").distinct()
    if registered is not None:
        names = names.join(registered.select("name").distinct(), "name", "left_anti")
    return names.select("name", F.inline(rows))


SCHEMA_JSON = "struct<database:string,table:string,columns:array<struct<name:string,data_type:string,nullable:boolean,primary_key:boolean,comment:string>>>"


def schemas_from_json(text: DataFrame, column: str) -> DataFrame:
    """Column records from JSON of table schemas, a list of them or a single one; the database is default where it is empty, names are lower case."""
    body = F.trim(column)
    many = F.when(body.startswith("["), F.from_json(body, f"array<{SCHEMA_JSON}>")).otherwise(F.array(F.from_json(body, SCHEMA_JSON)))
    tables = text.select(F.inline(many)).filter("`table` IS NOT NULL")
    cols = tables.select(F.lower(F.coalesce(F.nullif("database", F.lit("")), F.lit("default"))).alias("database"), F.lower("table").alias("table"), F.posexplode("columns").alias("ordinal", "c"))
    return cols.select("database", "table", (F.col("ordinal") + 1).alias("ordinal"), "c.name", "c.data_type", F.coalesce("c.nullable", F.lit(False)).alias("nullable"), F.coalesce("c.primary_key", F.lit(False)).alias("primary_key"), F.coalesce("c.comment", F.lit("")).alias("comment"))


def schemas_to_json(columns: DataFrame) -> DataFrame:
    """One row of JSON for each table, its columns in order; tables are narrow, so each is one group."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name", "data_type", "nullable", "primary_key", "comment")))
    tables = columns.groupBy("database", "table").agg(F.transform(ordered, lambda c: F.struct(*(c[k].alias(k) for k in ("name", "data_type", "nullable", "primary_key", "comment")))).alias("columns"))
    return tables.select("database", "table", F.to_json(F.struct("database", "table", "columns")).alias("json"))
