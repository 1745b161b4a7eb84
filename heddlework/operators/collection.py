"""Collection runs: what a task gathers of a set of tables, in one of four modes."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profile
from .matching import filtered

MODES = ("full", "incremental", "schema", "profile")
COLUMNS = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"


def collected(tables: dict[str, DataFrame], mode: str = "full", include: list[str] = (), exclude: list[str] = (), since: dict[str, tuple[str, object]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, statistics, failures) of the tables that the rules allow.

    Columns come from the schemas alone. Statistics are row counts (full), counts of the rows past a
    stored value (incremental, by table: column and value) or statistics of every column (profile);
    a schema run has none. A table that cannot be analysed is a failure, and the others go on.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(t,) for t in tables], "table_name string")
    allowed = [r[0] for r in filtered(names, "table_name", {"include": list(include), "exclude": list(exclude)}).collect()]  # names of tables
    columns, failures, statistics = [], [], None
    for name in allowed:
        try:
            df = tables[name]
            columns += [(name, i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
            if mode == "incremental":
                column, value = (since or {}).get(name, (df.columns[0], None))
                df = df.filter(F.col(column) > F.lit(value)) if value is not None else df
            if mode == "profile":
                one = profile.column_statistics(df, quantiles=False).select(F.lit(name).alias("table_name"), "column_name", "row_count", "null_count", "distinct_count")
            elif mode != "schema":
                one = profile.table_statistics(df).select(F.lit(name).alias("table_name"), F.lit(None).cast("string").alias("column_name"), "row_count", F.lit(None).cast("long").alias("null_count"), F.lit(None).cast("long").alias("distinct_count"))
            else:
                continue
            statistics = one if statistics is None else statistics.unionByName(one)
        except PySparkException as e:
            failures.append((name, str(e)[:200]))
    none = spark.createDataFrame([], "table_name string, column_name string, row_count long, null_count long, distinct_count long")
    return spark.createDataFrame(columns, COLUMNS), none if statistics is None else statistics, spark.createDataFrame(failures, "table_name string, error string")


def execution(columns: DataFrame, statistics: DataFrame, failures: DataFrame) -> DataFrame:
    """The run's one-row summary."""
    n = columns.agg(F.count_distinct("table_name").alias("tables"), F.count(F.lit(1)).alias("columns"))
    s = statistics.agg(F.coalesce(F.sum(F.when(F.col("column_name").isNull(), F.col("row_count"))), F.lit(0)).alias("records"))
    f = failures.agg(F.count(F.lit(1)).alias("errors"))
    return n.crossJoin(s).crossJoin(f)  # one row each
