"""Catalog tables: views over them, enrichment, paging inputs and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import canonical, is_system, type_parameters
from ..sources.versions import at_version, commit


def table_view(connectors: DataFrame, catalogs: DataFrame, schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with the names of their schema, catalog and connector."""
    return tables.join(schemas, "schema_id").join(catalogs, "catalog_id").join(connectors, "connector_id")


def column_view(catalogs: DataFrame, schemas: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns with the names of their table, schema and catalog; columns without a table are left out."""
    return columns.join(tables, "table_id").join(schemas, "schema_id").join(catalogs, "catalog_id")


def snapshot_columns(columns: DataFrame, keys: DataFrame, dialect: str) -> DataFrame:
    """Column records from rows as an information schema has them, read by any reader (jdbc or landed files).

    columns: table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default, extra and
    column_comment; keys: table_schema, table_name and column_name of the primary keys. Schemas of the system are left out.
    """
    on = ["table_schema", "table_name", "column_name"]
    own = columns.filter(~is_system(F.col("table_schema"), dialect))
    marked = own.join(keys.select(*on).distinct().withColumn("_key", F.lit(True)), on, "left")
    length, precision, scale = type_parameters(F.col("data_type"))
    return marked.select(
        *on, "ordinal_position", canonical(dialect, F.regexp_replace("data_type", r"\(.*$", "")).alias("data_type"), F.col("data_type").alias("source_type"), length.alias("length"), precision.alias("precision"), scale.alias("scale"),
        (F.upper("is_nullable") == "YES").alias("is_nullable"), F.col("column_default").alias("default_value"), F.coalesce(F.lower("extra").contains("auto_increment"), F.lit(False)).alias("is_auto_increment"), F.coalesce("_key", F.lit(False)).alias("is_primary_key"), F.coalesce("column_comment", F.lit("")).alias("comment"),
    )


def described_table(rows: DataFrame, partitions: DataFrame, key: str, order: str, name: str, type_: str, comment: str) -> DataFrame:
    """Columns of many tables from their DESCRIBE rows, partition columns flagged, with how many listed partitions each table has."""
    cols = described(rows, key, order, name, type_, comment).filter("section IN ('columns', 'partition')")
    n = partitions.filter("spec LIKE '%=%'").groupBy(key).agg(F.count_distinct("spec").alias("n_partitions"))
    return cols.join(n, key, "left").withColumn("n_partitions", F.coalesce("n_partitions", F.lit(0)).cast("long"))


def index_columns(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """(owner, index_name, seq, column_name, non_unique): the columns of each index of (owner, index_name, non_unique), by their position."""
    return indexes.join(columns, ["owner", "index_name"]).select("owner", "index_name", F.col("position").alias("seq"), "column_name", "non_unique")


#: What names a row of each stored table within its parent; rows without a parent are named by themselves.
UNIQUE_KEYS = {
    "connectors": ["id"], "catalogs": ["connector_id", "name"], "schemas": ["catalog_id", "name"], "tables": ["schema_id", "name"], "columns": ["table_id", "name"], "column_statistics": ["id"], "partitions": ["table_id", "name"],
    "lineage_nodes": ["id"], "lineage_edges": ["id"],
}


def stored(tables: dict[str, DataFrame], path: str, version: str = "updated_at", buckets: int = 64) -> dict[str, DataFrame]:
    """Writes catalog or lineage tables below a path, each row of one unique key once, and reads them back.

    Of several rows of a key the last by ``version`` stays (any of equals). What the path already has
    of a table stays where no new row has its key. Edges without a confidence get 1. Each table is kept in
    versions (``sources.versions``): only buckets with new keys are written, and readers of an old version are not disturbed.
    """
    out = {}
    for name, df in tables.items():
        keys, at = UNIQUE_KEYS[name], f"{path}/{name}"
        if name == "lineage_edges":
            own = F.coalesce("confidence", F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)
            df = df.withColumn("confidence", own.cast("decimal(3,2)"))
        n = commit(df, at, keys, lambda old, new, keys=keys: upserted(old, new, keys, version), buckets)
        out[name] = at_version(df.sparkSession, at, n)
    return out


def edge_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names and types of both ends."""
    end = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"))
    return edges.join(end("source"), "source_id").join(end("target"), "target_id")


def enriched(columns: DataFrame, keys: DataFrame, comments: DataFrame, on: list[str]) -> DataFrame:
    """Columns with whether they are in a key, and their comment or ''."""
    keys = keys.select(*on).distinct().withColumn("_key", F.lit(True))
    return columns.join(keys, on, "left").join(comments.select(*on, "comment"), on, "left").withColumn("is_key", F.coalesce("_key", F.lit(False))).withColumn("comment", F.coalesce("comment", F.lit(""))).drop("_key")


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """Child columns with the columns they refer to, position by position."""
    child = constraints.filter("refers_to IS NOT NULL").alias("c")
    parent = constraints.alias("p")
    hit = child.join(parent, (F.col("c.refers_to") == F.col("p.constraint_name")) & (F.col("c.position") == F.col("p.position")))
    return hit.select("c.constraint_name", "c.position", F.col("c.table_name").alias("table_name"), F.col("c.column_name").alias("column_name"), F.col("p.table_name").alias("parent_table"), F.col("p.column_name").alias("parent_column"))


def consumer_lag(latest: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages that each group has not read, by topic: never less than none for a partition."""
    lag = F.greatest(F.col("latest") - F.col("committed"), F.lit(0))
    return committed.join(latest, ["topic", "partition"]).withColumn("lag", lag).groupBy("group", "topic").agg(F.sum("lag").alias("lag"), F.count(F.lit(1)).alias("n_partitions"))


def deletable(sources: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Whether a row may go: how many tasks refer to it."""
    n = tasks.groupBy(key).agg(F.count(F.lit(1)).alias("n_tasks"))
    return sources.join(n, key, "left").withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)).cast("long")).withColumn("can_delete", F.col("n_tasks") == 0)


def applied_template(sources: DataFrame, templates: DataFrame) -> DataFrame:
    """The type of the template always, its configuration where the source has none."""
    t = templates.select("template_id", F.col("type").alias("_t"), F.col("config").alias("_c"))
    return sources.drop("type").join(t, "template_id").withColumn("config", F.coalesce("config", "_c")).withColumnRenamed("_t", "type").drop("_c")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Old rows without a new one, and the new ones; of new rows with one key the last by version stays."""
    if version:
        w = Window.partitionBy(*keys).orderBy(F.desc(version))
        new = new.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merged(target: DataFrame, source: DataFrame, key: str, delete: Column) -> DataFrame:
    """As MERGE: matched rows take the source's values or go, unmatched source rows come in. Delete is a condition on source columns."""
    flags = source.withColumn("_gone", delete)
    kept = target.join(source.select(key), key, "left_anti")
    return kept.unionByName(flags.filter("NOT _gone").select(*target.columns))


def bulk_result(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """For each id whether it was found; the message says so for those that were not."""
    hit = df.select(key).distinct().withColumn("_hit", F.lit(True))
    return ids.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("success"), F.when(F.col("_hit").isNull(), "not found").alias("message"))


def looked_up(references: DataFrame, tables: DataFrame, default_database: str = "default") -> DataFrame:
    """References (database, table) with the catalog's table: names without case, a missing database is the default one.

    Where the catalog does not know the database at all, any database with the table will do (the first by name).
    """
    database = F.lower(F.coalesce(F.nullif(F.col("database"), F.lit("")), F.lit(default_database)))
    refs = references.withColumns({"_d": database, "_t": F.lower("table")})
    known = tables.select(F.lower("database").alias("_d"), F.lower("table").alias("_t"), "table_id")
    first = known.groupBy("_t").agg(F.min_by("table_id", "_d").alias("_any"))
    databases = known.select("_d").distinct().withColumn("_known", F.lit(True))
    out = refs.join(known, ["_d", "_t"], "left").join(databases, "_d", "left").join(first, "_t", "left")
    return out.withColumn("table_id", F.coalesce("table_id", F.when(F.col("_known").isNull(), F.col("_any")))).drop("_d", "_t", "_any", "_known")


def described(rows: DataFrame, table: str, position: str, name: str, type_: str, comment: str) -> DataFrame:
    """Rows of DESCRIBE output with the section they stand in: columns, partition, detail, storage or properties.

    A marker row opens a section and is left out, as are blank rows and comments.
    """
    text = F.trim(F.col(name))
    marker = F.when(text.startswith("# Partition"), "partition").when(text.startswith("# Detailed"), "detail").when(text.startswith("# Storage"), "storage").when(text.rlike("^(Table|Storage Desc) Param"), "properties").when(text == "# col_name", None)
    w = Window.partitionBy(table).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_m", marker).withColumn("section", F.coalesce(F.last("_m", ignorenulls=True).over(w), F.lit("columns")))
    return out.filter(F.col("_m").isNull() & ~text.startswith("#") & (text != "")).drop("_m").withColumn("is_partition", F.col("section") == "partition")
