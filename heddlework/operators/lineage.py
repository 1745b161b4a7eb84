"""Lineage from statement logs and from tables of facts about statements.

No SQL is parsed here beyond bounded patterns: scripts are split at semicolons outside string
literals, statements classified by their first words, table names read after FROM, JOIN, INTO and
CREATE, and column definitions of CREATE TABLE split at commas of depth one. Column lineage joins
facts that any parser can land (``selects`` reads them from SELECT statements): select_items (stmt_id, branch, pos, alias, column_name, expr),
expr_refs (stmt_id, branch, pos, ref_pos, qualifier, column_name), from_items (stmt_id, branch,
from_pos, alias, table_name) and insert_columns (stmt_id, pos, column_name).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

_NAME = r'[`"\[]?[\w$]+[`"\]]?(?:\s*\.\s*[`"\[]?[\w$]+[`"\]]?)*'


def statements(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sql): statements of scripts without comment lines; blank ones and those that are neither DDL nor DML are left out."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*--.*$", ""), r"(?s)/\*.*?\*/", " ")
    pieces = F.regexp_extract_all(plain, F.lit(r"'[^']*+'|[^;']++|[;']"), F.lit(0))
    marked = F.array_join(F.transform(pieces, lambda x: F.when(x == ";", "\u0000").otherwise(x)), "")
    parts = scripts.select(key, F.posexplode(F.split(marked, "\u0000")).alias("pos", "sql")).withColumn("sql", F.trim(F.regexp_replace("sql", r"^\s+|\s+$", "")))
    return parts.filter(F.col("sql").rlike(r"(?i)^(SELECT|INSERT|UPDATE|DELETE|MERGE|TRUNCATE|CREATE|DROP|ALTER|WITH|REPLACE)\b"))


def statement_kind(sql: Column) -> Column:
    """The first word in lower case; WITH counts as what follows its common table expressions, select unless it inserts."""
    word = F.lower(F.regexp_extract(sql, r"^\s*(\w+)", 1))
    return F.when(word == "with", F.when(sql.rlike(r"(?is)\)\s*INSERT\b"), "insert").otherwise("select")).when(word == "replace", "insert").when(word.isin("select", "insert", "update", "delete", "merge", "truncate", "create", "drop", "alter"), word).otherwise("other")


def table_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r'[\s`"\[\]]', ""))


def table_lineage(stmts: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """(key, target, source): tables after FROM and JOIN into the table after INSERT INTO or CREATE ... AS; names of common table expressions are no sources.

    Statements without a target have the target RESULT_SET.
    """
    plain = F.regexp_replace(sql, r"(?m)--.*$", "")
    target = F.regexp_extract(plain, rf"(?is)\b(?:INSERT\s+(?:INTO|OVERWRITE)(?:\s+TABLE)?|MERGE\s+INTO|CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMPORARY\s+)?(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?)\s+({_NAME})", 1)
    names = F.regexp_extract_all(plain, F.lit(rf"(?is)\b(?:FROM|JOIN)\s+({_NAME})"), F.lit(1))
    ctes = F.regexp_extract_all(plain, F.lit(r"(?is)(?:\bWITH(?:\s+RECURSIVE)?|,)\s*([\w$]+)\s+AS\s*\("), F.lit(1))
    sources = F.array_except(F.transform(names, table_name), F.transform(ctes, table_name))
    out = stmts.select(key, F.when(target == "", "RESULT_SET").otherwise(table_name(target)).alias("target"), F.explode(sources).alias("source"))
    return out.filter("source NOT IN ('select', 'lateral', 'unnest', 'values', 'table')").distinct()


def ddl_columns(stmts: DataFrame, key: str, sql: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Columns of CREATE TABLE statements (table, ordinal, name, type, nullable, primary key, default, comment), and the statements that could not be read."""
    creates = stmts.filter(F.col(sql).rlike(r"(?i)^\s*CREATE\s+(EXTERNAL\s+|TEMPORARY\s+)?TABLE\b"))
    name = F.regexp_extract(sql, rf"(?is)TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*\(", 1)
    body = F.regexp_extract(sql, r"(?is)^[^(]*\((.*)\)[^)]*$", 1)
    read = creates.withColumns({"_t": table_name(name), "_b": body})
    good = read.filter("_t <> '' AND _b <> ''")
    # Commas of depth one outside quotes: an even number of quotes follows, and no closing bracket before an opening one.
    parts = F.split("_b", r",(?=(?:[^']*'[^']*')*[^']*$)(?![^(<']*[)>])")
    cols = good.select(key, F.col("_t").alias("table_name"), F.posexplode(parts).alias("ordinal", "d")).withColumn("d", F.trim("d"))
    cols = cols.filter(~F.col("d").rlike(r"(?i)^(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CONSTRAINT|KEY|INDEX|CHECK|WATERMARK)\b"))
    primary = F.col("d").rlike(r"(?i)\bPRIMARY\s+KEY\b")
    out = cols.select(
        key, "table_name", (F.col("ordinal") + 1).alias("ordinal"), F.lower(F.regexp_replace(F.regexp_extract("d", r'^(\S+)', 1), r'[`"\[\]]', "")).alias("name"), F.upper(F.regexp_extract("d", r"^\S+\s+(\w+(?:\s*[(<][^)>]*[)>]+)?)", 1)).alias("data_type"),
        (~F.col("d").rlike(r"(?i)\bNOT\s+NULL\b") & ~primary).alias("nullable"), primary.alias("primary_key"), F.nullif(F.regexp_extract("d", r"(?i)\bDEFAULT\s+('[^']*'|\S+)", 1), F.lit("")).alias("default_value"), F.regexp_extract("d", r"(?i)\bCOMMENT\s+'([^']*)'", 1).alias("comment"),
    )
    return out, read.filter("_t = '' OR _b = ''").select(key, F.lit("cannot read the definition").alias("error"))


def bound(refs: DataFrame, from_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """References with their table: by alias, else by table name; an unknown qualifier stays as it is.

    Without a qualifier the only table in scope, else the first one in FROM whose catalog columns have the name, else ''.
    """
    scope = from_items.select("stmt_id", "branch", "from_pos", F.lower(F.coalesce("alias", "table_name")).alias("_q"), F.lower("table_name").alias("_t"))
    refs = refs.withColumns({"_rq": F.lower("qualifier"), "_c": F.lower("column_name")})
    on = ["stmt_id", "branch"]
    named = scope.groupBy(*on, "_q").agg(F.min_by("_t", "from_pos").alias("_by_name"))
    count = scope.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min_by("_t", "from_pos").alias("_only"))
    having = scope.join(catalog.select(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")).distinct(), "_t").groupBy(*on, "_c").agg(F.min_by("_t", "from_pos").alias("_having"))
    out = refs.join(named.withColumnRenamed("_q", "_rq"), [*on, "_rq"], "left").join(count, on, "left").join(having, [*on, "_c"], "left")
    table = F.when(F.col("_rq").isNotNull(), F.coalesce("_by_name", "qualifier")).when(F.col("_n") == 1, F.col("_only")).otherwise(F.coalesce("_having", F.lit("")))
    return out.withColumn("table_name", table).drop("_rq", "_c", "_by_name", "_n", "_only", "_having")


def expanded_stars(stars: DataFrame, from_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(stmt_id, branch, pos, table, column, place) for each catalog column of ``*`` and ``t.*``; unknown tables yield nothing."""
    scope = from_items.select("stmt_id", "branch", "from_pos", F.lower(F.coalesce("alias", "table_name")).alias("_q"), F.lower("table_name").alias("table_name"))
    cols = catalog.select(F.lower("table_name").alias("table_name"), F.col("column_name"), "ordinal")
    hit = stars.join(scope, ["stmt_id", "branch"]).filter(F.col("qualifier").isNull() | (F.lower("qualifier") == F.col("_q"))).join(cols, "table_name")
    place = F.row_number().over(Window.partitionBy("stmt_id", "branch", "pos").orderBy("from_pos", "ordinal"))
    return hit.select("stmt_id", "branch", "pos", "table_name", "column_name", place.alias("place"))


def column_lineage(items: DataFrame, refs: DataFrame, from_items: DataFrame, catalog: DataFrame, insert_columns: DataFrame | None = None) -> DataFrame:
    """One row for each output column of each statement: target, sources in textual order joined by commas, and the expression.

    The target is the insert column of the position, else the alias, else the column, else _col{i}.
    The branches of a set operation feed the same outputs by position; names come from the first branch.
    """
    sources = bound(refs, from_items, catalog).withColumn("_s", F.concat_ws(".", F.nullif("table_name", F.lit("")), "column_name"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", "ref_pos", "_s"))), lambda x: x["_s"]), ",")
    by_pos = sources.groupBy("stmt_id", "pos").agg(listed.alias("sources"), F.count(F.lit(1)).alias("n_sources"))
    first = items.filter("branch = 0").select("stmt_id", "pos", "expr", F.coalesce("alias", "column_name", F.concat(F.lit("_col"), F.col("pos").cast("string"))).alias("_name"))
    out = first.join(by_pos, ["stmt_id", "pos"], "left")
    if insert_columns is not None:
        out = out.join(insert_columns.select("stmt_id", "pos", F.col("column_name").alias("_into")), ["stmt_id", "pos"], "left")
        out = out.withColumn("_name", F.coalesce("_into", "_name")).drop("_into")
    return out.select("stmt_id", "pos", F.col("_name").alias("target"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.col("expr").alias("operator"))


def to_base(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Edges (target, source) through views and derived tables replaced by edges from base columns only.

    Each round replaces sources that are targets themselves by what those are known to come from, so
    the length of the chains that are resolved doubles. It ends when no such source is left. What is
    left after so many rounds, for chains of a million steps, comes from itself: an error.
    """
    out = kept(edges.select("target", "source").distinct())
    for _ in range(rounds):
        if not out.join(out.select(F.col("target").alias("source")), "source", "left_semi").limit(1).count():
            return out
        rules = out.select(F.col("target").alias("_t"), F.col("source").alias("_s"))
        out = kept(out.join(rules, F.col("source") == F.col("_t"), "left").select("target", F.coalesce("_s", "source").alias("source")).distinct())
    left = out.join(out.select(F.col("target").alias("source")), "source", "left_semi").select("source").limit(5).collect()
    if left:
        raise ValueError(f"definitions that come from themselves: {', '.join(r.source for r in left)}")
    return out


def table_rollup(edges: DataFrame) -> DataFrame:
    """Targets with their distinct source tables in order; blank sources are skipped."""
    return edges.filter("source <> ''").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n_sources"))


def complexity(lineage: DataFrame) -> DataFrame:
    """By statement: columns, sources, most and mean sources of a column, operators, and the score columns + sources / 2 + operators * 2."""
    operator = F.col("operator").rlike(r"[(+*/|-]|\bCASE\b")
    g = lineage.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_sources").alias("n_sources"), F.max("n_sources").alias("max_sources"), F.round(F.avg("n_sources"), 6).alias("avg_sources"), F.count_if(operator).alias("n_operators"))
    return g.withColumn("score", F.col("n_columns") * 1.0 + F.col("n_sources") * 0.5 + F.col("n_operators") * 2.0)


# What tells of streams in an expression, as it is spelled.
STREAM_WORDS = {
    "time": ("CURRENT_TIMESTAMP", "NOW()", "event_time", "WATERMARK", "INTERVAL", "EXTRACT", "DATE_FORMAT", "TIMESTAMP"),
    "window": ("TUMBLE", "HOP", "SESSION", "OVER", "ROW_NUMBER", "RANK", "DENSE_RANK", "LAG", "LEAD"),
    "watermark": ("WATERMARK", "FOR SYSTEM_TIME AS OF"),
}


def stream_features(lineage: DataFrame) -> DataFrame:
    """How many expressions use each family of stream functions."""
    uses = lambda words: functools.reduce(Column.__or__, (F.contains(F.col("operator"), F.lit(w)) for w in words))
    return lineage.agg(*(F.count_if(uses(words)).alias(f"n_{k}") for k, words in STREAM_WORDS.items()))


def graph_edges(lineage: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Column lineage as graph edges with ids."""
    rows = lineage.select("stmt_id", F.col("target").alias("target_id"), F.explode(F.split("sources", ",")).alias("source_id"), F.col("operator").alias("transformation")).filter("source_id <> ''")
    return rows.select(F.md5(F.concat_ws(":", "source_id", "target_id", F.col("stmt_id").cast("string"))).alias("edge_id"), "source_id", "target_id", F.lit("derived_from").alias("type"), "transformation", F.lit(confidence).alias("confidence"))
