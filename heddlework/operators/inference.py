"""Schemas inferred from documents, delimited text, keys and object names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from .ranks import ranked

# SQL types of inferred types.
SQL_TYPES = {"boolean": "BOOLEAN", "integer": "BIGINT", "number": "DOUBLE", "string": "TEXT", "array": "JSON", "object": "JSON"}


def sql_type(inferred: Column) -> Column:
    out = None
    for k, v in SQL_TYPES.items():
        out = F.when(inferred == k, v) if out is None else out.when(inferred == k, v)
    return out.otherwise("TEXT")


def _kind(schema: Column) -> Column:
    """The inferred type of a variant's own schema text."""
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "BOOLEAN", "boolean").when(schema == "BIGINT", "integer").when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "number").when(schema == "VOID", "null").otherwise("string")
    )


def document_values(df: DataFrame, json: str, key: str, max_depth: int = 10) -> DataFrame:
    """(key, path, kind) for each field of each JSON object, by dotted path; arrays are leaves, objects are opened to max_depth.

    Documents are parsed once. Each level's fields are written to the shared folder, and the next level
    opens the objects among them; it ends with the first level that has none. Text that is no JSON object has no fields.
    """
    level = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v"))
    level = level.withColumn("kind", _kind(F.schema_of_variant("v"))).filter("kind = 'object'")
    out = None
    for depth in range(max_depth):
        fields = _fields(level)
        fields = cut(fields.withColumn("kind", _kind(F.schema_of_variant("v"))).withColumn("v", F.when(F.col("kind") == "object", F.col("v"))), "fields")
        kinds = fields.select("key", "path", "kind")
        out = kinds if out is None else out.unionByName(kinds)
        level = fields.filter("kind = 'object'")
        if depth + 1 == max_depth or level.limit(1).count() == 0:
            break
    return out


def _opened(level: DataFrame, variant: str) -> DataFrame:
    """The rows with ``_pos``, ``_name`` and ``_value`` for each element of an object or array."""
    parts = level.sparkSession.tvf.variant_explode(F.col(variant).outer())
    return level.lateralJoin(parts.select(F.col("pos").alias("_pos"), F.col("key").alias("_name"), F.col("value").alias("_value")))


def _fields(level: DataFrame) -> DataFrame:
    path = F.when(F.col("path") == "", F.col("_name")).otherwise(F.concat("path", F.lit("."), "_name"))
    return _opened(level, "v").select("key", path.alias("path"), F.col("_value").alias("v"))


def merged_types(values: DataFrame, merge: str = "most_common", ignore_nulls: bool = False) -> DataFrame:
    """(path, data_type, n) from (path, kind): the most frequent kind, the first by name of equals, or all kinds joined by a bar."""
    counts = values.filter("kind <> 'null'" if ignore_nulls else "true").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    if merge == "union":
        kind = F.array_join(F.array_sort(F.collect_set("kind")), "|")
    else:
        kind = F.min_by("kind", F.struct(-F.col("n"), "kind"))
    return counts.groupBy("path").agg(kind.alias("data_type"), F.sum("n").alias("n"))


def inferred_documents(df: DataFrame, json: str, key: str, max_depth: int = 10, merge: str = "most_common") -> DataFrame:
    """One row for each path: position by name, type, SQL type, whether null or absent in a document, coverage and how often each kind occurs."""
    values = document_values(df, json, key, max_depth)
    total = df.count()
    counts = values.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("kinds"), F.sum(F.when(F.col("kind") != "null", F.col("n"))).alias("not_null"))
    types = merged_types(values, merge).withColumnRenamed("n", "n_values")
    # Each path once in a document, as names in an object are distinct.
    out = types.join(kinds, "path")
    return ranked(out, F.col("path")).select("path", (F.col("rank") + 1).cast("int").alias("ordinal"), "data_type", sql_type(F.col("data_type")).alias("sql_type"), (F.coalesce("not_null", F.lit(0)) < total).alias("nullable"), F.round(F.col("n_values") * 100.0 / max(total, 1), 4).alias("coverage"), "kinds")


def text_kind(value: Column) -> Column:
    """The type of a field of delimited text; 1 and 0 are booleans before they are integers."""
    v = F.lower(F.trim(value))
    return (
        F.when(v.isNull() | v.isin("", "null", "na"), "null").when(v.isin("true", "false", "yes", "no", "1", "0"), "boolean").when(v.rlike(r"^[+-]?[0-9]+$") & v.try_cast("long").isNotNull(), "integer").when(v.try_cast("double").isNotNull() & v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([e][+-]?[0-9]+)?$"), "number").otherwise("string")
    )


def delimited(lines: DataFrame, line: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Lines of delimited text as columns of text; a line with another number of fields, quoted ones being one, is left out."""
    return parsed_lines(lines, line, columns, sep).filter("malformed IS NULL").drop("malformed")


def parsed_lines(lines: DataFrame, line: str, columns: list[str], sep: str = ",") -> DataFrame:
    """The same, with ``malformed``: the line itself if its number of fields is another."""
    schema = ", ".join(f"`{c}` STRING" for c in columns) + ", `_malformed` STRING"
    x = F.from_csv(F.col(line), schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    return lines.select(x.alias("x")).select(*(F.col("x")[c].alias(c) for c in columns), F.col("x._malformed").alias("malformed"))


def inferred_text(df: DataFrame, merge: str = "most_common") -> DataFrame:
    """One row for each column of text values, in order: type, SQL type, whether any is null."""
    columns = df.columns
    stacked = df.selectExpr(f"stack({len(columns)}, {', '.join(f'{i + 1}, {c!r}, `{c}`' for i, c in enumerate(columns))}) AS (ordinal, path, value)")
    values = stacked.withColumn("kind", text_kind(F.col("value")))
    types = merged_types(values, merge)
    nulls = values.groupBy("path", "ordinal").agg((F.count_if(F.col("kind") == "null") > 0).alias("nullable"))
    out = types.join(nulls, "path").select("ordinal", "path", "data_type", sql_type(F.col("data_type")).alias("sql_type"), "nullable", "n")
    return out


_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Separators of keys in the order in which they are tried. Fixed values.
SEPARATORS = (":", "-", "_", ".", "/")


def key_pattern(key: Column) -> Column:
    """The key with its variable segments as ``*``: digits, UUIDs, long hexadecimal, or mixed letters and digits."""
    variable = lambda x: x.rlike(r"^[0-9]+$") | x.rlike(_UUID) | x.rlike(r"^[0-9a-fA-F]{17,}$") | (x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]") & (F.length(x) > 8))
    masked = lambda sep: F.array_join(F.transform(F.split(key, F.lit("\\" + sep)), lambda x: F.when(variable(x), "*").otherwise(x)), sep)
    out = F.when(variable(key), "*").otherwise(key)
    for sep in reversed(SEPARATORS):
        out = F.when(key.contains(sep), masked(sep)).otherwise(out)
    return out


def store_key_pattern(key: Column) -> Column:
    """As ``key_pattern`` for keys with colons: numbers, UUIDs, or six and more letters and digits of both kinds."""
    variable = lambda x: x.rlike(r"^[+-]?[0-9]{1,19}$") | x.rlike(_UUID) | (x.rlike(r"^[0-9A-Za-z]{6,}$") & x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
    return F.array_join(F.transform(F.split(key, ":"), lambda x: F.when(variable(x), "*").otherwise(x)), ":")


def key_patterns(df: DataFrame, key: str, pattern: Column, samples: int = 5) -> DataFrame:
    """Patterns with counts, ranks by count, shares of all keys, running coverage, and the first few keys by name."""
    rows = df.select(F.col(key).alias("key"), pattern.alias("pattern"))
    counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # Keys are made distinct and ranked before they are collected, so each pattern's list is short.
    few = rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("pattern").orderBy("key"))).filter(F.col("_r") <= samples)
    few = few.groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("samples"))
    # Keys without separators are patterns of their own, so there may be as many patterns as keys.
    out = ranked(counts, F.desc("n"), F.col("pattern"), total="n", running="covered")
    total = out.agg(F.sum("n").alias("total"))
    return out.join(few, "pattern").crossJoin(F.broadcast(total)).select((F.col("rank") + 1).cast("int").alias("place"), "pattern", "n", F.round(F.col("covered") * 100.0 / F.col("total"), 4).alias("coverage"), "samples")  # total is one row


def pattern_columns(patterns: DataFrame) -> DataFrame:
    """Key patterns as column records."""
    return patterns.select(F.concat(F.lit("pattern_"), F.col("place").cast("string")).alias("column_name"), F.lit("TEXT").alias("data_type"), F.concat(F.lit("Pattern: "), "pattern", F.lit(", count: "), F.col("n").cast("string")).alias("comment"))


def prefixes(objects: DataFrame, key: str, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """Keys below the prefix by the text before the next delimiter: number of objects and, if there is a size, bytes."""
    rest = F.substring(F.col(key), len(prefix) + 1, F.length(key))
    name = F.substring_index(rest, delimiter, 1)
    rows = objects.filter(F.col(key).startswith(prefix)).withColumn("prefix", name).filter("prefix <> ''")
    size = F.sum("size") if "size" in objects.columns else F.lit(None).cast("long")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_objects"), size.alias("size_bytes"))


def prefix_partitions(objects: DataFrame, key: str, table: str, delimiter: str = "/") -> DataFrame:
    """One partition for each prefix below a table's."""
    found = prefixes(objects, key, f"{table}{delimiter}", delimiter)
    return ranked(found, F.col("prefix")).select(F.concat(F.lit("prefix-"), F.col("rank").cast("string")).alias("name"), F.concat(F.lit(f"prefix = '{table}{delimiter}"), "prefix", F.lit(f"{delimiter}'")).alias("expression"), "n_objects")


def first_structured(objects: DataFrame, key: str, prefix: str, format: str) -> DataFrame:
    """The first object with a known format of each prefix."""
    w = Window.partitionBy(prefix).orderBy(key)
    return objects.filter(F.col(format).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def subjects(df: DataFrame, subject: str) -> DataFrame:
    """Registry subjects as topics, with which of key and value schemas each has."""
    part = F.when(F.col(subject).endswith("-key"), "key").when(F.col(subject).endswith("-value"), "value").otherwise("unknown")
    topic = F.regexp_replace(F.col(subject), "-(key|value)$", "")
    return df.select(topic.alias("topic"), part.alias("part")).groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"))


def avro_fields(df: DataFrame, schema: str, key: str) -> DataFrame:
    """Fields of record schemas in JSON: name, type (of a union the first that is not null) and whether null is allowed."""
    fields = _opened(df.select(F.col(key), F.expr(f"variant_get(try_parse_json(`{schema}`), '$.fields')").alias("_v")), "_v").select(key, F.col("_pos").alias("pos"), F.col("_value").alias("f"))
    type_ = F.variant_get("f", "$.type", "variant")
    text = F.to_json(type_)
    union = text.startswith("[")
    first = F.get(F.filter(F.from_json(text, "array<string>"), lambda x: x != "null"), F.lit(0))
    plain = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"t":'), text, F.lit("}")), "$.t")).otherwise(F.get_json_object(text, "$.type"))
    return fields.select(key, F.col("pos").alias("ordinal"), F.variant_get("f", "$.name", "string").alias("name"), F.when(union, first).otherwise(plain).alias("type"), (union & text.contains('"null"')).alias("nullable"))


def info_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """Lines ``name:value`` of server information as rows; comments and blank lines are left out."""
    lines = df.select(key, F.explode(F.split(text, r"\r?\n")).alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    return lines.select(key, F.substring_index("line", ":", 1).alias("name"), F.regexp_replace("line", "^[^:]*:?", "").alias("value"))


def keyspace(df: DataFrame, text: str, key: str) -> DataFrame:
    """Databases of a key-value store from their information lines: number, keys, and keys with an expiry."""
    lines = info_lines(df, text, key).filter(F.col("name").rlike(r"^db[0-9]+$"))
    number = lambda name: F.regexp_extract("value", rf"(?:^|,){name}=([0-9]+)", 1).try_cast("long")
    return lines.select(key, F.substring("name", 3, 10).cast("int").alias("db"), number("keys").alias("keys"), number("expires").alias("expires"))


def selected_settings(df: DataFrame, json: str, key: str, paths: dict[str, str]) -> DataFrame:
    """Chosen values of nested settings as (key, name, value); what is missing is left out."""
    pairs = ", ".join(f"{n!r}, get_json_object(`{json}`, {p!r})" for n, p in paths.items())
    return df.selectExpr(f"`{key}`", f"stack({len(paths)}, {pairs}) AS (name, value)").filter("value IS NOT NULL")


def mapping_columns(df: DataFrame, json: str, key: str, max_depth: int = 5) -> DataFrame:
    """Index mappings as columns by dotted name; objects and nested fields with properties are opened."""
    level = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.expr(f"variant_get(try_parse_json(`{json}`), '$.properties')").alias("v"))
    out = None
    for _ in range(max_depth):
        fields = _fields(level.filter("v IS NOT NULL"))
        now = fields.select("key", "path", F.coalesce(F.try_variant_get("v", "$.type", "string"), F.when(F.try_variant_get("v", "$.properties", "variant").isNotNull(), "object").otherwise("text")).alias("type"))
        out = now if out is None else out.unionByName(now)
        level = fields.select("key", "path", F.try_variant_get("v", "$.properties", "variant").alias("v")).filter("v IS NOT NULL")
        if not level.limit(1).count():
            break
    return out.select(F.col("key").alias(key), "path", "type")
