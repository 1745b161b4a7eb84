"""Types of sources as canonical names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical names by dialect. Whole names, whatever their case.
MYSQL = {
    "int": "INTEGER", "integer": "INTEGER", "tinyint": "INTEGER", "smallint": "INTEGER", "mediumint": "INTEGER", "bigint": "INTEGER",
    "float": "FLOAT", "double": "FLOAT", "real": "FLOAT",
    "decimal": "DECIMAL", "numeric": "DECIMAL",
    "char": "STRING", "varchar": "STRING", "tinytext": "STRING", "text": "STRING", "mediumtext": "STRING", "longtext": "STRING",
    "date": "DATE", "time": "TIME", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP",
    "binary": "BINARY", "varbinary": "BINARY", "tinyblob": "BINARY", "blob": "BINARY", "mediumblob": "BINARY", "longblob": "BINARY",
    "boolean": "BOOLEAN", "bool": "BOOLEAN", "json": "JSON",
}
POSTGRES = {
    "integer": "INTEGER", "smallint": "INTEGER", "bigint": "INTEGER", "int2": "INTEGER", "int4": "INTEGER", "int8": "INTEGER",
    "real": "FLOAT", "double precision": "FLOAT", "float4": "FLOAT", "float8": "FLOAT",
    "numeric": "DECIMAL", "decimal": "DECIMAL",
    "character": "STRING", "character varying": "STRING", "text": "STRING", "char": "STRING", "varchar": "STRING",
    "date": "DATE", "time": "TIME", "time without time zone": "TIME", "time with time zone": "TIME",
    "timestamp": "TIMESTAMP", "timestamp without time zone": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP",
    "bytea": "BINARY", "boolean": "BOOLEAN", "json": "JSON", "jsonb": "JSON", "uuid": "UUID", "array": "ARRAY",
}
HIVE = {
    "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "integer": "INTEGER", "bigint": "INTEGER",
    "float": "FLOAT", "double": "FLOAT", "double precision": "FLOAT", "decimal": "DECIMAL", "numeric": "DECIMAL",
    "string": "STRING", "varchar": "STRING", "char": "STRING", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp with local time zone": "TIMESTAMP",
    "binary": "BINARY", "boolean": "BOOLEAN", "array": "ARRAY", "map": "MAP", "struct": "STRUCT", "uniontype": "UNION",
}
SQLSERVER = {
    "varchar": "TEXT", "nvarchar": "TEXT", "char": "TEXT", "nchar": "TEXT", "text": "TEXT", "ntext": "TEXT",
    "int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER",
    "decimal": "NUMERIC", "numeric": "NUMERIC", "money": "NUMERIC", "smallmoney": "NUMERIC",
    "float": "DOUBLE", "real": "DOUBLE", "bit": "BOOLEAN",
    "datetime": "TIMESTAMP", "datetime2": "TIMESTAMP", "smalldatetime": "TIMESTAMP", "date": "TIMESTAMP", "time": "TIMESTAMP", "datetimeoffset": "TIMESTAMP",
    "binary": "BLOB", "varbinary": "BLOB", "image": "BLOB", "uniqueidentifier": "UUID", "xml": "XML",
}
ELASTICSEARCH = {
    "text": "string", "keyword": "string", "long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "double": "double", "float": "float", "half_float": "float", "scaled_float": "decimal",
    "date": "timestamp", "boolean": "boolean", "binary": "binary", "object": "object", "nested": "object", "geo_point": "geometry", "geo_shape": "geometry", "ip": "string",
}
AVRO = {"null": "null", "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "bytes": "bytes", "string": "string"}
AVRO_KINDS = ("record", "enum", "array", "map")
# Beginnings of names, in the order in which they are tried.
CLICKHOUSE = [
    ("int8", "TINYINT"), ("int16", "SMALLINT"), ("int32", "INTEGER"), ("int64", "BIGINT"), ("uint8", "TINYINT"), ("uint16", "SMALLINT"), ("uint32", "INTEGER"), ("uint64", "BIGINT"), ("float32", "REAL"), ("float64", "DOUBLE"), ("decimal", "DECIMAL"),
    ("string", "TEXT"), ("fixedstring", "CHAR"), ("datetime", "TIMESTAMP"), ("date", "DATE"), ("uuid", "UUID"), ("array", "ARRAY"), ("tuple", "STRUCT"), ("enum", "ENUM"),
]
DORIS = [
    ("tinyint", "TINYINT"), ("smallint", "SMALLINT"), ("int", "INTEGER"), ("bigint", "BIGINT"), ("largeint", "BIGINT"), ("float", "REAL"), ("double", "DOUBLE"), ("decimal", "DECIMAL"), ("char", "CHAR"), ("varchar", "VARCHAR"), ("string", "TEXT"), ("text", "TEXT"),
    ("datetime", "TIMESTAMP"), ("timestamp", "TIMESTAMP"), ("date", "DATE"), ("array", "ARRAY"), ("map", "MAP"), ("struct", "STRUCT"), ("json", "JSON"), ("bitmap", "BLOB"), ("hll", "BLOB"),
]
#: Kinds of tables by dialect; every other kind is a table.
TABLE_TYPES = {
    "mysql": {"VIEW": "VIEW", "BASE TABLE": "TABLE"},
    "postgres": {"VIEW": "VIEW", "BASE TABLE": "TABLE", "MATERIALIZED VIEW": "MATERIALIZED_VIEW", "FOREIGN TABLE": "EXTERNAL_TABLE"},
    "hive": {"VIRTUAL_VIEW": "VIEW", "VIEW": "VIEW", "EXTERNAL_TABLE": "EXTERNAL_TABLE", "MATERIALIZED_VIEW": "MATERIALIZED_VIEW", "MANAGED_TABLE": "TABLE", "TABLE": "TABLE"},
}
#: Storage formats by what the input class contains, in this order; no format for others.
STORAGE = [("parquet", "parquet"), ("orc", "orc"), ("avro", "avro"), ("rcfile", "rcfile"), ("sequencefile", "sequencefile"), ("textinputformat", "text"), ("json", "json")]
#: Categories of sources and their types.
CATEGORIES = {
    "RDBMS": ["mysql", "postgres", "oracle", "sqlserver"],
    "DataWarehouse": ["hive", "clickhouse", "doris", "starrocks"],
    "DocumentDB": ["mongodb", "elasticsearch"],
    "KeyValue": ["redis", "etcd"],
    "MessageQueue": ["kafka", "rabbitmq", "rocketmq"],
    "ObjectStorage": ["minio", "s3", "oss"],
}
#: Databases, schemas or users that belong to the system, by dialect, and beginnings of such names.
SYSTEM_NAMES = {
    "mysql": ["information_schema", "performance_schema", "mysql", "sys"],
    "postgres database": ["postgres"],
    "postgres": ["pg_catalog", "information_schema", "pg_toast"],
    "oracle": [
        "SYS", "SYSTEM", "DBSNMP", "SYSMAN", "OUTLN", "MGMT_VIEW", "DIP", "ORACLE_OCM", "APPQOSSYS", "WMSYS", "EXFSYS", "CTXSYS", "ANONYMOUS", "XDB", "XS$NULL", "OJVMSYS", "LBACSYS", "APEX_040000",
        "APEX_PUBLIC_USER", "FLOWS_FILES", "MDDATA", "SPATIAL_CSW_ADMIN_USR", "SPATIAL_WFS_ADMIN_USR", "PUBLIC",
    ],
    "sqlserver database": ["master", "tempdb", "model", "msdb"],
    "sqlserver": ["sys", "information_schema", "guest", "INFORMATION_SCHEMA"],
    "clickhouse": ["system", "information_schema", "INFORMATION_SCHEMA"],
}
SYSTEM_BEGINNINGS = {"postgres": ["pg_temp_", "pg_toast_temp_"]}
#: Engines whose objects are no tables.
NO_TABLES = {"clickhouse": ["View", "MaterializedView", "Dictionary"]}

WHOLE = {"mysql": MYSQL, "postgres": POSTGRES, "hive": HIVE, "sqlserver": SQLSERVER, "elasticsearch": ELASTICSEARCH}
BEGINNINGS = {"clickhouse": CLICKHOUSE, "doris": DORIS}


def base_type(data_type: Column) -> Column:
    """The lower-case name without what stands in parentheses or angle brackets."""
    return F.trim(F.regexp_replace(F.lower(data_type), r"[(<].*$", ""))


def looked_up(value: Column, values: dict[str, str], otherwise: Column | None = None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), value), otherwise if otherwise is not None else value)


def canonical(dialect: str, data_type: Column) -> Column:
    """The canonical name of a type.

    Unknown types are their own name in upper case; TEXT for SQL Server and where beginnings are
    tried; string for Elasticsearch, whose names are taken as they are; and Avro types keep theirs.
    """
    if dialect == "avro":
        return _avro(data_type)
    if dialect in BEGINNINGS:
        name = F.lower(data_type)
        if dialect == "clickhouse":
            name = F.lower(F.regexp_replace(F.regexp_replace(data_type, r"^Nullable\(", ""), r"\)$", ""))
        out = F.when(name == ("bool" if dialect == "clickhouse" else "boolean"), "BOOLEAN")
        for beginning, kind in BEGINNINGS[dialect]:
            out = out.when(name.startswith(beginning), kind)
        return out.otherwise("TEXT")
    name = {"hive": base_type(data_type), "elasticsearch": data_type}.get(dialect, F.lower(data_type))
    otherwise = {"sqlserver": F.lit("TEXT"), "elasticsearch": F.lit("string")}.get(dialect, F.upper(name))
    return F.when(name.isNotNull(), looked_up(name, WHOLE[dialect], otherwise))


def _avro(x: Column) -> Column:
    """A type as a name, a JSON object, or a JSON list, of which the first that is not null counts."""

    def one(x: Column) -> Column:
        kind = F.get_json_object(x, "$.type")
        complex_ = F.when(kind.isNull(), "object").when(kind.isin(*AVRO_KINDS), kind).otherwise("complex")
        return F.when(x.startswith("{"), complex_).otherwise(looked_up(x, AVRO))

    members = F.filter(F.from_json(x, "array<string>"), lambda m: m != "null")
    return F.when(F.ltrim(x).startswith("["), F.coalesce(one(F.get(members, F.lit(0))), F.lit("union"))).otherwise(one(F.trim(x)))


def type_parameters(data_type: Column) -> tuple[Column, Column, Column]:
    """Length of character types; precision and scale of decimal types; by how the name begins."""
    pattern, name = r"\((\d+)(?:,\s*(\d+))?\)", F.lower(data_type)
    one = F.regexp_extract(data_type, pattern, 1).try_cast("int")
    two = F.regexp_extract(data_type, pattern, 2).try_cast("int")
    text = name.startswith("varchar") | name.startswith("char")
    decimal = ~text & (name.startswith("decimal") | name.startswith("numeric"))
    return F.when(text, one), F.when(decimal, one), F.when(decimal, two)


def table_type(value: Column, dialect: str) -> Column:
    return looked_up(F.upper(value), TABLE_TYPES[dialect], F.lit("TABLE"))


def storage_format(input_class: Column) -> Column:
    out = F.lit("")
    for part, name in reversed(STORAGE):
        out = F.when(F.lower(input_class).contains(part), name).otherwise(out)
    return out


def category(source_type: Column) -> Column:
    """The category of a type of source; empty if unknown."""
    return looked_up(source_type, {t: c for c, types in CATEGORIES.items() for t in types}, F.lit(""))


def is_category(value: Column) -> Column:
    return value.isin(*CATEGORIES)


def is_system(name: Column, dialect: str) -> Column:
    """Whether a database, schema or user of a dialect belongs to the system (names as they are spelled)."""
    out = name.isin(*SYSTEM_NAMES[dialect])
    for beginning in SYSTEM_BEGINNINGS.get(dialect, []):
        out = out | name.startswith(beginning)
    return out


def is_table_engine(engine: Column, dialect: str) -> Column:
    return ~engine.isin(*NO_TABLES.get(dialect, []))
