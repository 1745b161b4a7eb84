"""Column functions on names, paths and sensitive text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of values that must not reach an audit log, and that a shown connection must hide. Fixed values.
REDACTED_KEYS = ("password", "secret", "api_key", "access_key", "secret_key", "token", "private_key", "credentials")
MASKED_KEYS = ("password", "secret", "api_key", "access_key", "secret_key")
#: Audit actions by severity; all others are info.
WARNING_ACTIONS = ("login_failed", "password_change")
CRITICAL_ACTIONS = ("datasource_delete", "task_delete", "config_change")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: ``*``, ``?``, ``[abc]``, ``[a-z]``, ``[!x]`` or ``[^x]``.

    The first ``]`` of a class is literal, and a class that is not closed matches nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[":
            start = i + 1 if pattern[i : i + 1] in ("!", "^") else i
            end = pattern.find("]", start + 1)
            if end < 0:
                return "[^\\s\\S]"
            body = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[start:end])
            out.append(f"[{'^' if start > i else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"^{''.join(out)}$"


def matches_glob(value: Column, pattern: str, case_sensitive: bool = True) -> Column:
    return value.rlike(("" if case_sensitive else "(?i)") + glob_regex(pattern))


def matches_regex(value: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """Whether the expression is found anywhere; a bad one is an error when the plan is made."""
    re.compile(pattern)
    return value.rlike(("" if case_sensitive else "(?i)") + pattern)


def allowed(value: Column, include: list[str], exclude: list[str], kind: str = "glob", case_sensitive: bool = True) -> Column:
    """Exclusion wins; without includes everything else is allowed. Kinds other than regex are globs."""
    one = matches_regex if kind == "regex" else matches_glob
    any_of = lambda ps: F.coalesce(F.lit(False), *()) if not ps else _any([one(value, p, case_sensitive) for p in ps])
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def normal_path(path: Column) -> Column:
    """Segments that are numbers or UUIDs become ``:id``."""
    identifier = r"^([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.when(x.rlike(identifier), ":id").otherwise(x)), "/")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """A column made from a value that is computed once, wherever the column uses it."""
    return F.transform(F.array(value), use)[0]


#: Tokens of JSON text: strings, marks, white space, other values, and a quote that closes no string. They cover all of a text.
JSON_TOKEN = r'"(?:[^"\\]++|\\[\s\S])*+"|[\{\}\[\]:,]|\s++|[^\s\{\}\[\]:,"]++|"'
#: So many tokens are put together before they are appended to what is there, so that long texts are not copied for each token.
TOKEN_BLOCK = 256


def redacted_json(text: Column, keys: tuple[str, ...] = REDACTED_KEYS, by: str = "[REDACTED]") -> Column:
    """JSON text with the whole values of the keys replaced at any depth, whether objects, lists or plain values, also inside lists.

    Names are compared after unescaping. What is outside the values stays as it was written. Text that is
    no valid JSON stays if it has none of the names, and is replaced as a whole if it has, as where a value
    would end is not known then.
    """
    unescaped = lambda t: F.when(t.contains("\\"), F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
    replaced = F.to_json(F.array(F.lit(by))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(by)))) - 2)

    def step(a: Column, t: Column) -> Column:
        """The next token: pending is 1 after one of the keys, 2 after its colon; skip is the depth at which a value that is left out ends, or -1."""
        turn = F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        depth, inside, blank = a["depth"] + turn, a["skip"] >= 0, t.rlike(r"^\s")
        value = ~inside & ~blank & (a["pending"] == 2)
        out = F.when(inside, F.lit("")).when(value, replaced).otherwise(t)
        skip = F.when(inside & (depth > a["skip"]), a["skip"]).when(value & (turn == 1), a["depth"]).otherwise(-1)
        key = t.startswith('"') & unescaped(t).isin(*keys)
        pending = F.when(inside | value, 0).when(blank, a["pending"]).when((a["pending"] == 1) & (t == ":"), 2).when(key, 1).otherwise(0)
        return F.struct(F.concat(a["out"], out).alias("out"), depth.alias("depth"), skip.alias("skip"), pending.alias("pending"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(-1).alias("skip"), F.lit(0).alias("pending"))

    def block(a: Column, tokens: Column) -> Column:
        return bound(F.aggregate(tokens, a.withField("out", F.lit("")), step), lambda own: own.withField("out", F.concat(a["out"], own["out"])))

    def blocks(tokens: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / TOKEN_BLOCK).cast("int")), lambda i: F.slice(tokens, i * TOKEN_BLOCK + 1, TOKEN_BLOCK))

    done = F.aggregate(bound(F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0)), blocks), begin, block)["out"]
    named = F.lit(False)
    for k in keys:
        named = named | text.contains(k)
    return F.when(text.isNull() | ~(named | text.contains("\\u")), text).when(F.try_parse_json(text).isNotNull(), done).otherwise(F.lit(by))


def redacted_map(m: Column, keys: tuple[str, ...] = REDACTED_KEYS, by: str = "[REDACTED]") -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.isin(*keys), F.lit(by)).otherwise(v))


def masked_config(m: Column) -> Column:
    """Secrets of a connection, where they are not empty, as asterisks."""
    return F.transform_values(m, lambda k, v: F.when(k.isin(*MASKED_KEYS) & (v != ""), F.lit("********")).otherwise(v))


def masked(value: Column, keep: int) -> Column:
    """Some characters at either end stay; of a value too short for that, none."""
    return F.when(F.length(value) <= 2 * keep, F.lit("****")).otherwise(F.concat(F.left(value, F.lit(keep)), F.lit("****"), F.right(value, F.lit(keep))))


def unquoted(name: Column) -> Column:
    """An identifier without its quotes."""
    return F.regexp_replace(F.trim(name), r'^[`"\[]|[`"\]]$', "")


def node_id(*parts: Column) -> Column:
    """Names joined by dots, blank ones left out."""
    return F.concat_ws(".", *(F.when(F.trim(p) != "", F.lower(F.trim(p))) for p in parts))


def hashed_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def severity(action: Column) -> Column:
    return F.when(action.isin(*WARNING_ACTIONS), "warning").when(action.isin(*CRITICAL_ACTIONS), "critical").otherwise("info")


def file_format(path: Column) -> Column:
    """csv, json or parquet by suffix, whatever its case; null for others."""
    return F.nullif(F.regexp_extract(F.lower(path), r"\.(csv|json|parquet)$", 1), F.lit(""))


def partition_values(spec: Column) -> Column:
    """``a=1/b=2`` as a map; parts without ``=`` are left out."""
    parts = F.filter(F.split(spec, "/"), lambda x: x.contains("="))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1), F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x)))))
