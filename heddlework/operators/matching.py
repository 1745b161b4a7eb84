"""Filters by patterns, searches, validation and access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import allowed
from ..sources.storage import cut


def filtered(df: DataFrame, column: str, *rules: dict) -> DataFrame:
    """Rows that every rule allows; a rule has include, exclude, kind and case_sensitive."""
    for rule in rules:
        df = df.filter(allowed(F.col(column), **rule))
    return df


def literal_grams(pattern: Column) -> Column:
    """Runs of three characters that every match of a regular expression has; empty where none can be told.

    Escapes and classes stand for any character, and so does what an asterisk or question mark makes
    optional. Expressions with groups, alternatives or counts have none.
    """
    gap = "\u0000"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\\.", gap), r"\[\^?\]?[^\]]*\]", gap), r"[\s\S][*?]", gap)
    runs = F.split(plain, r"[\x00.^$+]")
    grams = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 3), _grams))
    return F.when(pattern.rlike(r"[(){|]"), F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def _grams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))


def filtered_by_table(df: DataFrame, column: str, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """As ``filtered`` with the rules in a table (pattern, exclude) of regular expressions.

    Rules are indexed by three characters that each match must have, of several the ones that
    fewest values have. A value is compared only with the rules of its own threes, by an equi-join.
    Rules without such characters are compared with every value; they are broadcast, and their number is checked.
    """
    rules = cut(rules.select(F.col("pattern").alias("_p"), F.col("exclude").alias("_x"), literal_grams(F.col("pattern")).alias("_g")).distinct(), "rules")
    values = cut(df.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").distinct(), "values")
    of_value = values.select("_v", F.explode(F.array_distinct(F.when(F.length("_v") >= 3, _grams(F.col("_v"))))).alias("_k"))
    common = of_value.groupBy(F.col("_k").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    keyed = rules.select("_p", "_x", F.explode("_g").alias("_f")).join(common, "_f", "left").groupBy("_p", "_x").agg(F.min_by("_f", F.coalesce("_n", F.lit(0))).alias("_k"))
    hits = of_value.join(keyed, "_k").filter(F.rlike("_v", "_p")).select("_v", "_x")
    rest = rules.filter(F.size("_g") == 0)
    n = rest.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} patterns without three plain characters in a row")
    if n:
        hits = hits.unionByName(values.join(F.broadcast(rest), F.rlike("_v", "_p")).select("_v", "_x"))
    hits = cut(hits.distinct(), "hits")
    out = df.join(hits.filter("_x"), F.col(column) == F.col("_v"), "left_anti")
    if rules.filter("NOT _x").limit(1).count():
        out = out.join(hits.filter("NOT _x"), F.col(column) == F.col("_v"), "left_semi")
    return out


def word_search(df: DataFrame, key: str, columns: list[str], terms: list[str]) -> DataFrame:
    """Keys with at least one of the words in the columns, and how many of them."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    hits = F.size(F.array_intersect(F.array_distinct(words), F.array(*(F.lit(t.lower()) for t in terms))))
    return df.select(key, hits.alias("score")).filter("score > 0")


def validated(df: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """Adds ``errors``: (field, message) for each failed check; a check that is null fails."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, ok, message in checks))
    return df.withColumn("errors", F.filter(found, lambda x: x.isNotNull()))


def with_template(requests: DataFrame, templates: DataFrame, path: str = "path") -> DataFrame:
    """Requests with the template of their path, if any; an exact one goes before one with ``*``.

    Templates are a trie: for each level a table of (segments in all, what is in front, segment). The
    distinct paths walk down it by equi-joins, one for each level, with their own segment and with ``*``.
    """
    trie = cut(templates.select("template", F.split("template", "/").alias("_s")).distinct(), "templates")
    depth = trie.agg(F.max(F.size("_s"))).first()[0] or 0
    at = requests.select(path).filter(F.col(path).isNotNull()).distinct().withColumn("_s", F.split(path, "/")).withColumn("_n", F.size("_s")).withColumn("_at", F.lit(""))
    ends = None
    for i in range(depth):
        front = F.array_join(F.slice("_s", 1, i), "/") if i else F.lit("")
        level = trie.filter(F.size("_s") > i).select(F.size("_s").alias("_m"), front.alias("_from"), F.col("_s")[i].alias("_seg"), F.array_join(F.slice("_s", 1, i + 1), "/").alias("_to")).distinct()
        own = at.filter(F.col("_n") > i).withColumn("_own", F.explode(F.array_distinct(F.array(F.col("_s")[i], F.when(F.col("_s")[i] != "", "*").otherwise(F.col("_s")[i])))))
        at = own.join(level, (F.col("_n") == F.col("_m")) & (F.col("_at") == F.col("_from")) & (F.col("_own") == F.col("_seg"))).select(path, "_s", "_n", F.col("_to").alias("_at"))
        done = at.filter(F.col("_n") == i + 1).select(path, F.col("_at").alias("_found"))
        ends = done if ends is None else ends.unionByName(done)
    if ends is None:
        ends = at.select(path, F.col("_at").alias("_found")).filter("false")
    hit = ends.join(templates, F.col("_found") == F.col("template")).drop("_found")
    best = hit.withColumn("_r", F.row_number().over(Window.partitionBy(path).orderBy(F.col("template").contains("*"), "template"))).filter("_r = 1").drop("_r")
    return requests.join(best, path, "left")


def access_decisions(requests: DataFrame, permissions: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds ``permission`` and ``allowed``: paths without a permission and the role admin are always allowed."""
    out = with_template(requests, permissions)
    granted = roles.select(F.col("role").alias("_role"), F.col("permission").alias("_granted")).distinct()
    out = out.join(granted, (F.col("role") == F.col("_role")) & (F.col("permission") == F.col("_granted")), "left")
    return out.withColumn("allowed", F.col("permission").isNull() | (F.col("role") == "admin") | F.col("_granted").isNotNull()).drop("_role", "_granted", "template")


def listed(df: DataFrame, order: list[str], token: str | None = None, size: int = 100, **equal) -> tuple[DataFrame, str | None, int]:
    """A page of the rows for which every given value is equal, the next page's token (none at the end) and the number of all such rows.

    A token is an offset; one that cannot be read is 0. Empty values do not filter.
    """
    for column, value in equal.items():
        if value not in (None, "", 0):
            df = df.filter(F.col(column) == value)
    start = int(token) if token and token.isdigit() else 0
    total = df.count()
    return df.orderBy(*order).offset(start).limit(size), str(start + size) if start + size < total else None, total


def numbered_page(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Pages count from 1 and have at most 100 rows."""
    size = max(1, min(size, 100))
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def past(df: DataFrame, column: str, last: object) -> tuple[DataFrame, DataFrame]:
    """Rows beyond the stored value, and the next value to store as one row."""
    new = df.filter(F.col(column) > F.lit(last)) if last is not None else df
    return new, new.agg(F.coalesce(F.max(column), F.lit(last)).alias("last_value"))


#: What a dependency may be on.
DEPENDENCY_TYPES = ("workflow", "time")


def dependency_errors(dependencies: DataFrame) -> DataFrame:
    """Adds ``error``, null for a valid dependency: a workflow needs an id, a time window hours 0 to 23 and 0 to 24 in order."""
    kind, start, end = F.col("type"), F.col("start_hour"), F.col("end_hour")
    workflow = F.when(F.coalesce("workflow_id", F.lit("")) == "", F.lit("workflow dependency requires workflow_id"))
    window = (
        F.when(start.isNull() & end.isNull(), F.lit("time dependency requires time_window")).when(~F.coalesce(start, F.lit(0)).between(0, 23), F.concat(F.lit("invalid start_hour: "), start.cast("string")))
        .when(~F.coalesce(end, F.lit(0)).between(0, 24), F.concat(F.lit("invalid end_hour: "), end.cast("string"))).when(F.coalesce(start, F.lit(0)) >= F.coalesce(end, F.lit(0)), F.lit("start_hour must be less than end_hour"))
    )
    unknown = F.concat(F.lit("unknown dependency type: "), F.coalesce(kind, F.lit("")))
    return dependencies.withColumn("error", F.when(kind == DEPENDENCY_TYPES[0], workflow).when(kind == DEPENDENCY_TYPES[1], window).otherwise(unknown))
