"""Column lineage read from the text of SELECT statements, by a table of tokens and window functions over it.

No grammar is parsed. A statement's tokens get a depth by a running sum over brackets; a bracket before
SELECT or WITH opens a query; within a query the last clause word at its own depth names the clause, and
commas there separate outputs. Column references are the names of an output that are neither functions,
aliases, types, units nor reserved words: so arguments, conditions and results of CASE, and what OVER
partitions and orders by all count. A statement's tokens are one group of a window, bounded by its text.

Statements that differ only in names, literals, blanks and comments have one form (as in the digests of a statement
log). Names become numbered marks, each form is read once, and its outputs are spelled with the names of every
statement that has it; so the windows' work grows with the forms, and a statement costs its tokens and one join.

Not told apart: parameters of lambda functions (they count as columns), brackets around identifiers
(``[a b]``), and select lists of UPDATE, DELETE and MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import kept
from .lineage import bound, expanded_stars, to_base

_IDENTIFIER = r'(?:[\p{L}_$@#][\p{L}\p{N}_$]*+|"[^"]*+"|`[^`]*+`)'
_BLANK = r"(?:\s++|--[^\n]*+|/\*[\s\S]*?\*/)*+"
#: Names with their qualifiers, strings (a doubled quote is two strings side by side), numbers, marks.
TOKEN = rf"(?:{_IDENTIFIER}(?:\s*+\.\s*+(?:{_IDENTIFIER}|\*))*+|'[^']*+'|[0-9][\p{{L}}\p{{N}}_.]*+|::|->|\|\||<>|[<>!=]=|\S)"

# Words of the language; as qualified names they are columns all the same.
CLAUSES = "WITH INSERT INTO OVERWRITE CREATE SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH WINDOW QUALIFY UNION INTERSECT EXCEPT MINUS PARTITION VALUES CLUSTER DISTRIBUTE SORT".split()
JOINS = "JOIN LEFT RIGHT FULL INNER OUTER CROSS NATURAL SEMI ANTI ON USING LATERAL TABLE TABLESAMPLE PIVOT UNPIVOT FOR".split()
RESERVED = (
    CLAUSES
    + JOINS
    + "AND OR NOT IN IS NULL LIKE ILIKE RLIKE REGEXP SIMILAR BETWEEN CASE WHEN THEN ELSE END AS DISTINCT ALL ANY SOME TRUE FALSE EXISTS ESCAPE OVER BY ROWS RANGE GROUPS UNBOUNDED PRECEDING FOLLOWING CURRENT ROW ASC DESC NULLS FIRST LAST INTERVAL FILTER WITHIN AT TIME ZONE TOP DIV COLLATE".split()
    + "CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP LOCALTIME LOCALTIMESTAMP SYSDATE PRECISION VARYING".split()
)
UNITS = "YEAR QUARTER MONTH WEEK DAY HOUR MINUTE SECOND MILLISECOND MICROSECOND".split()
DATE_FUNCTIONS = "TIMESTAMPDIFF TIMESTAMPADD DATEADD DATEDIFF DATE_TRUNC".split()
#: All words that the reading depends on. Other names are exchangeable.
WORDS = [*RESERVED, *UNITS, *DATE_FUNCTIONS, "VIEW", "IF"]
_NAME = r'(?s)^[\p{L}_$@#]|^["`].*["`]$|^["`].*\.'


def _clean(name: Column) -> Column:
    return F.regexp_replace(name, r'[\s`"]', "")


def _raw(sql: str) -> Column:
    return F.regexp_extract_all(F.regexp_replace(sql, "^" + _BLANK, ""), F.lit(TOKEN + _BLANK), F.lit(0))


def token_table(stmts: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """(key, i, raw, tok, word, kind, level, query, rel, clause, branch, pos, …): one row for each token, with the query, clause and output that it stands in.

    ``sql`` is a text, or an array of tokens. ``raw`` also has the blanks and comments behind the token. A query is named by its first token; the statement's own is 0.
    """
    raw = F.col(sql) if isinstance(stmts.schema[sql].dataType, T.ArrayType) else _raw(sql)
    t = stmts.select(key, F.posexplode(raw).alias("i", "raw")).withColumn("tok", F.regexp_extract("raw", "^" + TOKEN, 0))
    kind = F.when(F.col("tok").rlike(r"(?s)^'.*'$"), "string").when(F.col("tok").rlike(_NAME), "name").when(F.col("tok").rlike("^[0-9]"), "number").otherwise("mark")
    all_ = Window.partitionBy(key).orderBy("i")
    t = t.withColumns({"word": F.upper("tok"), "kind": kind})
    t = t.withColumns({f"prev{n}": F.lag("word", n).over(all_) for n in (1, 2)} | {f"next{n}": F.lead("tok", n).over(all_) for n in (1, 2, 5, 6, 7)} | {"prev_kind": F.lag("kind").over(all_), "next_kind": F.lead("kind").over(all_)})
    opens, closes = F.col("tok") == "(", F.col("tok") == ")"
    upto, before = all_.rowsBetween(Window.unboundedPreceding, 0), all_.rowsBetween(Window.unboundedPreceding, -1)
    # Both brackets stand on the outer level, and there a closing one belongs to the last opening one.
    t = t.withColumn("level", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto) - opens.cast("int"))
    t = t.withColumn("opener", opens & F.upper("next1").isin("SELECT", "WITH"))
    on_level = Window.partitionBy(key, "level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    partner = F.last(F.when(opens, F.struct("i", "opener", "prev1", "prev2")), True).over(on_level)
    t = t.withColumn("partner", F.when(closes, partner)).withColumn("closer", closes & F.coalesce(F.col("partner.opener"), F.lit(False)))
    t = t.withColumn("q", F.coalesce(F.sum(F.col("opener").cast("int")).over(before), F.lit(0)) - F.sum(F.col("closer").cast("int")).over(upto))
    begins = F.when(F.lag("opener").over(all_), F.col("i"))
    t = t.withColumn("begins", begins).withColumn("query", F.coalesce(F.last("begins", True).over(Window.partitionBy(key, "q").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    t = t.withColumn("rel", F.col("level") - F.min("level").over(Window.partitionBy(key, "query")))
    # IS DISTINCT FROM and WITHIN GROUP begin no clause.
    begins_clause = (F.col("rel") == 0) & F.col("word").isin(*CLAUSES) & ~((F.col("word") == "FROM") & F.coalesce(F.col("prev1") == "DISTINCT", F.lit(False))) & ~((F.col("word") == "GROUP") & F.coalesce(F.col("prev1") == "WITHIN", F.lit(False)))
    own = Window.partitionBy(key, "query").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"begins_clause": begins_clause, "clause": F.last(F.when(begins_clause, F.col("word")), True).over(own), "branch": F.sum(F.when(begins_clause & (F.col("word") == "SELECT"), 1).otherwise(0)).over(own).cast("int") - 1})
    comma = (F.col("tok") == ",") & (F.col("rel") == 0) & (F.col("clause") == "SELECT")
    t = t.withColumn("comma", F.coalesce(comma, F.lit(False)))
    return t.withColumn("pos", F.sum(F.col("comma").cast("int")).over(Window.partitionBy(key, "query", "branch").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def _flagged(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens of outputs, with whether they are the output's alias, a reference or a star."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    t = tokens.filter("clause = 'SELECT' AND NOT begins_clause AND NOT comma").filter("NOT coalesce((prev1 = 'SELECT' AND word IN ('DISTINCT', 'ALL', 'TOP')) OR (prev1 = 'TOP' AND kind = 'number'), false)")
    item = Window.partitionBy(key, "query", "branch", "pos")
    t = t.withColumns({"first_i": F.min("i").over(item), "last_i": F.max("i").over(item)})
    name, reserved, word = F.col("kind") == "name", F.col("word").isin(*RESERVED), F.col("word")
    unit = flag((F.col("prev2") == "INTERVAL") & F.col("prev_kind").isin("string", "number")) | flag(word.isin(*UNITS) & (F.col("prev1") == "(") & ((F.upper("next1") == "FROM") | F.col("prev2").isin(*DATE_FUNCTIONS)))
    ends = (F.col("prev1") == "AS") | (F.col("prev1") == ")") | F.col("prev_kind").isin("string", "number") | ((F.col("prev_kind") == "name") & (~F.col("prev1").isin(*RESERVED) | F.col("prev1").isin("END", "NULL", "TRUE", "FALSE")))
    alias = flag(name & (F.col("rel") == 0) & (F.col("i") == F.col("last_i")) & (F.col("i") > F.col("first_i")) & ends & ~reserved & ~word.contains(".")) & ~unit
    star = flag(((F.col("tok") == "*") | (name & word.endswith("*"))) & (F.col("first_i") == F.col("last_i")))
    ref = flag(name & ~word.endswith("*") & ~reserved) & ~alias & ~unit & ~flag(F.col("next1") == "(") & ~flag(F.col("next_kind") == "string") & ~flag(F.col("prev1").isin("AS", "::", "COLLATE"))
    return t.withColumns({"alias": alias, "star": star, "ref": ref, "as": flag((word == "AS") & (F.col("rel") == 0))})


def _alias_behind(next1: str, next2: str) -> Column:
    """The alias that follows a table or a derived table, with or without AS."""
    ok = lambda c: F.when(F.col(c).rlike(r'^[\p{L}_$@#"`]') & ~F.upper(c).isin(*RESERVED), _clean(F.col(c)))
    return F.when(F.upper(next1) == "AS", ok(next2)).otherwise(ok(next1))


def select_facts(stmts: DataFrame, key: str, sql: str = "sql") -> dict[str, DataFrame]:
    """Facts of every query of each statement: items, refs, stars, from_items, inserts, scalars and errors; the tokens are computed once and kept.

    ``stmt_id`` is the key, ``#`` and the query. ``expr`` is the text of an output without what its subqueries hold; a subquery alone is ``subquery``. Tables in from_items that are derived or common table expressions have such an id as their name.
    """
    t = kept(token_table(stmts, key, sql))
    id_ = lambda q: F.concat_ws("#", F.col(key).cast("string"), q.cast("string"))
    t = t.withColumn("stmt_id", id_(F.col("query")))
    out = _flagged(t, key)
    texts = F.array_sort(F.collect_list(F.when(~F.col("alias") & ~F.col("as"), F.struct("i", "raw"))))
    one = F.count_if(~F.col("alias") & ~F.col("as")) == 1
    column = F.regexp_extract(_clean(F.max(F.when(F.col("ref"), F.col("tok")))), r"[^.]*$", 0)
    items = out.groupBy(F.col(key), "stmt_id", "query", "branch", "pos").agg(
        F.max(F.when(F.col("alias"), _clean(F.col("tok")))).alias("alias"), F.when(one & (F.count_if("ref") == 1), column).alias("column_name"),
        F.regexp_replace(F.regexp_replace(F.array_join(F.transform(texts, lambda x: x["raw"]), ""), r"\s+$", ""), r"^\(\)$", "subquery").alias("expr"), F.max("star").alias("star"),
        F.array_sort(F.collect_list(F.when(~F.col("alias") & ~F.col("as"), F.col("i")))).alias("places"),
    )
    parts = _clean(F.col("tok"))
    qualifier = F.nullif(F.regexp_replace(parts, r"\.?[^.]*$", ""), F.lit(""))
    refs = out.filter("ref").select("stmt_id", "branch", "pos", F.col("i").alias("ref_pos"), qualifier.alias("qualifier"), F.regexp_extract(parts, r"[^.]*$", 0).alias("column_name"))
    stars = out.filter("star").select("stmt_id", "branch", "pos", qualifier.alias("qualifier"))

    named = t.filter("kind = 'name' AND clause = 'FROM' AND coalesce(next1, '') <> '('").filter("(rel = 0 AND (prev1 IN ('FROM', 'JOIN') OR prev1 = ',')) OR (prev1 = 'TABLE' AND prev2 IN ('(', ','))").filter(~F.col("word").isin(*RESERVED))
    temporal = F.upper("next1") == "FOR"
    alias = F.when(temporal, _alias_behind("next6", "next7")).otherwise(_alias_behind("next1", "next2"))
    plain = named.select(key, "stmt_id", "branch", F.col("i").alias("from_pos"), alias.alias("alias"), F.lower(_clean(F.col("tok"))).alias("table_name"))
    closed = t.filter("closer").withColumns({"inner": id_(F.col("partner.i") + 1), "as_": _alias_behind("next1", "next2")})
    ctes = closed.filter("clause = 'WITH' AND partner.prev1 = 'AS'").select(F.col(key).alias("_k"), F.lower(_clean(F.col("partner.prev2"))).alias("_name"), "inner")
    # Inside its own definition the name of a common table expression is itself, so rows of recursion are told by the id.
    plain = plain.join(ctes, (F.col(key) == F.col("_k")) & (F.col("table_name") == F.col("_name")), "left")
    plain = plain.select("stmt_id", "branch", "from_pos", F.coalesce("alias", "table_name").alias("alias"), F.coalesce("inner", "table_name").alias("table_name"))
    derived = closed.filter("clause = 'FROM' AND partner.prev1 IN ('FROM', 'JOIN', ',', 'LATERAL')").select("stmt_id", "branch", F.col("partner.i").alias("from_pos"), F.coalesce("as_", "inner").alias("alias"), F.col("inner").alias("table_name"))
    scalars = closed.filter("clause = 'SELECT'").select(F.col("inner").alias("stmt_id"), F.col("stmt_id").alias("outer_id"), F.col("branch").alias("outer_branch"), F.col("pos").alias("outer_pos"), F.col("partner.i").alias("at"))

    into = t.filter("query = 0 AND kind = 'name' AND clause IN ('INTO', 'OVERWRITE') AND rel = 1")
    inserts = into.select("stmt_id", (F.row_number().over(Window.partitionBy("stmt_id").orderBy("i")) - 1).alias("pos"), _clean(F.col("tok")).alias("column_name"))
    target = t.filter("query = 0 AND kind = 'name' AND rel = 0").filter(
        "(clause IN ('INTO', 'OVERWRITE') AND prev1 IN ('INTO', 'OVERWRITE', 'TABLE')) OR (clause = 'CREATE' AND prev1 IN ('TABLE', 'VIEW', 'EXISTS') AND word <> 'IF')"
    ).filter(~F.col("word").isin(*RESERVED)).groupBy("stmt_id").agg(F.lower(_clean(F.min_by("tok", "i"))).alias("target_table"))
    return {"tokens": t, "items": items, "refs": refs, "stars": stars, "from_items": plain.unionByName(derived), "scalars": scalars, "inserts": inserts, "targets": target, "errors": _errors(stmts, t, out, key)}


def _errors(stmts: DataFrame, tokens: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, error): the first reason, if any, for which a statement's text is no whole SELECT."""
    g = tokens.groupBy(key).agg(
        F.count_if(F.col("tok").isin("'", '"', "`")).alias("quotes"), F.min(F.col("level")).alias("low"), F.sum(F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)).alias("open"), F.count_if(F.col("begins_clause") & (F.col("word") == "SELECT")).alias("selects"),
        F.count_if((F.col("rel") == 0) & F.col("prev1").isin("FROM", "JOIN") & F.col("word").isin(*CLAUSES, "JOIN", "ON", "USING")).alias("no_table"),
        F.count_if(F.col("begins_clause") & F.col("word").isin("FROM", "WHERE", "GROUP", "HAVING", "LIMIT") & (F.col("prev1").isin("SELECT", ","))).alias("no_item"), F.max_by("word", "i").alias("end"), F.count_if(F.col("comma") & F.col("prev1").isin("SELECT", ",")).alias("no_item_2"),
    )
    why = (
        F.when(F.coalesce("quotes", F.lit(0)) > 0, "unclosed quote").when((F.col("low") < 0) | (F.col("open") != 0), "unbalanced brackets").when(F.coalesce("selects", F.lit(0)) == 0, "no SELECT")
        .when(F.col("no_item") + F.col("no_item_2") > 0, "missing output").when((F.col("no_table") > 0) | F.col("end").isin("FROM", "JOIN"), "missing table").when(F.col("end").isin("SELECT", ",", "WHERE", "BY", "AND", "OR"), "unfinished")
    )
    return stmts.select(key).join(g, key, "left").select(key, why.alias("error")).filter("error IS NOT NULL")


#: A name in a form: the form, the name's number without and, in the case of its letters, with regard to case (0: lower case).
_MARK, _BITS = r"^\?[0-9a-f]{32}_[0-9]+_[aA]{24}$", 24


def _parsed(name: Column) -> Column:
    """A dotted name of a form as parts: the text, or the numbers of the name that belongs there."""
    field = lambda p, i: F.split(p, "_")[i]
    number = lambda p: F.conv(F.translate(field(p, 2), "aA", "01"), 2, 10).cast("int")
    return F.transform(F.split(name, r"\."), lambda p: F.struct(p.alias("text"), F.when(p.rlike(_MARK), field(p, 1).cast("int")).alias("any"), F.when(p.rlike(_MARK), number(p)).alias("exact")))


def _spelled(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.when(x["any"].isNull(), x["text"]).when(x["exact"] == 0, F.get("lowers", x["any"] - 1)).otherwise(F.get("names", x["exact"] - 1))), ".")


def _forms(stmts: DataFrame, key: str, catalog: DataFrame, sql: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements (key, form, raw, names, lowers), the forms (form, tokens), and their catalog.

    A form has the columns of the catalog's tables that its statements may read, so that stars and names without qualifier mean the same in all of them.
    """
    none = F.array().cast("array<string>")
    # Texts are small beside the work on them, so files alone would give few tasks.
    stmts = stmts.select(key, sql).repartition(int(stmts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    t = stmts.select(key, F.coalesce(_raw(sql), none).alias("raw")).withColumn("tok", F.transform("raw", lambda r: F.regexp_extract(r, "^" + TOKEN, 0)))
    t = t.withColumn("parts", F.transform("tok", lambda x: F.when(x.rlike(_NAME) & ~F.upper(x).isin(*WORDS), F.split(_clean(x), r"\.")).otherwise(none)))
    fixed = lambda a: F.upper(a).isin(*WORDS, "*", "") | a.rlike("(?i)^_col[0-9]+$")
    t = t.withColumn("names", F.filter(F.array_distinct(F.flatten("parts")), lambda a: ~fixed(a)))
    columns = catalog.filter("table_name IS NOT NULL AND column_name IS NOT NULL")
    if columns.limit(1).count():
        t = kept(t)
        tables = columns.groupBy(F.lower("table_name").alias("table_name")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("columns"))
        behind = F.transform("tok", lambda x, i: F.when(x.rlike(_NAME) & F.upper(F.get("tok", i - 1)).isin("FROM", "JOIN", "TABLE", ","), F.lower(_clean(x))))
        read = t.select(key, F.posexplode(F.array_distinct(F.filter(behind, lambda x: x.isNotNull()))).alias("place", "table_name")).join(tables, "table_name")
        t = t.join(read.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "table_name", "columns"))).alias("read")), key, "left")
        of_table = F.flatten(F.transform("read", lambda c: F.transform(c["columns"], lambda x: x["column_name"])))
        t = t.withColumn("names", F.array_distinct(F.concat("names", F.filter(F.coalesce(of_table, none), lambda a: ~fixed(a)))))
        # A table whose name is such words alone is no form's own: its statements keep all their names.
        t = t.withColumn("names", F.when(F.coalesce(F.exists("read", lambda c: F.forall(F.split(c["table_name"], r"\."), fixed)), F.lit(False)), none).otherwise(F.col("names")))
    else:
        t = t.withColumn("read", F.lit(None).cast("array<struct<place:int,table_name:string,columns:array<struct<ordinal:int,column_name:string>>>>"))
    t = t.withColumn("lowers", F.array_distinct(F.transform("names", F.lower)))
    place = lambda a, e: F.concat(F.lit("?"), F.array_position("lowers", F.lower(a)).cast("string"), F.lit("_"), F.translate(F.lpad(F.bin(e), _BITS, "0"), "01", "aA"))
    mark = lambda a: F.when(F.array_contains("names", a), place(a, F.array_position("names", a))).otherwise(a)
    lower_mark = lambda a: F.when(F.array_contains("lowers", a), place(a, F.lit(0))).otherwise(a)
    plain = F.transform("tok", lambda x: F.when(x.rlike(r"(?s)^'.*'$"), "'s'").when(x.rlike("^[0-9]"), "0").otherwise(x))
    tokens = F.zip_with(plain, "parts", lambda x, p: F.when(F.size(p) == 0, x).otherwise(F.array_join(F.transform(p, lambda a: F.when(a == "*", a).otherwise(F.concat(F.lit('"'), mark(a), F.lit('"')))), ".")))
    of = F.transform("read", lambda c: F.struct(F.array_join(F.transform(F.split(c["table_name"], r"\."), lower_mark), ".").alias("t"), F.transform(c["columns"], lambda x: F.struct(x["ordinal"].alias("o"), mark(x["column_name"]).alias("c"))).alias("cs")))
    t = t.select(key, "raw", "names", "lowers", tokens.alias("tokens"), F.coalesce(of, F.array().cast("array<struct<t:string,cs:array<struct<o:int,c:string>>>>")).alias("read"))
    t = kept(t.withColumn("form", F.md5(F.to_json(F.struct("tokens", "read")))))
    forms = kept(t.select("form", "tokens", "read").distinct())
    # Names are the form's own, so that no catalog is another's.
    own = lambda c, around: F.regexp_replace(c, F.lit(rf"{around}\?([0-9]+_[aA]{{{_BITS}}})(?={around or '$|[.]'})"), F.concat(F.lit(f"{around}?"), "form", F.lit("_$1")))
    flat = forms.select("form", F.explode("read").alias("r")).select("form", "r.t", F.explode("r.cs").alias("x"))
    known = flat.select(own(F.col("t"), "").alias("table_name"), own(F.col("x.c"), "").alias("column_name"), F.col("x.o").alias("ordinal")).distinct()
    return t, forms.select("form", F.transform("tokens", lambda x: own(x, '"')).alias("tokens")), known


def _form_lineage(stmts: DataFrame, key: str, catalog: DataFrame, sql: str) -> tuple[DataFrame, DataFrame]:
    """Outputs of each form (key, target_table, pos, target, listed, expr), and forms with errors; expr is the places of its tokens or, behind a star, a name."""
    f = select_facts(stmts, key, sql)
    errors = f["errors"]
    good = f["items"].join(errors, key, "left_anti")
    starry = good.filter("star").select("stmt_id", "branch", "pos")
    name = F.coalesce("alias", "column_name", F.concat(F.lit("_col"), F.col("pos").cast("string")))
    outputs = good.filter("NOT star").withColumns({"target": name, "expr": F.struct(F.col("places").alias("at"), F.lit(None).cast("string").alias("named"))})
    catalog = catalog.select("table_name", "column_name", F.col("ordinal").cast("int").alias("ordinal"))
    inner = outputs.filter("query <> 0 AND branch = 0").select(F.col("stmt_id").alias("table_name"), F.col("target").alias("column_name"), F.col("pos").alias("ordinal"))
    known = kept(catalog.unionByName(inner))
    open_ = expanded_stars(f["stars"].join(starry, ["stmt_id", "branch", "pos"], "left_semi"), f["from_items"], known)
    # Outputs behind a star move by as many places as the star has columns.
    width = open_.groupBy("stmt_id", "branch", "pos").agg(F.count(F.lit(1)).alias("n"))
    shift = F.coalesce(F.sum(F.coalesce("n", F.lit(1)) - 1).over(Window.partitionBy("stmt_id", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = good.select("stmt_id", "branch", "pos").join(width, ["stmt_id", "branch", "pos"], "left").withColumn("shift", shift.cast("int")).drop("n")
    owner = good.select("stmt_id", F.col(key), "query").distinct()
    stars = open_.join(places, ["stmt_id", "branch", "pos"]).join(owner, "stmt_id").select(F.col(key), "stmt_id", "query", "branch", (F.col("pos") + F.col("shift") + F.col("place") - 1).alias("pos"), F.col("column_name").alias("target"), F.concat_ws(".", "table_name", "column_name").alias("source"), F.lit(0).alias("ref_pos"), F.struct(F.lit(None).cast("array<int>").alias("at"), F.col("column_name").alias("named")).alias("expr"))

    hit = bound(f["refs"], f["from_items"], known).select("stmt_id", "branch", "pos", "ref_pos", F.concat_ws(".", F.nullif("table_name", F.lit("")), "column_name").alias("source"))
    hit = kept(hit)
    # What a scalar subquery reads belongs to the output that it stands in, one nesting after another.
    scalars, level, reads = f["scalars"], hit, hit
    while True:
        level = kept(level.join(scalars, "stmt_id").select(F.col("outer_id").alias("stmt_id"), F.col("outer_branch").alias("branch"), F.col("outer_pos").alias("pos"), "ref_pos", "source"))
        if not level.limit(1).count():
            break
        reads = reads.unionByName(level)
    whole = outputs.join(places, ["stmt_id", "branch", "pos"]).join(reads, ["stmt_id", "branch", "pos"], "left").select(F.col(key), "stmt_id", "query", "branch", (F.col("pos") + F.col("shift")).alias("pos"), "target", "source", "ref_pos", "expr")
    whole = kept(whole.unionByName(stars))
    # The first branch of a set operation names the outputs of all.
    names = whole.filter("branch = 0").groupBy("stmt_id", "pos").agg(F.min("target").alias("_n"), F.min("expr").alias("_e"))
    whole = whole.join(names, ["stmt_id", "pos"], "left").withColumns({"target": F.coalesce("_n", "target"), "expr": F.coalesce("_e", "expr")}).drop("_n", "_e")

    inside = whole.filter("query <> 0 AND source IS NOT NULL").filter(~F.col("source").startswith(F.concat("stmt_id", F.lit("."))))
    base = to_base(inside.select(F.concat_ws(".", "stmt_id", "target").alias("target"), "source"))
    top = whole.filter("query = 0").join(base.select(F.col("target").alias("source"), F.col("source").alias("_b")), "source", "left").withColumn("source", F.coalesce("_b", "source"))
    # What is left of a query's own names has no source: constants.
    top = top.withColumn("source", F.when(~F.col("source").startswith(F.concat(F.col(key).cast("string"), F.lit("#"))), F.col("source")))
    listed = F.collect_list(F.when(F.col("source").isNotNull(), F.struct("branch", "ref_pos", _parsed(F.col("source")).alias("source"))))
    out = top.groupBy(F.col(key), "stmt_id", "pos", "target", "expr").agg(listed.alias("listed"))
    out = out.join(f["targets"], "stmt_id", "left").join(f["inserts"].withColumnRenamed("column_name", "_into"), ["stmt_id", "pos"], "left")
    return out.select(F.col(key), F.coalesce("target_table", F.lit("RESULT_SET")).alias("target_table"), "pos", F.coalesce("_into", "target").alias("target"), "listed", "expr"), errors


def text_lineage(stmts: DataFrame, key: str, catalog: DataFrame, sql: str = "sql") -> tuple[DataFrame, DataFrame]:
    """Lineage of each statement's outputs from its text, and the statements that could not be read.

    (key, target_table, pos, target, sources, n_sources, operator): sources are columns of tables, found
    through derived tables, common table expressions and scalar subqueries of the statement, in the order
    of their places; a column that is read twice is there twice. Without INTO or CREATE the table is RESULT_SET. ``catalog`` (table_name,
    column_name, ordinal) settles names without qualifier and stars; a star of an unknown table is left out.
    A statement with an error has no lineage and doesn't touch that of others.
    """
    catalog = catalog.select("table_name", "column_name", F.col("ordinal").cast("int").alias("ordinal"))
    t, forms, known = _forms(stmts, key, catalog, sql)
    out, errors = _form_lineage(forms, "form", known, "tokens")
    out = out.withColumns({"target_table": _parsed(F.col("target_table")), "target": _parsed(F.col("target")), "named": _parsed(F.col("expr.named"))})
    whole = t.select(key, "form", "raw", "names", "lowers").join(kept(out), "form")
    text = F.array_join(F.transform("expr.at", lambda i: F.get("raw", i)), "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), r"^\(\)$", "subquery")
    listed = F.array_sort(F.transform("listed", lambda x: F.struct(x["branch"].alias("b"), x["ref_pos"].alias("p"), _spelled(x["source"]).alias("source"))))
    return whole.select(
        key, _spelled(F.col("target_table")).alias("target_table"), "pos", _spelled(F.col("target")).alias("target"),
        F.array_join(F.transform(listed, lambda x: x["source"]), ",").alias("sources"), F.size("listed").cast("long").alias("n_sources"), F.coalesce(text, _spelled(F.col("named"))).alias("operator"),
    ), t.select(key, "form").join(kept(errors), "form").select(key, "error")


def base_lineage(lineage: DataFrame) -> DataFrame:
    """(target, source): columns that statements write, from the columns that no statement of the batch writes."""
    edges = lineage.filter("target_table <> 'RESULT_SET' AND sources <> ''").select(F.concat_ws(".", "target_table", "target").alias("target"), F.explode(F.split("sources", ",")).alias("source"))
    return to_base(edges)
