"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from fixed patterns: e-mail and IP addresses, card and telephone numbers. Further
candidates come from looser patterns: secrets, written-out addresses and local telephone numbers.
Three labelers vote on every candidate (-1, 0 or 1): the form of the span, a gazetteer, and words
in front of it. Their votes are counted over all documents by pattern of votes and span features, of
which there is a bounded number (see ``MOST_PATTERNS``). Expectation-maximisation on these counts
estimates how reliable each labeler is and the probability that a pattern is personal data; a
logistic span classifier is trained on those probabilities and decides which candidates are added.
Base spans always stay.

A null text is empty and has no spans. Repeated rows give repeated results. A candidate that is as
likely as not is added; spans of several kinds that begin at one place are all reported. Positions are code
points, ends exclusive. Other columns are ignored by the operator and kept by the pipeline's stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "address", "contact")
KINDS = BASE + ADDED

# The patterns match what the plain ones in the comments match. They are written so that Java's
# matcher neither recurses nor tries a run of characters again from each of its places.
_LOCAL = "A-Za-z0-9._%+-"
_HOST = "A-Za-z0-9-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++\.(?=[{_HOST}])[{_HOST}.]*?(?=\.\.|\.?(?![{_HOST}.]))",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-]{2}|[\x20-]?(?![0-9\x20-]))",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[^\s,;\"']{6,}+)|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "address": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:\(at\)|\[at\])\x20?[{_HOST}]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[{_HOST}]++)++",
    "contact": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without this has no match, and the pattern isn't tried.
NEEDS = {"email": "@", "phone": "+", "address": "at"}

# Fixed lists of the gazetteer and context labelers.
TLDS = "com|org|net|edu|gov|int|info|io|co|uk|de|fr|es|it|nl|ru|jp|cn|br|in|eu|ch|at|se|no|fi|pl"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
SECRET_PREFIXES = "AKIA|ghp_|sk_|xox|eyJ"
CUES = {
    "email": "mail|contact|write|reach|address", "ip": "ip|host|server|address|client|ping", "card": "card|visa|credit|debit|master|payment|pay", "phone": "call|phone|tel|mobile|fax|cell|dial",
    "secret": "key|login|user|auth|credential|export", "address": "mail|contact|write|reach|address", "contact": "call|phone|tel|mobile|fax|cell|dial",
}
AGAINST = "version|isbn|order|invoice|release|section|figure|example"
#: Characters of context, from at most so many pieces (matches and what lies between them) in front of a match.
CONTEXT, NEAR = 40, 8

#: kinds x votes (3 labelers of 3 values) x lengths x alphabets: the largest number of rows that reach the driver.
LENGTHS, ALPHABETS = (10, 16, 24), 4
MOST_PATTERNS = len(KINDS) * 27 * (len(LENGTHS) + 1) * ALPHABETS

LABELLED = "struct<kind:string,start:int,end:int,form:int,gazetteer:int,context:int,length:int,alphabet:int>"
#: Running values over an array are taken in blocks of so many, so that no array grows an element at a time.
RUN = 256
#: Marks around matches, and what stands for it if a text has it; no pattern tells the two apart.
MARK, INSTEAD = "\ue000", "\ue001"


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, both: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element what ``both`` makes of start and all elements before it, and last of all elements: one more than there are.

    Within blocks of RUN elements and over the blocks' totals arrays do grow by one element at a
    time, so n elements take some RUN * n + (n / RUN) ** 2 steps.
    """

    def over(x: Column, first: Column) -> Column:
        step = lambda at, y: F.struct(both(at["last"], y).alias("last"), F.concat(at["out"], F.array(at["last"])).alias("out"))
        return F.aggregate(x, F.struct(first.alias("last"), F.array().cast("array<int>").alias("out")), step, lambda at: F.concat(at["out"], F.array(at["last"])))

    def long(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: F.slice(v, i * RUN + 1, RUN))
        return _named(blocks, lambda b: _named(over(F.transform(b, lambda x: F.aggregate(x, start, both)), start), lambda befores: joined(b, befores)))

    def joined(blocks: Column, befores: Column) -> Column:
        parts = F.zip_with(blocks, F.slice(befores, 1, F.size(blocks)), lambda b, first: F.slice(over(b, first), 1, F.size(b)))
        return F.concat(F.flatten(parts), F.array(F.element_at(befores, -1)))

    return _named(values, lambda v: F.when(F.size(v) > RUN, long(v)).otherwise(over(v, start)))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _labelled(kind: str, x: Column) -> Column:
    """A candidate with the votes of the three labelers and the features of the classifier."""
    m, before = x["m"], F.lower(x["before"])
    digits = F.regexp_replace(m, "[^0-9]", "")
    one_digit = F.length(F.translate(digits, "0", "")) == 0
    form = {"secret": _vote(m.rlike("[0-9]"), m.rlike(r"(.)\1{5}")), "address": _vote(m.rlike(r"(?i)dot|\."), F.lit(False)), "contact": _vote(~digits.rlike("^[01]"), one_digit)}.get(kind, _vote(_valid(kind, m), ~_valid(kind, m)))
    gazetteer = {
        "email": _vote(m.rlike(rf"(?i)\.({TLDS})$"), m.rlike(r"\.[0-9]+$")), "ip": _vote(~m.rlike(r"^(0|255)\."), m.rlike(r"^(0|255)\.")), "card": _vote(digits.rlike(f"^({CARD_ISSUERS})"), digits.rlike("^0")),
        "phone": _vote(digits.rlike("^[1-9]"), digits.rlike("^0")), "secret": _vote(m.rlike(f"({SECRET_PREFIXES})"), m.rlike("(?i)[=:] ?(true|false|none|null)")), "address": _vote(m.rlike(rf"(?i)({TLDS})$"), m.rlike("[0-9]$")), "contact": _vote(digits.rlike("^[2-9]"), digits.rlike("^(000|123)")),
    }[kind]
    context = _vote(before.rlike(rf"\b({CUES[kind]})\b"), before.rlike(rf"\b({AGAINST})\b"))
    length = sum((F.when(F.length(m) > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    alphabet = F.when(m.rlike("^[0-9 .()+-]*$"), 0).when(m.rlike("^[^0-9]*$"), 1).when(m.rlike("[0-9]{6}"), 2).otherwise(3)
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), form.alias("form"), gazetteer.alias("gazetteer"), context.alias("context"), length.alias("length"), alphabet.alias("alphabet"))


def _apart(base: Column, more: Column) -> Column:
    """Of the spans of ``more`` those that overlap none of ``base``, by one pass over both in order of their starts."""
    place = lambda x, own: F.struct(x["start"].alias("start"), own.alias("own"), x["end"].alias("end"), x.alias("span"))
    none = F.filter(F.transform(more, lambda x: place(x, F.lit(True))), lambda x: F.lit(False))
    row = F.array_sort(F.concat(none, F.transform(base, lambda x: place(x, F.lit(False))), F.transform(more, lambda x: place(x, F.lit(True)))), lambda x, y: F.coalesce(F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)), x["own"].cast("int") - y["own"].cast("int")))
    ends = lambda r: _running(F.transform(r, lambda x: F.when(x["own"], 0).otherwise(x["end"])), lambda a, b: F.greatest(a, b), F.lit(0))
    far = 2**31 - 1
    starts = lambda r: _running(F.reverse(F.transform(r, lambda x: F.when(x["own"], far).otherwise(x["start"]))), lambda a, b: F.least(a, b), F.lit(far))
    kept = lambda r, e, s: F.filter(F.transform(r, lambda x, i: F.when(x["own"] & (F.get(e, i) <= x["start"]) & (F.get(s, F.size(r) - 1 - i) >= x["end"]), x["span"])), lambda x: x.isNotNull())
    swept = _named(row, lambda r: _named(ends(r), lambda e: _named(starts(r), lambda s: kept(r, e, s))))
    return F.when((F.size(base) > 0) & (F.size(more) > 0), swept).otherwise(more)


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns ``_base`` and ``_more``: the base spans, and the candidates that do not overlap them.

    Each pattern is matched once: its matches are put between marks, at which the text is then
    split. What is in front of a match is taken from the pieces before it, so the work grows with the
    text and its matches alone.
    """
    body = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), MARK, INSTEAD)
    pieces = {k: F.split(F.regexp_replace(body, F.lit(p), F.lit(f"{MARK}$0{MARK}")), MARK, -1) for k, p in PATTERNS.items()}
    none = F.array(F.lit(""))
    df = df.withColumns({f"_p_{k}": F.when(F.contains(body, F.lit(NEEDS[k])), x).otherwise(none) if k in NEEDS else x for k, x in pieces.items()})
    df = df.withColumns({f"_at_{k}": F.when(F.size(f"_p_{k}") > 1, _running(F.transform(f"_p_{k}", lambda x: F.length(x)), lambda a, b: a + b, F.lit(0))).otherwise(F.array(F.lit(0))) for k in KINDS})

    def span(kind: str, i: Column) -> Column:
        p, at = F.col(f"_p_{kind}"), F.col(f"_at_{kind}")
        last = F.greatest(F.lit(1), i - NEAR + 2)
        before = F.substring(F.array_join(F.slice(p, last, i - last + 1), ""), -CONTEXT, CONTEXT)
        return F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(p, i).alias("m"), before.alias("before"))

    def spans(kind: str) -> Column:
        odd = F.sequence(F.lit(1), F.size(f"_p_{kind}") - 2, F.lit(2))
        return F.when(F.size(f"_p_{kind}") > 1, F.filter(F.transform(odd, lambda i: span(kind, i)), lambda x: _valid(kind, x["m"])))

    labelled = lambda k: F.coalesce(F.transform(spans(k), lambda x: _labelled(k, x)), F.array().cast(f"array<{LABELLED}>"))
    df = df.withColumns({"_base": F.concat(*(labelled(k) for k in BASE)), "_more": F.concat(*(labelled(k) for k in ADDED))})
    return df.withColumn("_more", _apart(F.col("_base"), F.col("_more"))).drop(*(f"_{x}_{k}" for x in ("p", "at") for k in KINDS))


FEATURES = ("kind", "form", "gazetteer", "context", "length", "alphabet")
LABELERS = ("form", "gazetteer", "context")


def patterns(df: DataFrame) -> list[dict]:
    """How often each pattern of votes and features occurs in all documents: at most MOST_PATTERNS rows."""
    spans = df.select(F.explode(F.concat("_base", "_more")).alias("x")).select(*(F.col(f"x.{f}").alias(f) for f in FEATURES))
    return [r.asDict() for r in spans.groupBy(*FEATURES).count().orderBy(*FEATURES).limit(MOST_PATTERNS).collect()]


def reliabilities(counts: list[dict], rounds: int = 50) -> tuple[dict, list[float]]:
    """Expectation-maximisation with two classes: p(vote | labeler, class), and each pattern's probability."""
    # The start trusts each labeler a little.
    given = {(f, v, c): (0.5 if (v > 0) == c and v else 0.3 if v == 0 else 0.2) for f in LABELERS for v in (-1, 0, 1) for c in (False, True)}
    prior, posterior = 0.5, [0.5] * len(counts)
    for _ in range(rounds):
        for i, r in enumerate(counts):
            yes, no = prior, 1 - prior
            for f in LABELERS:
                yes, no = yes * given[f, r[f], True], no * given[f, r[f], False]
            posterior[i] = yes / (yes + no)
        total = sum(r["count"] for r in counts)
        if not total:
            break
        sure = sum(p * r["count"] for p, r in zip(posterior, counts, strict=True))
        prior = (sure + 1) / (total + 2)
        for f in LABELERS:
            for v in (-1, 0, 1):
                for c in (False, True):
                    part = sum((p if c else 1 - p) * r["count"] for p, r in zip(posterior, counts, strict=True) if r[f] == v)
                    # Ten pseudo-counts of the start keep a labeler that never votes from being trusted or blamed.
                    start = 0.5 if (v > 0) == c and v else 0.3 if v == 0 else 0.2
                    given[f, v, c] = (part + 10 * start) / ((sure if c else total - sure) + 10)
    return given, posterior


def classifier(counts: list[dict], posterior: list[float], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple[str, object] | None, float]:
    """Logistic regression on the features, trained on the patterns' probabilities; None is the constant."""
    weights: dict = {None: 0.0} | {(f, r[f]): 0.0 for r in counts for f in FEATURES}
    total = sum(r["count"] for r in counts) or 1
    for _ in range(rounds):
        step = dict.fromkeys(weights, 0.0)
        for r, p in zip(counts, posterior, strict=True):
            own = [None, *((f, r[f]) for f in FEATURES)]
            error = (p - 1 / (1 + math.exp(-sum(weights[k] for k in own)))) * r["count"] / total
            for k in own:
                step[k] += error
        for k in weights:
            weights[k] += rate * (step[k] - decay * weights[k])
    return weights


def fit(df: DataFrame) -> dict:
    """The span classifier, from documents with candidates."""
    counts = patterns(df)
    return classifier(counts, reliabilities(counts)[1])


def _sure(weights: dict, x: Column) -> Column:
    score = F.lit(weights[None])
    for f in FEATURES:
        cases = F.lit(0.0)
        for (name, value), w in ((k, w) for k, w in weights.items() if k):
            if name == f:
                cases = F.when(x[f] == F.lit(value), F.lit(w)).otherwise(cases)
        score = score + cases
    return score >= 0


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def found(documents: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of its base spans, and all spans."""
    candidates = cut(with_candidates(texts(documents)).drop("text"), "pii")
    weights = fit(candidates)
    added = F.filter("_more", lambda x: _sure(weights, x))
    of = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")
    return candidates.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", added)).alias("spans"), F.size(added).cast("long").alias("n_added")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


#: Texts are cut out of blocks of so many code points.
CUT = 1024


def _slice(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is given in blocks of CUT."""
    first = F.floor(start / CUT).cast("int")
    part = F.array_join(F.slice(blocks, first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
    return F.substring(part, start - first * CUT + 1, end - start)


def masked(candidates: DataFrame, weights: dict, text: str = "text") -> DataFrame:
    """Documents with candidates, their spans replaced by their kinds in brackets; spans that overlap are masked as one, with the earliest's kind."""
    body = F.col(text).cast("string")
    spans = F.array_sort(F.transform(F.concat("_base", F.filter("_more", lambda x: _sure(weights, x))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    df = candidates.withColumn("_all", spans).drop("_base", "_more")
    some = F.size("_all") > 0
    df = df.withColumns({"_ends": F.when(some, _running(F.transform("_all", lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))), "_blocks": F.when(some, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))})
    # The first span of each overlapping run: none before it reaches into it.
    heads = F.filter(F.transform("_all", lambda x, i: F.when(F.get("_ends", i) <= x["start"], F.struct(F.get("_ends", i).alias("since"), x["start"].alias("start"), x["kind"].alias("kind")))), lambda x: x.isNotNull())
    out = F.transform(heads, lambda x: F.concat(_slice(F.col("_blocks"), x["since"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = _slice(F.col("_blocks"), F.element_at("_ends", -1), F.length(body))
    return df.withColumn(text, F.when(some, F.concat(F.array_join(out, ""), rest)).otherwise(F.col(text))).drop("_all", "_ends", "_blocks")


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in each text is replaced by its kind; every document stays.

    Texts are matched once: the spans are written beside the columns of documents, whatever these are called.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    candidates = cut(with_candidates(docs.toDF(*names), text), "pii")
    out = masked(candidates, fit(candidates), text)
    if "n_chars" in docs.columns:
        out = out.withColumn(names[docs.columns.index("n_chars")], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
