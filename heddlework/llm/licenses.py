"""Licence statements by sentence rules, with DataFrame functions.

A text is cut into sentences at blank lines and after ``.``, ``;``, ``!`` or ``?`` (or ``:`` at a line's
end) followed by white space; other line ends are white space, as licence texts come wrapped. Copyright
lines, SPDX identifiers and lines that are a whole statement are sentences of their own. A sentence is normalised (lower case, runs of
anything but letters and digits as one space) and mapped to the identifier of a known licence sentence,
an index into ``SENTENCES``; unknown ones get none and break a sequence. The sequence of
identifiers is matched against the ordered rules: the longest rules come first and a rule claims the
identifiers it matches, so a full licence text counts once, not once more for a sentence that also
stands alone.

A null text has no sentences. One row for each claimed rule, with the number of its first sentence
(from 0, of those with a letter) and how many sentences it covers; of several patterns that fit a
sentence, and of several rules, the first counts. A statement of two licences has both, joined by OR or
AND. Repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

#: Every known sentence has one of these; only texts and sentences that have are looked at (a test draws sentences from all patterns).
FILTER = "|".join(
    [
        "licen[sc]",
        "copyright",
        "permission",
        "warrant",
        "redistribut",
        "rights reserved",
        "public domain",
        "spdx",
        "liab",
        "gnu",
        "apache org",
        "of the mpl",
        "unencumbered",
        "free to copy",
        "to endorse or promote",
        "is free software",
        "free software foundation",
        "(?:released|distributed|available|published|provided|covered|free software)(?: for use| to you)?(?: under| by)",
    ]
)
#: In a text other characters can stand where a normalised sentence has a space.
TEXT_FILTER = FILTER.replace(" ", "[^a-z0-9]+")
#: Each alternative of the filter has one of these, which are quick to look for.
STEMS = "licen copyright permission warrant redistribut reserved public spdx liab gnu apache mpl unencumbered free endorse released distributed available published provided covered".split()

#: Licences that are named in statements: the identifier, and its name as a pattern of the normalised form.
NAMED = [
    ("MIT", r"mit( x11)?"), ("Apache-2.0", r"apache( software)?( licen[sc]e)?( version| v)? ?2( 0)?"), ("Apache-1.1", r"apache( software)?( licen[sc]e)?( version| v)? ?1 1"),
    ("LGPL-2.1", r"(gnu )?(lesser|library) general public( licen[sc]e)?( lgpl)?( version| v)? ?2( [01])?|(gnu )?lgpl( version| v)? ?2( [01])?"), ("LGPL-3.0", r"(gnu )?lesser general public( licen[sc]e)?( lgpl)?( version| v)? ?3( 0)?|(gnu )?lgpl( version| v)? ?3( 0)?"),
    ("AGPL-3.0", r"(gnu )?affero general public( licen[sc]e)?( agpl)?( version| v)? ?3( 0)?|(gnu )?agpl( version| v)? ?3( 0)?"),
    ("GPL-2.0", r"(gnu )?general public( licen[sc]e)?( gpl)?( version| v)? ?2( 0)?|(gnu )?gpl( version| v)? ?2( 0)?"), ("GPL-3.0", r"(gnu )?general public( licen[sc]e)?( gpl)?( version| v)? ?3( 0)?|(gnu )?gpl( version| v)? ?3( 0)?"),
    ("BSD-2-Clause", r"(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"), ("BSD-3-Clause", r"(bsd 3 clause|3 clause bsd|(new|modified|revised) bsd)"), ("BSD", r"bsd"), ("ISC", r"isc"), ("Zlib", r"zlib( libpng)?"),
    ("MPL-2.0", r"mozilla public( licen[sc]e)?( mpl)?( version| v)? ?2( 0)?|mpl( version| v)? ?2( 0)?"), ("EPL-2.0", r"eclipse public( licen[sc]e)?( epl)?( version| v)? ?2( 0)?|epl( version| v)? ?2( 0)?"), ("BSL-1.0", r"boost software( licen[sc]e)?( version)?( 1 0)?"),
    ("Artistic-2.0", r"artistic( licen[sc]e)?( version)? 2( 0)?"), ("EUPL-1.2", r"european union public( licen[sc]e)?( version| v)?( 1 2)?|eupl( version| v)?( 1 2)?"), ("Unlicense", r"unlicen[sc]e"), ("WTFPL", r"wtfpl|do what the fuck you want to public( licen[sc]e)?"),
    ("CC0-1.0", r"(cc0|creative commons (zero|cc0))( universal)?( version| v)?( 1 0)?( universal)?"), ("CC-BY-NC-SA-4.0", r"(cc|creative commons) (by nc sa|attribution noncommercial sharealike)( 4 0)?( international)?"), ("CC-BY-NC-ND-4.0", r"(cc|creative commons) (by nc nd|attribution noncommercial noderivatives)( 4 0)?( international)?"),
    ("CC-BY-NC-4.0", r"(cc|creative commons) (by nc|attribution noncommercial)( 4 0)?( international)?"), ("CC-BY-ND-4.0", r"(cc|creative commons) (by nd|attribution noderivatives)( 4 0)?( international)?"), ("CC-BY-SA-4.0", r"(cc|creative commons) (by sa|attribution sharealike)( 4 0)?( international)?"),
    ("CC-BY-4.0", r"(cc|creative commons) (by|attribution)( 4 0)?( international)?"), ("OFL-1.1", r"sil open font( licen[sc]e)?( version)?( 1 1)?"), ("PSF-2.0", r"(python software foundation|psf)( licen[sc]e)?( version| v)?( 2)?"), ("Proprietary", r"(proprietary|commercial)"),
]
_SUBJECT = r"(this|the|all) (work|software|project|code|source code|file|text|document|program|library|package|material|content|article)"
_SAYS = rf"((.* )?(which|that|it) |{_SUBJECT} )?((is|are|was) )?((dual|triple|multi|also) )?((re)?licen[sc]ed|released|distributed|available|made available|published|provided|covered|free software)( for use| to you)?( under| by)( the)?( terms of( the)?)?"
_TAIL = r"( (see|as (described|found|stated|given)|for (more )?details|details|a copy of|the full text) .*)?"
_LATER = r"( (or|and) (any |at your option any )?later( version)?)?"
_ANY = "(?:" + "|".join(v for _, v in NAMED).replace("(", "(?:") + ")"
#: A statement of two licences: the first, how they are joined, and the second.
_SEVERAL = f"{_SAYS}(?: either)?(?: the)?".replace("(?:", "(").replace("(", "(?:") + rf" ({_ANY})(?: licen[sc]e)? (or|and)(?: the)? ({_ANY})(?: licen[sc]e)?" + _TAIL.replace("(", "(?:")

#: Known sentences, as patterns of the whole normalised form; an identifier is the place in this list. The first that fits counts.
SENTENCES: list[tuple[str, str]] = [
    ("mit grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software .*"),
    ("mit notice", r"(the above copyright notice and this permission notice|the above copyright notice and this permission notice including the next paragraph) shall be included in all copies or substantial portions of the software"),
    ("mit disclaimer", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("mit liability", r"in no event shall the authors or copyright holders be liable.*"),
    ("apache compliance", r"you may not use this (file|work) except in compliance with the license"),
    ("apache copy", r"you may obtain a copy of the license at( https? www apache org licenses license 2 0( (html|txt))?)?"),
    ("apache address", r"https? www apache org licenses license 2 0( (html|txt))?"),
    ("apache disclaimer", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("apache see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("bsd grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd source", r"([1a] )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd binary", r"([2b] )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd names", r"([34c] )?(neither the name of .*|the name of the author) may (not )?be used to endorse or promote products.*"),
    ("bsd disclaimer", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("bsd liability", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages.*"),
    ("isc grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc disclaimer", r"the software is provided as is and .* disclaims all warranties.*"),
    ("isc liability", r"in no event shall .* be liable for any special direct indirect or consequential damages.*"),
    ("zlib disclaimer", r"this software is provided as is without any express or implied warranty"),
    ("zlib liability", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions.*"),
    ("gpl2 notice", r".*you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (either )?version 2.*"),
    ("gpl3 notice", r".*you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (either )?version 3.*"),
    ("lgpl2 notice", r".*you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation (either )?version 2.*"),
    ("lgpl3 notice", r".*you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (either )?version 3.*"),
    ("agpl notice", r".*you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    ("gpl free", r"this (program|software|library) is free software"),
    ("gpl terms", r".*you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl terms", r".*you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation"),
    ("gpl version 2", r"(either )?version 2( [01])? of the license( or at your option any later version)?"),
    ("gpl version 3", r"(either )?version 3( 0)? of the license( or at your option any later version)?"),
    ("gpl hope", r".*is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl implied", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl see", r"see the gnu (lesser |library |affero )?general public license for more details"),
    ("gpl copy", r"you should have received a copy of the gnu (lesser |library |affero )?general public license.*"),
    ("gpl else", r"if not (see|write to)( to)? (the free software foundation|(https? )?www gnu org).*"),
    ("mpl notice", r"this source code form is subject to the terms of the mozilla public license v(ersion)? ?2 0"),
    ("mpl copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("epl notice", r"(this program and the accompanying materials|all rights reserved this program and the accompanying materials) are made available under the terms of the eclipse public license v?(ersion )? ?2 0.*"),
    ("boost grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("boost notice", r"distributed under the boost software license version 1 0.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense grant", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("public domain", rf"({_SUBJECT} (is|has been) )?(hereby )?((dedicated|placed|released|committed) )?(to |in |into )?the public domain"),
    ("all rights reserved", r"all rights reserved"),
    ("copyright", r"(portions )?copyright( c)? ([0-9]{4}|by ).*"),
    ("spdx", r"spdx license identifier .*"),
    ("says several", _SEVERAL),
    *((f"says {k}", rf"{_SAYS} ({v})( licen[sc]e)?( the licen[sc]e)?{_LATER}{_TAIL}") for k, v in NAMED),
    *((f"title {k}", rf"(the |licen[sc]e )?({v}) licen[sc]e( (mit|isc|zlib|agpl|lgpl|gpl|mpl|epl|wtfpl))?( (version|v) ?[0-9]( [0-9])?)?( (january|february|june|november) ([0-9]+ )?[0-9]{{4}})?" if k not in ("Proprietary",) else r"proprietary licen[sc]e") for k, v in NAMED),
]
IDS = {name: i for i, (name, _) in enumerate(SENTENCES)}


def _rule(text: str) -> str:
    """A rule's pattern over identifiers: each name in angle brackets becomes ``<its number>``; a star stands for all names that begin so."""

    def one(m: re.Match) -> str:
        found = [i for name, i in IDS.items() if name == m[1] or (m[1].endswith("*") and name.startswith(m[1][:-1]))]
        return "(<" + ">|<".join(map(str, found)) + ">)"

    return re.sub(r"<([^>]*)>", one, text)


_HEAD = "(<title *>)?(<copyright>|<all rights reserved>)*"
_GPL = "<gpl hope>(<gpl implied>)?(<gpl see>)?(<gpl copy>)?(<gpl else>)?"
#: Ordered rules: licence, name of the rule, and the sequence of sentences.
RULES = [
    (licence, rule, _rule(pattern))
    for licence, rule, pattern in [
        ("MIT", "full text", f"{_HEAD}<mit grant><mit notice><mit disclaimer>(<mit liability>)?"), ("BSD-3-Clause", "full text", f"{_HEAD}<bsd grant><bsd source><bsd binary><bsd names><bsd disclaimer>(<bsd liability>)?"), ("BSD-2-Clause", "full text", f"{_HEAD}<bsd grant><bsd source><bsd binary><bsd disclaimer>(<bsd liability>)?"),
        ("Apache-2.0", "full notice", f"{_HEAD}<says Apache-2.0><apache compliance>(<apache copy>)?(<apache address>)?<apache disclaimer>(<apache see>)?"), ("ISC", "full text", f"{_HEAD}<isc grant><isc disclaimer>(<isc liability>)?"), ("Zlib", "full text", f"{_HEAD}<zlib disclaimer><zlib liability><zlib grant>"),
        *((k, "full notice", f"{_HEAD}(<gpl free>)?({notice}){_GPL}") for k, notice in [("GPL-2.0", "<gpl2 notice>|<gpl terms><gpl version 2>"), ("GPL-3.0", "<gpl3 notice>|<gpl terms><gpl version 3>"), ("LGPL-2.1", "<lgpl2 notice>|<lgpl terms><gpl version 2>"), ("LGPL-3.0", "<lgpl3 notice>|<lgpl terms><gpl version 3>"), ("AGPL-3.0", "<agpl notice>(<gpl version 3>)?")]),
        ("MPL-2.0", "full notice", f"{_HEAD}<mpl notice>(<mpl copy>)?"), ("EPL-2.0", "full notice", f"{_HEAD}<epl notice>"), ("BSL-1.0", "full text", f"{_HEAD}<boost grant>"), ("BSL-1.0", "full notice", f"{_HEAD}<boost notice>"), ("Unlicense", "full text", f"{_HEAD}<unlicense>(<unlicense grant>)?"),
        ("Several", "statement", "(<copyright>)*<says several>"), *((k, "statement", f"(<copyright>)*<says {k}>") for k, _ in NAMED), *((k, "title", f"<title {k}>") for k, _ in NAMED),
        *((k, "part of the notice", p) for k, p in [("GPL-2.0", "<gpl2 notice>|(<gpl free>)?<gpl terms><gpl version 2>"), ("GPL-3.0", "<gpl3 notice>|(<gpl free>)?<gpl terms><gpl version 3>"), ("LGPL-2.1", "<lgpl2 notice>|(<gpl free>)?<lgpl terms><gpl version 2>"), ("LGPL-3.0", "<lgpl3 notice>|(<gpl free>)?<lgpl terms><gpl version 3>"), ("AGPL-3.0", "<agpl notice>")]),
        ("BSD", "part of the text", "(<bsd *>)+"), ("MIT", "part of the text", "(<mit *>)+"), ("Apache-2.0", "part of the notice", "(<apache *>)+"), ("ISC", "part of the text", "(<isc *>)+"), ("Zlib", "part of the text", "(<zlib *>)+"), ("GPL", "part of the notice", "(<gpl *>)+"), ("MPL-2.0", "part of the notice", "<mpl copy>"), ("Unlicense", "part of the text", "<unlicense grant>"),
        ("SPDX", "identifier", "<spdx>"), ("Public-Domain", "statement", "<public domain>"), ("Proprietary", "all rights reserved", "(<copyright>)*<all rights reserved>"), ("Unknown", "copyright only", "(<copyright>)+"),
    ]
]
#: Lines that are sentences of their own get blank lines around them.
_LINES = r"(?i)(\n[^a-z0-9\n]*(?:(?:portions )?copyright[ ]*(?:\(c\)|©|[0-9]{4}|by )|spdx-license-identifier:)[^\n]*)"
#: So do lines that are a whole statement, whatever line is in front of them.
_STATEMENTS = r"(?i)\n([^a-z0-9\n]*(?:(?:(?:this|the|all) \w+(?: \w+)? (?:is|are) )?(?:licensed|released|available|published) under [^\n]*\.|all rights reserved\.?)[^a-z0-9\n]*)\n"
#: Initials end no sentence. Letters with accents in front are named by what they are not, as engines differ in what a word boundary is; neighbours take a second pass.
_INITIAL = r"(^|[\x00-\x20(\"'\[])([A-Za-z])\. "
_ENDS = r"\n[^A-Za-z0-9\n]*\n|[.;!?][\"')\]]*[ \t\r\n]+|:[ \t\r]*\n"
_SPDX = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+(?: (?:and|or|with) [a-z0-9.+-]+)*)"
_PATTERN = "|".join(f"({p})" for _, _, p in RULES)

def normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def named(x: Column) -> Column:
    """The licence of a name in normalised form."""
    out = F.lit(None).cast("string")
    for k, v in reversed(NAMED):
        out = F.when(x.rlike(f"^(?:{v})$"), k).otherwise(out)
    return out


def likely(text: Column) -> Column:
    """Whether a text can have a known sentence."""

    def stems(low: Column) -> Column:
        out = low.contains(STEMS[0])
        for x in STEMS[1:]:
            out = out | low.contains(x)
        return out & low.rlike(TEXT_FILTER)

    return F.transform(F.array(F.lower(text)), stems)[0]


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, the ``parts`` (sentences with a letter), and ``seq``: for each its identifier in angle brackets, ``<>`` for one that is not known."""
    def identifier(x: Column) -> Column:
        out = F.lit("<>")
        for i, (_, pattern) in reversed(list(enumerate(SENTENCES))):
            out = F.when(x.rlike(f"^(?:{pattern})$"), F.lit(f"<{i}>")).otherwise(out)
        return F.when(x.rlike(FILTER), out).otherwise(F.lit("<>"))

    docs = texts(documents).filter(likely(F.col("text")))
    plain = F.regexp_replace(F.regexp_replace("text", _INITIAL, "$1$2 "), _INITIAL, "$1$2 ")
    apart = F.regexp_replace(F.concat(F.lit("\n"), plain, F.lit("\n")), F.lit(_LINES), F.lit("\n\n$1\n\n"))
    apart = F.regexp_replace(apart, F.lit(_STATEMENTS), F.lit("\n\n$1\n\n"))
    docs = docs.withColumn("parts", F.filter(F.split(apart, _ENDS), lambda x: x.rlike("[A-Za-z]")))
    # Exploded, so that what follows reads the sequence and does not compute it again.
    seq = F.array_join(F.transform(F.transform("parts", normal), identifier), "")
    return docs.select("doc_id", F.explode(F.array(F.struct("parts", seq.alias("seq")))).alias("x")).select("doc_id", "x.parts", "x.seq")


def licences(documents: DataFrame) -> DataFrame:
    """One row for each rule that a document's sentences match: doc_id, licence, rule, first sentence, sentences. An SPDX rule's licence is what the line says."""
    seq = sentences(documents).filter(F.col("seq").rlike("[0-9]"))
    found = seq.select("doc_id", "parts", F.regexp_extract_all("seq", F.lit(f"({_PATTERN})"), F.lit(0)).alias("found"), F.split("seq", _PATTERN, -1).alias("rest"))
    rows = found.select("doc_id", "parts", "rest", "found", F.posexplode("found").alias("i", "m"))
    many = lambda x: F.length(x) - F.length(F.translate(x, "<", ""))  # sentences of a piece of the sequence
    before = many(F.array_join(F.slice("found", 1, F.col("i")), "")) + many(F.array_join(F.slice("rest", 1, F.col("i") + 1), ""))
    which = F.lit(None).cast("string")
    for licence, rule, pattern in reversed(RULES):
        which = F.when(F.col("m").rlike(f"^(?:{pattern})$"), F.lit(f"{licence}\t{rule}")).otherwise(which)
    out = rows.select("doc_id", F.split(which, "\t").alias("x"), F.get("parts", before + many(F.col("m")) - 1).alias("part"), before.cast("long").alias("first_sentence"), many(F.col("m")).cast("long").alias("n_sentences"))
    said = F.nullif(F.regexp_extract("part", _SPDX, 1), F.lit(""))
    both = [F.regexp_extract(normal(F.col("part")), _SEVERAL, i) for i in (1, 2, 3)]
    licence = F.when(F.col("x")[0] == "SPDX", F.coalesce(said, F.lit("SPDX"))).when(F.col("x")[0] == "Several", F.concat_ws(" ", named(both[0]), F.upper(both[1]), named(both[2]))).otherwise(F.col("x")[0])
    return out.select("doc_id", licence.alias("licence"), F.col("x")[1].alias("rule"), "first_sentence", "n_sentences")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in SQL: sentences are rows, and a document's identifiers are matched one claim at a time."""
    quoted = lambda x: x.replace("'", "''")
    identifier = " ".join(f"WHEN regexp_matches(x, '^(?:{quoted(p)})$') THEN '<{i}>'" for i, (_, p) in enumerate(SENTENCES))
    name = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(regexp_extract(p, '{_SEVERAL}', {i}), '^(?:{v})$') THEN '{k}'" for k, v in NAMED) + " END"
    which = " ".join(f"WHEN regexp_matches(m, '^(?:{p})$') THEN '{lic}\t{rule}'" for lic, rule, p in RULES)
    return rf"""
WITH RECURSIVE s AS (
  SELECT row_number() OVER () AS rid, doc_id, [x for x in string_split_regex(regexp_replace(regexp_replace(chr(10) || regexp_replace(regexp_replace(text, '{quoted(_INITIAL)}', '\1\2 ', 'g'), '{quoted(_INITIAL)}', '\1\2 ', 'g') || chr(10), '{_LINES}', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g'), '{_STATEMENTS}', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g'), '{quoted(_ENDS)}') if regexp_matches(x, '[A-Za-z]')] AS parts
  FROM documents WHERE regexp_matches(lower(text), '{TEXT_FILTER}')),
l AS (SELECT rid, doc_id, parts, [trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) for x in parts] AS l FROM s),
q AS (
  SELECT rid, doc_id, parts, array_to_string([CASE WHEN NOT regexp_matches(x, '{FILTER}') THEN '<>' {identifier} ELSE '<>' END for x in l], '') AS seq
  FROM l),
r AS (
  SELECT rid, doc_id, seq, parts, 0 AS pos, CAST(NULL AS VARCHAR) AS m, 0 AS first FROM q WHERE regexp_matches(seq, '[0-9]')
  UNION ALL
  SELECT rid, doc_id, seq, parts, pos + strpos(substr(seq, pos + 1), e) - 1 + length(e), e, pos + strpos(substr(seq, pos + 1), e) - 1
  FROM (SELECT *, regexp_extract(substr(seq, pos + 1), '{_PATTERN}') AS e FROM r) WHERE e <> ''),
c AS (SELECT *, split_part(w, chr(9), 1) AS lic, length(substr(seq, 1, first)) - length(replace(substr(seq, 1, first), '<', '')) AS n FROM (SELECT *, CASE {which} END AS w FROM r WHERE m IS NOT NULL))
SELECT doc_id, CASE WHEN lic = 'SPDX' THEN coalesce(nullif(regexp_extract(part, '{_SPDX}', 1), ''), 'SPDX') WHEN lic = 'Several' THEN {name(1)} || ' ' || upper(regexp_extract(p, '{_SEVERAL}', 2)) || ' ' || {name(3)} ELSE lic END AS licence, split_part(w, chr(9), 2) AS rule, CAST(n AS BIGINT) AS first_sentence, CAST(length(m) - length(replace(m, '<', '')) AS BIGINT) AS n_sentences
FROM (SELECT *, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS p FROM (SELECT *, parts[n + length(m) - length(replace(m, '<', ''))] AS part FROM c))
"""


ORACLE = _oracle()
