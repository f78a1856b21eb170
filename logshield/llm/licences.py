"""Licence scan by sentence rules, in DataFrame functions only.

Sentences are normalised and mapped to identifiers of known licence sentences; ordered rules
then replace sequences of identifiers by a licence, longer and more special ones first, each
sentence being used once. Sentences are tested only in texts, and where they hold a word, that
every rule needs; nothing is exploded, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every sentence rule's sentence holds one of these.
SIGNS = ("licen", "copyright", "permission", "redistribut", "warrant", "spdx", "public domain", "as is", "liable", "endorse")
#: (identifier, pattern of the normalised sentence), first match wins.
SENTENCES = (
    ("spdx-mit", r"^spdx licen[cs]e identifier mit$"),
    ("spdx-apache2", r"^spdx licen[cs]e identifier apache 2\.0$"),
    ("spdx-gpl3", r"^spdx licen[cs]e identifier gpl 3\.0( only| or later)?$"),
    ("spdx-bsd3", r"^spdx licen[cs]e identifier bsd 3 clause$"),
    ("spdx-bsd2", r"^spdx licen[cs]e identifier bsd 2 clause$"),
    ("spdx-ccbync4", r"^spdx licen[cs]e identifier cc by nc 4\.0$"),
    ("spdx-gpl2", r"^spdx licen[cs]e identifier gpl 2\.0( only| or later)?$"),
    ("spdx-lgpl21", r"^spdx licen[cs]e identifier lgpl 2\.1( only| or later)?$"),
    ("spdx-lgpl3", r"^spdx licen[cs]e identifier lgpl 3\.0( only| or later)?$"),
    ("spdx-agpl3", r"^spdx licen[cs]e identifier agpl 3\.0( only| or later)?$"),
    ("spdx-mpl2", r"^spdx licen[cs]e identifier mpl 2\.0$"),
    ("spdx-isc", r"^spdx licen[cs]e identifier isc$"),
    ("spdx-cc0", r"^spdx licen[cs]e identifier cc0 1\.0$"),
    ("spdx-ccby4", r"^spdx licen[cs]e identifier cc by 4\.0$"),
    ("spdx-ccbysa4", r"^spdx licen[cs]e identifier cc by sa 4\.0$"),
    ("spdx-unlicense", r"^spdx licen[cs]e identifier unlicense$"),
    ("spdx-bsl1", r"^spdx licen[cs]e identifier bsl 1\.0$"),
    ("spdx-epl2", r"^spdx licen[cs]e identifier epl 2\.0$"),
    ("spdx-zlib", r"^spdx licen[cs]e identifier zlib$"),
    ("mit-grant", r"^permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", r"^the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software$"),
    ("mit-warranty", r"^the software is provided as is without warranty of any kind express or implied"),
    ("mit-liability", r"^in no event shall the authors or copyright holders be liable"),
    ("mit-ref", r"^(this (work|file|software|code|program|text|document) is )?(released|licen[cs]ed|distributed|available) under the (terms of the )?mit licen[cs]e$"),
    ("isc-grant", r"^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", r"^the software is provided as is and the author disclaims all warranties"),
    ("bsd-pre", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"^([0-9]\.? )?redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"^([0-9]\.? )?redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"^([0-9]\.? )?neither the name of .* may be used to endorse or promote products derived from this software"),
    ("bsd-asis", r"^this software is provided by the copyright holders? and contributors as is"),
    ("bsd-ref", r"^(this .* is )?(released|licen[cs]ed|distributed) under the (terms of the )?(3 clause |new |modified )?bsd licen[cs]e$"),
    ("bsd3-ref", r"^(this .* is )?(released|licen[cs]ed|distributed) under the (terms of the )?bsd 3 clause licen[cs]e$"),
    ("bsd2-ref", r"^(this .* is )?(released|licen[cs]ed|distributed) under the (terms of the )?(bsd 2 clause|2 clause bsd|simplified bsd) licen[cs]e$"),
    ("apache2-ref", r"^(this .* is )?(released|licen[cs]ed|distributed) under the (terms of the )?apache licen[cs]e,? version 2\.0( the licen[cs]e)?$"),
    ("apache2-use", r"^you may not use this file except in compliance with the licen[cs]e$"),
    ("apache2-copy", r"^you may obtain a copy of the licen[cs]e at"),
    ("apache2-warranty", r"^unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("lgpl3-ref", r"licen[cs]ed under the (terms of the )?gnu lesser general public licen[cs]e version 3"),
    ("lgpl21-ref", r"licen[cs]ed under the (terms of the )?gnu lesser general public licen[cs]e version 2\.1"),
    ("agpl3-ref", r"licen[cs]ed under the (terms of the )?gnu affero general public licen[cs]e version 3"),
    ("gpl3-later", r"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (at your option )?any later version$"),
    ("gpl2-later", r"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (at your option )?any later version$"),
    ("gpl3-ref", r"licen[cs]ed under the (terms of the )?gnu general public licen[cs]e version 3$"),
    ("gpl2-ref", r"licen[cs]ed under the (terms of the )?gnu general public licen[cs]e version 2$"),
    ("gpl-useful", r"^this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", r"^you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("mpl2-ref", r"subject to the terms of the mozilla public licen[cs]e v\.? ?2\.0$"),
    ("ccbyncsa4-ref", r"licen[cs]ed under (a |the )?(cc by nc sa 4\.0|creative commons attribution noncommercial sharealike 4\.0)"),
    ("ccbync4-ref", r"licen[cs]ed under (a |the )?(cc by nc 4\.0|creative commons attribution noncommercial 4\.0)"),
    ("ccbysa4-ref", r"licen[cs]ed under (a |the )?(cc by sa 4\.0|creative commons attribution sharealike 4\.0)"),
    ("ccby4-ref", r"licen[cs]ed under (a |the )?(cc by 4\.0|creative commons attribution 4\.0)"),
    ("unlicense-ref", r"^this is free and unencumbered software released into the public domain$"),
    ("bsl1-ref", r"^boost software licen[cs]e version 1\.0|under the boost software licen[cs]e version 1\.0"),
    ("epl2-ref", r"under the terms of the eclipse public licen[cs]e (version |v\.? ?)?2\.0"),
    ("zlib-warranty", r"^this software is provided as is without any express or implied warranty$"),
    ("cc0-ref", r"(cc0 1\.0|dedicated to the public domain|released into the public domain)"),
    ("copyright", r"^(copyright|c copyright)( c)?( [0-9 ]+)?"),
    ("reserved", r"^all rights reserved$"),
)
#: (licence, class, sequences of identifiers), tried in this order.
RULES = (
    ("MIT", "permissive", (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), ("mit-grant", "mit-notice", "mit-warranty"))),
    ("BSD-3-Clause", "permissive", (("bsd-pre", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"),)),
    ("BSD-2-Clause", "permissive", (("bsd-pre", "bsd-source", "bsd-binary", "bsd-asis"),)),
    ("ISC", "permissive", (("isc-grant", "isc-warranty"),)),
    ("Apache-2.0", "permissive", (("apache2-ref", "apache2-use", "apache2-copy", "apache2-warranty"), ("apache2-ref", "apache2-use", "apache2-copy"))),
    ("GPL-3.0-or-later", "copyleft", (("gpl3-later", "gpl-useful", "gpl-copy"), ("gpl3-later",))),
    ("GPL-2.0-or-later", "copyleft", (("gpl2-later", "gpl-useful", "gpl-copy"), ("gpl2-later",))),
    ("AGPL-3.0", "copyleft", (("agpl3-ref",), ("spdx-agpl3",))),
    ("LGPL-3.0", "copyleft", (("lgpl3-ref",), ("spdx-lgpl3",))),
    ("LGPL-2.1", "copyleft", (("lgpl21-ref",), ("spdx-lgpl21",))),
    ("GPL-3.0", "copyleft", (("gpl3-ref",), ("spdx-gpl3",))),
    ("GPL-2.0", "copyleft", (("gpl2-ref",), ("spdx-gpl2",))),
    ("MPL-2.0", "copyleft", (("mpl2-ref",), ("spdx-mpl2",))),
    ("EPL-2.0", "copyleft", (("epl2-ref",), ("spdx-epl2",))),
    ("CC-BY-NC-SA-4.0", "noncommercial", (("ccbyncsa4-ref",),)),
    ("CC-BY-NC-4.0", "noncommercial", (("ccbync4-ref",), ("spdx-ccbync4",))),
    ("CC-BY-SA-4.0", "copyleft", (("ccbysa4-ref",), ("spdx-ccbysa4",))),
    ("CC-BY-4.0", "permissive", (("ccby4-ref",), ("spdx-ccby4",))),
    ("Unlicense", "permissive", (("unlicense-ref",), ("spdx-unlicense",))),
    ("BSL-1.0", "permissive", (("bsl1-ref",), ("spdx-bsl1",))),
    ("Zlib", "permissive", (("zlib-warranty",), ("spdx-zlib",))),
    ("ISC", "permissive", (("spdx-isc",),)),
    ("CC0-1.0", "permissive", (("cc0-ref",), ("spdx-cc0",))),
    ("Apache-2.0", "permissive", (("apache2-ref",), ("spdx-apache2",))),
    ("BSD-3-Clause", "permissive", (("bsd-ref",), ("bsd3-ref",), ("spdx-bsd3",))),
    ("BSD-2-Clause", "permissive", (("bsd2-ref",), ("spdx-bsd2",))),
    ("MIT", "permissive", (("mit-ref",), ("spdx-mit",))),
)
# A line that goes on in lower case continues the sentence; other lines and stops end it.
_WRAP, _STOP, _OTHER, _EDGE = r"\r?\n[ \t#*/;-]*([a-z])", r"([.!?;:])[ \t\r\f]+", r"[^a-z0-9.]+", r"^[ .]+|[ .]+$"


# A tag is a sentence of its own, colon or not. Line ends that neither _WRAP nor _STOP decide may
# be inside a sentence, unless a stop, an empty line, a list marker or a known beginning is there.
_TAG = r"(?i)(spdx-licen[cs]e-identifier)[ \t]*:[ \t]*([^\r\n]*)"
# The stop of an abbreviated version ends no sentence.
_VERSION = r"(?i)\b(v|ver)\.\s+(?=[0-9])"
_HEADS = (
    r"permission (is hereby|to use)|the above copyright notice|the software is provided|in no event shall|redistributions? |neither the name|this software is provided|you may (not use|obtain a copy)"
    r"|unless required by|this program is|you should have received|copyright (\(c\)|©|[0-9])|all rights reserved|(licen[cs]ed|released) under"
)
_SOFT = rf"(?i)(?<=[^\s.!?;:])[ \t\r]*\n(?![ \t\r#*/;-]*(\n|$|[0-9a-z]{{1,2}}[.)] |\([0-9a-z]{{1,2}}\) |{_HEADS}))|(?<=;)\n(?=either version)"
_MARK = "\x01"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text in order; `?` for a sentence about a
    licence that no rule knows. A sentence is read over its wrapped lines and also line by line;
    what its lines say alone is never lost."""
    tagged = F.regexp_replace(F.regexp_replace(text, _TAG, "\n$1 $2\n"), _VERSION, "$1 ")
    lines = F.regexp_replace(F.regexp_replace(tagged, _WRAP, " $1"), _STOP, "$1\n")
    some = F.filter(F.split(F.regexp_replace(F.replace(lines, F.lit(_MARK), F.lit(" ")), _SOFT, _MARK), "\n"), lambda s: _holds_sign(F.lower(s)))
    read = F.transform(some, lambda s: F.struct(
        F.filter(F.transform(F.split(s, _MARK), lambda u: F.when(_holds_sign(F.lower(u)), _identified(u))), lambda i: i.isNotNull()).alias("each"),
        F.when(F.contains(s, F.lit(_MARK)), _identified(s)).alias("whole"),
        F.rlike(s, F.lit(r"(?i)^[^a-z0-9]*(c[^a-z0-9]+)?copyright")).alias("owned"),
    ))
    return F.flatten(F.transform(read, _picked))


def _identified(s: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(s), _OTHER, " "), _EDGE, "")
    first = lambda s: F.coalesce(*(F.when(F.rlike(s, F.lit(p)), F.lit(i)) for i, p in SENTENCES), F.when(F.contains(s, F.lit("licen")), F.lit("?")))
    return F.transform(F.array(plain), first)[0]


def _picked(x: Column) -> Column:
    each, whole = x["each"], x["whole"]
    others = F.filter(each, lambda i: ~i.isin("?", "copyright") & (i != whole))
    lead = F.when(x["owned"], F.array(F.lit("copyright"))).otherwise(F.array().cast("array<string>"))
    joined = F.when(F.size(others) == 0, F.concat(lead, F.array(whole))).when(F.array_contains(each, whole), each).otherwise(F.concat(each, F.array(whole)))
    return F.when(whole.isNull() | whole.isin("?", "copyright"), each).otherwise(joined)


def _holds_sign(low: Column) -> Column:
    test = F.contains(low, F.lit(SIGNS[0]))
    for s in (*SIGNS[1:], "cc0"):
        test = test | F.contains(low, F.lit(s))
    return test


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licences (sorted), n_licences, n_unknown and class of every row of
    docs(doc_id, text, ...). The class is the strictest found: noncommercial, copyleft,
    permissive, then unknown (a sentence about a licence that no rule knows) and none.

    Defined cases: null and empty texts have none of it; rows that repeat a doc_id are scanned
    each; a licence named twice counts once; of two rules for the same sentence the first counts;
    a very long text is scanned whole; other columns are ignored."""
    got = docs.select("doc_id", F.when(_holds_sign(F.lower("text")), F.col("text")).alias("text"))
    got = got.select("doc_id", F.coalesce(sentence_ids(F.col("text")), F.array().cast("array<string>")).alias("ids"))
    seq = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for name, kind, forms in RULES:
        for form in forms:
            seq = F.replace(seq, F.lit("".join(f"<{i}>" for i in form)), F.lit(f"[{kind[0]}:{name}]"))
    got = got.withColumn("seq", F.when(F.size("ids") > 0, seq).otherwise(F.lit("")))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("seq", F.lit(r"\[[a-z]:([^\]]+)\]"), 1)))
    kind = F.when(F.contains("seq", F.lit("[n:")), "noncommercial").when(F.contains("seq", F.lit("[c:")), "copyleft").when(F.contains("seq", F.lit("[p:")), "permissive")
    unknown = (F.char_length("seq") - F.char_length(F.replace("seq", F.lit("<?>"), F.lit("<>")))).cast("long")
    return got.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licences"), F.size(names).cast("long").alias("n_licences"),
        unknown.alias("n_unknown"), kind.when(unknown > 0, "unknown").otherwise("none").alias("class"),
    )


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sign = lambda c: "(" + " OR ".join(f"contains({c}, {q(s)})" for s in SIGNS) + ")"
    case = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(i)}" for i, p in SENTENCES)
    seq = "string_agg('<' || id || '>', '' ORDER BY k)"
    for name, kind, forms in RULES:
        for form in forms:
            seq = f"replace({seq}, {q(''.join(f'<{i}>' for i in form))}, {q(f'[{kind[0]}:{name}]')})"
    return f"""
WITH line AS (
  SELECT doc_id, generate_subscripts(l, 1) AS k, lower(unnest(l)) AS s FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(text, {q(_WRAP)}, ' \\1', 'g'), {q(_STOP)}, '\\1' || chr(10), 'g'), chr(10)) AS l
    FROM documents WHERE {sign("lower(text)")})),
plain AS (SELECT doc_id, k, regexp_replace(regexp_replace(s, {q(_OTHER)}, ' ', 'g'), {q(_EDGE)}, '', 'g') AS s FROM line WHERE {sign("s")}),
known AS (SELECT doc_id, k, CASE {case} WHEN contains(s, 'licen') THEN '?' END AS id FROM plain),
seqs AS (SELECT doc_id, string_agg(id, ',' ORDER BY k) AS ids, {seq} AS seq, count(*) FILTER (WHERE id = '?') AS n_unknown FROM known WHERE id IS NOT NULL GROUP BY doc_id),
named AS (SELECT *, list_sort(list_distinct(regexp_extract_all(seq, '\\[[a-z]:([^\\]]+)\\]', 1))) AS names FROM seqs)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences, CAST(coalesce(len(names), 0) AS BIGINT) AS n_licences,
  coalesce(n_unknown, 0) AS n_unknown, CASE WHEN contains(seq, '[n:') THEN 'noncommercial' WHEN contains(seq, '[c:') THEN 'copyleft' WHEN contains(seq, '[p:') THEN 'permissive'
    WHEN n_unknown > 0 THEN 'unknown' ELSE 'none' END AS class
FROM documents d LEFT JOIN named USING (doc_id)
"""


ORACLE = _oracle()
