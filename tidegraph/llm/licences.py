"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into pieces (line breaks, and . ; ! ? : before white space), each is normalised (lower case, runs of
anything but letters and digits are one space), and known sentences become identifiers: those that are one piece, or several
pieces in a row of one paragraph, as in wrapped notices and in 'SPDX-License-Identifier: MIT' or 'v. 2.0'. The sequence of a text's identifiers
is matched against ordered licence rules: each rule names a licence and the identifiers that make it up, in order; a rule
that matches consumes its identifiers, so that later, shorter rules see only what is left, with a gap where they were. A known sentence that no rule
consumes makes the text's licence UNKNOWN.

Null and empty texts have no sentences. Texts of any length are taken whole. Repeated sentences match again, and a licence
is listed once. Only the column that is given is read; the result is one struct column that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences of public licence texts and of common licence notices, normalised, with identifiers.
SENTENCES = {
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "MitName": "released under the mit license",
    "MitLicensed": "licensed under the mit license",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdName": "licensed under the bsd license",
    "ApacheHead": "licensed under the apache license version 2 0 the license",
    "ApacheComply": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at",
    "ApacheName": "licensed under the apache license version 2 0",
    "GplFree": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Gpl2Free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GplWarranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "Gpl3Name": "this work is licensed under the gnu general public license version 3",
    "Gpl2Name": "this work is licensed under the gnu general public license version 2",
    "LgplName": "licensed under the gnu lesser general public license version 3",
    "AgplName": "licensed under the gnu affero general public license version 3",
    "MplHead": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "CcByNc": "licensed under cc by nc 4 0",
    "CcBy": "licensed under cc by 4 0",
    "CcBySa": "licensed under cc by sa 4 0",
    "CcByLong": "this work is licensed under a creative commons attribution 4 0 international license",
    "CcByNcLong": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "CcBySaLong": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "Cc0": "this work is dedicated to the public domain under cc0 1 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "SpdxMit": "spdx license identifier mit",
    "SpdxApache": "spdx license identifier apache 2 0",
    "SpdxGpl3": "spdx license identifier gpl 3 0 or later",
    "SpdxBsd3": "spdx license identifier bsd 3 clause",
    "Reserved": "all rights reserved",
}
# Licence, what it allows, its sentences in order. Longer rules stand before those they contain.
RULES = [
    ("BSD-3-Clause", "permissive", "BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "permissive", "BsdGrant BsdSource BsdBinary"),
    ("MIT", "permissive", "MitGrant MitNotice MitAsIs MitLiability"),
    ("MIT", "permissive", "MitGrant MitNotice MitAsIs"),
    ("MIT", "permissive", "MitGrant MitNotice"),
    ("Apache-2.0", "permissive", "ApacheHead ApacheComply ApacheCopy"),
    ("Apache-2.0", "permissive", "ApacheHead ApacheComply"),
    ("GPL-3.0-or-later", "copyleft", "GplFree GplWarranty GplSee"),
    ("GPL-3.0-or-later", "copyleft", "GplFree GplWarranty"),
    ("GPL-2.0-or-later", "copyleft", "Gpl2Free GplWarranty GplSee"),
    ("GPL-3.0-or-later", "copyleft", "GplFree"),
    ("GPL-2.0-or-later", "copyleft", "Gpl2Free"),
    ("Apache-2.0", "permissive", "ApacheHead"),
    ("Apache-2.0", "permissive", "ApacheName"),
    ("Apache-2.0", "permissive", "SpdxApache"),
    ("MIT", "permissive", "MitName"),
    ("MIT", "permissive", "MitLicensed"),
    ("MIT", "permissive", "SpdxMit"),
    ("ISC", "permissive", "IscGrant"),
    ("BSD", "permissive", "BsdName"),
    ("BSD-3-Clause", "permissive", "SpdxBsd3"),
    ("GPL-3.0-only", "copyleft", "Gpl3Name"),
    ("GPL-2.0-only", "copyleft", "Gpl2Name"),
    ("GPL-3.0-or-later", "copyleft", "SpdxGpl3"),
    ("LGPL-3.0", "copyleft", "LgplName"),
    ("AGPL-3.0", "copyleft", "AgplName"),
    ("MPL-2.0", "copyleft", "MplHead"),
    ("CC-BY-NC-4.0", "noncommercial", "CcByNc"),
    ("CC-BY-NC-4.0", "noncommercial", "CcByNcLong"),
    ("CC-BY-SA-4.0", "copyleft", "CcBySa"),
    ("CC-BY-SA-4.0", "copyleft", "CcBySaLong"),
    ("CC-BY-4.0", "permissive", "CcBy"),
    ("CC-BY-4.0", "permissive", "CcByLong"),
    ("CC0-1.0", "permissive", "Cc0"),
    ("Unlicense", "permissive", "Unlicense"),
    ("LicenseRef-all-rights-reserved", "reserved", "Reserved"),
]
#: Every known sentence has one of these; between words there may be anything but letters and digits.
HINT = r"(?i)licen[sc]|reserved|granted|permitted|redistribut|warranty|copyright|public[^A-Za-z0-9]+domain|mozilla|liable"
PIECE_END = r"[.;!?:]?[ \t\r]*\n|[.;!?:](?=\s|$)"
#: Of pieces with a | before and after each: known sentences, the longest first. No piece is empty but between paragraphs.
KNOWN = rf"(?<=\|)(?:{'|'.join(s.replace(' ', '[ |]') for s in sorted(SENTENCES.values(), key=len, reverse=True))})(?=\|)"
CLASSES = ["reserved", "noncommercial", "copyleft", "permissive"]  # the strictest first
SCHEMA = "licences array<string>, allows string, n_known int, n_unmatched int"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scan(text: Column) -> Column:
    """A struct (SCHEMA): licences in the order of the rules, UNKNOWN last; the strictest class of what they allow."""
    names = F.create_map(*(F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)))
    pieces = F.concat(F.lit("|"), F.array_join(F.transform(F.split(text, PIECE_END), normalised), "|"), F.lit("|"))
    known = F.transform(F.regexp_extract_all(pieces, F.lit(KNOWN), F.lit(0)), lambda s: F.try_element_at(names, F.translate(s, "|", " ")))
    ids = F.when(text.rlike(HINT), known).otherwise(F.array().cast("array<string>"))
    rules = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(a).alias("allows"), F.lit(f" {s.replace(' ', '  ')} ").alias("ids")) for n, a, s in RULES))
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("licences"), F.array().cast("array<string>").alias("allows"))

    def apply(state: Column, rule: Column) -> Column:
        met = F.contains(state["left"], rule["ids"])
        none = F.array().cast("array<string>")
        return F.struct(
            F.replace(state["left"], rule["ids"], F.lit(" . ")).alias("left"),
            F.concat(state["licences"], F.when(met, F.array(rule["licence"])).otherwise(none)).alias("licences"),
            F.concat(state["allows"], F.when(met, F.array(rule["allows"])).otherwise(none)).alias("allows"),
        )

    def finish(state: Column) -> Column:
        unmatched = F.regexp_count(state["left"], F.lit("[A-Za-z0-9]+"))
        strictest = F.coalesce(*(F.when(F.array_contains(state["allows"], c), F.lit(c)) for c in CLASSES), F.when(unmatched > 0, F.lit("unknown")), F.lit("none"))
        rest = F.when(unmatched > 0, F.array(F.lit("UNKNOWN"))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(F.array_distinct(state["licences"]), rest).alias("licences"), strictest.alias("allows"), F.size(ids).alias("n_known"), unmatched.alias("n_unmatched"))

    empty = F.struct(F.array().cast("array<string>").alias("licences"), F.lit("none").alias("allows"), F.lit(0).alias("n_known"), F.lit(0).alias("n_unmatched"))
    return F.when(F.size(ids) > 0, F.aggregate(rules, start, apply, finish)).otherwise(empty)


def oracle() -> str:
    """The query op4 in DuckDB's SQL: the same sentences and rules, applied one rule after the other."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(n)}" for n, s in SENTENCES.items()) + "}"
    last = f"""SELECT doc_id, list_filter(list_transform(
        regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.;!?:](\\s|$)', E'\\n', 'g'), E'\\n'),
        lambda s: ({names})[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM documents"""
    last = f"SELECT doc_id, len(ids) AS n_known, ' ' || array_to_string(ids, '  ') || ' ' AS rest, []::VARCHAR[] AS licences, []::VARCHAR[] AS allows FROM ({last})"
    for name, allows, ids in RULES:
        pattern = quoted(f" {ids.replace(' ', '  ')} ")
        last = f"""SELECT doc_id, n_known, replace(rest, {pattern}, ' . ') AS rest,
            CASE WHEN contains(rest, {pattern}) THEN list_append(licences, {quoted(name)}) ELSE licences END AS licences,
            CASE WHEN contains(rest, {pattern}) THEN list_append(allows, {quoted(allows)}) ELSE allows END AS allows FROM ({last})"""
    order = " ".join(f"WHEN list_contains(allows, '{c}') THEN '{c}'" for c in CLASSES)
    return f"""WITH r AS ({last}),
    u AS (SELECT *, len(regexp_extract_all(rest, '[A-Za-z0-9]+')) AS n_unmatched FROM r),
    f AS (SELECT *, list_filter(licences, lambda x, i: list_position(licences, x) = i) AS once FROM u)
    SELECT doc_id, array_to_string(CASE WHEN n_unmatched > 0 THEN list_append(once, 'UNKNOWN') ELSE once END, ',') AS licences,
      CASE {order} WHEN n_unmatched > 0 THEN 'unknown' ELSE 'none' END AS allows, n_known::INTEGER AS n_known, n_unmatched::INTEGER AS n_unmatched FROM f"""
