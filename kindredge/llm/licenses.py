"""Licence scan by sentences and ordered rules, in DataFrame functions alone.

A text is reduced to its words (a-z and 0-9, A-Z lower-cased) with marks where a sentence may end: at sentence marks, empty
lines and ends of lines. One pass of a pattern over all known licence sentences finds those that stand between two such
ends, wrapped over lines or not; what it finds is looked up for the sentence's identifier. The identifiers met, in order,
are matched against rules: a rule matches where its identifiers follow each other. Everything happens within a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-details": "See the GNU General Public License for more details",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4-notice": "Licensed under CC BY 4.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "gpl2-under": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "lgpl-under": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-granted": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "apache-title": "Apache License",
    "apache-title-version": "Version 2.0, January 2004",
    "cc0-notice": "Licensed under CC0 1.0",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0",
    "bsd-notice": "Licensed under the BSD License",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "mpl-notice": "Licensed under the Mozilla Public License, version 2.0",
    "all-rights": "All rights reserved",
}
# Rule -> (licence, identifiers in order).
RULES = {
    "mit-notice": ("MIT", ["mit-notice"]), "mit-notice-2": ("MIT", ["mit-notice-2"]),
    "mit-text": ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]), "mit-titled": ("MIT", ["mit-title-2", "mit-grant"]), "mit-titled-2": ("MIT", ["mit-title", "mit-grant"]),
    "apache-notice": ("Apache-2.0", ["apache-notice"]), "apache-header": ("Apache-2.0", ["apache-notice-the", "apache-may-not", "apache-obtain", "apache-unless"]),
    "gpl3-notice": ("GPL-3.0", ["gpl3-notice"]), "gpl3-header": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    "cc-by-nc-4-notice": ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]), "cc-by-4-notice": ("CC-BY-4.0", ["cc-by-4-notice"]),
    "bsd-2-text": ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty"]), "bsd-conditions": ("BSD", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    "bsd-3-text": ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"]), "bsd-notice": ("BSD", ["bsd-notice"]),
    "isc-text": ("ISC", ["isc-grant"]), "zlib-text": ("Zlib", ["zlib-provided", "zlib-granted"]), "unlicense-text": ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    "gpl2-header": ("GPL-2.0-or-later", ["gpl2-under", "gpl2-version"]), "gpl2-notice": ("GPL-2.0", ["gpl2-notice"]), "agpl3-header": ("AGPL-3.0-or-later", ["agpl-free"]),
    "lgpl21-header": ("LGPL-2.1-or-later", ["lgpl-under", "lgpl21-version"]), "lgpl3-header": ("LGPL-3.0-or-later", ["lgpl3-free"]),
    "mpl-header": ("MPL-2.0", ["mpl-short", "mpl-copy"]), "mpl-notice": ("MPL-2.0", ["mpl-notice"]), "epl-header": ("EPL-2.0", ["epl-terms"]),
    "bsl-text": ("BSL-1.0", ["bsl-title", "bsl-grant"]), "apache-text": ("Apache-2.0", ["apache-title", "apache-title-version"]),
    "cc0-notice": ("CC0-1.0", ["cc0-notice"]), "cc-by-sa-4-notice": ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    "all-rights": ("proprietary", ["all-rights"]),
}
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A text becomes words with one separator between any two: "|" where a sentence surely ends (a mark before white space, an
# empty line), "~" at another line's end (a sentence may be wrapped there), else a blank. A run of separators is its strongest.
STEPS = [("[|~]", " "), ("[.;!?][ \\t\\r\\n]+", "|"), ("\\n[ \\t\\r]*\\n", "|"), ("\\n", "~"), ("[^a-z0-9|~]+", " ")]
RUNS = [("[ ~]*[|][ ~|]*", "|"), (" *~[ ~]*", "~")]


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWERED))).strip(" ")


def pattern(sentences: dict[str, str]) -> str:
    """Any known sentence, as the first group, between two ends, which are doubled in the text. Longer ones come first."""
    known = sorted({normal(s) for s in sentences.values()}, key=lambda s: (-len(s), s))
    return f"[|~]({'|'.join(s.replace(' ', '(?: |~~)') for s in known)})[|~]"


def anchors(sentences: dict[str, str]) -> list[str]:
    """Few words of which every known sentence has one: texts with none of them have no known sentence."""
    left, out = [set(normal(s).split()) for s in sentences.values()], []
    while left:
        words = sorted({w for s in left for w in s}, key=lambda w: (-sum(w in s for s in left) * min(len(w), 7) ** 2, w))
        out.append(words[0])
        left = [s for s in left if words[0] not in s]
    return out


def _check(sentences: dict[str, str], rules: dict[str, tuple[str, list[str]]]) -> None:
    if bare := [name for name, s in sentences.items() if not normal(s)]:
        raise ValueError(f"sentences without a word of a-z and 0-9: {bare}")
    if lost := [name for name, (_, ids) in rules.items() if not ids or set(ids) - set(sentences)]:
        raise ValueError(f"rules without sentences, or with unknown ones: {lost}")


def separated(text: str) -> Column:
    """A text column as words and separators; ends are doubled, so that two sentences do not share one."""
    out = F.translate(F.col(text), _UPPER, _LOWERED)
    for old, new in STEPS:
        out = F.regexp_replace(out, old, new)
    out = F.concat(F.lit("|"), out, F.lit("|"))
    for (old, new), inside in zip(RUNS, ("(?<![ ~|])", "(?<! )"), strict=True):
        out = F.regexp_replace(out, inside + old.replace("*", "*+", 1), new)  # a run is looked at once, from its start
    return F.replace(F.replace(out, F.lit("|"), F.lit("||")), F.lit("~"), F.lit("~~"))


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: dict[str, tuple[str, list[str]]] = RULES) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, rule, license, matches, first_sentence), a row a document row and matching rule.

    A known sentence is met where its words stand between two ends: sentence marks before white space, empty lines, ends
    of lines; it may itself run over ends of lines. Of sentences that begin at one place the longest counts. Text that is
    no known sentence may stand between those that a rule names (copyright holders, addresses). ``matches`` counts matches
    that do not overlap, ``first_sentence`` is the number (from 0, among the known sentences met) at which the first
    begins. Null texts and texts without known sentences give no row; null doc_ids are carried; repeated rows give
    repeated rows; further columns are ignored; an empty table gives no rows. Texts of any length are taken whole. Raises
    ValueError for a sentence without words or a rule of unknown sentences."""
    _check(sentences, rules)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    number = {normal(s): i for i, s in enumerate(sentences.values())}
    of = {name: number[normal(s)] for name, s in sentences.items()}
    known = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])  # only what the pattern found is looked up
    may = docs.filter(F.translate("text", _UPPER, _LOWERED).rlike("|".join(anchors(sentences))))
    met = may.select("doc_id", F.regexp_extract_all(separated("text"), F.lit(pattern(sentences)), F.lit(1)).alias("met")).filter(F.size("met") > 0)
    ids = F.transform("met", lambda s: F.concat(F.lit("<"), F.element_at(known, F.replace(s, F.lit("~~"), F.lit(" "))).cast("string"), F.lit(">")))
    found = met.select("doc_id", F.array_join(ids, "").alias("seq"))
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"), F.lit("".join(f"<{of[i]}>" for i in names)).alias("seq")) for name, (lic, names) in rules.items()])
    rows = found.select("doc_id", "seq", F.explode(F.filter(table, lambda r: F.contains(F.col("seq"), r["seq"]))).alias("r"))
    before = F.expr("left(seq, instr(seq, r.seq) - 1)")
    matches = (F.length("seq") - F.length(F.replace(F.col("seq"), F.col("r.seq"), F.lit("")))) / F.length("r.seq")
    first = F.length(before) - F.length(F.replace(before, F.lit("<"), F.lit("")))
    return rows.select("doc_id", "r.rule", "r.license", matches.cast("long").alias("matches"), first.cast("long").alias("first_sentence"))


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    number = {normal(s): i for i, s in enumerate(SENTENCES.values())}
    known = ", ".join(f"({q(s)}, {i})" for s, i in number.items())
    rules = ", ".join(f"({q(n)}, {q(lic)}, {q(''.join(f'<{number[normal(SENTENCES[i])]}>' for i in ids))})" for n, (lic, ids) in RULES.items())
    text = f"translate(text, '{_UPPER}', '{_LOWERED}')"
    for old, new in STEPS:
        text = f"regexp_replace({text}, {q(old)}, {q(new)}, 'g')"
    text = f"'|' || {text} || '|'"
    for old, new in RUNS:
        text = f"regexp_replace({text}, {q(old)}, {q(new)}, 'g')"
    return f"""
WITH known(s, id) AS (VALUES {known}), rules(rule, license, pat) AS (VALUES {rules}),
flat AS (SELECT row_number() OVER () AS r, doc_id, replace(replace({text}, '|', '||'), '~', '~~') AS t FROM documents WHERE text IS NOT NULL),
met AS (SELECT r, doc_id, regexp_extract_all(t, {q(pattern(SENTENCES))}, 1) AS m FROM flat),
each AS (SELECT r, doc_id, unnest(m) AS s, unnest(range(len(m))) AS pos FROM met),
seqs AS (SELECT r, doc_id, string_agg('<' || id || '>', '' ORDER BY pos) AS seq FROM each JOIN known ON known.s = replace(each.s, '~~', ' ') GROUP BY r, doc_id)
SELECT doc_id, rule, license, CAST((length(seq) - length(replace(seq, pat, ''))) / length(pat) AS BIGINT) AS matches,
  CAST(length(regexp_replace(left(seq, instr(seq, pat) - 1), '[^<]', '', 'g')) AS BIGINT) AS first_sentence
FROM seqs JOIN rules ON contains(seq, pat)"""
