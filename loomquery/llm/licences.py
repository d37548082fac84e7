"""Licence scans by sentence rules.

Known licence sentences are found in a normalised text, and the sequence of their identifiers is matched against ordered rules: a rule holds if its
identifiers occur in its order, whatever known sentences lie between. A rule may supersede others that its text contains; a separate text of them stays.

A known sentence begins and ends at a line's edge or a sentence's end and may run over any lines of one paragraph: a line break inside it, with the comment
marks and list marks around, counts as a blank, and a colon ends what it announces like a line. A line without a letter or digit is blank and ends a paragraph. Of known sentences from one place the
longest counts, after those of its lines that are known sentences themselves.
Everything happens within a row, in built-in expressions: no shuffle, no Python, and one group of copies or one source is no burden.

Defined results: a null text has no sentences and no licences; so has an empty one; n_sentences counts what lies
between sentence ends and line breaks, so a wrapped sentence counts once a line; a sentence that isn't known is counted only; the order of
equal sentences doesn't matter; repeated rows repeat; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SENTENCE_END = r"[.!?]+(?:\s+|$)|\n"
#: A line break and the next line's comment and list marks.
LINE_START = r"[\r\n][^\p{L}\p{N}\r\n]*(?:(?:rem|dnl)\b[^\p{L}\p{N}\r\n]*)?(?:(?:[a-z0-9]|[ivx]+)\)[ \t]+)?"
#: Each known sentence holds one of these; a text without them needs no search.
HINTS = ("licens", "permission", "redistribution", "warrant", "reserved", "unencumbered", "neighboring", "mozilla", "derivative", "affirmer")

#: SPDX identifiers that a line "SPDX-License-Identifier: X" may name.
SPDX = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "BSL-1.0", "Zlib", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC0-1.0", "Unlicense")

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-short": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "apache-short": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "apache-head": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-asis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "apache-term": ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",),
    "apache-means": ("You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",),
    "apache-marks": ("This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",),
    "gpl2-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",),
    "gpl2-free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl2-aim": ("By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",),
    "gpl2-applies": ("This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License.",),
    "gpl3-short": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "gpl3-copyleft": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "gpl3-term": ("\"This License\" refers to version 3 of the GNU General Public License.",),
    "lgpl21-free": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-hope": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "lgpl21-aim": ("This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",),
    "lgpl3-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "lgpl3-adds": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
    "agpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl-copyleft": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "agpl-term": ("\"This License\" refers to version 3 of the GNU Affero General Public License.",),
    "mpl-head": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "mpl-grant": ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",),
    "mpl-source": ("All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",),
    "epl-head": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"),
    "epl-title": ("Eclipse Public License - v 2.0",),
    "epl-terms": ("THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",),
    "bsd-use": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-disclaimer": ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",),
    "boost-short": ("Distributed under the Boost Software License, Version 1.0.",),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "cc0-notice": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",),
    "cc0-fallback": ("Should any part of the Waiver for any reason be judged legally invalid or ineffective under applicable law, then the Waiver shall be preserved to the maximum extent permitted taking into account Affirmer's express Statement of Purpose.",),
    "cc-by-4": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "reserved": ("All rights reserved.",),
} | {f"spdx-{x}": (f"SPDX-License-Identifier: {x}",) for x in SPDX}

#: (licence, identifiers in order)
RULES = (
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-fragment", ("mit-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-head", "apache-copy")),
    ("Apache-2.0", ("apache-head", "apache-asis")),
    ("Apache-2.0", ("apache-term", "apache-means", "apache-marks")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0", ("gpl2-aim", "gpl2-applies")),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl3-copyleft", "gpl3-term")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-2.1", ("lgpl21-aim",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-3.0", ("lgpl3-adds",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0", ("agpl-copyleft", "agpl-term")),
    ("MPL-2.0", ("mpl-head", "mpl-copy")),
    ("MPL-2.0", ("mpl-grant", "mpl-source")),
    ("EPL-2.0", ("epl-head",)),
    ("EPL-2.0", ("epl-title", "epl-terms")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC0-1.0", ("cc0-fallback",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("All-rights-reserved", ("reserved",)),
    *((x, (f"spdx-{x}",)) for x in SPDX),
)
#: A licence whose whole text holds that of others, or the notices that it tells its users to apply.
SUPERSEDES = {"MIT": ("MIT-fragment",), "BSD-3-Clause": ("BSD-2-Clause",)}


def normal(sentence: str) -> str:
    """The rule table's side of the normalisation."""
    return re.sub("[^a-z0-9]+", " ", re.split(SENTENCE_END, sentence.lower())[0]).strip()


def sentence_table() -> dict[str, str]:
    return {normal(s): name for name, texts in SENTENCES.items() for s in texts}


def rule_pattern(names: tuple[str, ...]) -> str:
    """Over identifiers that are joined and enclosed by bars: the SQL's side, which has linear time by itself."""
    return r"\|" + r"\|(?:.*\|)?".join(names) + r"\|"


def order_pattern(names: tuple[str, ...]) -> str:
    """Over codes: the identifiers in order, whatever lies between. Each is looked for once, from the place of the one before: no way back, so time is linear in the codes."""
    return "^" + "".join(f"[^{CODES[n]}]*+{CODES[n]}" for n in names)


def unwrapped(text: Column) -> Column:
    """Of a lower-case text, the words between single blanks; one line break where the text has one, two at ends of sentences and paragraphs."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.replace(text, F.lit("\r\n"), F.lit("\n"))), LINE_START, "\n")
    # What a colon announces may begin a sentence, as may what follows its number.
    lines = F.regexp_replace(lines, r":[ \t]+(?:\(?(?:[a-z0-9]|[ivx]+)[.)][ \t]+)?", ":\n")
    lines = F.regexp_replace(lines, r"([.!?][ \t]+)\(?(?:[0-9]|[ivx]+)[.)][ \t]+", "$1")
    ended = F.regexp_replace(lines, r"[.!?]+(?:\s+|$)", "\n\n")
    edged = F.regexp_replace(ended, r"[^a-z0-9\n]*\n[^a-z0-9\n]*", "\n")
    return F.trim(F.regexp_replace(edged, r"[^a-z0-9\n ][^a-z0-9\n]*| [^a-z0-9\n]+", " "))


def sentence_pattern() -> str:
    """Known sentences between line breaks, the longest first."""
    known = sorted(sentence_table(), key=lambda s: (-len(s), s))
    return r"(?<![^\n])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in known) + r")(?![^\n])"


#: One character for each identifier: runs of others are then character classes, which need no stack.
CODES = {name: chr(0x100 + i) for i, name in enumerate(SENTENCES)}


def compact_pattern(names: tuple[str, ...]) -> str:
    """Over codes: the identifiers in order, without the first one again or a cut (#) between."""
    codes = [CODES[n] for n in names]
    return codes[0] + "".join(f"[^{codes[0]}{c}#]*+{c}" for c in codes[1:])


def separate(codes: Column, licence: str, covered: str) -> Column:
    """Whether a covered licence's text stands outside the texts of the licence that contains it."""
    inner = next(names for name, names in RULES if name == covered)
    outer = next(names for name, names in RULES if name == licence and set(inner) <= set(names))
    rest = F.regexp_replace(codes, compact_pattern(outer), "#")
    return rest.contains("#") & rest.rlike(compact_pattern(inner))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (known ones in order, joined by bars), licences (sorted, joined by commas)."""
    known = F.create_map(*(F.lit(x) for pair in sentence_table().items() for x in pair))
    lower = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    sentences = F.split(lower, SENTENCE_END)
    hinted = functools.reduce(Column.__or__, (F.contains(lower, F.lit(h)) for h in HINTS))
    found = F.when(hinted, F.regexp_extract_all(unwrapped(lower), F.lit(sentence_pattern()), 0)).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentences.alias("s"), found.alias("f"))
    counted = F.size(F.filter("s", lambda s: s.rlike("[a-z0-9]")))

    def identify(m: Column) -> Column:
        lines = F.filter(F.transform(F.split(m, "\n"), lambda x: F.try_element_at(known, x)), lambda i: i.isNotNull())
        return F.array_distinct(F.concat(lines, F.array(F.element_at(known, F.translate(m, "\n", " ")))))

    out = out.select("doc_id", counted.cast("long").alias("n_sentences"), F.flatten(F.transform("f", identify)).alias("ids"))
    out = out.withColumn("sentence_ids", F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")))
    code = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    out = out.withColumn("codes", F.array_join(F.transform("ids", lambda i: F.element_at(code, i)), ""))
    codes = F.col("codes")
    held = F.array(*(F.when(codes.rlike(order_pattern(names)), F.lit(licence)) for licence, names in RULES))
    found = F.array_sort(F.array_distinct(F.array_compact(held)))
    for licence, covered in ((a, b) for a, bs in SUPERSEDES.items() for b in bs):
        drop = F.array_contains(found, licence) & F.array_contains(found, covered) & ~separate(codes, licence, covered)
        found = F.when(drop, F.array_remove(found, covered)).otherwise(found)
    # Few documents hold a known sentence: the rules are tried on those alone.
    return out.select("doc_id", "n_sentences", F.when(F.size("ids") > 0, F.col("sentence_ids")).otherwise("").alias("sentence_ids"), F.when(F.size("ids") > 0, F.array_join(found, ",")).otherwise("").alias("licences"))


def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in sentence_table().items())
    rules = ", ".join(f"({quoted(licence)}, {quoted(rule_pattern(names))})" for licence, names in RULES)
    covers = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, bs in SUPERSEDES.items() for b in bs)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(licence, pattern) AS (VALUES {rules}), covers(licence, covered) AS (VALUES {covers}),
s AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{SENTENCE_END}') AS s FROM documents),
n AS (SELECT doc_id, len(list_filter(s, lambda x: regexp_matches(x, '[a-z0-9]')))::BIGINT AS n_sentences FROM s),
u AS (SELECT doc_id, unnest(s) AS raw, unnest(generate_series(1, len(s))) AS pos FROM s),
i AS (SELECT doc_id, '|' || string_agg(id, '|' ORDER BY pos) || '|' AS sentence_ids FROM u JOIN known ON sentence = trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
h AS (SELECT DISTINCT doc_id, licence FROM i JOIN rules ON regexp_matches(sentence_ids, pattern)),
f AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM h WHERE NOT EXISTS (SELECT 1 FROM covers c JOIN h g ON g.licence = c.licence WHERE g.doc_id = h.doc_id AND c.covered = h.licence) GROUP BY doc_id)
SELECT n.doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licences, '') AS licences FROM n LEFT JOIN i USING (doc_id) LEFT JOIN f USING (doc_id)
"""


QUERIES = {"op5_licence_rules": op5_licence_rules}
ORACLES = {"op5_licence_rules": _oracle()}
