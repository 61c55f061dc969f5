"""Operator 5, licence scan by sentence rules. DataFrame functions only.

Each text is cut into pieces (at line ends, and after . ! ? ; before white space), which are normalised
(lower case; anything but letters, digits and dots within words becomes one space, comment marks too). What introduces or ends a
notice ("this project is", "see LICENSE") is left out. A known sentence is a
piece or, where lines are wrapped or a stop is within it, neighbouring pieces joined by a space; of those
that begin at a piece the longest counts, and the next begins after it. None goes over a line without
letters and digits. A known sentence has an identifier. The identifiers of a text, in order, are matched
against the licence rules, which are sequences of identifiers; a rule matches where its identifiers stand next to each other.
Rules are ordered: what an earlier (longer) rule has covered, a later one doesn't see.

Known are the sentences of licences and their headers, titles with their dates, notices ("released under ..."; built from ``VERBS`` and
``NAMES``), SPDX lines (from ``SPDX`` and ``DEPRECATED``; each licence of an expression counts, exceptions don't) and "License: ..." lines. Whoever is named
in BSD's third clause counts as the copyright holder. A choice of two licences counts as both, so that the class is the stricter one's.

Edge cases: a null text counts as empty; a text without known sentences has n_sentences 0, an empty
``licenses`` and class "none". A sentence that is known but completes no rule counts in n_sentences only. Repeated rows are each
returned. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL = "under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
#: Identifiers and the normalised licence sentences that bear them.
SENTENCES = (
    ("mit_title", "the mit license"),
    ("mit_title", "mit license"),
    ("mit_title", "the mit license mit"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_condition", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc_title", "isc license"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache2_title", "apache license version 2.0 january 2004"),
    ("apache2_notice", "licensed under the apache license version 2.0 the license"),
    ("apache2_use", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("apache2_as_is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl3_title", "gnu general public license version 3 29 june 2007"),
    ("gpl2_title", "gnu general public license version 2 june 1991"),
    ("lgpl3_title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21_title", "gnu lesser general public license version 2.1 february 1999"),
    ("agpl3_title", "gnu affero general public license version 3 19 november 2007"),
    *((f"{k}_free", f"this {what} is free software you can redistribute it and or modify it {_GPL.format(kind, version)}") for k, kind, version in (("gpl3", "", "3"), ("gpl2", "", "2"), ("lgpl3", "lesser ", "3"), ("lgpl21", "lesser ", "2.1"), ("agpl3", "affero ", "3")) for what in ("program", "library")),
    *(("gpl_hope", f"this {what} {_HOPE}") for what in ("program", "library")),
    ("mpl2_title", "mozilla public license version 2.0"),
    ("mpl2_form", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    *(("bsd_source", f"{n}redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer") for n in ("", "1 ")),
    *(("bsd_binary", f"{n}redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution") for n in ("", "2 ")),
    *(("bsd_name", f"{n}the name of {who} may not be used to endorse or promote products derived from this software without specific prior written permission") for n in ("", "3 ") for who in ("the author", "the copyright holder")),
    *(("bsd_name", f"{n}neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission") for n in ("", "3 ")),
    ("unlicense_free", "this is free and unencumbered software released into the public domain"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost_title", "boost software license version 1.0 august 17th 2003"),
    ("cc0_title", "cc0 1.0 universal"),
)
#: How notices begin, and how licences are called in them.
VERBS = ("released", "licensed", "distributed", "available", "published", "provided")
NAMES = (
    ("mit", "mit license"), ("mit", "mit licence"), ("mit", "terms of the mit license"),
    ("apache2", "apache license version 2.0"), ("apache2", "apache license 2.0"), ("apache2", "apache 2.0 license"), ("apache2", "apache 2.0"),
    ("gpl3", "gnu general public license version 3"), ("gpl3", "gnu general public license v3.0"), ("gpl3", "gnu gpl version 3"), ("gpl3", "gnu gplv3"), ("gpl3", "gplv3"), ("gpl3", "gpl 3.0"),
    ("gpl2", "gnu general public license version 2"), ("gpl2", "gnu gpl version 2"), ("gpl2", "gplv2"), ("gpl2", "gpl 2.0"),
    ("lgpl3", "gnu lesser general public license version 3"), ("lgpl3", "lgplv3"), ("lgpl21", "gnu lesser general public license version 2.1"), ("lgpl21", "lgplv2.1"),
    ("agpl3", "gnu affero general public license version 3"), ("agpl3", "agplv3"), ("agpl3", "agpl 3.0"),
    ("mpl2", "mozilla public license 2.0"), ("mpl2", "mozilla public license version 2.0"), ("mpl2", "mpl 2.0"),
    ("bsd3", "bsd 3 clause license"), ("bsd3", "3 clause bsd license"), ("bsd3", "new bsd license"), ("bsd2", "bsd 2 clause license"), ("bsd2", "2 clause bsd license"), ("bsd2", "simplified bsd license"),
    ("isc", "isc license"), ("unlicense", "unlicense"), ("boost1", "boost software license version 1.0"), ("boost1", "boost software license 1.0"), ("zlib", "zlib license"),
    ("cc0", "cc0 1.0"), ("cc0", "cc0 1.0 universal"), ("cc0", "cc0 license"),
    ("ccby4", "cc by 4.0"), ("ccby4", "creative commons attribution 4.0 international license"),
    ("ccbysa4", "cc by sa 4.0"), ("ccbysa4", "creative commons attribution sharealike 4.0 international license"),
    ("ccbync4", "cc by nc 4.0"), ("ccbync4", "creative commons attribution noncommercial 4.0 international license"),
    ("epl2", "eclipse public license 2.0"), ("epl2", "eclipse public license v 2.0"), ("epl2", "eclipse public license version 2.0"), ("epl1", "eclipse public license 1.0"), ("epl1", "eclipse public license v 1.0"),
    ("cddl1", "common development and distribution license 1.0"), ("cddl1", "common development and distribution license"), ("artistic2", "artistic license 2.0"), ("artistic1", "artistic license"), ("wtfpl", "do what the fuck you want to public license"),
)
#: Identifiers of SPDX lines, with the licence's key here.
SPDX = (
    ("mit", "MIT"), ("apache2", "Apache-2.0"), ("gpl3", "GPL-3.0-only"), ("gpl3_later", "GPL-3.0-or-later"), ("gpl2", "GPL-2.0-only"), ("gpl2_later", "GPL-2.0-or-later"),
    ("lgpl3", "LGPL-3.0-only"), ("lgpl3_later", "LGPL-3.0-or-later"), ("lgpl21", "LGPL-2.1-only"), ("lgpl21_later", "LGPL-2.1-or-later"), ("agpl3", "AGPL-3.0-only"), ("agpl3_later", "AGPL-3.0-or-later"),
    ("mpl2", "MPL-2.0"), ("bsd3", "BSD-3-Clause"), ("bsd2", "BSD-2-Clause"), ("isc", "ISC"), ("unlicense", "Unlicense"), ("boost1", "BSL-1.0"), ("zlib", "Zlib"),
    ("cc0", "CC0-1.0"), ("ccby4", "CC-BY-4.0"), ("ccbysa4", "CC-BY-SA-4.0"), ("ccbync4", "CC-BY-NC-4.0"),
    ("epl2", "EPL-2.0"), ("epl1", "EPL-1.0"), ("cddl1", "CDDL-1.0"), ("artistic2", "Artistic-2.0"), ("artistic1", "Artistic-1.0"), ("wtfpl", "WTFPL"),
)
#: Identifiers of SPDX that are no longer used, with the key of what they stand for.
DEPRECATED = (("gpl3", "GPL-3.0"), ("gpl2", "GPL-2.0"), ("lgpl3", "LGPL-3.0"), ("lgpl21", "LGPL-2.1"), ("agpl3", "AGPL-3.0"))
_plain = lambda name: name.lower().replace("-", " ")
SENTENCES += tuple((f"{k}_notice", f"{verb} under {a}{name}") for k, name in NAMES for verb in VERBS for a in ("the ", "a ", ""))
SENTENCES += tuple((f"{k}_spdx", f"{how} {_plain(name)}") for k, name in SPDX + DEPRECATED for how in ("spdx license identifier", "license", "licence", "licensed under"))
SENTENCES += tuple((f"{k}_notice", f"{how} {name}") for k, name in NAMES for how in ("license", "licence") if name not in {_plain(n) for _, n in SPDX + DEPRECATED})
SENTENCES = tuple((k, s) for s, k in {s: k for k, s in reversed(SENTENCES)}.items())[::-1]  # of those that bear one sentence, the first identifier
#: Licence, its class, and the rule; longer rules first.
RULES = (
    ("MIT", "permissive", ("mit_title", "mit_grant", "mit_condition", "as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_condition")),
    ("BSD-3-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", "permissive", ("apache2_notice", "apache2_use", "apache2_copy", "apache2_as_is")),
    ("Apache-2.0", "permissive", ("apache2_notice", "apache2_use")),
    ("MPL-2.0", "weak copyleft", ("mpl2_form", "mpl2_copy")),
    ("ISC", "permissive", ("isc_title", "isc_grant")),
    *((name, kind, (f"{k}_free", "gpl_hope")) for k, name, kind in (("gpl3", "GPL-3.0-or-later", "copyleft"), ("gpl2", "GPL-2.0-or-later", "copyleft"), ("lgpl3", "LGPL-3.0-or-later", "weak copyleft"), ("lgpl21", "LGPL-2.1-or-later", "weak copyleft"), ("agpl3", "AGPL-3.0-or-later", "copyleft"))),
    *((name, kind, (f"{k}_free",)) for k, name, kind in (("gpl3", "GPL-3.0-or-later", "copyleft"), ("gpl2", "GPL-2.0-or-later", "copyleft"), ("lgpl3", "LGPL-3.0-or-later", "weak copyleft"), ("lgpl21", "LGPL-2.1-or-later", "weak copyleft"), ("agpl3", "AGPL-3.0-or-later", "copyleft"))),
    ("MPL-2.0", "weak copyleft", ("mpl2_form",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("Unlicense", "permissive", ("unlicense_free",)),
    ("Zlib", "permissive", ("zlib_grant",)),
    *((name, kind, (f"{k}_title",)) for k, name, kind in (("apache2", "Apache-2.0", "permissive"), ("gpl3", "GPL-3.0-only", "copyleft"), ("gpl2", "GPL-2.0-only", "copyleft"), ("lgpl3", "LGPL-3.0-only", "weak copyleft"), ("lgpl21", "LGPL-2.1-only", "weak copyleft"), ("agpl3", "AGPL-3.0-only", "copyleft"), ("mpl2", "MPL-2.0", "weak copyleft"), ("boost", "BSL-1.0", "permissive"), ("cc0", "CC0-1.0", "permissive"))),
)
_CLASS = {"gpl": "copyleft", "agp": "copyleft", "lgp": "weak copyleft", "mpl": "weak copyleft", "epl": "weak copyleft", "cdd": "weak copyleft", "ccbync4": "noncommercial", "ccbysa4": "copyleft"}
RULES += tuple((name, _CLASS.get(k, _CLASS.get(k[:3], "permissive")), (f"{k}_{how}",)) for k, name in SPDX for how in ("notice", "spdx") if how == "spdx" or "later" not in k)
#: The strictest class of a text's licences is its class.
STRICTNESS = ("noncommercial", "copyleft", "weak copyleft", "permissive")
#: A stop at a line's end is one cut, so that an empty piece is always an empty line.
CUT = r"(?<=[.!?;])[\x20\x09\x0B-\x0D]+\n?|\n"
#: A sentence must have one of these to be known at all; most texts are passed over before they are cut.
CUES = ("licens", "licenc", "permission", "redistribut", "warrant", "copyright", "unencumbered", "gpl", "apache", "mpl", "cc0")
CUE_CC = r"\bcc[^a-z0-9]+by\b"
#: What is left out at the beginning (up to the verb) and at the end of a notice.
INTRO = r"(?m)^(?:this|the|our)[ \n](?:project|software|work|program|code|library|package|file|document|repository|source code)[ \n](?:is|are)[ \n](%s)[ \n]under" % "|".join(VERBS)
OUTRO = r"(?m)[ \n](?:see|read)[ \n](?:the[ \n])?(?:license|licence|copying)(?:[ \n]file)?(?:[ \n]for[ \n](?:more[ \n])?(?:details|information))?$"
#: Whoever is named in the third clause stands for the copyright holder; up to 16 words, over a stop or a wrapped line too.
NAMED = r"\bneither[ \n]the[ \n]names?[ \n]of[ \n](?:[a-z0-9.]+[ \n]){1,16}?nor[ \n]the[ \n]names?[ \n]of[ \n](?:its|their|any|other|the)[ \n]contributors[ \n]may"
HOLDER = "neither the name of the copyright holder nor the names of its contributors may"
#: A choice of two licences is a notice of each.
DUAL = r"(?m)^dual licensed under (?:either )?(?:of )?"
EITHER = r"(?m)^(%s) under either (?:of )?(.+?) or (.+?)(?: at your option)?$" % "|".join(VERBS)
#: "The code is MIT licensed."
LICENSED = r"(?m)^(?:(?:this|the|our) )?(?:project|software|work|program|code|library|package|file|repository|source code) is ([a-z0-9.]+(?: [a-z0-9.]+){0,5}?) licensed$"
#: SPDX expressions: each licence of one has a line of its own, exceptions are left out, and a plus is "or later".
LATER = r"(?i)(gpl-[0-9]\.[0-9])\+"
SPDX_LINE = "spdx license identifier "
SPDX_WITH = r"(?m) with .*$"


def _normal(s: Column) -> Column:
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9.]+|\.(?![a-z0-9])|(?<![a-z0-9])\.", " ")
    return F.trim(F.regexp_replace(s, " +", " "))


def _expression(p: Column) -> Column:
    """The lines of an SPDX expression; other pieces as they are."""
    each = F.regexp_replace(F.regexp_replace(F.replace(p, F.lit(" or later"), F.lit(" or_later")), " (?:or|and) ", "\n" + SPDX_LINE), SPDX_WITH, "")
    return F.when(p.startswith(SPDX_LINE), F.replace(each, F.lit(" or_later"), F.lit(" or later"))).otherwise(p)


#: In this order, over the pieces joined by line ends.
REWRITES = ((INTRO, "$1 under"), (OUTRO, ""), (DUAL, "licensed under either of "), (EITHER, "$1 under $2\n$1 under $3"), (LICENSED, "license $1"), (NAMED, HOLDER))


def _runs(sentences: tuple) -> str:
    """A pattern of the known sentences over whole pieces, a piece a line: a tree by words, so each word is tried once; the longest is tried first."""
    tree: dict = {}
    for _, s in sentences:
        at = tree
        for w in s.split(" "):
            at = at.setdefault(w, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        each = [re.escape(w) + (("(?:[ \\n]" + pattern(n) + ")?" if "" in n else "[ \\n]" + pattern(n)) if set(n) - {""} else "") for w, n in sorted(node.items()) if w]
        return each[0] if len(each) == 1 else "(?:" + "|".join(each) + ")"

    return "(?m)^" + pattern(tree) + "$"


def _cued(low: Column, sentences: tuple) -> Column:
    """Whether a text in lower case can have any of the sentences."""
    if not all(any(c in s for c in CUES) or re.search(CUE_CC, s) for _, s in sentences):
        return F.lit(True)
    out = low.contains("cc") & low.rlike(CUE_CC)
    for c in reversed(CUES):
        out = low.contains(c) | out
    return out


def scan(docs: DataFrame, sentences: tuple = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses (names in the order of their first rules, comma-joined), license_class."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.create_map(*(F.lit(x) for k, s in sentences for x in (s, k)))
    pieces = F.array_join(F.transform(F.split(F.regexp_replace("text", LATER, "$1-or-later"), CUT), lambda p: _expression(_normal(p))), "\n")
    for rule, by in REWRITES:
        pieces = F.regexp_replace(pieces, rule, by)
    found = F.regexp_extract_all(pieces, F.lit(_runs(sentences)), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.replace(s, F.lit("\n"), F.lit(" "))))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low")).select("doc_id", F.when(_cued(F.col("low"), sentences), ids).otherwise(none).alias("ids"))
    # " a b c " with doubled spaces, so that neighbours can each be matched and cut out
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("rest"))
    for i, (_, _, rule) in enumerate(rules):
        body = "  ".join(rule)
        rows = rows.withColumns({f"hit{i}": F.col("rest").contains(f" {body} "), "rest": F.replace("rest", F.lit(f" {body} "), F.lit(" | "))})
    by_name = {n: reduce(or_, (F.col(f"hit{i}") for i, r in enumerate(rules) if r[0] == n)) for n, _, _ in rules}
    names = F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit in by_name.items())))
    kinds = F.array(*(F.when(F.col(f"hit{i}"), F.lit(k)) for i, (_, k, _) in enumerate(rules)))
    strict = F.coalesce(*(F.when(F.array_contains(F.array_compact(kinds), k), F.lit(k)) for k in STRICTNESS), F.lit("none"))
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(names, ",").alias("licenses"), strict.alias("license_class"))


def sql() -> str:
    """The same result in DuckDB's SQL, for the tables of sentences and rules above."""
    known = ", ".join(f"('{s}', '{k}')" for k, s in SENTENCES)
    rest = "' ' || string_agg(id, '  ' ORDER BY i) || ' '"
    steps, at = [], "r0"
    for i, (_, _, rule) in enumerate(RULES):
        body = f" {'  '.join(rule)} "
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE (rest), contains(rest, '{body}') AS hit{i}, replace(rest, '{body}', ' | ') AS rest FROM {at})")
        at = f"r{i + 1}"
    names = list(dict.fromkeys(n for n, _, _ in RULES))
    either = lambda keep: " OR ".join(f"hit{i}" for i, r in enumerate(RULES) if keep(r))
    listed = ", ".join(f"CASE WHEN {either(lambda r, n=n: r[0] == n)} THEN '{n}' END" for n in names)
    strict = " ".join(f"WHEN {either(lambda r, k=k: r[1] == k)} THEN '{k}'" for k in STRICTNESS)
    rewritten = "string_agg(t, chr(10) ORDER BY i)"
    for rule, by in REWRITES:
        rewritten = f"regexp_replace({rewritten}, '{rule}', '{re.sub(r'[$]([0-9])', r'\\\1', by)}', 'g')"
    return rf"""WITH lines AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{LATER}', '\1-or-later', 'g'), '([.!?;])[\x20\x09\x0B-\x0D]+\n?', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM lines),
n AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9.]+', ' ', 'g'), '\.\.+', ' ', 'g'), '\.( |$)', ' ', 'g'), '(^| )\.', ' ', 'g'), ' +', ' ', 'g')) AS t FROM s),
e AS (SELECT doc_id, i, CASE WHEN starts_with(t, '{SPDX_LINE}') THEN array_to_string(list_transform(string_split_regex(replace(t, ' or later', ' or_later'), ' (?:or|and) '), lambda x, k: CASE WHEN k = 1 THEN '' ELSE '{SPDX_LINE}' END || replace(string_split(x, ' with ')[1], ' or_later', ' or later')), chr(10)) ELSE t END AS t FROM n),
j AS (SELECT doc_id, regexp_extract_all({rewritten}, '{_runs(SENTENCES)}') AS f FROM e GROUP BY doc_id),
f AS (SELECT doc_id, unnest(f) AS t, generate_subscripts(f, 1) AS i FROM j),
ids AS (SELECT doc_id, i, k.id FROM f JOIN (VALUES {known}) AS k(t, id) ON k.t = replace(f.t, chr(10), ' ')),
r0 AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ' ' ORDER BY i) AS sentence_ids, {rest} AS rest FROM ids GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ','), '') AS licenses, coalesce(CASE {strict} END, 'none') AS license_class
FROM documents d LEFT JOIN {at} USING (doc_id)"""
