"""Licence recognition: sentences to identifiers, then identifier sequences against ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licences that a tag names.
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)

#: Licence sentences as (identifier, pattern), the pattern over lower-case words of letters, digits and .+-
#: A sentence has every identifier whose pattern it holds, in the order of the text.
SENTENCES = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice .*shall be included in all copies"),
    ("mit-as-is", "the software is provided as is without warranty of any kind"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable"),
    ("mit-0", "under (the )?(terms of the )?mit-0|mit no attribution"),
    ("mit-ref", "(under|of) (the )?(terms of the )?mit licen[cs]e"),
    ("apache-2-ref", "under (the )?(terms of the )?apache licen[cs]e,? ?(version|v)? ?2"),
    ("apache-except", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-as-is", "software distributed under the license is distributed on an as is basis"),
    ("apache-see", "see the license for the specific language governing permissions"),
    ("agpl-3-later", "gnu affero general public license.* version 3 of the license or .*any later version"),
    ("agpl-3", "gnu affero general public license.*(version|v) ?3"),
    ("lgpl-3-later", "gnu lesser general public license.* version 3 of the license or .*any later version"),
    ("lgpl-2.1-later", "gnu lesser general public license.* version 2.1 of the license or .*any later version"),
    ("lgpl-3", "gnu lesser general public license.*(version|v) ?3"),
    ("lgpl-2.1", "gnu lesser general public license.*(version|v) ?2.1"),
    ("gpl-3-later", "gnu general public license.* version 3 of the license or .*any later version"),
    ("gpl-2-later", "gnu general public license.* version 2 of the license or .*any later version"),
    ("gpl-3", "gnu general public license.*(version|v) ?3"),
    ("gpl-2", "gnu general public license.*(version|v) ?2"),
    ("gpl-hope", "distributed in the hope that it will be useful but without any warranty"),
    ("gpl-received", "you should have received a copy of the gnu"),
    ("mpl-2", "subject to the terms of the mozilla public license v. 2.0|mozilla public license,? (version|v.?) ?2"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "neither the name of .* may be used to endorse or promote products"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-ref", "under (the )?(terms of the )?(3-clause bsd|bsd 3-clause|bsd-3-clause)"),
    ("bsd-2-ref", "under (the )?(terms of the )?(2-clause bsd|bsd 2-clause|bsd-2-clause)"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties"),
    ("cc-by-nc-sa-4", "cc by-nc-sa 4.0|creative commons attribution-noncommercial-sharealike 4.0"),
    ("cc-by-nc-nd-4", "cc by-nc-nd 4.0|creative commons attribution-noncommercial-noderiv[a-z]* 4.0"),
    ("cc-by-nc-4", "cc by-nc 4.0|creative commons attribution-noncommercial 4.0"),
    ("cc-by-sa-4", "cc by-sa 4.0|creative commons attribution-sharealike 4.0"),
    ("cc-by-nd-4", "cc by-nd 4.0|creative commons attribution-noderiv[a-z]* 4.0"),
    ("cc-by-4", "cc by 4.0|creative commons attribution 4.0"),
    ("cc0", "cc0 1.0|creative commons zero"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("epl-2", "eclipse public license (version|v.?) ?2"),
    ("boost-1", "boost software license (version )?1.0"),
    ("public-domain", "(placed|released|dedicated) (in|into|to) the public domain"),
    ("all-rights", "all rights reserved"),
    ("mit-title", "(^| )mit licen[cs]e"),
    ("apache-2-title", "(^| )apache licen[cs]e,? ?(version|v)? ?2"),
    ("bsd-3-title", "(new|modified|revised) bsd licen[cs]e|3-clause bsd|bsd 3-clause|bsd-3-clause"),
    ("bsd-2-title", "simplified bsd licen[cs]e|2-clause bsd|bsd 2-clause|bsd-2-clause"),
    ("isc-title", "(^| )isc licen[cs]e"),
    ("zlib-as-is", "this software is provided as-is without any express or implied warranty"),
    ("zlib-origin", "the origin of this software must not be misrepresented"),
    ("zlib-marked", "altered source versions must be plainly marked as such"),
    ("zlib-notice", "this notice may not be removed or altered from any source distribution"),
    ("wtfpl", "do what the fuck you want to public license"),
    *((f"spdx-{name.lower()}", f"spdx-license-identifier {name.lower()}( |$)") for name in SPDX),
]

#: Rules as (licence, pattern over identifiers joined by spaces), tried in this order. What a rule matches is
#: used up, so a licence's full text is told from a mention of it and from those that share its sentences.
RULES = [
    ("Apache-2.0", " apache-2-ref apache-except( apache-obtain)?( apache-as-is)?( apache-see)? "),
    ("MIT", " mit-grant( mit-notice)?( mit-as-is)?( mit-liable)? "),
    ("BSD-3-Clause", " bsd-grant bsd-source bsd-binary bsd-endorse( bsd-as-is)? "),
    ("BSD-2-Clause", " bsd-grant bsd-source bsd-binary( bsd-as-is)? "),
    ("ISC", " isc-grant( isc-as-is)? "),
    ("AGPL-3.0-or-later", " agpl-3-later( gpl-hope)?( gpl-received)? "),
    ("LGPL-3.0-or-later", " lgpl-3-later( gpl-hope)?( gpl-received)? "),
    ("LGPL-2.1-or-later", " lgpl-2.1-later( gpl-hope)?( gpl-received)? "),
    ("GPL-3.0-or-later", " gpl-3-later( gpl-hope)?( gpl-received)? "),
    ("GPL-2.0-or-later", " gpl-2-later( gpl-hope)?( gpl-received)? "),
    ("AGPL-3.0-only", " agpl-3( gpl-hope)?( gpl-received)? "),
    ("LGPL-3.0-only", " lgpl-3( gpl-hope)?( gpl-received)? "),
    ("LGPL-2.1-only", " lgpl-2.1( gpl-hope)?( gpl-received)? "),
    ("GPL-3.0-only", " gpl-3( gpl-hope)?( gpl-received)? "),
    ("GPL-2.0-only", " gpl-2( gpl-hope)?( gpl-received)? "),
    ("MPL-2.0", " mpl-2( mpl-copy)? "),
    ("Apache-2.0", " apache-2-ref "),
    ("MIT-0", " mit-0 "),
    ("MIT", " mit-ref "),
    ("BSD-3-Clause", " bsd-3-ref "),
    ("BSD-2-Clause", " bsd-2-ref "),
    ("CC-BY-NC-SA-4.0", " cc-by-nc-sa-4 "),
    ("CC-BY-NC-ND-4.0", " cc-by-nc-nd-4 "),
    ("CC-BY-NC-4.0", " cc-by-nc-4 "),
    ("CC-BY-SA-4.0", " cc-by-sa-4 "),
    ("CC-BY-ND-4.0", " cc-by-nd-4 "),
    ("CC-BY-4.0", " cc-by-4 "),
    ("CC0-1.0", " cc0 "),
    ("Unlicense", " unlicense-free "),
    ("EPL-2.0", " epl-2 "),
    ("BSL-1.0", " boost-1 "),
    ("Public-Domain", " public-domain "),
    ("Zlib", " zlib-as-is( zlib-origin)?( zlib-marked)?( zlib-notice)? "),
    ("WTFPL", " wtfpl "),
    ("MIT", " mit-title "),
    ("Apache-2.0", " apache-2-title "),
    ("BSD-3-Clause", " bsd-3-title "),
    ("BSD-2-Clause", " bsd-2-title "),
    ("ISC", " isc-title "),
    *((name, f" spdx-{name.lower()} ") for name in SPDX),
]


def _escaped(pattern: str) -> str:
    """The patterns above mean a dot followed by a digit, or after a v, literally."""
    out = []
    for k, c in enumerate(pattern):
        literal = c == "." and pattern[k + 1 : k + 2] not in ("*", "?", "+")
        out.append("[.]" if literal else c)
    return "".join(out)


def _rule(pattern: str) -> str:
    """A rule over identifiers written as <identifier>."""
    return _escaped(re.sub(r"[a-z0-9][a-z0-9.-]*", r"<\g<0>>", pattern).replace(" ", ""))


#: Identifiers whose words are part of others'; others are hidden by the same version with "or later".
_HIDDEN_BY = {
    "public-domain": ["unlicense-free"], "mit-title": ["mit-ref"], "apache-2-title": ["apache-2-ref"], "bsd-3-title": ["bsd-3-ref", "spdx-bsd-3-clause"], "bsd-2-title": ["bsd-2-ref", "spdx-bsd-2-clause"],
}
#: What stands between a GNU licence's name and its version: no other licence's name.
_NAMES = "gnu |apache |mozilla |eclipse |boost |creative |mit |bsd "
_GAP = f"(?:(?!{_NAMES}).)*"


def _hidden_by(name: str) -> list[str]:
    return _HIDDEN_BY.get(name, [f"{name}-later"])


def _is_gnu(name: str) -> bool:
    return re.match("[al]?gpl-[0-9]", name) is not None


def _sentence(name: str, pattern: str) -> str:
    """A pattern of SENTENCES as it is searched where a sentence may have several identifiers."""
    return _escaped(pattern).replace(".*", _GAP) if _is_gnu(name) else _escaped(pattern)


def _ways(pattern: str) -> list[str]:
    """The pattern without choices: a text for each, with a tab for what may be missing or vary."""
    plain = re.sub(r"\([^()]*\)\?|\[[^]]*\][*?]?|\.[*?]|[^()\]]\?", "\t", pattern)
    group = re.search(r"\(([^()]*)\)", plain)
    if group is None:
        return plain.split("|")
    return [way for choice in group[1].split("|") for way in _ways(plain[: group.start()] + choice + plain[group.end() :])]


def gate() -> str:
    """A pattern that every text and sentence with one of SENTENCES matches: the longest word of each way to fulfil one."""
    words = {max(re.split(r"[ \t]", way), key=len) for _, pattern in SENTENCES for way in _ways(pattern)}
    return "|".join(re.escape(w) for w in sorted(words) if not any(o != w and o in w for o in words))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licences, sentence_ids, n_sentences, n_unmatched), one row per input row.

    licences: those recognised, in the rules' order, each once, joined by commas. sentence_ids: the identifiers of licence
    sentences in the order of the text, joined by spaces; a sentence has all that it holds, but for those whose words are
    part of another's, as a version's are of the same version "or later". n_sentences: how many identifiers. n_unmatched: identifiers that no rule used. Sentences end at
    . ! or ? before white space; line breaks within one are spaces. Null, empty and other texts without licence sentences
    give empty strings and zeros. There is no shuffle.
    """
    text = F.col(text_col)
    words = F.regexp_replace(F.lower(text), r"[^a-z0-9.!?+-]+", " ")
    sentences = F.split(F.regexp_replace(words, r"[.!?]+( |$)", "\n"), "\n")
    likely = F.filter(sentences, lambda s: s.rlike(gate()))

    def identifiers(s):
        places = [F.struct(F.regexp_instr(s, F.lit(_sentence(name, p))).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"), F.array(*map(F.lit, _hidden_by(name))).alias("by")) for k, (name, p) in enumerate(SENTENCES)]
        return F.array_sort(F.filter(F.array(*places), lambda x: x["at"] > 0))

    def without_hidden(found):
        return F.transform(F.filter(found, lambda x: ~F.arrays_overlap(F.transform(found, lambda y: y["name"]), x["by"])), lambda x: x["name"])

    ids = F.flatten(F.transform(F.transform(likely, identifiers), without_hidden))
    there = F.coalesce(F.lower(text).rlike(gate()), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(there, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    rows = rows.select("doc_id", "ids", F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")).alias("left"))
    found = F.array().cast("array<string>")
    rows = rows.withColumn("found", found)
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_rule(pattern)).alias("pattern")) for name, pattern in RULES])
    start = F.struct(F.col("left").alias("left"), F.col("found").alias("found"))

    def apply(state, rule):
        hit = F.regexp_like(state["left"], rule["pattern"])
        after = F.struct(F.regexp_replace(state["left"], rule["pattern"], F.lit("#")).alias("left"), F.array_append(state["found"], rule["name"]).alias("found"))
        return F.when(hit, after).otherwise(state)

    matched = F.when(F.size("ids") > 0, F.aggregate(steps, start, apply)).otherwise(start)
    rows = rows.select("doc_id", "ids", matched.alias("m"))
    unused = F.when(F.size("ids") > 0, F.regexp_count("m.left", F.lit("<"))).otherwise(F.lit(0))
    return rows.select(
        "doc_id", F.array_join(F.array_distinct("m.found"), ",").alias("licences"), F.array_join("ids", " ").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"), unused.cast("long").alias("n_unmatched"),
    )


def oracle_sql() -> str:
    """The same in SQL over `documents`, from the same fixed values: without the gate, and with sentences cut at licence names
    where the query looks ahead for them."""
    found = []
    for k, (name, pattern) in enumerate(SENTENCES):
        p = _escaped(pattern)
        if _is_gnu(name):
            first = f"list_filter(range(len(parts)), lambda i: regexp_matches(parts[i + 1], '^(?:{p})'))"
            at = f"CASE WHEN len({first}) > 0 THEN CAST(coalesce(list_sum(list_transform(parts[1:({first})[1]], lambda x: length(x))), 0) AS BIGINT) END"
        else:
            at = f"CASE WHEN regexp_matches(s, '{p}') THEN length(regexp_extract(s, '^(.*?)(?:{p})', 1)) END"
        found.append(f"{{'at': {at}, 'k': {k}, 'name': '{name}', 'hidden_by': {_hidden_by(name)!r}}}")
    steps, at = [], "t0"
    for k, (licence, pattern) in enumerate(RULES, 1):
        p = _rule(pattern)
        steps.append(
            f"t{k} AS (SELECT doc_id, ids, CASE WHEN regexp_matches(rest, '{p}') THEN list_append(found, '{licence}') ELSE found END AS found, regexp_replace(rest, '{p}', '#', 'g') AS rest FROM {at})"
        )
        at = f"t{k}"
    return f"""
WITH d AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(text), '[^a-z0-9.!?+-]+', ' ', 'g'), '[.!?]+( |$)', chr(10), 'g'), chr(10)) AS sentences FROM documents
), u AS (
  SELECT doc_id, unnest(sentences) AS s, unnest(range(len(sentences))) AS n FROM d
), p AS (
  SELECT doc_id, n, s, string_split(regexp_replace(s, '({_NAMES})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM u
), f AS (
  SELECT doc_id, n, list_sort(list_filter([{", ".join(found)}], lambda x: x.at IS NOT NULL)) AS found FROM p
), h AS (
  SELECT doc_id, n, list_transform(list_filter(found, lambda x: NOT list_has_any(x.hidden_by, list_transform(found, lambda y: y.name))), lambda x: x.name) AS ids FROM f WHERE len(found) > 0
), g AS (
  SELECT doc_id, flatten(list(ids ORDER BY n)) AS ids FROM h GROUP BY doc_id
), i AS (
  SELECT documents.doc_id, coalesce(g.ids, []) AS ids FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id
), t0 AS (
  SELECT doc_id, ids, CAST([] AS VARCHAR[]) AS found, '<' || coalesce(array_to_string(ids, '><'), '') || '>' AS rest FROM i
), {", ".join(steps)}
SELECT x.doc_id, coalesce(array_to_string(list_filter(x.found, lambda name, i: list_position(x.found, name) = i), ','), '') AS licences, coalesce(array_to_string(x.ids, ' '), '') AS sentence_ids, CAST(len(x.ids) AS BIGINT) AS n_sentences,
  CAST(CASE WHEN len(x.ids) > 0 THEN len(regexp_extract_all(x.rest, '<')) ELSE 0 END AS BIGINT) AS n_unmatched
FROM {at} x
"""
