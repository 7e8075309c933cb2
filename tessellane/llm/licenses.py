"""Licence scans by sentence rules, with DataFrame operations only.

A text is cut into sentences, each sentence is normalised and mapped to the identifier of a known licence sentence or
to nothing, and the document's identifier sequence is matched against ordered rules. All of that happens inside a row,
so nothing is shuffled. The sentences and rules are tables of this module (at most ``MOST_SENTENCES`` entries), so
putting them into the plan has a fixed bound.

A single line break inside a paragraph is white space where that makes a known sentence, and a sentence's end otherwise, so both
line-wrapped licences and notices of a line each are found.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import whole_text

MOST_SENTENCES = 1000
# Sentences of licences, normalised, and the rules made of them.
#: Sentence identifier, normalised sentence; sentences of one identifier are forms of one sentence.
SENTENCES = (
    ("ap1", "licensed under the apache license version 2 0"),
    ("ap2", "you may not use this file except in compliance with the license"),
    ("ap3", "you may obtain a copy of the license at"),
    ("ap4", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gp1", "this work is licensed under the gnu general public license version 3"),
    ("gp2", "this work is licensed under the gnu general public license version 2"),
    ("gp3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gp4", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gp5", "you should have received a copy of the gnu general public license along with this program"),
    ("mi1", "released under the mit license"),
    ("mi2", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mi3", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mi4", "the software is provided as is without warranty of any kind express or implied"),
    ("bs1", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bs2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bs3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bs4", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc1", "licensed under cc by nc 4 0"),
    ("cc2", "licensed under cc by 4 0"),
    ("cc3", "licensed under cc by sa 4 0"),
    ("cc4", "licensed under cc by nd 4 0"),
    ("cc5", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("ar1", "all rights reserved"),
    ("ap5", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gt1", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gt2", "the precise terms and conditions for copying distribution and modification follow"),
    ("mi2", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mi4", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bs4", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gp6", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gp7", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gt3", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gt4", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("lg1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lg2", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lg3", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("ag1", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("ag2", "you should have received a copy of the gnu affero general public license along with this program"),
    ("mp1", "this source code form is subject to the terms of the mozilla public license v"),
    ("mp2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mp2", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("is1", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("is1", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("is2", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("un1", "this is free and unencumbered software released into the public domain"),
    ("un2", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cz1", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cz2", "this software is distributed without any warranty"),
    ("zl1", "this software is provided as is without any express or implied warranty"),
    ("zl2", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zl3", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ep1", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("bo1", "distributed under the boost software license version 1 0"),
    ("bo2", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("wt1", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("at1", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("at2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("cc6", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc7", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc8", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc9", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
)
#: Rule name, licence, the sentences that have to follow each other among the known ones; rules of one name are forms of one rule.
RULES = (
    ("apache-2.0.notice", "Apache-2.0", ("ap1",)),
    ("apache-2.0.header", "Apache-2.0", ("ap1", "ap2", "ap3", "ap4")),
    ("gpl-3.0.notice", "GPL-3.0", ("gp1",)),
    ("gpl-2.0.notice", "GPL-2.0", ("gp2",)),
    ("gpl-3.0.header", "GPL-3.0-or-later", ("gp3", "gp4", "gp5")),
    ("mit.notice", "MIT", ("mi1",)),
    ("mit.text", "MIT", ("mi2", "mi3", "mi4")),
    ("bsd-2-clause.text", "BSD-2-Clause", ("bs1", "bs2", "bs3")),
    ("bsd-3-clause.text", "BSD-3-Clause", ("bs1", "bs2", "bs3", "bs4")),
    ("cc-by-nc-4.0.notice", "CC-BY-NC-4.0", ("cc1",)),
    ("cc-by-4.0.notice", "CC-BY-4.0", ("cc2",)),
    ("cc-by-sa-4.0.notice", "CC-BY-SA-4.0", ("cc3",)),
    ("cc-by-nd-4.0.notice", "CC-BY-ND-4.0", ("cc4",)),
    ("cc-by-4.0.deed", "CC-BY-4.0", ("cc5",)),
    ("all-rights-reserved", "proprietary", ("ar1",)),
    ("apache-2.0.notice", "Apache-2.0", ("ap5",)),
    ("apache-2.0.header", "Apache-2.0", ("ap5", "ap3", "ap4")),
    ("gpl-3.0.text", "GPL-3.0", ("gt1", "gt2")),
    ("gpl-3.0.text", "GPL-3.0", ("gt1", "gt2", "gp3", "gp4", "gp5")),
    ("bsd-2-clause.text", "BSD-2-Clause", ("ar1", "bs1", "bs2", "bs3")),
    ("bsd-3-clause.text", "BSD-3-Clause", ("ar1", "bs1", "bs2", "bs3", "bs4")),
    ("gpl-2.0.header", "GPL-2.0-or-later", ("gp6", "gp4")),
    ("gpl-2.0-only.header", "GPL-2.0-only", ("gp7",)),
    ("gpl-2.0.text", "GPL-2.0", ("gt3", "gt4")),
    ("gpl-3.0.text", "GPL-3.0", ("gt3", "gt1")),
    ("lgpl-2.1.header", "LGPL-2.1-or-later", ("lg1", "lg2")),
    ("lgpl-3.0.header", "LGPL-3.0-or-later", ("lg3", "gp4")),
    ("agpl-3.0.header", "AGPL-3.0-or-later", ("ag1", "gp4", "ag2")),
    ("mpl-2.0.header", "MPL-2.0", ("mp1", "mp2")),
    ("isc.text", "ISC", ("is1", "is2")),
    ("unlicense.text", "Unlicense", ("un1", "un2")),
    ("cc0-1.0.dedication", "CC0-1.0", ("cz1", "cz2")),
    ("zlib.text", "Zlib", ("zl1", "zl2", "zl3")),
    ("epl-2.0.header", "EPL-2.0", ("ep1",)),
    ("bsl-1.0.notice", "BSL-1.0", ("bo1",)),
    ("bsl-1.0.text", "BSL-1.0", ("bo2",)),
    ("wtfpl.text", "WTFPL", ("wt1",)),
    ("apache-2.0.text", "Apache-2.0", ("at1", "at2")),
    ("cc-by-sa-4.0.deed", "CC-BY-SA-4.0", ("cc6",)),
    ("cc-by-nc-4.0.deed", "CC-BY-NC-4.0", ("cc7",)),
    ("cc-by-nc-sa-4.0.deed", "CC-BY-NC-SA-4.0", ("cc8",)),
    ("cc-by-nd-4.0.deed", "CC-BY-ND-4.0", ("cc9",)),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def marked(text: Column) -> Column:
    """The text's words (A-Z lower-cased, each run of other characters than a-z and 0-9 one space) with marks between them.

    S is a sentence's end: a full stop, exclamation or question mark before white space, a line without words, a numbered
    list item's start. L is another line break. The text stands between two S.
    """
    out = F.translate(text, _UPPER, _LOWER)
    out = F.regexp_replace(out, r"[.!?](?=[ \t\r\n])", "S")
    out = F.regexp_replace(out, r"(?:\r\n?|\n)[ \t]*\(?(?:[0-9]{1,3}|[a-z])\)(?=[ \t])", "S")
    out = F.regexp_replace(out, r"\r\n?|\n", "L")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9SL]+", " "), " ?([SL]) ?", "$1")
    return F.regexp_replace(F.concat(F.lit("S"), F.trim(out), F.lit("S")), "[SL]{2,}", "S")


def _any_of(forms: list[str]) -> str:
    """A regular expression of the forms, those that begin alike together; the longest where several fit."""
    if len(forms) == 1:
        return forms[0].replace(" ", "[ L]")
    begins: dict[str, list[str]] = {}
    for form in forms:
        begins.setdefault(form[:1], []).append(form[1:])
    empty = begins.pop("", None)
    parts = [first.replace(" ", "[ L]") + _any_of(sorted(set(rest))) for first, rest in sorted(begins.items())]
    return parts[0] if len(parts) == 1 and empty is None else f"(?:{'|'.join(parts)}{'|' if empty is not None else ''})"


def _needed_words(forms: set[str]) -> list[str]:
    """A few words of which every form has one, so a text without any of them holds no form."""
    left, out = {f: {w for w in f.split() if len(w) > 5} or set(f.split()) for f in forms}, []
    while left:
        counts: dict[str, int] = {}
        for words in left.values():
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        out.append(max(sorted(counts), key=lambda w: counts[w]))
        left = {f: words for f, words in left.items() if out[-1] not in words}
    return out


def known_sentences(text: Column, known) -> Column:
    """The known sentences (normalised) in text order: from mark to mark, over single line breaks, the longest where several fit."""
    forms = {sentence for _, sentence in known}
    pattern = f"[SL]{_any_of(sorted(forms))}(?=[SL])"
    found = F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.translate(F.substring(s, 2, 1_000_000), "L", " "))


def may_hold(text: Column, known) -> Column:
    """Whether a text has a word that every known sentence needs one of; only those are worth normalising."""
    lower = F.translate(text, _UPPER, _LOWER)
    return reduce(or_, [F.contains(lower, F.lit(w)) for w in _needed_words({sentence for _, sentence in known})])


def _covers(longer: tuple[str, ...], shorter: tuple[str, ...]) -> bool:
    return len(longer) > len(shorter) and f",{','.join(shorter)}," in f",{','.join(longer)},"


def scan(docs: DataFrame, known=SENTENCES, rules=RULES, text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_sentences (known ones), sentence_ids (in text order), rules, licenses.

    The last three are comma-joined. A rule matches if its sentences follow each other in the sequence of known
    sentences (unknown ones between them don't matter); a rule that is part of a longer rule that matched isn't
    reported. Rules of one name are sequences of one rule. Licences are distinct and in code-point order. Null and empty texts have no sentence and empty strings;
    repeated rows stay; texts are scanned whole; other columns aren't read.
    """
    if len(known) > MOST_SENTENCES or len(rules) > MOST_SENTENCES:
        raise ValueError(f"at most {MOST_SENTENCES} sentences and rules")
    table = F.create_map(*[F.lit(x) for name, sentence in known for x in (sentence, name)])
    ids = F.filter(F.transform(known_sentences(whole_text(text), known), lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull())
    # The condition stands outside, where it is compiled; functions with lambdas and all in them are interpreted.
    ids = F.when(may_hold(whole_text(text), known), ids).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", ids.alias("ids")).withColumn("row", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    holds = {seq: F.contains(F.col("row"), F.lit(f",{','.join(seq)},")) for _, _, seq in rules}
    hits: dict[tuple[str, str], Column] = {}
    for name, licence, seq in rules:
        hit = holds[seq]
        for longer in holds:
            if _covers(longer, seq):
                hit = hit & ~holds[longer]
        hits[name, licence] = hits[name, licence] | hit if (name, licence) in hits else hit
    named = [F.when(hit, F.lit(name)) for (name, _), hit in hits.items()]
    licences = [F.when(hit, F.lit(licence)) for (_, licence), hit in hits.items()]
    kept = lambda cols: F.array_compact(F.array(*cols))
    where_some = lambda c: F.when(F.size("ids") > 0, c).otherwise("")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        where_some(F.array_join(kept(named), ",")).alias("rules"), where_some(F.array_join(F.array_sort(F.array_distinct(kept(licences))), ",")).alias("licenses"),
    )


def oracle(known=SENTENCES, rules=RULES) -> str:
    """The scan in SQL. Its regular expressions can't look ahead, so each mark is doubled: one ends a sentence, one begins the next."""
    pairs = ", ".join(f"('{i}', '{s}')" for i, s in known)
    forms = "|".join(s.replace(" ", "(?: |LL)") for s in sorted((s for _, s in known), key=lambda s: (-len(s), s)))
    cond = {q: f"contains(ids, ',{','.join(q)},')" for _, _, q in rules}
    hits: dict[tuple[str, str], list[str]] = {}
    for name, licence, q in rules:
        hits.setdefault((name, licence), []).append("(" + " AND ".join([cond[q], *(f"NOT {cond[longer]}" for longer in cond if _covers(longer, q))]) + ")")
    names = ", ".join(f"CASE WHEN {' OR '.join(h)} THEN '{n}' END" for (n, _), h in hits.items())
    lics = ", ".join(f"CASE WHEN {' OR '.join(h)} THEN '{lic}' END" for (_, lic), h in hits.items())
    return rf"""
WITH known(id, sentence) AS (VALUES {pairs}),
docs AS (SELECT row_number() OVER () AS rn, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
m1 AS (SELECT rn, doc_id, regexp_replace(regexp_replace(t, '[.!?]([ \t\r\n])', 'S\1', 'g'), '(?:\r\n?|\n)[ \t]*\(?(?:[0-9]{{1,3}}|[a-z])\)([ \t])', 'S\1', 'g') AS t FROM docs),
m2 AS (SELECT rn, doc_id, regexp_replace(regexp_replace(t, '\r\n?|\n', 'L', 'g'), '[^a-z0-9SL]+', ' ', 'g') AS t FROM m1),
m3 AS (SELECT rn, doc_id, regexp_replace('S' || trim(regexp_replace(t, ' ?([SL]) ?', '\1', 'g')) || 'S', '[SL]{{2,}}', 'S', 'g') AS t FROM m2),
cut AS (SELECT rn, doc_id, regexp_extract_all(regexp_replace(t, '([SL])', '\1\1', 'g'), '[SL](?:{forms})[SL]') AS parts FROM m3),
lines AS (SELECT rn, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
hits AS (SELECT rn, pos, id FROM (SELECT rn, pos, replace(part[2:-2], 'LL', ' ') AS s FROM lines) l JOIN known k ON l.s = k.sentence),
seqs AS (SELECT rn, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS seq FROM hits GROUP BY rn),
rows_ AS (SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(seq, '') AS sentence_ids, ',' || coalesce(seq, '') || ',' AS ids FROM docs d LEFT JOIN seqs USING (rn))
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids,
       array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS rules,
       array_to_string(list_sort(list_distinct(list_filter([{lics}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM rows_
"""
