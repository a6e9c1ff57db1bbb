"""License scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, only letters, digits and single spaces) and looked up among known licence sentences;
the identifiers that are found, in text order, form a sequence, and ordered licence rules are matched against it.

A sentence ends at an end mark before white space, or at a line without words; a single line end is white space, so wrapped texts and texts behind
comment marks read like any other.  A sentence that is not known as a whole is tried line by line, for notices without an end mark.  A sentence that names
a licence is a lead ("this work is licensed under the", "SPDX-License-Identifier:") and a name; the lead is cut off by a pattern and the name looked up.

A rule names the sentences that must follow each other; `*` stands for up to GAP other known sentences.  Where a longer rule contains a shorter one,
the longer one's matches are taken out before the shorter one is tried, so that a text with both is reported with both.  Everything is built from
DataFrame functions on one row: no shuffle, no Python.  Texts without any anchor word skip the splitting; every known sentence holds one.

Defined results: null and empty texts have no sentences and no licences; a repeated sentence counts each time; a licence is reported once per
text, in the order of the rules; only the first line of a heading counts where a licence's text follows it without a blank line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of public licences in normal form.  Those that hold "licen" count alone, the others only after a lead.
NAMES: dict[str, tuple[str, ...]] = {
    "0BSD": ("zero clause bsd license", "bsd zero clause license", "0bsd"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "affero general public license version 3", "gnu agpl version 3", "gnu agplv3", "agpl 3 0", "agplv3", "agpl 3 0 only", "agpl 3 0 or later"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache 2 0", "apache license version 2 0 the license"),
    "Artistic-2.0": ("artistic license 2 0", "artistic 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost software license", "bsl 1 0"),
    "CC0-1.0": ("creative commons zero v1 0 universal license", "cc0 1 0 universal license", "cc0 1 0 universal", "cc0 1 0 license", "cc0 1 0", "creative commons zero"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "common development and distribution license 1 0", "common development and distribution license", "cddl 1 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "epl 2 0"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public licence v 1 2", "european union public licence 1 2", "european union public license 1 2", "eupl 1 2"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu general public license version 2 0", "gnu gpl version 2", "gnu gpl v2", "gpl 2 0", "gplv2", "gpl 2 0 only", "gpl 2 0 or later"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu general public license version 3 0", "gnu gpl version 3", "gnu gpl v3", "gpl 3 0", "gplv3", "gpl 3 0 only", "gpl 3 0 or later"),
    "ISC": ("isc license", "internet systems consortium license", "isc"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl 2 1", "lgplv2 1", "lgpl 2 1 only", "lgpl 2 1 or later"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lgpl version 3", "lgpl 3 0", "lgplv3", "lgpl 3 0 only", "lgpl 3 0 or later"),
    "MIT": ("mit license", "the mit license", "expat license", "the mit license mit", "mit"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0"),
    "MS-PL": ("microsoft public license", "microsoft public license ms pl", "ms pl"),
    "NCSA": ("university of illinois ncsa open source license", "ncsa open source license", "ncsa"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1", "sil open font license", "ofl 1 1"),
    "PostgreSQL": ("postgresql license", "postgresql"),
    "PSF-2.0": ("python software foundation license version 2", "python software foundation license", "psf license", "psf 2 0"),
    "Unlicense": ("unlicense", "the unlicense"),
    "WTFPL": ("do what the fuck you want to public license", "wtfpl license", "wtfpl"),
    "Zlib": ("zlib license", "zlib libpng license", "zlib"),
}
#: the Creative Commons licences, by their parts
_CC = {"BY": "attribution", "NC": "noncommercial", "SA": "sharealike", "ND": "noderivatives"}
for _parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("3.0", "4.0"):
        _short, _n = _parts.lower().replace("-", " "), _v.replace(".", " ")
        _long = " ".join(_CC[p] for p in _parts.split("-")) + f" {_n} " + ("international" if _v == "4.0" else "unported")
        NAMES[f"CC-{_parts}-{_v}"] = (f"cc {_short} {_n}", f"cc {_short} {_n} license", f"creative commons {_long} license", f"creative commons {_long}", f"creative commons {_short} {_n} license")

#: what may stand before a licence's name in a sentence
LEAD = (
    "^(?:spdx license identifier |(?:(?:this|the) (?:work|project|software|program|file|code|library|package|source code|document|text|data set|dataset|module|article|page) (?:is|was) |it is |all code is )?"
    "(?:also |dual |now )?(?:re)?(?:released|licensed|distributed|available|provided|published|made available|offered|covered) (?:for use |freely )?under (?:the terms (?:and conditions )?of )?(?:the |a |an )?)"
)
#: numbering before a sentence, and the words that such sentences begin with
NUMBER = "^(?:[0-9a-z]|[1-9][0-9]) (altered|neither|permission|redistributions|the|this) "

# fixed values: sentences of public licences in normal form, by identifier
SENTENCES: dict[str, tuple[str, ...]] = {
    "arr": ("all rights reserved",),
    "mit.grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit0.grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",),
    "mit.notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "liable": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "apache2.may": ("you may not use this file except in compliance with the license",),
    "apache2.unless": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "bsd.redist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd.source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd.binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd.endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd.asis": (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "this software is provided by the author as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "isc.grant": tuple(f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("and or", "and")),
    "0bsd.grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "isc.asis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "gpl.recopy": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "mpl2.form": ("this source code form is subject to the terms of the mozilla public license v",),
    "mpl2.copy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "zlib.grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib.notice": ("this notice may not be removed or altered from any source distribution",),
    "unlicense.free": ("this is free and unencumbered software released into the public domain",),
    "unlicense.any": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "boost.grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "postgres.grant": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",),
    "wtfpl.copy": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
    "epl2.made": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",),
    "epl1.made": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
}
#: the notices of the GNU licences: licence, its name, its version
_GNU = (("AGPL-3.0", "affero general public", "3"), ("GPL-2.0", "general public", "2"), ("GPL-3.0", "general public", "3"), ("LGPL-2.1", "lesser general public", "2 1"), ("LGPL-3.0", "lesser general public", "3"))
_WHAT = ("", *(f"{w} is free software " for w in ("this program", "this library", "this software", "this file", "it")))
_ENDS = ("either version {} of the license or at your option any later version", "version {} of the license", "either version {} of the license or any later version")
for _id, _name, _v in _GNU:
    _may = f"you can redistribute it and or modify it under the terms of the gnu {_name} license as published by the free software foundation"
    SENTENCES[f"gnu.{_name.split()[0]}.may"] = tuple(_w + _may for _w in _WHAT)
    SENTENCES[f"gnu.v{_v.replace(' ', '.')}"] = tuple(_e.format(_v) for _e in _ENDS)
    SENTENCES[f"{_id}.free"] = tuple(f"{_w}{_may} {_e.format(_v)}" for _w in _WHAT for _e in _ENDS)

#: licence -> alternatives, each a sequence of identifiers that follow each other; `*`: other known sentences may stand between
_TEXTS: dict[str, tuple[tuple[str, ...], ...]] = {
    "0BSD": (("0bsd.grant",),),
    "Apache-2.0": (("apache2.may",), ("apache2.unless",)),
    "BSD-2-Clause": (("bsd.redist", "*", "bsd.source", "*", "bsd.binary"),),
    "BSD-3-Clause": (("bsd.redist", "*", "bsd.source", "*", "bsd.binary", "*", "bsd.endorse"),),
    "BSL-1.0": (("boost.grant",),),
    "EPL-1.0": (("epl1.made",),),
    "EPL-2.0": (("epl2.made",),),
    "ISC": (("isc.grant", "*", "isc.asis"), ("isc.grant",)),
    "MIT": (("mit.grant", "*", "mit.notice"), ("mit.notice", "*", "asis")),
    "MIT-0": (("mit0.grant",),),
    "MPL-2.0": (("mpl2.form",), ("mpl2.copy",)),
    "PostgreSQL": (("postgres.grant",),),
    "Unlicense": (("unlicense.free", "*", "unlicense.any"), ("unlicense.free",)),
    "WTFPL": (("wtfpl.copy",),),
    "Zlib": (("zlib.grant", "*", "zlib.notice"),),
    "proprietary-notice": (("arr",),),
} | {i: ((f"{i}.free",), (f"gnu.{n.split()[0]}.may", f"gnu.v{v.replace(' ', '.')}"), (f"{i}.name", "*", "gpl.recopy")) for i, n, v in _GNU}
RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = tuple((i, (*_TEXTS.get(i, ()), *(((f"{i}.name",),) if i in NAMES else ()))) for i in sorted({*NAMES, *_TEXTS}, key=lambda i: (i == "proprietary-notice", i)))
#: (a rule that contains another, the other one)
WITHIN = (("BSD-3-Clause", "BSD-2-Clause"),)
GAP = 6
#: every known sentence holds one of these
ANCHORS = ("licen", "reserved", "permission", "copyright", "warrant", "redistribut", "permitted", "unencumbered", "anyone is free", "under ", "by ", "notice", "mpl", "shall the")
#: every text with a known sentence holds one of these
TEXT_ANCHORS = ("licen", "reserved", "permission", "copyright", "warrant", "redistribut", "permitted", "unencumbered", "anyone is free", "released", "distributed", "available", "provided", "published", "offered", "covered", "altered")
#: sentences end here: end marks before white space, or lines that hold no words
SPLIT = r"[.!?;:]+[\"')]*(?:[ \t\r\n]+|$)|\r?\n(?:[ \t#*/;%|=-]*\r?\n)+"


def _known() -> dict[str, str]:
    """Normal form -> identifier; a leading @ stands for a lead."""
    out = {form: i for i, forms in SENTENCES.items() for form in forms}
    for licence, forms in NAMES.items():
        for form in forms:
            out[f"@{form}"] = f"{licence}.name"
            if "licen" in form:
                out.setdefault(form, f"{licence}.name")
    return out


KNOWN = _known()


def _look(sentence: Column) -> Column:
    """The identifier of a raw sentence, or null."""
    plain = F.trim(F.regexp_replace(sentence, r"[^\p{L}\p{N}]+", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, NUMBER, "$1 "), LEAD, "@")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair]), plain)


def identifiers(text: Column) -> Column:
    """The known sentences of a text, in order, as their identifiers."""
    low = F.regexp_replace(F.lower(text), "spdx-license-identifier:", "spdx-license-identifier ")
    line = lambda s: F.filter(F.transform(F.split(s, r"\r?\n"), _look), lambda i: i.isNotNull())
    told = F.transform(F.filter(F.split(low, SPLIT), lambda s: s.rlike("|".join(ANCHORS))), lambda s: F.struct(s.alias("s"), _look(s).alias("i")))
    found = F.flatten(F.transform(told, lambda x: F.when(x["i"].isNotNull(), F.array(x["i"])).when(F.contains(x["s"], F.lit("\n")), line(x["s"])).otherwise(F.array().cast("array<string>"))))
    return F.when(F.lower(text).rlike("|".join(TEXT_ANCHORS)), found).otherwise(F.array().cast("array<string>"))


def rule_pattern(alternatives: tuple[tuple[str, ...], ...]) -> str:
    """A pattern over the sequence written as `;a;b;c;`."""
    one = lambda a: "".join("(?:[^;]+;){0,%d}" % GAP if i == "*" else re.escape(i).replace("\\-", "-") + ";" for i in a)
    return ";(?:" + "|".join(map(one, alternatives)) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses: both joined by `;`."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifiers(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("ids"))
    told = told.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws(";", "ids").alias("sentence_ids"))
    line = F.concat(F.lit(";"), F.col("sentence_ids"), F.lit(";"))
    rules, longer = dict(RULES), {less: name for name, less in WITHIN}
    test = {name: (F.regexp_replace(line, rule_pattern(_TEXTS[longer[name]]), ";") if name in longer else line).rlike(rule_pattern(a)) for name, a in rules.items()}
    some = F.concat_ws(";", *[F.when(t, F.lit(name)) for name, t in test.items()])
    return told.select("*", F.when(F.col("n_sentences") > 0, some).otherwise("").alias("licenses"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: s.replace("'", "''")
    keys, values = ", ".join(f"'{q(k)}'" for k in KNOWN), ", ".join(f"'{q(v)}'" for v in KNOWN.values())
    longer = {less: name for name, less in WITHIN}
    test = {name: f"regexp_matches({f"regexp_replace(line, '{q(rule_pattern(_TEXTS[longer[name]]))}', ';', 'g')" if name in longer else 'line'}, '{q(rule_pattern(a))}')" for name, a in RULES}
    licences = ", ".join(f"CASE WHEN {t} THEN '{name}' END" for name, t in test.items())
    plain = "trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    look = lambda s: f"regexp_replace(regexp_replace({plain.format(s)}, '{NUMBER}', '\\1 '), '{LEAD}', '@')"
    return f"""
WITH known AS (SELECT unnest([{keys}]) AS form, unnest([{values}]) AS id),
rows AS (SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(replace(lower(coalesce(text, '')), 'spdx-license-identifier:', 'spdx-license-identifier '), '{q(SPLIT)}') AS parts FROM documents),
sentences AS (SELECT rid, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM rows),
whole AS (SELECT rid, pos, 0 AS line, id, s FROM sentences LEFT JOIN known ON {look("s")} = form),
cut AS (SELECT rid, pos, regexp_split_to_array(s, '\r?\n') AS lines FROM whole WHERE id IS NULL AND contains(s, chr(10))),
single AS (SELECT rid, pos, unnest(lines) AS l, generate_subscripts(lines, 1) AS line FROM cut),
hits AS (
  SELECT rid, string_agg(id, ';' ORDER BY pos, line) AS sentence_ids, count(*) AS n
  FROM (SELECT rid, pos, line, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT rid, pos, line, id FROM single JOIN known ON {look("l")} = form) GROUP BY rid),
lines AS (
  SELECT d.doc_id, coalesce(h.n, 0) AS n_sentences, coalesce(h.sentence_ids, '') AS sentence_ids, ';' || coalesce(h.sentence_ids, '') || ';' AS line
  FROM rows d LEFT JOIN hits h USING (rid))
SELECT doc_id, n_sentences, sentence_ids, concat_ws(';', {licences}) AS licenses FROM lines"""
