"""Licence scans by sentence rules, with DataFrame functions only.

Texts are normalised (lower case, runs of other signs than a-z and 0-9 become one
space), but keep where sentences can begin and end: at closing marks before white
space, empty lines, line ends, colons and parentheses.  Comment marks and numbers
of list items at line starts go.  A known licence sentence between two such places
stands for its identifier, even where it is wrapped over lines; any other text ends
a run.  Runs of identifiers are then matched, in order, against the licence rules; a
rule names sentences that follow each other.  A GNU licence without a version is
named without one; BSD notices are told apart by their clauses.  Licences joined by
AND or OR (in SPDX expressions, or as "the X license and the Y license") are each
named; an exception after WITH does not change the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BREAK = r"[.!?;]+(?:[ \t\r\n]+|$)|[\r\n]+"
NOT_PLAIN = "[^a-z0-9]+"

# One-line forms and their identifiers (one letter each); the DuckDB twin knows these alone.
SENTENCES = {
    "licensed under the apache license version 2 0": "A",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "B",
    "released under the mit license": "M",
    "permission is hereby granted free of charge to any person obtaining a copy": "N",
    "the software is provided as is without warranty of any kind express or implied": "W",
    "this work is licensed under the gnu general public license version 3": "G",
    "this program is free software": "F",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "R",
    "licensed under cc by nc 4 0": "C",
    "licensed under cc by 4 0": "Y",
    "redistribution and use in source and binary forms with or without modification are permitted": "D",
    "all rights reserved": "L",
}
# Ordered rules over these; the first that matches at a place takes its sentences. Optional sentences stand in brackets with a question mark.
RULES = (
    ("Apache-2.0", "AB?"),
    ("MIT", "M(?:NW?)?|NW?"),
    ("GPL-3.0", "G"),
    ("GPL", "FR|R"),
    ("CC-BY-NC-4.0", "C"),
    ("CC-BY-4.0", "Y"),
    ("BSD", "DW?"),
    ("Proprietary", "L"),
)

# Canonical wording, as patterns over normalised words; a space also stands for a line end, a mark or a bracket.
_NAME = r"(?:[a-z0-9]+ ){1,12}?"
_THING = r"(?:this|the|our) (?:work|program|software|project|package|library|file|code|source code|document|module|repository|tool|dataset|data|article|book) is "
_LATER = r"(?: only| or later| or newer| or any later version| or at your option any later version)?"
_FSF = r"you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation (?:either )?version {1}(?: of the license)?" + _LATER
_WORDS = {
    "A": r"licensed under the apache license version 2 0 the license",
    "K": r"you may not use this file except in compliance with the license",
    "J": r"you may obtain a copy of the license at(?: https? (?:www )?(?:apache org licenses license 2 0|mozilla org mpl(?: mpl 1 1)?)(?: html| txt)?)?",
    "B": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "E": r"see the license for the specific language governing permissions and limitations under the license",
    "N": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "O": r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software",
    "W": r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement",
    "Q": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "d": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "p": r"redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "q": r"redistributions? in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "r": rf"all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: this product includes software developed by {_NAME}and its contributors)?",
    "s": rf"neither the names? of (?:{_NAME})?(?:nor the names of (?:its|their|the|any) contributors )?may be used to endorse or promote products derived from this software without specific prior written permission",
    "t": rf"this software is provided by {_NAME}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "u": rf"in no event shall {_NAME}be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "F": r"this (?:program|library|software|file|package) is free software",
    "H": r"this (?:program|library|software|file|package) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "V": r"see the gnu (?:lesser |library |affero )?general public license for more details",
    "X": r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|software|file|package)(?: if not see https? (?:www )?gnu org licenses)?",
    "v": r"if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0",
    "w": r"to view a copy of this license visit https? (?:www )?creativecommons org (?:licenses|publicdomain) [a-z]+(?: [a-z]+){0,2} [1-4] [05](?: deed [a-z]+| legalcode)?(?: or send a letter to creative commons (?:[a-z0-9]+ ){1,16}?usa)?",
}
# Canonical wording of further licences, by the family they name.
_MORE = {
    "ISC": ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD": (r"(?:0bsd|bsd (?:0|zero) clause|(?:0|zero) clause bsd)", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    "Zlib": ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    "Unlicense": ("unlicense", r"this is free and unencumbered software released into the public domain"),
    "BSL-1.0": (r"(?:boost software licen[sc]e|boost|bsl) ?(?:version |v ?)?1 0", r"boost software license version 1 0(?: august 17th 2003)?"),
    "EPL-2.0": (r"(?:eclipse public licen[sc]e|epl) ?(?:version |v ?)?2 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?2 0(?: which (?:is available|accompanies).{0,120}?)?"),
    "EPL-1.0": (r"(?:eclipse public licen[sc]e|epl) ?(?:version |v ?)?1 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?1 0(?: which (?:is available|accompanies).{0,120}?)?"),
}
_CLAUSES = {
    "BSD-2-Clause": r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|(?:simplified |free)bsd)(?: simplified)?",
    "BSD-3-Clause": r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: new| revised| modified)?",
    "BSD-4-Clause": r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: original)?",
}
_CC = {"BY": "attribution", "BY-SA": "attribution share ?alike", "BY-ND": "attribution no ?deriv(?:ative)?s", "BY-NC": "attribution non ?commercial",
       "BY-NC-SA": "attribution non ?commercial share ?alike", "BY-NC-ND": "attribution non ?commercial no ?deriv(?:ative)?s"}
_WITH = r"(?: with (?:[a-z0-9]+ ){1,6}?exception(?: [0-9]){0,3})?"
_V = r"(?:version |v(?: |\W)?)?"


def _gnu(kind: str, short: str, version: str) -> str:
    return rf"(?:gnu )?(?:{kind}general public licen[sc]e(?: {short})?|{short}) ?{_V}{version}(?: {short} ?{_V}{version})?{_LATER}"


def _families() -> dict[str, tuple[str, list[str]]]:
    """Rule: (pattern of the licence's name, further sentences that name it)."""
    out = {
        "Apache-2.0": (rf"apache(?: software)?(?: licen[sc]e)? {_V}2(?: 0)?", ["apache license version 2 0 january 2004"]),
        "Apache-1.1": (rf"apache(?: software)?(?: licen[sc]e)? {_V}1 1", []),
        "MIT": (r"(?:mit|expat|x11)(?: x11| expat)?(?: licen[sc]e)?(?: mit| expat)?", [r"(?:the )?(?:mit|expat|x11) licen[sc]e(?: mit)?"]),
    }
    gnu = {"GPL": ("", "", (("3.0", "29 june 2007"), ("2.0", "june 1991"), ("1.0", "february 1989"))), "AGPL": ("affero ", "affero ", (("3.0", "19 november 2007"),)),
           "LGPL": ("(?:lesser|library) ", "(?:lesser |library )", (("3.0", "29 june 2007"), ("2.1", "february 1999"), ("2.0", "june 1991")))}
    for short, (kind, notice, versions) in gnu.items():
        for v, date in versions:
            number = v.replace(".", " ") if v == "2.1" else f"{v[0]}(?: 0)?"
            out[f"{short}-{v}"] = (_gnu(kind, short.lower(), number), [_FSF.format(notice, number), rf"gnu {notice}general public license version {number} {date}"])
        out[short] = (rf"(?:gnu )?(?:{kind}general public licen[sc]e(?: {short.lower()})?|{short.lower()}){_LATER}",
                      [rf"you can redistribute it and or modify it under the terms of the gnu {notice.strip()} ?general public license as published by the free software foundation"])
    out["MPL-2.0"] = (rf"(?:mozilla public licen[sc]e(?: mpl)?|mpl) ?{_V}2(?: 0)?", [r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", r"mozilla public license v(?:ersion)? 2 0"])
    out["MPL-1.1"] = (rf"(?:mozilla public licen[sc]e(?: mpl)?|mpl) ?{_V}1 1", [r"the contents of this file are subject to the mozilla public license version 1 1 the license", r"mozilla public license v(?:ersion)? 1 1"])
    for kind, words in _CC.items():
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            code = f"cc {kind.replace('-', ' ').lower()} {v.replace('.', ' ')}"
            name = rf"(?:creative commons )?{words} {v.replace('.', ' ')}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?(?: {code})?"
            out[f"CC-{kind}-{v}"] = (f"(?:{code}|{name})", [rf"creative commons {words} {v.replace('.', ' ')}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"])
    out["CC0-1.0"] = (r"cc0(?: 1 0)?(?: universal)?", [r"(?:creative commons )?cc0 1 0 universal"])
    for rule, name in _CLAUSES.items():
        out[rule] = (name, [rf"(?:the )?{name} licen[sc]e"])
    out["BSD"] = (r"bsd(?: style)?", [r"(?:the )?bsd licen[sc]e"])
    out |= {rule: (name, [wording]) for rule, (name, wording) in _MORE.items()}
    return out


def _spread(pattern: str, gap: str) -> str:
    """The pattern with every space standing for one or more of ``gap``."""
    return pattern.replace(" ?", f"{gap}*").replace(" ", f"{gap}+")


def _known() -> tuple[list[tuple[str, str]], tuple[tuple[str, str], ...]]:
    """Patterns with their identifiers, longer wording first, and the rules over all identifiers.

    Sentences that name a family have letters from U+0100 on.
    """
    whole, lines, named = [(p, i) for i, p in _WORDS.items()], [], {}
    for at, (rule, (name, more)) in enumerate(_families().items()):
        named[rule] = letter = chr(0x100 + at)
        whole += [(p, letter) for p in more]
        lines.append((rf"(?:{_THING}|it is )?(?:dual )?(?:licensed|released|distributed|available|published|provided|made available) under (?:the terms of )?(?:the |an? )?{name}(?: licen[sc]e)?(?: the licen[sc]e)?", letter))
        lines.append((rf"(?:spdx )?licen[sc]e(?: identifier)? (?:the )?{name}(?: licen[sc]e)?{_WITH}", letter))
    first = {
        "Apache-2.0": "[A{}]K?J?B?E?", "MIT": "(?:M|{})(?:NO?W?Q?)?|NO?W?Q?", "GPL-3.0": "G|F?{}(?:HV?X?)?", "GPL": "F?[R{}](?:HV?X?)?", "CC-BY-NC-4.0": "[C{}]w?", "CC-BY-4.0": "[Y{}]w?",
        "BSD-4-Clause": "dp?q?rs?t?u?|{}", "BSD-3-Clause": "dpqst?u?|{}", "BSD-2-Clause": "dpq(?![rs])t?u?|{}", "BSD": "d(?!p?q?r)(?!pq)p?q?s?t?u?|DW?|{}",
    }
    rules = [(n, first[n].replace("{}", named[n])) for n in first]
    for n, i in named.items():
        if n not in first:
            rules.append((n, f"F?{i}(?:HV?X?)?" if "GPL" in n else f"{i}v?" if n == "MPL-2.0" else f"{i}w?" if n.startswith("CC") else f"{i}K?J?B?E?"))
    return [(_spread(p, gap), i) for part, gap in ((whole, r"\W"), (lines, r"[\s:]"), (SENTENCES.items(), r"[\s:]")) for p, i in part], (*rules, ("Proprietary", "L(?!d)"))


KNOWN, ALL_RULES = _known()
#: Cheap test that every text with a known sentence passes.
HINT = r"(?i)licen|permission|software|redistribut|rights|mpl|gpl|gnu|apache|mozilla|bsd|zlib|unlicen|boost|\bbsl\b|\bepl\b|\bisc\b|creative|attribution|x11|expat|\bcc\W*(?:by|0)|under\W+(?:(?:the|an?|terms|of)\W+){0,5}mit\b"
#: Where sentences can begin and end: . stands for closing marks and empty lines, \\n for line ends, : for colons and parentheses.
LEAD = r"(?m)^[^a-z0-9\r\n]*(?:(?:dnl|rem|[0-9]{1,2}[.)]|[a-z][.)])[ \t]+)?"
PLACES = (
    (LEAD, ""), (r"[.!?;]+(?:[ \t\r\n]+|$)|(?:\r\n|\r(?!\n)|\n)[\r\n]+", "\u0001"), (r"\r\n?|\n", "\u0002"), ("[:()]", "\u0003"),
    ("[^a-z0-9\u0001-\u0003]+", " "), (" ?([\u0001-\u0003]) ?", "$1"),
)
#: An operator of an SPDX expression, and the words between two licences named in one sentence.
EXPRESSION = r"(?i)(SPDX-License-Identifier:|\G(?!\A))([^\r\n]*?)[ \t]+(?:AND|OR)[ \t]+"
BOTH = r"(licensed[ \u0002]under[ \u0002](?:[a-z0-9]+[ \u0002]){1,7}?(?:licen[sc]e|[0-9]))[ \u0002](?:and|or)[ \u0002](?:(?:the[ \u0002])?(?:[a-z]+[ \u0002]){1,3}?under[ \u0002]|(?=(?:the|an?)[ \u0002]))"
ANY = "(?<![a-z0-9 ])(?:" + "|".join(p for p, _ in KNOWN) + ")(?![a-z0-9 ])"


def sequence(text: Column) -> Column:
    """Identifiers of the text's known sentences in order, with ``-`` where other words stand between them."""
    plain = F.lower(F.regexp_replace(F.translate(text, "\u0001\u0002\u0003", "   "), EXPRESSION, "$1$2\n\nLicense: "))
    for pattern, mark in PLACES:
        plain = F.regexp_replace(plain, pattern, mark)
    plain = F.regexp_replace(plain, BOTH, "$1\u0001licensed under ")
    # Every second part is a known sentence: one-line forms by value, others by their pattern.
    parts = F.split(F.regexp_replace(F.translate(F.trim(plain), "\u0001\u0002\u0003", ".\n:"), ANY, "|$0|"), "[|]", -1)
    forms = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    by_letter: dict[str, list[str]] = {}
    for p, i in KNOWN:
        by_letter.setdefault(i, []).append(p)

    def identifier(part: Column, at: Column) -> Column:
        wording = F.coalesce(*(F.when(part.rlike(f"^(?:{'|'.join(ps)})$"), F.lit(i)) for i, ps in by_letter.items()))
        known = F.coalesce(F.element_at(forms, F.regexp_replace(part, r"[\s:]+", " ")), wording)
        return F.when(at % 2 == 1, known).when(part.rlike("[a-z0-9]"), "-").otherwise("")

    return F.array_join(F.transform(parts, identifier), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences long, sentence_ids, licences) of every row.

    ``sentence_ids`` has the identifiers of the known sentences in order,
    ``licences`` the names of the rules that match anywhere, in rule order,
    comma-joined; ``n_sentences`` counts the known sentences.  Null and empty texts,
    and texts without known sentences, give 0 and empty strings.  Rows stay as they
    are, repeated ones too; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`"), F.when(text.rlike(HINT), sequence(text)).otherwise(F.lit("")).alias("_run"))
    # No two rules begin with the same sentence, so each can be looked for alone.
    names = [F.when(F.col("_run").rlike(rule), F.lit(name)) for name, rule in ALL_RULES]
    ids = F.regexp_replace("_run", "-", "")
    return rows.select(id_col, F.length(ids).cast("long").alias("n_sentences"), ids.alias("sentence_ids"), F.concat_ws(",", *names).alias("licences"))


def oracle() -> str:
    """The same over ``documents`` in DuckDB, for the one-line forms on lines of their own."""
    quote = lambda s: "'" + s + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in SENTENCES.items()) + "}"
    rest, names = "run", []
    for name, rule in RULES:
        names.append(f"CASE WHEN regexp_matches({rest}, {quote(rule)}) THEN {quote(name)} END")
        rest = f"regexp_replace({rest}, {quote(rule)}, '-', 'g')"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), {quote(BREAK.replace(chr(92) + 't', chr(9)).replace(chr(92) + 'r', chr(13)).replace(chr(92) + 'n', chr(10)))}),
    lambda s: trim(regexp_replace(lower(s), '{NOT_PLAIN}', ' ', 'g'))), lambda s: s <> '') AS plain FROM documents
), runs AS (
  SELECT doc_id, coalesce(array_to_string(list_transform(plain, lambda s: coalesce({known}[s], '-')), ''), '') AS run FROM cut
)
SELECT doc_id, CAST(length(replace(run, '-', '')) AS BIGINT) AS n_sentences, replace(run, '-', '') AS sentence_ids,
  concat_ws(',', {', '.join(names)}) AS licences
FROM runs"""
