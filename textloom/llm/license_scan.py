"""License scans by ordered signature rules, in DataFrame functions alone.

A text is lower-cased and its words (runs of digits, letters and all other than ASCII) are joined by single spaces, so that rules
read past punctuation and line ends. Rules are regular expressions over whole words: signatures of licenses' own texts (grants,
conditions, disclaimers, notices in source files), addresses, SPDX identifiers, and the ways of naming a license.

Each rule has two groups of keywords, whole words of which every match holds one: one of each text that its expression spells, and for
rules that name a license one of the name. They are drawn from the expressions themselves (``keywords_of``). The words of a text
are intersected with all keywords once, and a rule is tried only where the text has a word of both of its groups. Detections are intervals; one that lies within another of a rule with a smaller priority
number, or of the same priority and longer, is suppressed (of equal ones the first rule's stays). They are taken in order of their
start, so a fold over the furthest end of each priority tells this in one pass.

Base phrases are counted apart, in all places; their labels always stay.

Everything about a document stands in its row: there is no shuffle and no Python.

Defined cases: a null or empty text has no words, no labels ("") and score 0. Equal rows get equal results. Columns other than
doc_id and text are ignored. Other than ASCII is lower-cased too; no letter outside ASCII turns into one that a base phrase holds.
"""

from __future__ import annotations

import json
from functools import lru_cache
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

#: Base phrases and their labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: License families: label, regular expression of the name, short identifier.
FAMILIES = [
    ("mit", "(?:mit|expat)", "mit"),
    ("apache-2", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apache-1", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1(?: [01])?", "apache 1 1"),
    ("gpl-2", "(?:gnu (?:general public licen[sc]e|gpl)|gpl)(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu (?:general public licen[sc]e|gpl)|gpl)(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "(?:gnu general public licen[sc]e|gnu gpl|gpl)", "gpl"),
    ("lgpl-2.1", "(?:gnu (?:lesser|library) general public licen[sc]e|gnu lgpl|lgpl)(?: version| v)? ?2(?: [01])?", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3", "(?:gnu lesser general public licen[sc]e|gnu lgpl|lgpl)(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "(?:gnu affero general public licen[sc]e|gnu agpl|agpl)(?:(?: version| v)? ?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "(?:gnu free documentation licen[sc]e|gfdl)", "gfdl 1 [123]"),
    ("bsd-2", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd-4", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("bsd", "bsd", "0bsd"),
    ("isc", "(?:isc|internet systems consortium)", "isc"),
    ("mpl-2", "(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?1(?: 1)?", "mpl 1 1"),
    ("epl", "(?:eclipse public licen[sc]e|epl)(?:(?: version| v)? ?[12](?: 0)?)?", "epl [12] 0"),
    ("cddl", "(?:common development and distribution licen[sc]e|cddl)(?:(?: version| v)? ?1(?: [01])?)?", "cddl 1 [01]"),
    ("cpl", "common public licen[sc]e(?:(?: version| v)? ?1(?: 0)?)?", "cpl 1 0"),
    ("eupl", "(?:european union public licen[sc]e|eupl)(?:(?: version| v)? ?1(?: [012])?)?", "eupl 1 [012]"),
    ("artistic", "(?:perl )?artistic(?: licen[sc]e)?(?:(?: version| v)? ?[12](?: 0)?)?", "artistic [12] 0"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("boost", "boost(?: software)?", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:do what the fuck you want to public licen[sc]e|wtfpl)", "wtfpl"),
    ("python", "(?:python software foundation|psf|python)", "(?:psf|python) 2 0"),
    ("php", "php", "php 3 01?"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "(?:openssl|ssleay)", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ofl", "(?:sil )?open font(?: licen[sc]e)?(?:(?: version| v)? ?1 1)?", "ofl 1 1"),
    ("odbl", "(?:open database licen[sc]e|odbl)", "odbl 1 0"),
    ("pddl", "(?:public domain dedication and licen[sc]e|pddl)", "pddl 1 0"),
    ("cc0", "(?:cc0(?: 1 0)?|cc zero|creative commons zero)", "cc0 1 0"),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv\\S*)(?: [1-4] 0)?", "cc by nc nd [1-4] 0"),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] 0)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1-4] 0)?", "cc by nc [1-4] 0"),
    ("cc-by-nd", "(?:cc|creative commons) (?:by nd|attribution no ?deriv\\S*)(?: [1-4] 0)?", "cc by nd [1-4] 0"),
    ("cc-by-sa", "(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1-4] 0)?", "cc by sa [1-4] 0"),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)(?: [1-4] 0)?", "cc by [1-4] 0"),
    ("public-domain", "public domain", "public domain"),
    ("proprietary", "(?:proprietary|commercial)", "proprietary"),
]
#: Signatures of licenses' own texts: label, priority, weight, expression. Between fixed words names and numbers may vary.
ANY = "(?:[^ ]+ ){0,12}?"
TEXTS = [
    ("mit", 1, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 1, 1.0, "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", 2, 0.9, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 3, 0.8, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 1, 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction"),
    ("x11", 1, 0.9, "except as contained in this notice the name of " + ANY + "shall not be used in advertising or otherwise to promote the sale"),
    ("bsd", 2, 0.9, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 3, 0.8, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, 0.8, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", 1, 1.0, "neither the names? of " + ANY + "nor the names of (?:its|their|the|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3", 1, 0.9, "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4", 1, 1.0, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-patent", 1, 0.9, "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual"),
    ("bsd", 3, 0.7, "this software is provided by " + ANY + "as is and any express or implied warranties"),
    ("isc", 1, 1.0, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", 1, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", 3, 0.7, "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("hpnd", 2, 0.8, "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("zlib", 1, 0.9, "this software is provided as is without any express or implied warranty in no event will the authors? be held liable"),
    ("zlib", 1, 1.0, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", 1, 1.0, "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", 1, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.9, "dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", 1, 1.0, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", 1, 0.9, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("apache-2", 1, 1.0, "licensed under the apache license version 2 0 (?:the license )?you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2", 2, 0.9, "you may not use this (?:file|work|software) except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", 2, 0.9, "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", 1, 0.9, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 2, 0.9, "terms and conditions for use reproduction and distribution"),
    ("apache-1", 1, 0.9, "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-2", 1, 1.0, "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", 1, 1.0, "redistribute it and or modify it under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2)"),
    ("gpl-3", 1, 1.0, "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", 1, 1.0, "redistribute it and or modify it under the terms of (?:version 3 of the gnu general public license|the gnu general public license version 3)"),
    ("lgpl-2.1", 1, 1.0, "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version 2"),
    ("lgpl-3", 1, 1.0, "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", 1, 1.0, "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", 3, 0.7, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", 3, 0.7, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license"),
    ("agpl-3", 3, 0.7, "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license"),
    ("gpl", 2, 0.8, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gfdl", 1, 1.0, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-exception", 2, 0.6, "as a special exception " + ANY + "(?:permission to link|gives? (?:you )?(?:unlimited )?permission)"),
    ("mpl-2", 1, 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 2, 0.9, "this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", 1, 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", 1, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 1, 1.0, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", 1, 0.9, "the accompanying program is provided under the terms of this common public license agreement"),
    ("eupl", 1, 1.0, "licensed under the eupl version 1 [012] (?:or as soon they will be approved by the european commission )?"),
    ("artistic", 1, 0.9, "this is free software you can redistribute it and or modify it under the (?:same )?terms of the artistic license"),
    ("perl", 1, 0.9, "under the same terms as perl(?: 5)?(?: itself)?"),
    ("ms-pl", 1, 0.9, "(?:licensed under the )?microsoft (?:public|reciprocal) license"),
    ("python", 1, 0.9, "psf hereby grants licensee a nonexclusive royalty free world ?wide license to reproduce"),
    ("openssl", 1, 0.9, "this product includes software developed by the openssl project"),
    ("openssl", 1, 0.9, "this product includes cryptographic software written by eric young"),
    ("curl", 1, 0.9, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ofl", 1, 1.0, "this font software is licensed under the sil open font license"),
    ("ofl", 1, 0.9, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("cc0", 1, 1.0, "to the extent possible under law " + ANY + "waived all copyright and related (?:or|and) neighbou?ring rights"),
    ("cc", 2, 0.6, "this work is licensed under (?:a |the )?creative commons"),
    ("cc-by-sa", 1, 0.9, "(?:text|content) is available under the creative commons attribution share ?alike license"),
    ("odbl", 1, 1.0, "this " + ANY + "is made available under the open database license"),
    ("pddl", 1, 0.9, "made available under the public domain dedication and license"),
    ("jsr", 2, 0.6, "the software shall be used for good not evil"),
    ("commercial", 2, 0.7, "(?:confidential and proprietary|proprietary and confidential) " + ANY + "all rights reserved"),
    ("proprietary", 2, 0.7, "unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:or \\S+ )?of this (?:file|software|document|material) (?:via any medium )?is strictly prohibited"),
    ("proprietary", 3, 0.5, "may not be (?:copied|reproduced|redistributed)" + " (?:[^ ]+ ){0,12}?" + "without (?:the )?(?:express |prior )*written permission"),
    ("no-ai", 2, 0.5, "may not be used (?:for|to) (?:the )?(?:training|train) (?:of )?(?:any )?(?:ai|artificial intelligence|machine learning|language) models?"),
    ("all-rights-reserved", 5, 0.3, "all rights reserved"),
]
#: Addresses, as words: label, expression. Every one of them is of the form host, then path.
ADDRESSES = [
    ("apache-2", "apache org licenses license 2 0"), ("apache-1", "apache org licenses license 1 [01]"), ("gpl-2", "gnu org (?:copyleft|licenses(?: old licenses)?) gpl 2 0"), ("gpl-3", "gnu org (?:copyleft|licenses) gpl 3 0"), ("gpl", "gnu org (?:copyleft|licenses) gpl"),
    ("lgpl-2.1", "gnu org (?:copyleft|licenses(?: old licenses)?) lgpl 2 1"), ("lgpl-3", "gnu org (?:copyleft|licenses) lgpl 3 0"), ("agpl-3", "gnu org licenses agpl(?: 3 0)?"), ("gfdl", "gnu org licenses fdl(?: 1 [123])?"), ("mit", "opensource org licenses? mit(?: license)?"),
    ("bsd-2", "opensource org licenses? bsd 2 clause"), ("bsd-3", "opensource org licenses? bsd 3 clause"), ("apache-2", "opensource org licenses? apache 2 0"), ("isc", "opensource org licenses? isc"), ("artistic", "opensource org licenses? artistic(?: license)? 2 0"),
    ("mpl-2", "mozilla org (?:en us )?mpl 2 0"), ("mpl-1.1", "mozilla org mpl (?:mpl )?1 1"), ("epl", "eclipse org (?:legal|org documents) epl(?: v10| 2 0| v20)?"), ("boost", "boost org license 1 0"), ("unlicense", "unlicense org"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]"), ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]"), ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]"), ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by", "creativecommons org licenses by [1-4] [05]"), ("cc0", "creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org publicdomain mark 1 0"), ("ofl", "scripts sil org ofl"), ("odbl", "opendatacommons org licenses odbl"),
    ("pddl", "opendatacommons org licenses pddl"), ("eupl", "joinup ec europa eu (?:[^ ]+ )*?eupl"), ("wtfpl", "(?:wtfpl net|sam zoy org wtfpl)"), ("cddl", "(?:opensource org licenses? cddl1|oracle com (?:[^ ]+ )*?cddl)"), ("zlib", "zlib net zlib license"),
]
#: Ways of stating a license: priority, weight, expression with {name}, {tail} and {id}.
WAYS = [
    (1, 1.0, "spdx licen[sc]e identifier {id}"),
    (2, 0.95, "(?:dual |re)?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}{tail}"),
    (2, 0.95, "(?:released|distributed|published|made available) under (?:the )?(?:terms of (?:the )?)?{name}{tail}"),
    (2, 0.9, "permission is granted under (?:the )?{name}{tail}"),
    (3, 0.85, "(?:subject to|in accordance with|under)? ?(?:the )?terms (?:and conditions )?of (?:the )?{name}{tail}"),
    (3, 0.85, "under (?:the |a |an )?{name} licen[sc]e(?: agreement)?(?: version \\d+(?: \\d+)?)?"),
    (4, 0.8, "copy of (?:the )?{name} licen[sc]e"),
    (4, 0.75, "licen[sc]e (?:is |type )?(?:the )?{name}"),
    (5, 0.6, "{name} licen[sc]e(?: agreement)?(?: version \\d+(?: \\d+)?)?"),
]
TAIL = "(?: licen[sc]e)?(?: version \\d+(?: \\d+)?)?"
PRIORITIES = 6
SPAN = "array<struct<start:int,stop:int,priority:int,rule:int,label:string,weight:double>>"


#: Words that say little about a license; a keyword is taken from among others where there are others.
COMMON = set("a an and any as at be by file for free from general have in is it itself language later library may models new no of on only open or org products program public same shall software source term terms that the this to type under use version with work you your".split())


def spellings(pattern: str) -> list[str]:
    """Strings that an expression of this scan's kind matches: every branch, every optional part with and without, x for what may vary."""

    def of(items) -> list[str]:
        out = [""]
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    part = [chr(arg)]
                case "IN":
                    part = ["1"] if str(arg[0][0]) == "CATEGORY" else ["x"] if str(arg[0][0]) == "NEGATE" else [c for o, x in arg for c in ([chr(x)] if str(o) == "LITERAL" else map(chr, range(x[0], x[1] + 1)))]
                case "NOT_LITERAL":
                    part = ["x"]
                case "MAX_REPEAT" | "MIN_REPEAT":
                    part = [*([""] if arg[0] == 0 else []), *of(arg[2])]
                case "SUBPATTERN":
                    part = of(arg[3])
                case "BRANCH":
                    part = [x for branch in arg[1] for x in of(branch)]
                case _:
                    raise ValueError(f"{op} in a rule")
            out = [a + b for a in out for b in part]
        return out

    return of(_parser.parse(pattern))


def keywords_of(pattern: str) -> tuple[str, ...]:
    """A word of each spelling: the longest of those that aren't COMMON, else the longest."""
    out = set()
    for x in spellings(pattern):
        words = [w for w in x.split(" ") if w and w != "x"]
        out.add(max(words, key=lambda w: (w not in COMMON, len(w), w)))
    return tuple(sorted(out))


@lru_cache(1)
def rules() -> tuple[dict, ...]:
    """All rules in order; a rule's number is its place. Every match holds a word of k1 and, where it isn't empty, one of k2."""
    out: list[dict] = []

    def put(label: str, priority: int, weight: float, pattern: str, k1: tuple[str, ...], k2: tuple[str, ...] = ()) -> None:
        out.append({"rule": len(out), "label": label, "priority": priority, "weight": weight, "k1": k1, "k2": k2, "pattern": f"(?<= )(?:{pattern.rstrip()})(?= )"})

    for label, priority, weight, pattern in TEXTS:
        put(label, priority, weight, pattern, keywords_of(pattern.rstrip()))
    for label, pattern in ADDRESSES:
        put(label, 2, 0.9, pattern, keywords_of(pattern))
    for priority, weight, way in WAYS:
        frame = way.replace("{tail}", "")
        for label, name, short in FAMILIES:
            # What follows a name may run on in its last word only where the name ends in an optional blank, which none does.
            own = short if "{id}" in way else name
            put(label, priority, weight, way.replace("{name}", name).replace("{tail}", TAIL).replace("{id}", short), keywords_of(frame.replace("{name}", " x ").replace("{id}", " x ")), keywords_of(own))
    return tuple(out)


def normalised(text: Column) -> Column:
    """A space, the words with a space after each."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def groups(table: tuple[dict, ...]) -> list[tuple[str, ...]]:
    return sorted({g for r in table for g in (r["k1"], r["k2"]) if g})


def keywords(table: tuple[dict, ...]) -> list[str]:
    return sorted({w for g in groups(table) for w in g})


def detections(norm: Column, hits: Column, table: tuple[dict, ...]) -> Column:
    """All detections of the rules of which norm has the keywords, as character intervals of norm, in order of rule. hits: its keywords."""
    own, words = groups(table), keywords(table)
    parts = range(-(-len(own) // 62))  # groups are bits of so many numbers
    bit = lambda g, i: 1 << own.index(g) % 62 if g and own.index(g) // 62 == i else 0
    masks = "".join(f",m{i}:long" for i in parts)
    rows = [{k: r[k] for k in ("rule", "label", "priority", "weight", "pattern")} | {f"m{i}": bit(r["k1"], i) | bit(r["k2"], i) for i in parts} for r in table]
    held = F.from_json(F.lit(json.dumps(rows)), f"array<struct<rule:int,label:string,priority:int,weight:double,pattern:string{masks}>>")
    of_word = [F.lit([sum(bit(g, i) for g in own if w in g) for w in words]) for i in parts]
    none = F.struct(*(F.lit(0).cast("long").alias(f"b{i}") for i in parts))

    def gathered(acc: Column, w: Column) -> Column:
        place = (F.call_function("array_position", F.lit(words), w) - 1).cast("int")
        return F.struct(*(acc[f"b{i}"].bitwiseOR(F.get(of_word[i], place)).alias(f"b{i}") for i in parts))

    def open_(acc: Column, r: Column) -> Column:
        out = F.lit(True)
        for i in parts:
            out &= acc[f"b{i}"].bitwiseAND(r[f"m{i}"]) == r[f"m{i}"]
        return out

    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))

    def spans(r: Column) -> Column:
        found = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
        between = F.split(norm, r["pattern"], F.lit(-1))

        def span(x: Column, i: Column) -> Column:
            start = total(F.slice(between, 1, i + 1)) + total(F.slice(found, 1, i))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("stop"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight"))

        return F.when(F.size(found) > 0, F.transform(found, span)).otherwise(F.array().cast(SPAN))

    # The bits are bound as a variable of a function, else the optimizer would put what makes them in the place of each use.
    bound = F.array(F.aggregate(hits, none, gathered))
    found = F.flatten(F.flatten(F.transform(bound, lambda acc: F.transform(F.filter(held, lambda r: open_(acc, r)), spans))))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPAN))


def unsuppressed(found: Column) -> Column:
    """What is left of detections: in order of start, long ones first, then priority and rule, whatever could hold one comes before it."""
    key = F.transform(found, lambda x: F.struct(x["start"].alias("a"), (-x["stop"]).alias("b"), x["priority"].alias("p"), x["rule"].alias("r"), x["label"].alias("label"), x["weight"].alias("weight")))
    state = f"struct<ends:array<int>,kept:{SPAN}>"
    first = F.struct(F.array_repeat(F.lit(-1), PRIORITIES + 1).alias("ends"), F.array().cast(SPAN).alias("kept")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        stop, p = -x["b"], x["p"]
        lost = F.array_max(F.slice(acc["ends"], 1, p + 1)) >= stop  # something of this priority or a better one reaches as far
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == p, F.greatest(e, stop)).otherwise(e))
        one = F.array(F.struct(x["a"].alias("start"), stop.alias("stop"), p.alias("priority"), x["r"].alias("rule"), x["label"].alias("label"), x["weight"].alias("weight"))).cast(SPAN)
        return F.when(lost, acc).otherwise(F.struct(ends.alias("ends"), F.concat(acc["kept"], one).alias("kept")).cast(state))

    return F.aggregate(F.array_sort(key), first, step)["kept"]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, places and labels of the base phrases, and the rules' labels, spans and score."""
    none = F.lit(None).cast("long")
    df = common.as_docs(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    norm = F.col("norm")
    df = df.withColumn("n_words", F.greatest(spaces(norm) - 1, F.lit(0)).cast("long"))
    table = rules()
    df = df.withColumn("hits", F.array_intersect(F.split(norm, " "), F.lit(keywords(table))))
    df = df.withColumn("found", detections(norm, F.col("hits"), table))
    df = df.withColumn("kept", F.when(F.size("found") > 1, unsuppressed(F.col("found"))).otherwise(F.col("found")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        has = F.contains(norm, F.lit(f" {phrase} "))
        counts.append(F.when(has, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(has, spaces(F.substring_index(norm, f" {phrase} ", 1)).cast("long")).otherwise(none))
        after = spaces(F.substring_index(norm, f" {phrase} ", -1))
        lasts.append(F.when(has, (F.col("n_words") - after - len(phrase.split())).cast("long")).otherwise(none))
        labels.append(F.when(has, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n_base = sum(counts[1:], counts[0])
    score = F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("kept", lambda x: x["weight"])), F.lit(0.0)))
    return df.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, F.transform("kept", lambda x: x["label"]))).alias("labels"),
        score.alias("score"),
        F.size("found").cast("long").alias("n_found"),
        F.array_join(F.transform(F.array_sort("kept"), lambda x: F.format_string("%d-%d:%s", x["start"], x["stop"], x["label"])), ",").alias("spans"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
