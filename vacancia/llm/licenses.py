"""Licence recognition by sentences, in DataFrame expressions only.

A text is normalised (lower case, other than letters and digits to one space) with marks where a sentence ends (after
. ! ? before white space, and at lines without a letter or digit), where a line does, and where a sentence may end (at a
semicolon, a bracket, a dash between blanks). A known sentence stands between two marks of any kind and may run over those
of the latter two kinds, so a notice on a line of its own, one with a remark behind it, and a wrapped text with or without
comment signs are all found. Known sentences become identifiers; a notice that names several licences becomes one for each,
in their order. Rules are ordered sequences of identifiers; a rule
matches where its identifiers follow each other among the known sentences of the text, and what a rule has taken isn't
matched again by a later one. Everything happens within the row: no shuffle, so no group can be hot.

The SQL is narrower: it cuts at every line break and knows each sentence in the one wording of SENTENCES, so it says the
same where a text holds only such sentences, each within a line, and misses wrapped licences.

Nulls count as empty texts; very long texts are read whole; repeated rows and null doc_ids are reported like others. An empty table gives no rows.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    "A": "released under the mit license",
    "B": "licensed under the apache license version 2 0",
    "C": "this work is licensed under the gnu general public license version 3",
    "D": "licensed under cc by nc 4 0",
    "E": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "F": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "G": "you may not use this file except in compliance with the license",
    "H": "you may obtain a copy of the license at",
    "I": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "J": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "K": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "L": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "M": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "N": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "O": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "P": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "Q": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "R": "this source code form is subject to the terms of the mozilla public license v",
    "S": "this is free and unencumbered software released into the public domain",
    "T": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "U": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "V": "this work is licensed under a creative commons attribution 4 0 international license",
    "W": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "X": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "Y": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "Z": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "a": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "b": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "c": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "d": "licensed under the bsd 3 clause license",
    "e": "licensed under the bsd 2 clause license",
    "f": "licensed under the isc license",
    "g": "licensed under the gplv3",
    "h": "licensed under the gplv2",
    "i": "licensed under the lgplv3",
    "j": "licensed under the agplv3",
    "k": "licensed under the mozilla public license version 2 0",
    "l": "released under the unlicense",
    "m": "licensed under the boost software license version 1 0",
    "n": "licensed under the zlib license",
    "o": "licensed under the eclipse public license 2 0",
    "p": "licensed under cc by 4 0",
    "q": "licensed under cc by sa 4 0",
    "r": "released under cc0 1 0",
    "s": "licensed under the gplv3 or later",
    "t": "licensed under the gplv2 or later",
    "u": "licensed under the lgplv2 1 or later",
    "v": "licensed under the lgplv2 1",
    "w": "licensed under the lgplv3 or later",
    "x": "licensed under the agplv3 or later",
    "y": "licensed under cc by sa 3 0",
    "z": "licensed under the eupl 1 2",
    "0": "licensed under cc by nc sa 4 0",
    "1": "licensed under cc by 3 0",
    "2": "licensed under the artistic license 2 0",
    "3": "gnu general public license version 3 29 june 2007",
    "4": "gnu general public license version 2 june 1991",
    "5": "use of this source code is governed by a bsd style license that can be found in the license file",
    "6": "use of this source code is governed by an mit style license that can be found in the license file",
    "7": "gnu lesser general public license version 2 1 february 1999",
    "8": "gnu affero general public license version 3 19 november 2007",
    "9": "apache license version 2 0 january 2004",
}
#: Further wordings, as the licences have them; "*" stands for the words of a name (at most NAME_WORDS).
WORDINGS = {
    "B": ("licensed under the apache license version 2 0 the license", "the asf licenses this file to you under the apache license version 2 0 the license"),
    "E": (SENTENCES["E"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "F": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "H": ("you may obtain a copy of the license at https? www apache org licenses license 2 0",),
    "K": ("neither the names? of * nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "M": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "N": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "O": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "P": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "Q": ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "5": ("use of this source code is governed by a bsd style license that can be found in the license file in the root of the source tree", "use of this source code is governed by a bsd license that can be found in the license file"),
    "6": ("use of this source code is governed by an mit style license that can be found in the license file or at https opensource org licenses mit",),
    "9": ("apache license version 2 0 january 2004 http www apache org licenses",),
    "y": ("this work is licensed under a creative commons attribution sharealike 3 0 unported license",),
    "1": ("this work is licensed under a creative commons attribution 3 0 unported license",),
}
NAME_WORDS = 20
#: How one-line notices name a licence, by identifier; what goes on with "or later" first.
NAMES = {
    "s": "gplv3 or later|gpl v3 or later|gpl 3 0 or later|gnu gplv3 or later|gnu general public license(?: version 3| v3)(?: 0)? or later",
    "t": "gplv2 or later|gpl v2 or later|gpl 2 0 or later|gnu gplv2 or later|gnu general public license(?: version 2| v2)(?: 0)? or later",
    "u": "lgplv2 1 or later|lgpl v2 1 or later|lgpl 2 1 or later|gnu lesser general public license(?: version 2 1| v2 1) or later",
    "w": "lgplv3 or later|lgpl v3 or later|lgpl 3 0 or later|gnu lesser general public license(?: version 3| v3)(?: 0)? or later",
    "x": "agplv3 or later|agpl v3 or later|agpl 3 0 or later|gnu affero general public license(?: version 3| v3)(?: 0)? or later",
    "A": "mit",
    "B": "apache(?: software)?(?: license)?(?: version| v)? 2 0",
    "C": "gnu general public license version 3",
    "D": "cc by nc 4 0",
    "d": "(?:new |modified )?bsd 3 clause|3 clause bsd|new bsd",
    "e": "(?:simplified )?bsd 2 clause|2 clause bsd|simplified bsd",
    "f": "isc",
    "g": "gplv3|gpl v3|gpl 3 0(?: only)?|gnu gplv3|gnu gpl v3|gnu general public license v3(?: 0)?",
    "h": "gplv2|gpl v2|gpl 2 0(?: only)?|gnu gplv2|gnu gpl v2|gnu general public license(?: version 2| v2)(?: 0)?",
    "i": "lgplv3|lgpl v3|lgpl 3 0(?: only)?|gnu lesser general public license(?: version 3| v3)(?: 0)?",
    "v": "lgplv2 1|lgpl v2 1|lgpl 2 1(?: only)?|gnu lesser general public license(?: version 2 1| v2 1)",
    "j": "agplv3|agpl v3|agpl 3 0(?: only)?|gnu affero general public license(?: version 3| v3)(?: 0)?",
    "k": "mpl 2 0|mozilla public license(?: version)? 2 0",
    "l": "unlicense",
    "m": "bsl 1 0|boost software license(?: version)? 1 0",
    "n": "zlib",
    "o": "epl 2 0|eclipse public license(?: version| v)? 2 0",
    "0": "cc by nc sa 4 0",
    "q": "cc by sa 4 0",
    "y": "cc by sa 3 0",
    "p": "cc by 4 0",
    "1": "cc by 3 0",
    "r": "cc0 1 0|cc0",
    "z": "eupl(?: v| version)? ?1 2|european union public licen[sc]e(?: version| v)? 1 2",
    "2": "artistic(?: license)? 2 0",
}
#: Notices on a line or in a sentence of their own; every wording of them with every name is one sentence.
_SUBJECT = "(?:(?:(?:this|the) (?:project|software|code|library|program|package|work|file|repository|module|crate)|it) is )?(?:dual )?"
_VERB = "(?:released|licensed|distributed|published|provided|made available|available|licensing) under "
NOTICES = (
    _SUBJECT + _VERB + "(?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?",
    "(?:the )?licen[sc]e (?:is )?(?:the )?(?:{name})(?: licen[sc]e)?",
    "spdx license identifier (?:{name})",
)
#: The same with several names.
SEVERAL = (
    _SUBJECT + _VERB + "(?:either of |either |both )?(?:the )?(?:terms of (?:both )?(?:the )?)?(?:{name})(?: licen[sc]e)?(?: (?:or|and) (?:the )?(?:{name})(?: licen[sc]e)?)+(?: at your option)?",
    "spdx license identifier (?:{name})(?: (?:or|and) (?:{name}))+",
)
#: Identifier sequences and licences, in the order in which they are tried.
RULES = (
    ("BGH", "Apache-2.0"), ("IJK", "BSD-3-Clause"), ("IJ", "BSD-2-Clause"), ("EF", "MIT"),
    ("A", "MIT"), ("B", "Apache-2.0"), ("C", "GPL-3.0-only"), ("D", "CC-BY-NC-4.0"), ("L", "ISC"),
    ("M", "GPL-3.0-or-later"), ("N", "GPL-2.0-or-later"), ("O", "LGPL-3.0-or-later"), ("P", "LGPL-2.1-or-later"), ("Q", "AGPL-3.0-or-later"),
    ("R", "MPL-2.0"), ("S", "Unlicense"), ("T", "BSL-1.0"), ("U", "Zlib"),
    ("V", "CC-BY-4.0"), ("W", "CC-BY-SA-4.0"), ("X", "CC-BY-NC-4.0"), ("Y", "CC-BY-NC-SA-4.0"), ("Z", "CC-BY-ND-4.0"), ("a", "CC0-1.0"), ("b", "WTFPL"), ("c", "EPL-2.0"),
    ("d", "BSD-3-Clause"), ("e", "BSD-2-Clause"), ("f", "ISC"), ("g", "GPL-3.0-only"), ("h", "GPL-2.0-only"), ("i", "LGPL-3.0-only"), ("j", "AGPL-3.0-only"),
    ("s", "GPL-3.0-or-later"), ("t", "GPL-2.0-or-later"), ("u", "LGPL-2.1-or-later"), ("v", "LGPL-2.1-only"), ("w", "LGPL-3.0-or-later"), ("x", "AGPL-3.0-or-later"),
    ("y", "CC-BY-SA-3.0"), ("z", "EUPL-1.2"), ("0", "CC-BY-NC-SA-4.0"), ("1", "CC-BY-3.0"), ("2", "Artistic-2.0"),
    ("3", "GPL-3.0-only"), ("4", "GPL-2.0-only"), ("5", "BSD-3-Clause"), ("6", "MIT"), ("7", "LGPL-2.1-only"), ("8", "AGPL-3.0-only"), ("9", "Apache-2.0"),
    ("k", "MPL-2.0"), ("l", "Unlicense"), ("m", "BSL-1.0"), ("n", "Zlib"), ("o", "EPL-2.0"), ("p", "CC-BY-4.0"), ("q", "CC-BY-SA-4.0"), ("r", "CC0-1.0"),
)
BREAK = r"\n+|[.!?;][ \t]+"
#: Marks in the normalised text, where letters are lower case: P where a sentence ends, S where it may, L where a line does.
ENDS, MAY_END = r"[.!?]\s+|\n[^\p{L}\p{N}]*\n", r";|[()\[\]]|[ \t]\p{Pd}+[ \t]"
#: Every known sentence holds one of these words or phrases.
CUES = (
    r"(?i)licen[sc]e|copyright|permission|permitted to|public domain|"
    r"\bunder\s+((the|terms|of)\s+)*(mit\b|apache|isc\b|zlib|[23]-clause|bsd|gnu|[al]?gpl|mozilla|mpl|boost|bsl|eclipse|epl|cc[ -]?by|cc0|unlicense)"
)


def _pattern(wording: str) -> str:
    name = f"(?:[a-z0-9PLS]+ ){{1,{NAME_WORDS}}}?"
    return wording.replace(" ", " (?:[LS] )*").replace("* (?:[LS] )*", name)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sequence (identifiers of the known sentences, in order), licenses (distinct, in the order of the rules)."""
    any_name = "|".join(NAMES.values())
    known = {k: sorted((v, *WORDINGS.get(k, ())), key=len, reverse=True) for k, v in SENTENCES.items()}  # the longest first
    sought = [*(_pattern(v) for k in known for v in known[k]), *(_pattern(n.format(name=any_name)) for n in (*NOTICES, *SEVERAL))]
    for k, name in NAMES.items():
        known[k] += [n.format(name=name) for n in NOTICES]
    known = {k: "|".join(map(_pattern, v)) for k, v in known.items()}
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), ENDS, " P "), MAY_END, " S "), r"\n", " L ")
    marked = F.concat(F.lit("P "), F.regexp_replace(marked, "[^a-z0-9PLS]+", " "), F.lit(" P"))
    marked = F.when(F.col("text").rlike(CUES), F.regexp_replace(marked, " +", " "))
    hits = F.regexp_extract_all(marked, F.lit(f"(?<=[PLS] )(?:{'|'.join(sought)})(?= [PLS])"), F.lit(0))
    names = {k: _pattern(n) for k, n in NAMES.items()}
    one = lambda s, patterns: F.coalesce(*[F.when(s.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in patterns.items()])
    named = F.lit(f"(?<![a-z0-9])(?:{'|'.join(names.values())})(?![a-z0-9])")
    identifiers = lambda s: F.coalesce(one(s, known), F.array_join(F.transform(F.regexp_extract_all(s, named, F.lit(0)), lambda n: one(n, names)), ""))
    df = docs.select("doc_id", F.coalesce(F.array_join(F.transform(hits, identifiers), ""), F.lit("")).alias("sequence"))
    return df.select("doc_id", "sequence", _licences(F.col("sequence")).alias("licenses"))


def _licences(sequence: Column) -> Column:
    """The rules are tried one after the other on what the ones before have left of the sequence."""
    rules = F.array(*[F.struct(F.lit(ids).alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    none = F.array().cast("array<string>")

    def tried(acc: Column, rule: Column) -> Column:
        fits = F.contains(acc["rest"], rule["ids"])
        return F.struct(F.replace(acc["rest"], rule["ids"], F.lit("-")).alias("rest"), F.when(fits, F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(rules, F.struct(sequence.alias("rest"), none.alias("found")), tried, lambda acc: acc["found"])
    ordered = dict.fromkeys(name for _, name in RULES)  # a licence stands where its first rule does
    listed = F.transform(F.array(found), lambda xs: F.filter(F.array(*[F.lit(n) for n in ordered]), lambda n: F.array_contains(xs, n)))[0]
    return F.when(sequence == "", none).otherwise(listed)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.length("sequence").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"))


def digest_sql() -> str:
    lookup = " ".join(f"when '{v}' then '{k}'" for k, v in SENTENCES.items())
    found, rest = [], "sequence"
    for ids, name in RULES:
        found.append(f"case when contains({rest}, '{ids}') then '{name}' end")
        rest = f"replace({rest}, '{ids}', '-')"
    ordered = [n for n in dict.fromkeys(name for _, name in RULES)]
    any_of = ", ".join(f"case when list_contains(f, '{n}') then '{n}' end" for n in ordered)
    return (
        rf"with s as (select doc_id, unnest(xs) as x, generate_subscripts(xs, 1) as i from (select doc_id, regexp_split_to_array(coalesce(text, ''), '{BREAK}') as xs from documents)), "
        f"k as (select doc_id, i, case trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) {lookup} end as id from s where regexp_matches(x, '{CUES}')), "
        "q as (select doc_id, coalesce(string_agg(id, '' order by i), '') as sequence from documents left join k using (doc_id) group by doc_id), "
        f"f as (select doc_id, sequence, [{', '.join(found)}] as f from q) "
        f"select doc_id, length(sequence) as n_sentences, concat_ws(',', {any_of}) as licenses from f"
    )
