"""License scans by sentence rules, in DataFrame functions alone.

A text is split into sentences, which may be wrapped over lines; in a normalised
sentence (lower case, runs of anything but letters, digits and dots between
digits as one space) each run of whole lines, one or more, that a known pattern
matches gets that pattern's identifier, so notices of a line and wrapped texts
are found alike, also below a heading without an empty line between.  The sequence of a text's
identifiers, in order, is matched against ordered rules: a rule holds where its
identifiers appear next to each other; the first rules win, and what a rule has
taken no later rule takes.

All of it happens inside the row: no join, no shuffle, no Python worker.

Defined results: null and empty texts have no sentences and an empty list of
licenses; a text's repeated sentences give repeated identifiers and one license;
repeated rows stay; an empty table stays empty; very long texts are scanned
whole.  Of the table's columns those named ``sentence_ids`` and ``licenses`` are
replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence identifier, pattern of the whole normalised sentence.
SENTENCES = (
    ("MIT-NOTICE", r"(?:this (?:work|software|project|file|code) is )?(?:released|licensed|distributed|available) under the (?:terms of the )?(?:mit|expat) licen[cs]e"),
    ("MIT-GRANT", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("MIT-COND", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ASIS-SOFTWARE", r"the software is provided as is without warranty of any kind.*"),
    ("APACHE-NOTICE", r"(?:this (?:work|software|project|file|code) is )?(?:released|licensed|distributed) under the (?:terms of the )?apache licen[cs]e(?: version)? 2(?:\.0)?(?: the licen[cs]e)?"),
    ("APACHE-COMPLY", r"you may not use this file except in compliance with the licen[cs]e"),
    ("APACHE-COPY", r"you may obtain a copy of the licen[cs]e at.*"),
    ("GPL3-NOTICE", r"(?:this (?:work|software|project|file|code|program) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public licen[cs]e(?: version)? 3(?:\.0)?"),
    ("GPL2-NOTICE", r"(?:this (?:work|software|project|file|code|program) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public licen[cs]e(?: version)? 2(?:\.0)?"),
    ("GPL-FREE", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation either version [0-9.]+ of the licen[cs]e or at your option any later version)?.*"),
    ("LGPL3-FREE", r"this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("AGPL3-FREE", r"this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("FREE-SOFTWARE", r"this (?:program|library|file|software|package) is free software"),
    ("REDIST-GPL", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("REDIST-LGPL", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("REDIST-AGPL", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("EITHER-2", r"either version 2 of the licen[cs]e or at your option any later version"),
    ("EITHER-2.1", r"either version 2\.1 of the licen[cs]e or at your option any later version"),
    ("EITHER-3", r"either version 3 of the licen[cs]e or at your option any later version"),
    ("VERSION-2", r"version 2(?: of the licen[cs]e)?(?: only)?"),
    ("GNU-HOPE", r"this (?:program|library|file|software|package) is distributed in the hope that it will be useful but without any warranty"),
    ("GNU-IMPLIED", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GNU-DETAILS", r"see the gnu (?:lesser |library |affero )?general public licen[cs]e for more details"),
    ("GNU-RECEIVED", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[cs]e along with this (?:program|library|file|software|package).*"),
    ("GPL3-TITLE", r"gnu general public licen[cs]e version 3 29 june 2007"),
    ("GPL2-TITLE", r"gnu general public licen[cs]e version 2 june 1991"),
    ("GPL2-SHORT", r"(?:this (?:work|software|project|file|code|program) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gpl ?v?(?:ersion )?2(?:\.0)?"),
    ("GPL3-SHORT", r"(?:this (?:work|software|project|file|code|program) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gpl ?v?(?:ersion )?3(?:\.0)?"),
    ("LGPL-SHORT", r"(?:this (?:work|software|project|file|code|library) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?lgpl(?: ?v?(?:ersion )?(?:2\.1|2|3)(?:\.0)?)?"),
    ("LGPL-NOTICE", r"(?:this (?:work|software|project|file|code|library) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu lesser general public licen[cs]e.*"),
    ("AGPL-NOTICE", r"(?:this (?:work|software|project|file|code|program) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu affero general public licen[cs]e.*"),
    ("BSD-REDIST", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSD-NAMES", r"neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-SOURCE", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-BINARY", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD-ADVERT", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("BSD-ASIS", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("ISC-GRANT", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD-GRANT", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC-ASIS", r"the software is provided as is and the author disclaims all warranties.*"),
    ("APACHE-ASIS", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("APACHE-SEE", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("APACHE-TITLE", r"apache licen[cs]e version 2\.0 january 2004.*"),
    ("UNLICENSE-FREE", r"this is free and unencumbered software released into the public domain"),
    ("UNLICENSE-ANYONE", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("BSL-GRANT", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e.*"),
    ("BSL-NOTICE", r"(?:distributed under the )?boost software licen[cs]e version 1\.0.*"),
    ("ZLIB-ASIS", r"this software is provided as is without any express or implied warranty"),
    ("ZLIB-GRANT", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("EPL2-TERMS", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v )?2\.0.*"),
    ("MPL2-OPEN", r"this source code form is subject to the terms of the mozilla public licen[cs]e(?: v)?"),
    ("MPL2-COPY", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("MIT-TITLE", r"(?:the )?mit licen[cs]e(?: mit)?"),
    ("BSD-NOTICE", r"(?:this (?:work|software|project|file|code) is )?(?:released|licensed|distributed) under the (?:terms of the )?bsd (?:2 clause |3 clause )?licen[cs]e"),
    ("MPL2-FORM", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?\.? ?2(?:\.0)?"),
    ("CC0-NOTICE", r"(?:this work is )?(?:released|licensed|dedicated) (?:under|to) (?:the )?(?:cc0|creative commons zero).*"),
    ("CC-BY-NC-NOTICE", r"(?:this work is )?licensed under (?:a |the )?(?:cc by nc|creative commons attribution noncommercial)(?: [1-4]\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CC-BY-SA-NOTICE", r"(?:this work is )?licensed under (?:a |the )?(?:cc by sa|creative commons attribution sharealike)(?: [1-4]\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CC-BY-NOTICE", r"(?:this work is )?licensed under (?:a |the )?(?:cc by|creative commons attribution)(?: [1-4]\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("PUBLIC-DOMAIN", r"(?:this (?:work|software|file) is )?(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("RESERVED", r"(?:copyright .*)?all rights reserved"),
)

# License identifiers that a tag may name ("SPDX-License-Identifier: MIT").
TAGS = tuple(
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense WTFPL Zlib".split()
)
SENTENCES += tuple((f"TAG-{t}", "spdx licen[cs]e identifier " + t.lower().replace("-", " ").replace(".", r"\.")) for t in TAGS)

# License, identifiers that must follow one another; earlier rules win.
RULES = (
    ("MIT", ("MIT-GRANT", "MIT-COND", "ASIS-SOFTWARE")),
    ("BSD-4-Clause", ("BSD-REDIST", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERT")),
    ("BSD-3-Clause", ("BSD-REDIST", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES")),
    ("BSD-2-Clause", ("BSD-REDIST", "BSD-SOURCE", "BSD-BINARY")),
    ("GPL-2.0-or-later", ("FREE-SOFTWARE", "REDIST-GPL", "EITHER-2")),
    ("GPL-2.0-only", ("FREE-SOFTWARE", "REDIST-GPL", "VERSION-2")),
    ("GPL-3.0-or-later", ("FREE-SOFTWARE", "REDIST-GPL", "EITHER-3")),
    ("LGPL-2.0-or-later", ("FREE-SOFTWARE", "REDIST-LGPL", "EITHER-2")),
    ("LGPL-2.1-or-later", ("FREE-SOFTWARE", "REDIST-LGPL", "EITHER-2.1")),
    ("LGPL-3.0-or-later", ("FREE-SOFTWARE", "REDIST-LGPL", "EITHER-3")),
    ("AGPL-3.0-or-later", ("FREE-SOFTWARE", "REDIST-AGPL", "EITHER-3")),
    ("LGPL-3.0-or-later", ("LGPL3-FREE",)),
    ("AGPL-3.0-or-later", ("AGPL3-FREE",)),
    ("GPL", ("REDIST-GPL",)),
    ("LGPL", ("REDIST-LGPL",)),
    ("AGPL", ("REDIST-AGPL",)),
    ("ISC", ("ISC-GRANT",)),
    ("0BSD", ("0BSD-GRANT",)),
    ("Unlicense", ("UNLICENSE-FREE",)),
    ("BSL-1.0", ("BSL-GRANT",)),
    ("BSL-1.0", ("BSL-NOTICE",)),
    ("Zlib", ("ZLIB-GRANT",)),
    ("EPL-2.0", ("EPL2-TERMS",)),
    ("MPL-2.0", ("MPL2-OPEN", "MPL2-COPY")),
    ("MPL", ("MPL2-OPEN",)),
    ("GPL-3.0", ("GPL3-TITLE",)),
    ("GPL-2.0", ("GPL2-TITLE",)),
    ("GPL-2.0", ("GPL2-SHORT",)),
    ("GPL-3.0", ("GPL3-SHORT",)),
    ("LGPL", ("LGPL-SHORT",)),
    ("Apache-2.0", ("APACHE-TITLE",)),
    ("BSD-3-Clause", ("BSD-REDIST", "BSD-NAMES")),
    ("Apache-2.0", ("APACHE-NOTICE", "APACHE-COMPLY", "APACHE-COPY")),
    ("Apache-2.0", ("APACHE-NOTICE", "APACHE-COMPLY")),
    ("MIT", ("MIT-GRANT", "MIT-COND")),
    ("MIT", ("MIT-GRANT",)),
    ("MIT", ("MIT-NOTICE",)),
    ("BSD-2-Clause", ("BSD-REDIST",)),
    ("BSD", ("BSD-NOTICE",)),
    ("Apache-2.0", ("APACHE-NOTICE",)),
    ("GPL-3.0", ("GPL3-NOTICE",)),
    ("GPL-2.0", ("GPL2-NOTICE",)),
    ("GPL", ("GPL-FREE",)),
    ("LGPL", ("LGPL-NOTICE",)),
    ("AGPL", ("AGPL-NOTICE",)),
    ("MPL-2.0", ("MPL2-FORM",)),
    ("CC0-1.0", ("CC0-NOTICE",)),
    ("CC-BY-NC", ("CC-BY-NC-NOTICE",)),
    ("CC-BY-SA", ("CC-BY-SA-NOTICE",)),
    ("CC-BY", ("CC-BY-NOTICE",)),
    ("Public-Domain", ("PUBLIC-DOMAIN",)),
    ("All-Rights-Reserved", ("RESERVED",)),
    ("MIT", ("MIT-TITLE",)),
)
RULES += tuple((t, (f"TAG-{t}",)) for t in TAGS)

#: A sentence without any of these words is no license sentence; each pattern above has one of them.
WORDS = ("licen", "permission", "warranty", "redistribut", "rights reserved", "public domain", "creative commons", "cc by", "cc0", "free software", "gpl", "mpl was not", "anyone is free", "warranties", "either version", "advertising materials")
#: A line without letters and digits, which becomes an empty one.  Possessive, as all runs here: Java recurses once per turn of a repeated group.
BLANK = r"\n[^\p{L}\p{N}\n]++(?=\n)"
#: A sentence ends at an empty line, or at . ! ? ; before white space.
SENTENCE_END = r"\n\n++|(?<=[.!?;])\s++"
#: A pattern over whole lines: its spaces may be line ends, what is open at its end is the rest of the line.
WRAPPED = r"(?m)^(?:" + "|".join(p.replace(".* ", r"[\s\S]*? ").replace(".*", r"[^\n]*").replace(" ", r"[ \n]") for _, p in SENTENCES) + r")$"


def normalised(sentence: Column) -> Column:
    """Lower case; dots stay only between digits; every other run of non-letters, non-digits in a line is a space."""
    plain = F.regexp_replace(F.lower(sentence), r"(?<![0-9])\.|\.(?![0-9])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}.\n]+", " "), r" ?\n ?", "\n"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    hint = "(?i)" + "|".join(WORDS).replace(" ", "[^a-z0-9]+")
    candidates = F.filter(F.split(F.regexp_replace(text, BLANK, "\n"), SENTENCE_END), lambda s: s.rlike(hint))
    known = F.flatten(F.transform(candidates, lambda s: F.regexp_extract_all(normalised(s), F.lit(WRAPPED), F.lit(0))))
    found = F.transform(known, lambda s: _identify(F.translate(s, "\n", " ")))
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<string>"))


def _identify(sentence: Column) -> Column:
    known = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in SENTENCES:
        known = known.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    return known


def licenses(ids: Column) -> Column:
    """Licenses of the rules that hold, in the rules' order, without repeats.

    The sequence is kept as one string, each identifier between bars; a rule
    takes all its occurrences out of it and leaves a break.
    """
    taken = F.aggregate(
        F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in seq)).alias("seq")) for name, seq in RULES)),
        F.struct(F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")).alias("rest"), F.array().cast("array<string>").alias("found")),
        lambda acc, rule: F.struct(
            F.replace(acc["rest"], rule["seq"], F.lit("#")).alias("rest"),
            F.when(F.contains(acc["rest"], rule["seq"]), F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        ),
    )
    return F.array_distinct(taken["found"])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``sentence_ids`` and ``licenses`` (arrays; clashing names are replaced)."""
    df = df.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("licenses", F.when(F.size("sentence_ids") > 0, licenses(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))
