"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised; known ones become identifiers,
and the sequence of identifiers is matched against ordered rules. Everything
happens within a row: no explode, join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = (
    ("gpl3", "this work is licensed under the gnu general public license version 3"),
    ("gpl2", "this work is licensed under the gnu general public license version 2"),
    ("apache2", "licensed under the apache license version 2 0"),
    ("apache2-use", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("as-is", "the software is provided as is without warranty of any kind"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "licensed under cc0 1 0"),
    ("reserved", "all rights reserved"),
)
# A licence and the identifiers that must follow each other in this
# order, others between them allowed; a rule that stands earlier wins over later ones.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "as-is")),
    ("MIT", ("mit",)),
    ("Apache-2.0", ("apache2",)),
    ("Apache-2.0", ("apache2-use", "apache2-copy")),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-2.0", ("gpl2",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("reserved",)),
)
_GNU = (("gpl3", "", "3"), ("gpl2", "", "2"), ("lgpl3", "lesser ", "3"), ("lgpl21", "lesser ", "2 1"), ("agpl3", "affero ", "3"))
# Whole sentences of licence texts and of the notices that they ask for. The registered SQL knows only SENTENCES and RULES.
WHOLE_SENTENCES = (
    *((f"{i}-notice", f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license {how}") for i, kind, v in _GNU for what in ("program", "library", "software", "file") for how in (f"as published by the free software foundation either version {v} of the license or at your option any later version", f"as published by the free software foundation version {v} of the license", f"as published by the free software foundation version {v}", f"version {v} as published by the free software foundation")),
    ("gpl3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl2-title", "gnu general public license version 2 june 1991"),
    ("lgpl3-title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21-title", "gnu lesser general public license version 2 1 february 1999"),
    ("agpl3-title", "gnu affero general public license version 3 19 november 2007"),
    ("apache2-title", "apache license version 2 0 january 2004"),
    ("apache2-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit-grant-whole", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    *(("isc", f"permission to use copy modify and {either}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies") for either in ("or ", "")),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl2-title", "mozilla public license version 2 0"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v"),
    *(("mpl2-copy", f"if a copy of the mpl was not distributed with this file you can obtain one at {http} mozilla org mpl 2 0") for http in ("http", "https")),
    ("epl2-title", "eclipse public license v 2 0"),
    ("epl1-title", "eclipse public license v 1 0"),
    *(("epl2-notice", f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}2 0 which is available at {http} www eclipse org legal epl 2 0") for v in ("", "v") for http in ("http", "https")),
    ("epl1-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl1-title", "boost software license version 1 0 august 17th 2003"),
)
WHOLE_RULES = (
    ("MIT", ("mit-grant-whole", "mit-notice", "mit-as-is")),
    *((name, (f"{i}-{part}",)) for name, i in (("GPL-3.0", "gpl3"), ("GPL-2.0", "gpl2"), ("LGPL-3.0", "lgpl3"), ("LGPL-2.1", "lgpl21"), ("AGPL-3.0", "agpl3")) for part in ("notice", "title")),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("ISC", ("isc",)),
    ("0BSD", ("0bsd",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    *((f"EPL-{v}.0", (f"epl{v}-{part}",)) for v in "21" for part in ("notice", "title")),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl1-title",)),
)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    Sentences begin and end at line ends and at ``.``, ``!`` or ``?`` before a space or tab;
    lower-cased, everything but a-z and 0-9 becomes one space. A sentence may also run
    over line ends, but not over empty lines or a line that ends with one of these marks.
    """
    # | stands for the end of a sentence or paragraph, / for a line end within
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "|/", "  ")
    for old, new in ((r"[.!?](?:[ \t]+|\r?\n)", "|"), (r"\n[^a-z0-9\n|]*(?=\n)", "|"), (r"\n", "/"), (r"[^a-z0-9|/]+", " "), (r"[ /]*\|[ /|]*", "|"), (r" */[ /]*", "/")):
        plain = F.regexp_replace(plain, old, new)
    known = dict((s, i) for i, s in (*SENTENCES, *WHOLE_SENTENCES))
    # longer ones first: a sentence may begin with another
    each = "|".join(s.replace(" ", "[ /]") for s in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(F.concat(F.lit("|"), F.trim(plain), F.lit("|")), F.lit(f"(?<=[|/])(?:{each})(?=[|/])"), F.lit(0))
    named = F.create_map(*[F.lit(x) for s, i in known.items() for x in (s, i)])
    return F.transform(found, lambda s: named[F.translate(s, "/", " ")])


def matched(ids: Column) -> Column:
    """Licences of the rules whose identifiers occur in order, in the rules' order, each once."""
    line = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    hits = [F.when(line.like("%|" + "|%|".join(seq) + "|%") if len(seq) == 1 else line.rlike(r"\|" + r"\|(?:.*\|)?".join(seq) + r"\|"), F.lit(name)) for name, seq in (*RULES, *WHOLE_RULES)]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def scan_licences(docs: DataFrame) -> DataFrame:
    """``(doc_id, sentence_ids, licences, licence)``, a row for each row of ``docs(doc_id, text)``.

    ``licence`` is the first licence or null; null and empty texts have none.
    Rows that repeat each get their row; other columns are ignored.
    """
    out = docs.select("doc_id", sentence_ids(F.col("text")).alias("sentence_ids"))
    out = out.withColumn("licences", matched(F.col("sentence_ids")))
    return out.withColumn("licence", F.get("licences", F.lit(0)))
