"""Licence recognition by sentence rules, in DataFrame functions only.

A text is split into sentences, each is normalised and looked up among known licence sentences; the sequence of
identifiers found is matched against rules: a sentence that names its licence by itself, or an ordered run of
sentences. Comment marks at the beginning of lines are dropped first. Where lines end inside a sentence is not known,
so there are two readings: one joins a line that goes on in lower case or with a bracket, the other every line that
has no stop at its end. What either reading finds counts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.names import free_name

# Sentences of public licence texts and notices.
SENTENCES: Mapping[str, str] = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "x11.names": "Except as contained in this notice, the name of the copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the copyright holder",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd.redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache2.notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2.asf": "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\")",
    "apache2.obtain": "you may not use this file except in compliance with the License",
    "apache2.copy": "You may obtain a copy of the License at",
    "gpl.terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gpl2.terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "v2.later": "either version 2 of the License, or (at your option) any later version",
    "v21.later": "either version 2.1 of the License, or (at your option) any later version",
    "v3.later": "either version 3 of the License, or (at your option) any later version",
    "gpl3.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.see": "See the GNU General Public License for more details",
    "mpl2.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "epl2.notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsl1.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "unlicense.free": "This is free and unencumbered software released into the public domain",
    "cc0.law": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0.work": "This work is dedicated to the public domain under CC0 1.0",
}
#: Sentences that name a licence by themselves.
ALONE: Mapping[str, str] = {
    "isc.grant": "ISC", "0bsd.grant": "0BSD", "apache2.notice": "Apache-2.0", "apache2.asf": "Apache-2.0", "gpl2.terms": "GPL-2.0-only", "gpl3.free": "GPL-3.0-or-later",
    "lgpl3.free": "LGPL-3.0-or-later", "agpl3.free": "AGPL-3.0-or-later", "mpl2.notice": "MPL-2.0", "epl2.notice": "EPL-2.0", "bsl1.grant": "BSL-1.0", "unlicense.free": "Unlicense",
    "cc0.law": "CC0-1.0", "cc0.work": "CC0-1.0",
}
#: (licence, run of sentence identifiers); of runs that contain one another the longer is reported.
RULES: Sequence[tuple[str, tuple[str, ...]]] = (
    ("BSD-4-Clause", ("bsd.redist", "bsd.source", "bsd.binary", "bsd.advert", "bsd.names")),
    ("BSD-3-Clause", ("bsd.redist", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.redist", "bsd.source", "bsd.binary")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("X11", ("mit.grant", "mit.notice", "x11.names")),
    ("Zlib", ("zlib.asis", "zlib.grant")),
    ("GPL-2.0-or-later", ("gpl.terms", "v2.later")),
    ("GPL-3.0-or-later", ("gpl.terms", "v3.later")),
    ("LGPL-2.1-or-later", ("lgpl.terms", "v21.later")),
    ("LGPL-3.0-or-later", ("lgpl.terms", "v3.later")),
    ("AGPL-3.0-or-later", ("agpl.terms", "v3.later")),
)
#: How a line refers to a licence, and what it calls it.
PHRASES = ("Released under the {}", "Licensed under the {}", "Distributed under the {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is released under the {}")
NAMES: Mapping[str, tuple[str, ...]] = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"), "BSD-3-Clause": ("BSD 3-Clause License",), "BSD-2-Clause": ("BSD 2-Clause License",),
    "ISC": ("ISC License",), "MPL-2.0": ("Mozilla Public License 2.0",), "GPL-2.0-only": ("GNU General Public License, version 2",), "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",), "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
}
#: Creative Commons licences of version 4.0: identifier part and name.
CREATIVE: Mapping[str, str] = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
#: Parts of a normalised sentence that differ from owner to owner, and what is looked up in their place.
TEMPLATES: Sequence[tuple[str, str]] = (
    (r"^neither the name of .+ nor the names of (its|his|her|their|any) contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
    (r"^all advertising materials mentioning features or use of this software must display the following acknowledgement .*$", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by the copyright holder"),
    (r"^except as contained in this notice the names? of .+ shall not be used in advertising .*$", "except as contained in this notice the name of the copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the copyright holder"),
    (r"^you may obtain a copy of the license at .*$", "you may obtain a copy of the license at"),
    (r"^.+ is free software you can redistribute", "this program is free software you can redistribute"),
    (r"^permission to use copy modify and distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose"),
    (r"(made available under the terms of the eclipse public license) v? ?2 0( which .*)?$", "$1 2 0"),
)
#: Every known sentence holds one of these; texts and sentences without any are passed over.
ANCHOR = "(?i)licen|permission|copyright|redistribut|public domain|warrant|advertising"
#: Comment marks at the beginning of a line.
LEADER = r"(^|\n)[ \t]*(?:#+|//+|/\*+|\*+/?|;+|--|%+|<!--|dnl |REM )?[ \t]*"
#: Line ends inside a sentence, by either reading.
WRAPPED = (r"\r?\n([a-z(])", r"([^\n.:;!?\r])[ \t]*\r?\n([^\n\r])")
#: Sentences end at line ends, or after . ! ? ; when white space or the end follows.
BREAK = r"[\r\n]+|[.!?;]+([ \t]+|$)"


def known_sentences() -> tuple[dict[str, str], dict[str, str]]:
    """(sentence by identifier, licence by identifier of those that name one)."""
    text, alone = dict(SENTENCES), dict(ALONE)

    def put(name: str, sentence: str, licence: str) -> None:
        text[name], alone[name] = sentence, licence

    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            for j, phrase in enumerate(PHRASES):
                put(f"ref.{licence}.{i}.{j}", phrase.format(name), licence)
    for part, name in CREATIVE.items():
        licence = f"CC-{part}-4.0"
        put(f"cc.{part}.short", f"Licensed under CC {part} 4.0", licence)
        put(f"cc.{part}.work", f"This work is licensed under CC {part} 4.0", licence)
        put(f"cc.{part}.long", f"This work is licensed under a Creative Commons {name} 4.0 International License", licence)
    for licence in SPDX:
        put(f"spdx.{licence}", f"SPDX-License-Identifier: {licence}", licence)
    return text, alone


def normal(text: str) -> str:
    """Lower-case ASCII letters and digits, anything else one space."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def normal_col(c: Column) -> Column:
    """A sentence normalised as :func:`normal` does, what differs by owner replaced."""
    c = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    for pattern, into in TEMPLATES:
        c = F.regexp_replace(c, pattern, into)
    return c


def scan(docs: DataFrame, text: str = "text", sentences: tuple[Mapping[str, str], Mapping[str, str]] | None = None, rules=RULES) -> DataFrame:
    """Adds ``license_sentences`` (identifiers found, in order) and ``licenses`` (sorted distinct).

    ``sentences`` are known sentences and the licences that some name by themselves. A rule holds where its
    identifiers follow one another in the sequence of known sentences; of the licences that hold so, one whose run is
    part of another's is left out. What only the second reading finds comes after what the first one does. Null, empty and
    licence-free texts have empty arrays. Whole texts are read whatever their length; repeated rows give repeated
    results; an empty table gives an empty one; columns of these names are replaced.
    """
    known, alone = sentences or known_sentences()
    assert all(re.search(ANCHOR, s) for s in known.values()), "a known sentence without an anchor word"
    names = list(known)
    number = {n: i for i, n in enumerate(names)}
    literal = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    lookup = literal((normal(known[n]), str(i)) for n, i in number.items())
    label = literal((str(i), n) for n, i in number.items())
    licence = literal((str(number[n]), lic) for n, lic in alone.items())
    none = F.array().cast("array<string>")
    some = F.col(text).rlike(ANCHOR)

    def reading(pattern: str, into: str) -> Column:
        joined = F.regexp_replace(F.regexp_replace(F.col(text), LEADER, "$1"), pattern, into)
        parts = F.filter(F.split(joined, BREAK), lambda s: s.rlike(ANCHOR))
        return F.when(some, F.filter(F.transform(parts, lambda s: lookup[normal_col(s)]), lambda x: x.isNotNull())).otherwise(none)

    runs = [(lic, "," + "".join(f"{number[x]}," for x in run)) for lic, run in rules]

    def hits(seq: Column) -> Column:
        return F.filter(F.array(*[F.when(seq.contains(run), F.lit(lic)) for lic, run in runs]), lambda x: x.isNotNull())

    made = F.struct(reading(WRAPPED[0], " $1").alias("a"), reading(WRAPPED[1], "$1 $2").alias("b"))

    def told(ids: Column) -> Column:
        seq = lambda x: F.concat(F.lit(","), F.concat_ws(",", x), F.lit(","))
        every = F.concat(ids["a"], F.array_except(ids["b"], ids["a"]))
        whole = F.array_union(hits(seq(ids["a"])), hits(seq(ids["b"])))
        for lic, run in rules:
            for longer, other in rules:
                if lic != longer and _within(run, other):
                    whole = F.when(F.array_contains(whole, longer), F.array_remove(whole, lic)).otherwise(whole)
        single = F.filter(F.transform(every, lambda i: licence[i]), lambda x: x.isNotNull())
        licences = F.when(F.size(every) > 0, F.array_sort(F.array_distinct(F.concat(whole, single)))).otherwise(none)
        return F.struct(F.transform(every, lambda i: label[i]).alias("license_sentences"), licences.alias("licenses"))

    got = F.transform(F.array(made), told)[0]
    rest = [c for c in docs.columns if c not in ("license_sentences", "licenses")]
    told_name = free_name(rest)
    return docs.select(*rest, got.alias(told_name)).select(*rest, f"{told_name}.license_sentences", f"{told_name}.licenses")


def _within(run: Sequence[str], other: Sequence[str]) -> bool:
    """Whether a run's identifiers occur in another, longer one's in order."""
    at = iter(other)
    return len(other) > len(run) and all(x in at for x in run)
