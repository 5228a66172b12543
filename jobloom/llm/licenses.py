"""License scans by patience alignment of notices with texts.

A word that occurs once in the notice and once in the part of the text looked at is an anchor.  The longest increasing
subsequence of the anchors is kept, and the gaps between them are aligned in the same way, so words that are common
elsewhere count where the gap makes them unique.  The share of the notice's words that are aligned is its coverage; a
word that a notice repeats may go unaligned where much around it is changed.

A match lacks at most ``n - coverage * n`` of a notice's n words, so of any one more of its words it has at least one.
These are the notice's key words, the longest ones; every occurrence of each in the text is looked at, with room before
and behind for as many added words as the notice has, and without room, for places where copies of the notice crowd.

Words that tell a version or variant must be aligned, and words that make another license must not stand in the match.
Short forms (an identifier of SPDX, a license's name) count word for word, one after the other, as of so few words none
can be missing or stand between.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import map_batches


class Notice(NamedTuple):
    """A license's identifier and wording, the words that a match must have and those that it must not hold; ``tight``: word for word."""

    name: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    tight: bool = False


# Identifiers of SPDX and the licenses' names.
LICENSES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License", "MPL-2.0": "Mozilla Public License 2.0",
    "GPL-2.0": "GNU General Public License v2.0", "GPL-3.0": "GNU General Public License v3.0", "LGPL-2.1": "GNU Lesser General Public License v2.1", "LGPL-3.0": "GNU Lesser General Public License v3.0", "AGPL-3.0": "GNU Affero General Public License v3.0",
    "CC0-1.0": "CC0 1.0 Universal", "CC-BY-4.0": "Creative Commons Attribution 4.0", "CC-BY-SA-4.0": "Creative Commons Attribution ShareAlike 4.0", "CC-BY-NC-4.0": "Creative Commons Attribution NonCommercial 4.0",
    "CC-BY-ND-4.0": "Creative Commons Attribution NoDerivatives 4.0", "CC-BY-NC-SA-4.0": "Creative Commons Attribution NonCommercial ShareAlike 4.0", "CC-BY-NC-ND-4.0": "Creative Commons Attribution NonCommercial NoDerivatives 4.0",
    "Unlicense": "The Unlicense", "EPL-2.0": "Eclipse Public License 2.0", "BSL-1.0": "Boost Software License 1.0", "Zlib": "zlib License", "Artistic-2.0": "Artistic License 2.0", "EUPL-1.2": "European Union Public Licence 1.2",
    "OFL-1.1": "SIL Open Font License 1.1", "PostgreSQL": "PostgreSQL License", "NCSA": "NCSA Open Source License", "MS-PL": "Microsoft Public License", "CDDL-1.0": "Common Development and Distribution License 1.0", "WTFPL": "Do What The Fuck You Want To Public License",
}
#: Identifiers that another one found in the same text includes.
INCLUDED = {"BSD-3-Clause": "BSD-2-Clause"}


def short_forms() -> list[Notice]:
    """Each license's SPDX line, its name and, where it has a version, its bare identifier and the name with the word version."""
    out = []
    for name, title in LICENSES.items():
        forms = [f"SPDX-License-Identifier: {name}", title]
        if re.search(r"\d$", name):
            forms += [name, re.sub(r" v?(\d)", r" Version \1", title)]
        out += [Notice(name, form, tight=True) for form in dict.fromkeys(forms)]
    return out


_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
_VARIANTS = ("sharealike", "noncommercial", "noderivatives", "noderivs")
#: Notices by identifier (fixed values: the licenses' own standard wording).
NOTICES = [
    Notice("MIT", "Released under the MIT License.", ("mit",)),
    Notice("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Notice("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    Notice("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache",)),
    Notice("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3"), ("lesser", "affero")),
    Notice("GPL-3.0", _GNU.format("General Public License", 3), ("3",), ("lesser", "affero")),
    Notice("GPL-2.0", _GNU.format("General Public License", 2), ("2",), ("lesser", "affero")),
    Notice("LGPL-3.0", _GNU.format("Lesser General Public License", 3), ("lesser", "3")),
    Notice("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1"), ("lesser", "2", "1")),
    Notice("AGPL-3.0", _GNU.format("Affero General Public License", 3), ("affero", "3")),
    Notice("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla",)),
    Notice("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Notice("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Notice("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", (), ("agreement",)),
    Notice("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", ("agreement",)),
    Notice("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Notice("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    Notice("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ("organization",)),
    Notice("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse", "2")),
    Notice("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", ("font",)),
    Notice("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    Notice("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "nc", "4"), ("nd", "sa")),
    Notice("CC-BY-4.0", _CC.format(""), ("attribution", "4"), _VARIANTS),
    Notice("CC-BY-SA-4.0", _CC.format("-ShareAlike"), ("sharealike", "4"), ("noncommercial",)),
    Notice("CC-BY-NC-4.0", _CC.format("-NonCommercial"), ("noncommercial", "4"), ("sharealike", "noderivatives", "noderivs")),
    Notice("CC-BY-ND-4.0", _CC.format("-NoDerivatives"), ("noderivatives", "4"), ("noncommercial",)),
    Notice("CC-BY-NC-SA-4.0", _CC.format("-NonCommercial-ShareAlike"), ("noncommercial", "sharealike", "4")),
    Notice("CC-BY-NC-ND-4.0", _CC.format("-NonCommercial-NoDerivatives"), ("noncommercial", "noderivatives", "4")),
    Notice("proprietary", "All rights reserved.", tight=True),
    *short_forms(),
]
#: Words that tell nothing of a short form: it is looked for by another of its words, if it has one.
_PLAIN = frozenset("by the to of you want do what license licence public general version open source software and 0 1 2 3 4".split())
#: Least coverage of a match.
COVERAGE = 0.8
_WORD = re.compile(r"\w+")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k:], at[k:] = ([v], [i]) if k == len(tops) else ([v, *tops[k + 1 :]], [i, *at[k + 1 :]])
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order: equal ends, then anchors and what lies in their gaps."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if in_b[w] == 1}
        both = [(x, place[w]) for x, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place]
        anchors = [both[x] for x in increasing([y for _, y in both])]
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:]) if x + 1 < x2 and y + 1 < y2]
    return sorted(out)


class Template:
    """A notice made ready for the search."""

    def __init__(self, notice: tuple, coverage: float):
        self.notice, self.coverage = Notice(*notice), coverage
        self.words = words = _WORD.findall(self.notice.text.lower())
        n = len(words)
        if self.notice.tight:
            self.keys = [min(((w, k) for k, w in enumerate(words)), key=lambda x: (x[0] in _PLAIN, -len(x[0]), x))]
            return
        #: (word, place): one more than a match may lack.
        self.keys = sorted(((w, k) for k, w in enumerate(words)), key=lambda x: (-len(x[0]), x))[: int(n * (1 - coverage) + 1e-9) + 1]

    def best(self, words: list[str], where: dict[str, list[int]]) -> tuple[float, int, int]:
        """Coverage, first and end word of the best aligned place in a text; coverage 0 if there is none."""
        n, found = len(self.words), (0.0, 0, 0)
        must, never = self.notice.must, frozenset(self.notice.never)
        if self.notice.tight:
            key, at = self.keys[0]
            return next(((1.0, p - at, p - at + n) for p in where.get(key, ()) if p >= at and words[p - at : p - at + n] == self.words), found)
        for start in sorted({p - at for key, at in self.keys for p in where.get(key, ())}):
            for room in (n, 0):
                low = max(0, start - room)
                pairs = align(self.words, words[low : max(0, start + n + room)])
                if not pairs or (len(pairs) / n, -(low + pairs[0][1]), 0) <= found:
                    continue
                have, a, b = {self.words[i] for i, _ in pairs}, low + pairs[0][1], low + pairs[-1][1] + 1
                if have.issuperset(must) and never.isdisjoint(words[a:b]):
                    found = len(pairs) / n, -a, b
            if found[0] == 1:
                break
        return found[0], -found[1], found[2]


def scanned(docs: DataFrame, notices: list[tuple] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, from_char, to_char, n_licenses, licenses): license notices in whole texts.

    ``licenses`` are the identifiers of all notices covered to ``coverage`` or more, sorted and joined by commas;
    ``license`` is that of the highest coverage (of equal ones the longest notice, then the first identifier), with the
    place of its best match in the text, the first of equal ones.  A match has at most as many added words before or
    after an aligned one as the notice has words; one of a tight notice has no added words.  Null, empty and notice-free texts have no license: nulls, 0 and ''.
    Whole texts of any length are looked at; repeated rows give a row each; an empty table gives no rows; other columns
    are ignored.
    """

    def make():
        each = [Template(x, coverage) for x in notices]
        keys = {k for n in each for k, _ in n.keys}

        def one(text):
            text = text or ""
            low = text.lower()
            here = {k for k in keys if k in low}
            matches = []
            if here and len(low) == len(text):
                spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
            elif here:  # lower-casing changed the length: words keep their own places
                spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            else:
                spans = []
            words = [text[a:b].lower() for a, b in spans]
            where: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                if w in here:
                    where.setdefault(w, []).append(i)
            for n in each:
                if any(k in where for k, _ in n.keys):
                    share, a, b = n.best(words, where)
                    if share >= coverage:
                        matches.append((-share, -len(n.words), n.notice.name, spans[a][0], spans[b - 1][1]))
            gone = {INCLUDED.get(m[2]) for m in matches}
            matches = [m for m in matches if m[2] not in gone]
            if not matches:
                return None, None, None, None, 0, ""
            top, names = min(matches), sorted({m[2] for m in matches})
            return top[2], -top[0], top[3], top[4], len(names), ",".join(names)

        return lambda ids, texts: [ids, *map(list, zip(*map(one, texts)))] if texts else [[]] * 7

    return map_batches(docs, ["doc_id", "text"], make, "doc_id bigint, license string, coverage double, from_char bigint, to_char bigint, n_licenses bigint, licenses string")
