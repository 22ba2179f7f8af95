"""Licence scans by sentence rules: normalised sentences to identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licences and licence notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-long": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Ordered rules; a rule holds where its sentences follow one another among a text's known sentences.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-notice-long", "apache-copy", "apache-asis", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-name"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope"]),
    ("Apache-2.0", ["apache-notice-long"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("ISC", ["isc-grant"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("AGPL-3.0", ["agpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
]

#: Sentences whose middle names someone, by identifier: what stands before and behind up to GAP_WORDS words.
NAMED: dict[str, tuple[str, str]] = {
    "bsd-endorse": ("Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-endorse-name": ("The name of", "may not be used to endorse or promote products derived from this software without specific prior written permission."),
}
GAP_WORDS = 12
#: Names of licences as notices write them, by SPDX identifier; {v} stands for each of the versions.
NAMES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("Apache-{v}", ("2.0",), ("the Apache License, Version {v}", "the Apache License {v}", "the Apache {v} License", "Apache {v}")),
    ("MIT", ("",), ("the MIT License", "the MIT licence", "the terms of the MIT License", "an MIT License", "MIT License", "MIT")),
    ("ISC", ("",), ("the ISC License", "ISC")),
    ("BSD-2-Clause", ("",), ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License")),
    ("BSD-3-Clause", ("",), ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License")),
    ("GPL-{v}", ("2.0", "3.0"), ("the GNU General Public License, version {n}", "the GNU General Public License v{v}", "the GNU GPL, version {n}", "the GNU GPLv{n}", "the GPLv{n}", "GPLv{n}")),
    ("GPL-{v}-or-later", ("2.0", "3.0"), ("the GNU General Public License, version {n} or later", "the GNU General Public License, version {n} or any later version", "the GPLv{n} or later")),
    ("LGPL-{v}", ("2.1", "3.0"), ("the GNU Lesser General Public License, version {n}", "the GNU Lesser General Public License v{v}", "the LGPLv{n}", "LGPLv{n}")),
    ("LGPL-{v}-or-later", ("2.1", "3.0"), ("the GNU Lesser General Public License, version {n} or later", "the LGPLv{n} or later")),
    ("AGPL-{v}", ("3.0",), ("the GNU Affero General Public License, version {n}", "the GNU Affero General Public License v{v}", "the AGPLv{n}", "AGPLv{n}")),
    ("AGPL-{v}-or-later", ("3.0",), ("the GNU Affero General Public License, version {n} or later", "the AGPLv{n} or later")),
    ("MPL-{v}", ("1.1", "2.0"), ("the Mozilla Public License {v}", "the Mozilla Public License, version {v}", "the Mozilla Public License, v. {v}", "MPL {v}")),
    ("EPL-{v}", ("1.0", "2.0"), ("the Eclipse Public License {v}", "the Eclipse Public License, version {v}", "the Eclipse Public License v{v}", "EPL {v}")),
    ("EUPL-{v}", ("1.1", "1.2"), ("the European Union Public Licence {v}", "the European Union Public Licence, version {v}", "the EUPL, version {v}")),
    ("BSL-{v}", ("1.0",), ("the Boost Software License, Version {v}", "the Boost Software License {v}")),
    ("Zlib", ("",), ("the zlib License", "the zlib/libpng License")),
    ("Artistic-{v}", ("1.0", "2.0"), ("the Artistic License {v}", "the Artistic License, version {v}")),
    ("OFL-{v}", ("1.1",), ("the SIL Open Font License, Version {v}", "the SIL Open Font License {v}")),
    ("CC-BY-{v}", ("2.0", "2.5", "3.0", "4.0"), ("CC BY {v}", "a Creative Commons Attribution {v} International License", "a Creative Commons Attribution {v} License", "the Creative Commons Attribution {v} License")),
    ("CC-BY-SA-{v}", ("2.0", "2.5", "3.0", "4.0"), ("CC BY-SA {v}", "a Creative Commons Attribution-ShareAlike {v} International License", "a Creative Commons Attribution-ShareAlike {v} License")),
    ("CC-BY-ND-{v}", ("3.0", "4.0"), ("CC BY-ND {v}", "a Creative Commons Attribution-NoDerivatives {v} International License")),
    ("CC-BY-NC-{v}", ("2.0", "2.5", "3.0", "4.0"), ("CC BY-NC {v}", "a Creative Commons Attribution-NonCommercial {v} International License", "a Creative Commons Attribution-NonCommercial {v} License")),
    ("CC-BY-NC-SA-{v}", ("2.0", "2.5", "3.0", "4.0"), ("CC BY-NC-SA {v}", "a Creative Commons Attribution-NonCommercial-ShareAlike {v} International License", "a Creative Commons Attribution-NonCommercial-ShareAlike {v} License")),
    ("CC-BY-NC-ND-{v}", ("3.0", "4.0"), ("CC BY-NC-ND {v}", "a Creative Commons Attribution-NonCommercial-NoDerivatives {v} International License")),
    ("CC0-{v}", ("1.0",), ("CC0 {v}", "CC0 {v} Universal", "the CC0 {v} Universal Public Domain Dedication")),
    ("Unlicense", ("",), ("the Unlicense",)),
    ("WTFPL", ("",), ("the WTFPL",)),
]
#: How notices begin.
LEADS = ["Licensed", "Released", "Distributed", "Published", "Available", *[f"{a} {b} is {c}" for a in ("This", "The") for b in ("work", "project", "software", "program", "file", "code", "library", "package", "document") for c in ("licensed", "released", "distributed", "available")]]


def notices() -> dict[str, list[str]]:
    """Notices of every named licence, by identifier `notice:SPDX`: each beginning with each name and version, and the SPDX line."""
    out: dict[str, list[str]] = {}
    for spdx, versions, names in NAMES:
        for v in versions:
            fill = lambda t, v=v: t.replace("{v}", v).replace("{n}", v.removesuffix(".0"))
            out[f"notice:{fill(spdx)}"] = [f"{lead} under {fill(name)}." for lead in LEADS for name in names] + [f"SPDX-License-Identifier: {fill(spdx)}"]
            if spdx.startswith(("GPL", "LGPL", "AGPL")) and "later" not in spdx:
                out[f"notice:{fill(spdx)}"].append(f"SPDX-License-Identifier: {fill(spdx)}-only")
    return out


#: A sentence ends after . ! ? : with white space behind, or at a line without a letter or digit; a one-letter "v." does not end it.
SPLIT = r"(?<=[.!?:])(?<!\bv\.)\s+|(?>\r\n|\v)[^\p{L}\p{N}\v]*(?>\r\n|\v)\s*"
#: In lower-case texts, which have no capitals, E stands for a sentence's end and N for a line's, each with all that is no letter or digit behind.
_MARKS = [(r"(?<!\bv)[.!?:]\s[^a-z0-9]*", "E"), (r"\v[^a-z0-9E]*", "N"), (r"[^a-z0-9EN]+", " ")]
#: Between the words of one sentence, and where the known sentence itself has a sentence's end inside (as behind "software:").
_GAP, _OWN_END = "(?: N?|N)", "(?: ?N?E| N?|N)"


def norm(sentence: str) -> str:
    """What `normalised` does, for the sentences above."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def marked(text: Column) -> Column:
    """Lower-case ASCII letters and digits with single blanks, and the marks above; comment marks and frames fall away."""
    text = F.lower(text)
    for pattern, mark in _MARKS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def _words(sentence: str) -> list[str]:
    """The words of a known sentence, each but the first behind what may part it from the one before."""
    import re

    out: list[str] = []
    for part in (x for p in re.split(r"(?<=[.!?:])(?<!\bv\.)\s+", sentence) if (x := norm(p))):
        for i, w in enumerate(part.split(" ")):
            out.append(w if not out else (_GAP if i else _OWN_END) + w)
    return out


def _branch(tree: dict) -> str:
    """A pattern of all ways through a tree of words; None ends a sentence. What sentences share is tried once."""
    ways = [k + _branch(v) for k, v in tree.items() if k is not None]
    body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
    return f"(?:{body})?" if body and None in tree else body


def pattern_of(sentences: list[str], named: dict[str, tuple[str, str]] | None = None) -> str:
    """What finds the sentences, the longest first, in marked texts: each from a line's or sentence's start to such an end, over any line breaks and its own ends inside."""
    tree: dict = {}
    for s in sentences:
        at = tree
        for w in _words(s):
            at = at.setdefault(w, {})
        at[None] = {}
    gaps = ["".join(_words(a)) + f"(?:{_GAP}[a-z0-9]+){{1,{GAP_WORDS}}}?" + _GAP + "".join(_words(b)) for a, b in (named or {}).values()]
    return f"(?:^ ?|[NE])({'|'.join([_branch(tree), *gaps])})(?= ?(?:[NE]|$))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str | list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(id, sentence_ids, licenses, n_sentences): known sentences in order, and the licences whose rules match, by rule order.

    Sentences may be wrapped over lines and stand in comments. Longer rules go first and use up their sentences, so that a full
    text is not also its parts. Null and empty texts have none.
    Rows are neither merged nor dropped. The rules travel as literals: their size is fixed, whatever the input. Without sentences of the caller's own, the fixed
    sentences, those with a name inside (NAMED) and the notices of all named licences (notices()) are known.
    """
    named = NAMED if sentences is None else {}
    generated = notices() if sentences is None else {}
    sentences = SENTENCES if sentences is None else sentences
    pairs = [(k, s) for k, v in {**generated, **sentences}.items() for s in ([v] if isinstance(v, str) else v)]
    known = {norm(s): k for k, s in pairs}  # a fixed sentence keeps its own identifier, whatever is generated
    ordered = sorted([*(rules or RULES), *[(k.removeprefix("notice:"), [k]) for k in generated]], key=lambda r: -len(r[1]))
    # one literal, not thousands of expressions that every rule of the optimiser would walk
    lookup = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in known.items())), F.lit(";"), F.lit("="))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = F.filter(F.split(text, SPLIT), lambda x: F.trim(x) != "")
    found_in = F.regexp_extract_all(marked(text), F.lit(pattern_of([s for _, s in pairs], named)), F.lit(1))

    def identifier(x: Column) -> Column:
        flat = F.regexp_replace(x, "[ NE]+", " ")
        by_gap = [F.when(flat.startswith(norm(a) + " ") & flat.endswith(" " + norm(b)), F.lit(k)) for k, (a, b) in named.items()]
        return F.coalesce(lookup[flat], *by_gap)

    ids = F.transform(found_in, identifier)
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(seq) + "|").alias("seq")) for name, seq in ordered])
    start = F.struct(F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|")).alias("left"), F.lit("").alias("found"))
    step = lambda acc, r: F.struct(
        F.replace(acc["left"], r["seq"], F.lit("#")).alias("left"),
        F.when(F.contains(acc["left"], r["seq"]), F.concat(acc["found"], F.lit("|"), r["name"])).otherwise(acc["found"]).alias("found"),
    )
    found = F.aggregate(table, start, step, lambda acc: F.array_distinct(F.filter(F.split(acc["found"], r"\|"), lambda x: x != "")))
    base = docs.select(F.col(id_col), F.size(parts).cast("long").alias("n_sentences"), ids.alias("sentence_ids"))
    return base.select(id_col, "sentence_ids", F.when(F.size("sentence_ids") > 0, found).otherwise(F.array().cast("array<string>")).alias("licenses"), "n_sentences")
