"""Licence recognition by sentences.

A text is cut into fragments, at sentence ends and line breaks. Words are
lower-cased runs of letters and digits. From each fragment's beginning, a trie
over the words of known licence sentences is walked across fragments (licence
texts are wrapped anywhere); the longest known sentence that ends where a
fragment ends is recognised. That gives a sequence of sentence identifiers with
places. Ordered rules are then matched against the sequence: a rule's
identifiers must come in its order, with at most ``gap`` fragments that belong
to nothing between two of them. Of rules that match at one place the longest
wins, and its sentences are used up: no later rule takes them, and a rule skips
sentences that another has used.

Known sentences are those of licence texts and headers, and notices, tags and
GNU grants that are made from a licence's names by rule (some 2000 sentences of 45
licences). Only texts that hold one of a few telling words are sent to Python;
every rule has a sentence that holds one.

Defined results: null or empty texts and texts without a rule give no rows; a
licence that stands in a text several times gives a row for each place;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import tidy

#: Sentences of public licence texts.
TEXTS = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit0.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.grant2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc.liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache.grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache.use": "you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache.permissions": "See the License for the specific language governing permissions and limitations under the License.",
    "apache.title": "Apache License Version 2.0, January 2004",
    "apache.terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache.copyright": "Grant of Copyright License.",
    "apache.patent": "Grant of Patent License.",
    "gpl.everyone": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl2.title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3.title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21.title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3.title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3.title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl2.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl1.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "boost.terms": "Distributed under the Boost Software License, Version 1.0.",
    "boost.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib.warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib.origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "artistic2.intent": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "artistic1.intent": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
    "unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl.title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl.zero": "You just DO WHAT THE FUCK YOU WANT TO.",
    "cc0.waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "postgresql.grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "ofl.terms": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "upl.grant": "Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the \"Software\"), free of charge and under any and all copyright rights in the Software",
    "eupl.terms": "This European Union Public Licence (the 'EUPL') applies to the Work (as defined below) which is provided under the terms of this Licence.",
    "ms-pl.accept": "This license governs use of the accompanying software.",
    "beerware.notice": "As long as you retain this notice you can do whatever you want with this stuff.",
}
#: Licences and the names that notices call them by.
NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "AFL-3.0": ("Academic Free License version 3.0", "Academic Free License, version 3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License version 3", "GNU AGPLv3", "AGPL-3.0"),
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache Software License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache 2.0"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-clause BSD license"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-3.0": ("CC BY 3.0", "CC-BY-3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0 License"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-3.0": ("CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 3.0 Unported License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2", "EUPL-1.2"),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GNU Free Documentation License 1.3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPLv3", "GPL-3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 2.1", "GNU LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3", "GNU LGPLv3", "LGPL-3.0"),
    "MIT": ("MIT License", "MIT licence", "Expat License", "MIT"),
    "MIT-0": ("MIT No Attribution License",),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL-2.0", "MPL 2.0"),
    "MS-PL": ("Microsoft Public License",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License Version 2", "PSF License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "UPL-1.0": ("Universal Permissive License v1.0", "Universal Permissive License, Version 1.0"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
}
#: How notices put a name; {} stands for it.
NOTICES = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}",
    "This software is licensed under the {}", "This software is released under the {}", "This software is distributed under the terms of the {}",
    "This file is licensed under the {}", "This program is licensed under the {}", "This library is licensed under the {}",
    "The code is released under the {}", "This code is licensed under the {}", "This package is licensed under the {}",
)
#: Programs and libraries under GNU licences: {thing}, the licence's name {kind} and its version {v}.
GNU = "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
GNU_KINDS = (
    ("GPL-2.0-or-later", "program", "General Public License", "2"), ("GPL-3.0-or-later", "program", "General Public License", "3"),
    ("LGPL-2.1-or-later", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0-or-later", "program", "Lesser General Public License", "3"),
    ("AGPL-3.0-or-later", "program", "Affero General Public License", "3"),
)
#: Ordered rules over sentences of texts, (licence, rule, identifiers).
TEXT_RULES = (
    ("MIT", "text", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", "text", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", "grant", ("mit.grant",)),
    ("MIT-0", "text", ("mit0.grant", "mit.warranty", "mit.liability")),
    ("MIT-0", "grant", ("mit0.grant",)),
    ("ISC", "text", ("isc.grant", "isc.warranty", "isc.liability")),
    ("ISC", "text", ("isc.grant2", "isc.warranty", "isc.liability")),
    ("ISC", "grant", ("isc.grant",)),
    ("ISC", "grant", ("isc.grant2",)),
    ("0BSD", "text", ("0bsd.grant", "isc.warranty", "isc.liability")),
    ("0BSD", "grant", ("0bsd.grant",)),
    ("BSD-4-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.names", "bsd.warranty")),
    ("BSD-4-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.names")),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names", "bsd.warranty")),
    ("BSD-3-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.warranty")),
    ("BSD-2-Clause", "text", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("Apache-2.0", "text", ("apache.title", "apache.terms", "apache.copyright", "apache.patent")),
    ("Apache-2.0", "text", ("apache.title", "apache.terms")),
    ("Apache-2.0", "header", ("apache.grant", "apache.use", "apache.copy", "apache.warranty", "apache.permissions")),
    ("Apache-2.0", "header", ("apache.grant", "apache.use", "apache.copy", "apache.warranty")),
    ("Apache-2.0", "grant", ("apache.grant",)),
    ("GPL-2.0", "text", ("gpl2.title", "gpl.everyone")),
    ("GPL-2.0", "title", ("gpl2.title",)),
    ("GPL-3.0", "text", ("gpl3.title", "gpl.everyone")),
    ("GPL-3.0", "title", ("gpl3.title",)),
    ("LGPL-2.1", "text", ("lgpl21.title", "gpl.everyone")),
    ("LGPL-2.1", "title", ("lgpl21.title",)),
    ("LGPL-3.0", "text", ("lgpl3.title", "gpl.everyone")),
    ("LGPL-3.0", "title", ("lgpl3.title",)),
    ("AGPL-3.0", "text", ("agpl3.title", "gpl.everyone")),
    ("AGPL-3.0", "title", ("agpl3.title",)),
    ("MPL-2.0", "header", ("mpl.terms", "mpl.copy")),
    ("MPL-2.0", "header", ("mpl.terms",)),
    ("EPL-2.0", "header", ("epl2.terms",)),
    ("EPL-1.0", "header", ("epl1.terms",)),
    ("BSL-1.0", "header", ("boost.terms",)),
    ("BSL-1.0", "text", ("boost.grant",)),
    ("Zlib", "text", ("zlib.warranty", "zlib.liability", "zlib.grant", "zlib.origin")),
    ("Zlib", "text", ("zlib.grant", "zlib.origin")),
    ("Artistic-2.0", "text", ("artistic2.intent",)),
    ("Artistic-1.0", "text", ("artistic1.intent",)),
    ("Unlicense", "text", ("unlicense.free", "unlicense.anyone")),
    ("Unlicense", "text", ("unlicense.free",)),
    ("WTFPL", "text", ("wtfpl.title", "wtfpl.zero")),
    ("WTFPL", "title", ("wtfpl.title",)),
    ("CC0-1.0", "text", ("cc0.waive",)),
    ("PostgreSQL", "text", ("postgresql.grant",)),
    ("OFL-1.1", "header", ("ofl.terms",)),
    ("UPL-1.0", "text", ("upl.grant",)),
    ("EUPL-1.2", "text", ("eupl.terms",)),
    ("MS-PL", "text", ("ms-pl.accept",)),
    ("Beerware", "text", ("beerware.notice",)),
)


def catalogue() -> tuple[dict[str, str], tuple]:
    """Sentences by identifier, and the ordered rules: those of texts, and by rule notices, tags and GNU grants."""
    sentences, rules = dict(TEXTS), list(TEXT_RULES)
    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            for j, notice in enumerate(NOTICES):
                own = f"{licence}.notice{i}.{j}"
                sentences[own] = notice.format(name)
                rules.append((licence, "notice", (own,)))
        for tag in (licence, f"{licence}-only", f"{licence}-or-later"):
            if tag == licence or "GPL" in licence or "GFDL" in licence:
                sentences[f"{tag}.tag"] = f"SPDX-License-Identifier: {tag}"
                rules.append((tag, "tag", (f"{tag}.tag",)))
    for licence, thing, kind, v in GNU_KINDS:
        own = f"{licence}.grant"
        sentences[own] = GNU.format(thing=thing, kind=kind, v=v)  # whatever its marks, since they are no words
        hope = "lgpl.hope" if thing == "library" else "gpl.hope"
        rules += [(licence, "header", (own, hope)), (licence, "grant", (own,))]
    return sentences, tuple(rules)


SENTENCES, RULES = catalogue()
#: Every rule has a sentence with one of these words.
TELLING = r"(?i)licen[cs]e|(?:released|distributed|available) under|permission|redistribut|warrant|public domain|retain this notice|semblance of artistic|copyright|WTFPL|do what the fuck"

_WORD = re.compile(r"[^\W_]+")
_FRAGMENT = re.compile(r"[^\n.;:!?]*(?:[.;:!?](?=\S)[^\n.;:!?]*)*[.;:!?]*\s*")


def words(s: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(s)]


class Rules:
    """The trie of known sentences, and rules by their first identifier, longest first."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        self.trie: dict = {}
        for name, s in sentences.items():
            node = self.trie
            for w in words(s):
                node = node.setdefault(w, {})
            node[None] = name
        self.rules: dict[str, list] = {}
        for licence, rule, ids in sorted(rules, key=lambda r: -len(r[2])):
            self.rules.setdefault(ids[0], []).append((licence, rule, ids))

    def sentences(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, first fragment, fragment after the last, start, end) of the known sentences, in order."""
        cut = [m.span() for m in _FRAGMENT.finditer(text) if m.end() > m.start()]
        parts = [words(text[a:b]) for a, b in cut]
        out, i = [], 0
        while i < len(parts):
            node, j, best = self.trie, i, None
            while j < len(parts):
                for w in parts[j]:
                    node = node.get(w)
                    if node is None:
                        break
                if node is None:
                    break
                j += 1
                if None in node and parts[j - 1]:
                    best = (node[None], i, j)
            if best and parts[i]:
                end = cut[best[2] - 1]
                out.append((*best, cut[i][0], cut[i][0] + len(text[cut[i][0] : end[1]].rstrip())))
                i = best[2]
            else:
                i += 1
        return out

    def match(self, text: str, gap: int) -> list[tuple[str, str, list[str], int, int]]:
        """(licence, rule, identifiers, start, end) of the rules that match, in order."""
        found, out, used = self.sentences(text), [], set()
        for i, s in enumerate(found):
            if i in used:
                continue
            for licence, rule, ids in self.rules.get(s[0], ()):
                taken, at = [i], i
                for want in ids[1:]:
                    nxt = next((k for k in range(at + 1, len(found)) if k not in used and found[k][0] == want and found[k][1] - found[at][2] <= gap), None)
                    if nxt is None:
                        break
                    taken.append(nxt)
                    at = nxt
                if len(taken) == len(ids):
                    used.update(taken)
                    out.append((licence, rule, list(ids), s[3], found[at][4]))
                    break
        return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", gap: int = 6) -> DataFrame:
    """(key, licence, rule, sentences, start, end), a row for each place; places in code points, end exclusive."""

    def run(batches):
        rules = Rules()
        for b in batches:
            row, got = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                for m in rules.match(t, gap):
                    row.append(i)
                    got.append(m)
            columns = [pa.array([g[c] for g in got], t) for c, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row, pa.int64())), *columns], names=[key, "licence", "rule", "sentences", "start", "end"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, licence string, rule string, sentences array<string>, start int, end int"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").rlike(TELLING)).mapInArrow(tidy(run), schema)
