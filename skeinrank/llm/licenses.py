"""License scans by sentence rules.

A text is split into parts at punctuation and line ends; the words from the start of a part on are looked up in a
table of known licence sentences, over whatever punctuation and line ends stand between them, up to the end of a part.  What is left of a text is its ordered sequence of sentence identifiers; licence rules
are ordered identifier sequences, matched against it with the most specific rule first.  A part that no known sentence
explains is reported as ``unknown-notice`` if it speaks of a licence; a machine-readable tag is its expression.

Edge cases: null or empty texts have no sentences and no licence; a sentence counts wherever it stands
and as often as it stands; rules never overlap, earlier and longer ones win; equal texts give equal rows;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

# Known licence sentences, as words (see words()), and their identifiers.  {v} stands for a version number.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2": "apache-under",
    "licensed under the apache license version 2 the license": "apache-under",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2": "apache-obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-under",
    "licensed under the mit license": "mit-under",
    "this project is licensed under the mit license": "mit-under",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version {v}": "gpl-under",
    "licensed under the gnu general public license version {v}": "gpl-under",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version": "gpl-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "see the gnu general public license for more details": "gpl-see",
    "this work is licensed under the gnu lesser general public license version {v}": "lgpl-under",
    "this work is licensed under the gnu affero general public license version {v}": "agpl-under",
    "this source code form is subject to the terms of the mozilla public license {v}": "mpl-subject",
    "licensed under cc by {v}": "cc-by", "licensed under cc by sa {v}": "cc-by-sa", "licensed under cc by nc {v}": "cc-by-nc",
    "licensed under cc by nd {v}": "cc-by-nd", "licensed under cc by nc sa {v}": "cc-by-nc-sa", "licensed under cc by nc nd {v}": "cc-by-nc-nd",
    "this work is licensed under a creative commons attribution {v} international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike {v} international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial {v} international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "all rights reserved": "all-rights",
    "mit license": "mit-title", "the mit license": "mit-title",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "licensed under the bsd 3 clause license": "bsd-3-under", "licensed under the bsd 2 clause license": "bsd-2-under",
    "boost software license version 1": "boost-title", "distributed under the boost software license version 1": "boost-under",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "gnu general public license version {v}": "gpl-title", "gnu lesser general public license version {v}": "lgpl-title",
    "gnu library general public license version {v}": "lgpl-title", "gnu affero general public license version {v}": "agpl-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version {v} of the license": "gpl-exact",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version": "lgpl-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {v} of the license or at your option any later version": "agpl-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "licensed under the gnu lesser general public license version {v}": "lgpl-under", "licensed under the gnu affero general public license version {v}": "agpl-under",
    "mozilla public license version {v}": "mpl-title", "licensed under the mozilla public license version {v}": "mpl-under",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2": "mpl-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2": "mpl-obtain",
    "eclipse public license {v}": "epl-title", "eclipse public license version {v}": "epl-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license {v} which accompanies this distribution": "epl-available",
    "this program and the accompanying materials are made available under the terms of the eclipse public license {v}": "epl-available",
    "this program and the accompanying materials are made available under the terms of the eclipse public license {v} which is available at": "epl-available",
    "apache license version 2": "apache-title",
    "licensed under cc0 {v}": "cc0", "cc0 {v} universal": "cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "this work is licensed under a creative commons attribution noderivatives {v} international license": "cc-by-nd",
    "this work is licensed under a creative commons attribution noncommercial sharealike {v} international license": "cc-by-nc-sa",
    "this work is licensed under a creative commons attribution noncommercial noderivatives {v} international license": "cc-by-nc-nd",
    "this font software is licensed under the sil open font license version {v}": "ofl-under", "sil open font license version {v}": "ofl-title",
    "licensed under the eupl version {v}": "eupl-under", "licensed under the isc license": "isc-under", "isc license": "isc-title",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "the artistic license {v}": "artistic-title", "licensed under the artistic license {v}": "artistic-under",
    "do what the fuck you want to public license": "wtfpl-title",
}
# Licence rules as ordered sequences of sentence identifiers; {v} takes the version of the first sentence that has one.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache-under", "apache-comply", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-under", "apache-comply", "apache-obtain")),
    ("Apache-2.0", ("apache-under",)),
    ("MIT", ("mit-under", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-under",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-{v}-or-later", ("gpl-later", "gpl-hope", "gpl-see")),
    ("GPL-{v}-or-later", ("gpl-later",)),
    ("GPL-{v}-only", ("gpl-under",)),
    ("LGPL-{v}-only", ("lgpl-under",)),
    ("AGPL-{v}-only", ("agpl-under",)),
    ("MPL-{v}", ("mpl-subject",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-{v}", ("cc-by",)), ("CC-BY-SA-{v}", ("cc-by-sa",)), ("CC-BY-NC-{v}", ("cc-by-nc",)),
    ("CC-BY-ND-{v}", ("cc-by-nd",)), ("CC-BY-NC-SA-{v}", ("cc-by-nc-sa",)), ("CC-BY-NC-ND-{v}", ("cc-by-nc-nd",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")), ("MIT", ("mit-title", "mit-grant")), ("MIT", ("mit-title",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source")), ("BSD-style", ("bsd-grant",)), ("BSD-style", ("bsd-as-is",)), ("BSD-3-Clause", ("bsd-3-under",)), ("BSD-2-Clause", ("bsd-2-under",)),
    ("BSL-1.0", ("boost-title", "boost-grant")), ("BSL-1.0", ("boost-title",)), ("BSL-1.0", ("boost-under",)), ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")), ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")), ("Zlib", ("zlib-grant",)),
    ("GPL-{v}-only", ("gpl-exact", "gpl-hope", "gpl-see")), ("GPL-{v}-only", ("gpl-exact",)), ("GPL-{v}", ("gpl-title",)),
    ("LGPL-{v}-or-later", ("lgpl-later", "lgpl-hope", "lgpl-see")), ("LGPL-{v}-or-later", ("lgpl-later",)), ("LGPL-{v}", ("lgpl-title",)),
    ("AGPL-{v}-or-later", ("agpl-later", "gpl-hope", "agpl-see")), ("AGPL-{v}-or-later", ("agpl-later",)), ("AGPL-{v}", ("agpl-title",)),
    ("MPL-{v}", ("mpl-subject", "mpl-obtain")), ("MPL-{v}", ("mpl-title",)), ("MPL-{v}", ("mpl-under",)),
    ("EPL-{v}", ("epl-title", "epl-available")), ("EPL-{v}", ("epl-available",)), ("EPL-{v}", ("epl-title",)),
    ("Apache-2.0", ("apache-title", "apache-under", "apache-comply", "apache-obtain", "apache-as-is", "apache-see")), ("Apache-2.0", ("apache-title",)),
    ("CC0-{v}", ("cc0", "cc0-waiver")), ("CC0-{v}", ("cc0",)), ("CC0-{v}", ("cc0-waiver",)),
    ("OFL-{v}", ("ofl-under", "ofl-title")), ("OFL-{v}", ("ofl-under",)), ("OFL-{v}", ("ofl-title",)), ("EUPL-{v}", ("eupl-under",)),
    ("ISC", ("isc-title", "isc-grant", "isc-as-is")), ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-title",)), ("ISC", ("isc-under",)),
    ("Artistic-{v}", ("artistic-title",)), ("Artistic-{v}", ("artistic-under",)), ("WTFPL", ("wtfpl-title",)),
    ("Proprietary", ("all-rights",)),
]
UNKNOWN, TAGGED = "unknown-notice", "spdx-tag"

_WORD = re.compile(r"(?<![0-9a-z.])v?([0-9]+(?:\.[0-9]+)*)(?![0-9a-z])|[a-z0-9]+", re.IGNORECASE | re.ASCII)
_ATOM = re.compile(r"(?:[^.!?;:\n]|[.](?=[0-9A-Za-z])|:(?=//))+")
_NOTICE = re.compile(r"\b(?:un)?licen[sc]ed? (?:under|by)\b", re.IGNORECASE)
_UNDER, _LICENSE = re.compile(r"\bunder the\b", re.IGNORECASE), re.compile(r"\blicen[sc]e\b", re.IGNORECASE)
_PAUSE = re.compile(r"[\"')]*\s*[,(\u2013\u2014]|\s+-")
#: A machine-readable tag: identifiers joined by AND, OR and WITH, in brackets or not.
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)")
#: Every known sentence and every notice holds one of these (in lower case), so texts without are done.
_HINTS = (b"licen", b"permi", b"redistribut", b"reserved", b"warrant", b"unencumbered", b"notice", b"endorse", b"liab", b"origin", b"advertis", b"universal", b"waived", b"mpl", b"eupl", b"cc0")


def words(text: str, start: int, most: int) -> list[tuple[str, str | None, int, int]]:
    """(word, version, start, end) of up to so many words from a place on: lower case, one spelling of licence, a version's number apart and without its v."""
    found = (m for m in _WORD.finditer(text, start) if m[0] not in ("v", "V"))
    return [(m[0].lower().replace("licence", "license"), m[1], *m.span()) for m in islice(found, most)]


#: The known sentences by their first two words (# for any version), longest first.
_BY_OPENING: dict[tuple[str, ...], list[tuple[list[str], str]]] = {}
for _sentence, _identifier in sorted(SENTENCES.items(), key=lambda x: -len(x[0].split())):
    _BY_OPENING.setdefault(tuple("#" if w == "{v}" or w.isdigit() else w for w in _sentence.split()[:2]), []).append((_sentence.split(), _identifier))


def _fits(want: str, word: str, version: str | None) -> bool:
    """{v} is any version; a number is itself, with or without .0."""
    if version is None:
        return want == word
    return want == "{v}" or want == re.sub(r"\.0\b", "", version)


def _is_notice(text: str, start: int, end: int) -> bool:
    """Whether a part of a text speaks of a licence: "licensed under", or "under the ... licence"."""
    if _NOTICE.search(text, start, end):
        return True
    under = _UNDER.search(text, start, end)
    return under is not None and _LICENSE.search(text, under.end(), end) is not None


def identified(text: str) -> list[tuple[str, str | None, int, int]]:
    """(identifier, version, start, end) of each known sentence, tag and unknown notice, in text order.

    A known sentence starts where a part of the text starts, ends where one ends or at a comma, bracket or dash, and may hold any number
    of parts and lines; the longest one counts.  Of a tag the version is its expression.
    """
    out, i = [], 0
    tags = [(TAGGED, re.sub(r"\s+", " ", m[1]), *m.span()) for m in _TAG.finditer(text)] if "SPDX-" in text else []
    atoms = [m.span() for m in _ATOM.finditer(text)]
    while i < len(atoms):
        start, end = atoms[i]
        found = None
        known = _BY_OPENING.get(tuple("#" if v else w for w, v, _, _ in words(text, start, 2)), ())
        if known and _WORD.search(text, start, end):
            some = words(text, start, len(known[0][0]) + 1)
            for sentence, identifier in known:
                n = len(sentence)
                if len(some) < n or not all(_fits(x, w, v) for x, (w, v, _, _) in zip(sentence, some, strict=False)):
                    continue
                j = bisect_left(atoms, some[n - 1][3], lo=i, key=lambda a: a[1])  # the part that the last word ends in
                if len(some) == n or some[n][2] >= atoms[j][1] or _PAUSE.match(text, some[n - 1][3]):
                    found = identifier, next((v for _, v, _, _ in some[:n] if v), None), j
                    break
        if found:
            identifier, version, i = found
        elif not any(a < end and start < b for _, _, a, b in tags) and _is_notice(text, start, end):
            identifier, version = UNKNOWN, None
        else:
            i += 1
            continue
        end = atoms[i][1]
        out.append((identifier, version, start + len(text[start:end]) - len(text[start:end].lstrip()), start + len(text[start:end].rstrip())))
        i += 1
    return sorted([*out, *tags], key=lambda x: (x[2], x[3])) if tags else out


_BY_FIRST: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _name, _rule in RULES:
    _BY_FIRST.setdefault(_rule[0], []).append((_name, _rule))


for _rules in _BY_FIRST.values():
    _rules.sort(key=lambda x: -len(x[1]))


def match_rules(found: list[tuple[str, str | None, int, int]]) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, sentences) of the rules that match the identifier sequence.

    From left to right, the longest rule that starts with a sentence counts.  Between two of its sentences others may stand, but none
    that starts a rule itself, unless the rule has it further on, and no notice or tag.
    """
    out, used = [], set()
    for i, (identifier, version, start, end) in enumerate(found):
        if i in used:
            continue
        if identifier in (UNKNOWN, TAGGED):
            out.append((version if identifier == TAGGED else UNKNOWN, start, end, 1))
            continue
        for name, rule in _BY_FIRST.get(identifier, ()):
            taken = [i]
            for j in range(i + 1, len(found)):
                if len(taken) == len(rule):
                    break
                other = found[j][0]
                if other == rule[len(taken)]:
                    taken.append(j)
                elif other in (UNKNOWN, TAGGED) or other in _BY_FIRST and other not in rule[len(taken) :]:
                    break
            if len(taken) == len(rule):
                used.update(taken)
                version = next((found[j][1] for j in taken if found[j][1]), None)
                if "{v}" in name and version and "." not in version:
                    version += ".0"
                out.append((name.replace("{v}", version or "any"), found[i][2], found[taken[-1]][3], len(rule)))
                break
    return out


def scan_text(text: str | None) -> list[tuple[str, int, int, int]]:
    return match_rules(identified(text or ""))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        texts = at.strings(batch.column(1))
        raw, off = at.utf8(texts)
        flagged: set[int] = set()
        for a, b in at.slices(off):
            data = at.LOWER[raw[off[a] : off[b]]].tobytes()
            for hint in _HINTS:
                where = data.find(hint)
                while where >= 0:
                    row = a + int(np.searchsorted(off[a : b + 1] - off[a], where, side="right")) - 1
                    flagged.add(row)
                    where = data.find(hint, max(where + 1, int(off[row + 1] - off[a])))
        found = [scan_text(texts[i].as_py()) if i in flagged else [] for i in range(len(texts))]
        names = [sorted({x[0] for x in f}) for f in found]
        spans = [",".join(f"{n}:{s}:{e}" for n, s, e, _ in f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(n) for n in names], pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_matches", "licenses", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_matches, the distinct licences (sorted, comma-joined) and spans (``licence:start:end``, code points) of each row; map-only."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_scan, f"doc_id {kind}, n_matches long, licenses string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
