"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case; lines that are copyright notices
dropped; everything but letters and digits, line breaks too, turned into single spaces;
equivalent spellings made one. So neither case, punctuation nor wrapping make a difference.

The registry is a table of SHA-256 digests of canonical texts: whole licences (files in
``licences`` and the short ones below, each with the headings it goes by and without one),
and the headers and one-line notices by which files name a licence. Documents are
hash-joined to it by the digests of their whole text and of each paragraph and line,
so a licence that is a part of a document is found by the same join. A whole text decides
``licence_id``, else the smallest licence among the parts does.

A copyright notice is a line that starts with the word or the sign and goes on with the
sign, a year, "by" or a placeholder in brackets; prose that happens to be wrapped before
"copyright" stays. A notice of a bare holder, without year or sign, isn't told from prose.

Only parts that hold one of a few words can be in the registry: words, chosen from it, of which
every entry has one. Other parts are not digested, which changes no result.

Everything is built-in expressions over whole texts, made once and written. The registry's rows are counted and
broadcast up to ``REGISTRY_ROWS``; beyond it the joins shuffle digests. Only hits are grouped.

Edge cases: a null text has a null digest and no licence; an empty text, or one of
copyright lines alone, has the digest of the empty string, which is never in the registry;
entries with one canonical form keep the smallest id; ties go to the smallest id; repeated
rows, and rows with a null id, each get a row; very long texts are scanned whole; columns
other than the id and the text are not read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialise

REGISTRY_ROWS = 10_000
# The wording of the licences and of their customary headers and notices.
#: Spellings that make no difference, as (spelling, the one kept), applied in this order to words between single spaces.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("https", "http"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("organisation", "organization"), ("whilst", "while"),
)
NOTICE_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright[ \t]*:?[ \t]*(?:\(c\)|©|[12]\d\d\d|by[ \t]|[<\[{])|\(c\)[ \t]*(?:copyright|[12]\d\d\d|by[ \t])|©|all rights reserved[.]?[ \t\r]*$)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_CONTRIBUTORS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Short licences, as (id, the headings they go by, text).
SHORT = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + _AS_IS),
    ("ISC", ("ISC License", "The ISC License"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), _BSD + _CONTRIBUTORS),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"), _BSD + _THIRD + _CONTRIBUTORS),
    ("Zlib", ("zlib License", "The zlib License"), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", ("The Unlicense",), 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",), 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)
#: Headers and one-line notices that name a licence, as (id, text).
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def long_licences() -> list[tuple[str, str]]:
    """(id, text) of the licences that are files beside this module."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licences").glob("*.txt"))]


def default_registry() -> list[tuple[str, str]]:
    """(id, text) of all that is known."""
    short = [(i, f"{h}\n\n{text}") for i, headings, text in SHORT for h in ("", *headings)]
    return [*short, *long_licences(), *NOTICES]


def canonical(text: str) -> str:
    """The canonical form, in Python; documents get it by the expressions below."""
    kept = _without_notices(text.lower())
    words = " ".join("".join(c if c.isalnum() else " " for c in kept).split())
    for spelling, one in EQUIVALENT:
        words = words.replace(spelling, one)
    return words


_NOTICE = re.compile(r"(copyright[ \t]*:?[ \t]*(\(c\)|©|[12]\d\d\d|by[ \t]|[<\[{])|\(c\)[ \t]*(copyright|[12]\d\d\d|by[ \t])|©|all rights reserved\.?\s*$)", re.ASCII)


def _without_notices(text: str) -> str:
    out = []
    for line in text.split("\n"):
        start = next((k for k, c in enumerate(line) if c.isalnum() or c in "(©"), len(line))
        if not _NOTICE.match(line, start):
            out.append(line)
    return "\n".join(out)


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical(text).encode("utf-8", "surrogatepass")).hexdigest()


def registry_rows(registry: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(digest, id), each digest once."""
    known: dict[str, str] = {}
    for i, text in default_registry() if registry is None else registry:
        if canonical(text):
            known[digest_of(text)] = min(i, known.get(digest_of(text), i))
    return sorted(known.items())


def marker_words(texts: list[str]) -> list[str]:
    """A few words of which each canonical text has one, whatever its spelling before; '' where there is none for a text."""
    made = {w for pair in EQUIVALENT for half in pair for w in half.split()}
    left = [{w for w in canonical(t).split() if len(w) > 3 and not any(m in w or w in m for m in made)} for t in texts if canonical(t)]
    out = []
    while left:
        counts = Counter(w for own in left for w in own)
        if not counts:
            return [""]
        best = min(counts, key=lambda w: (-counts[w], w))
        out.append(best)
        left = [own for own in left if best not in own]
    return out


def _worded(text: Column) -> Column:
    """Lower-case words and line breaks, without copyright notices."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE_LINE, ""), NOT_WORD, " ")


def _folded(worded: Column) -> Column:
    """Words between single spaces, in one spelling."""
    c = F.trim(F.regexp_replace(worded, r"[ \n]+", " "))
    for spelling, kept in EQUIVALENT:
        c = F.replace(c, F.lit(spelling), F.lit(kept))
    return c


def _digest(folded: Column) -> Column:
    return F.sha2(folded.cast("binary"), 256)


def licence_scan(docs: DataFrame, registry: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of the whole canonical text, licence_id, matched ('text' if the whole text is
    known, else 'part' if a paragraph or line is), and part_ids: the sorted licences of those, joined by commas ('' for none)."""
    rows, markers = registry_rows(registry), marker_words([t for _, t in (default_registry() if registry is None else registry)])
    marked = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers], F.lit(False))
    known = docs.sparkSession.createDataFrame(rows, "known string, known_id string")
    known = F.broadcast(known) if len(rows) <= REGISTRY_ROWS else known
    worded = docs.select(F.col(id_col).alias("_id"), _worded(F.col(text_col)).alias("_worded"))
    parts = F.filter(F.array_distinct(F.concat(F.split("_worded", "\n"), F.split("_worded", r"\n[ \n]*\n"))), marked)
    digests = F.when(marked(F.col("_worded")), F.transform(parts, lambda p: _digest(_folded(p)))).otherwise(F.array().cast("array<string>"))
    scanned = materialise(worded.select("_id", _digest(_folded(F.col("_worded"))).alias("digest"), digests.alias("_parts")), "digests")
    # rows of one id and one text have the same parts, so hits are kept by both
    hits = scanned.select(F.col("_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.explode("_parts").alias("part")).join(known, F.col("part") == F.col("known"))
    found = hits.groupBy("hit_id", "hit_digest").agg(F.array_sort(F.collect_set("known_id")).alias("ids"))
    whole = scanned.select("_id", "digest").join(known, F.col("digest") == F.col("known"), "left").withColumnRenamed("known_id", "whole_id")
    joined = whole.join(found, whole["_id"].eqNullSafe(found["hit_id"]) & (whole["digest"] == found["hit_digest"]), "left")
    matched = F.when(F.col("whole_id").isNotNull(), "text").when(F.col("ids").isNotNull(), "part")
    return joined.select(F.col("_id").alias(id_col), "digest", F.coalesce("whole_id", F.col("ids")[0]).alias("licence_id"), matched.alias("matched"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("part_ids"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL over the documents table: lines are judged one by one, and words gathered."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(d)}, {quoted(i)})" for d, i in registry_rows())
    words = "array_to_string(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), ' ')"

    def one(c: str) -> str:
        c = words.format(c)
        for spelling, kept in EQUIVALENT:
            c = f"replace({c}, {quoted(spelling)}, {quoted(kept)})"
        return c

    return f"""
        WITH known(digest, licence_id) AS (VALUES {rows}),
        lines AS (
            SELECT row_number() OVER () AS r, doc_id, text IS NULL AS none, list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda l:
                NOT regexp_matches(regexp_replace(l, '^[^\\p{{L}}\\p{{N}}(©]*', ''), '^(copyright[ \\t]*:?[ \\t]*(\\(c\\)|©|[12][0-9][0-9][0-9]|by[ \\t]|[<\\[{{])|\\(c\\)[ \\t]*(copyright|[12][0-9][0-9][0-9]|by[ \\t])|©|all rights reserved[.]?\\s*$)')) AS own
            FROM documents),
        whole AS (SELECT r, doc_id, CASE WHEN NOT none THEN sha256({one("array_to_string(own, ' ')")}) END AS digest, own FROM lines),
        numbered AS (SELECT r, unnest(own) AS line, generate_subscripts(own, 1) AS k FROM whole),
        marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '[\\p{{L}}\\p{{N}}]') THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS paragraph FROM numbered),
        parts AS (
            SELECT r, sha256({one("line")}) AS digest FROM marked
            UNION SELECT r, sha256({one("string_agg(line, ' ' ORDER BY k)")}) FROM marked GROUP BY r, paragraph),
        hits AS (SELECT r, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS part_ids, min(licence_id) AS least FROM parts JOIN known USING (digest) GROUP BY r)
        SELECT w.doc_id, w.digest, coalesce(k.licence_id, h.least) AS licence_id,
            CASE WHEN k.licence_id IS NOT NULL THEN 'text' WHEN h.least IS NOT NULL THEN 'part' END AS matched, coalesce(h.part_ids, '') AS part_ids
        FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN hits h ON w.r = h.r"""
