"""Operator 1 - licence scan by template-markup matching.

A template is licence wording with marked regions: ``<<beginOptional>>`` ..
``<<endOptional>>`` may be left out, ``<<var;match=a|b>>`` is one of the listed
words and ``<<var;words=m-n>>`` any m to n words. Each template is compiled to
an automaton over word tokens; a text is accepted where the mandatory wording
stands word for word. All templates run as one automaton whose states are sets
of template positions, built as they are met.

Edge cases: null or empty text has no words, no labels and score 0; words are
case-folded for A-Z only; texts of any length are read whole (memory follows
the largest text of a batch); repeated ids or rows give one output row each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rolloutlab.llm.common import id_text, table
from rolloutlab.llm.vectext import LOWER, chunks, span_hashes, text_bytes, word_spans

# The wording to look for (fixed values): base phrases first, then templates. A "-notice" or "-tag" is a short mention,
# a "-header" the whole wording that a licence asks for in source files, a "-text" the whole licence below its copyright line.
BASE = {
    "mit": "under the MIT license",
    "apache-2": "Apache License Version 2",
    "cc-by-nc": "CC BY NC",
}
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
          " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE")
_DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
              " conditions are met: <<beginOptional>><<var;match=1|a>><<endOptional>> Redistributions of source code must retain the above"
              " copyright notice, this list of conditions and the following disclaimer. <<beginOptional>><<var;match=2|b>><<endOptional>>"
              " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
              " in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = (" <<beginOptional>><<var;match=3|c>><<endOptional>> Neither the <<var;match=name|names>> of <<var;words=1-12>> nor the names of"
              " <<var;words=1-4>> may be used to endorse or promote products derived from this software without specific prior written permission.")
_BSD_WARRANTY = (" THIS SOFTWARE IS PROVIDED BY <<var;words=1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
                 " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL"
                 " <<var;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,"
                 " BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
                 " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
                 " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")
_ISC_GRANT = ("Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or"
              " without fee is hereby granted")
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = (". THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
                 " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT,"
                 " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
                 " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE")


def _gnu(name: str, version: str) -> str:
    """The notice that a licence of the GNU family asks for, with or without later versions."""
    return (f"free software: you can redistribute it and/or modify it under the terms of the {name}"
            f" as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>> version {version} <<beginOptional>>of the"
            " License<<endOptional>> <<beginOptional>>, or (at your option) any later version<<endOptional>>. <<var;words=1-6>> is distributed in"
            " the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
            f" PARTICULAR PURPOSE. See the {name} for more details")


def _creative(terms: str) -> str:
    return f"licensed under <<var;match=a|the>> Creative Commons {terms} 4.0 International <<beginOptional>>Public<<endOptional>> License"


TEMPLATES = {
    "0bsd-text": _ISC_GRANT + _ISC_WARRANTY,
    "agpl-3.0-header": _gnu("GNU Affero General Public License", "3"),
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use <<var;words=1-4>> except in compliance with"
                         " the License. You may obtain a copy of the License at <<var;match=http|https>>://www.apache.org/licenses/LICENSE-2.0"
                         " <<beginOptional>>.txt<<endOptional>> <<beginOptional>>html<<endOptional>> Unless required by applicable law or agreed to in writing,"
                         " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
                         " KIND, either express or implied. See the License for the specific language governing permissions and limitations"
                         " under the License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>",
    "bsd-2-clause-text": _BSD_GRANT + _BSD_WARRANTY,
    "bsd-3-clause-text": _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY,
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"
                    " documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the"
                    " Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to"
                    " do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above"
                    " license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in"
                    " part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of"
                    f" machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT"
                    " SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN"
                    f" CONTRACT, TORT OR OTHERWISE, {_DEALINGS}",
    "cc-by-4.0-header": _creative("Attribution"),
    "cc-by-nc-4.0-header": _creative("Attribution-NonCommercial"),
    "cc-by-nc-4.0-notice": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"
                           " <<beginOptional>>International<<endOptional>> <<beginOptional>>license<<endOptional>>",
    "cc-by-nc-nd-4.0-header": _creative("Attribution-NonCommercial-<<var;match=NoDerivatives|NoDerivs>>"),
    "cc-by-nc-sa-4.0-header": _creative("Attribution-NonCommercial-ShareAlike"),
    "cc-by-nd-4.0-header": _creative("Attribution-<<var;match=NoDerivatives|NoDerivs>>"),
    "cc-by-sa-4.0-header": _creative("Attribution-ShareAlike"),
    "gpl-2.0-header": _gnu("GNU General Public License", "2"),
    "gpl-3.0-header": _gnu("GNU General Public License", "3"),
    "gpl-3.0-notice": "This <<var;match=work|program|software|file>> is licensed under the GNU General Public License, version 3"
                      " <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "isc-text": _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY,
    "lgpl-2.1-header": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _gnu("GNU Lesser General Public License", "3"),
    "mit-notice": "<<var;match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
                " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
                " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
                " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
                " copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be"
                f" included in all copies or substantial portions of the Software. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1-12>>"
                " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
                f" {_DEALINGS}",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
                      " with this file, You can obtain one at <<var;match=http|https>>://mozilla.org/MPL/2.0",
    "spdx-tag": "SPDX License Identifier <<var;words=1-4>>",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
                      " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
                      " non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software"
                      " dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of"
                      " the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of"
                      " relinquishment in perpetuity of all present and future rights to this software under copyright law."
                      f" {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
                      f" WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will <<var;words=1-6>> be held liable for any"
                 " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
                 " commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
                 " <<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the"
                 " original software. If you use this software in a product, an <<var;match=acknowledgment|acknowledgement>> in the product"
                 " documentation would be appreciated but is not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly"
                 " marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may"
                 " not be removed or altered from any source distribution",
}

WORD_BYTE = np.ones(256, bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD_BYTE[lo:hi + 1] = False
_MARK = re.compile(r"<<(.*?)>>")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, matches array<struct<label:string,start:bigint,end:bigint>>")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def parse(template: str) -> list:
    """Nested list of ('word', w), ('any', m, n), ('one', {words}) and ('opt', [...])."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(template), None]:
        stack[-1] += [("word", w) for w in words_of(template[at:m.start() if m else len(template)])]
        if m is None:
            break
        at, tag = m.end(), m.group(1)
        if tag == "beginOptional":
            stack.append([])
        elif tag == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif found := re.fullmatch(r"var;match=([\w|-]+)", tag):
            stack[-1].append(("one", frozenset(found.group(1).lower().encode().split(b"|"))))
        elif found := re.fullmatch(r"var;words=(\d+)-(\d+)", tag):
            stack[-1].append(("any", int(found.group(1)), int(found.group(2))))
        else:
            raise ValueError(f"unknown mark {tag!r}")
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def regex(items: list) -> str:
    """The same template as a regular expression over words that each end in a blank (for SQL)."""
    out = ""
    for kind, *x in items:
        if kind == "word":
            out += re.escape(x[0].decode()).replace("\\-", "-") + " "
        elif kind == "one":
            out += "(?:" + "|".join(sorted(w.decode() for w in x[0])) + ") "
        elif kind == "any":
            out += f"(?:[^ ]+ ){{{x[0]},{x[1]}}}"
        else:
            out += f"(?:{regex(x[0])})?"
    return out


@dataclass
class Automaton:
    """Token automaton of many templates; deterministic states are made on demand."""
    edges: list[list[tuple[frozenset | None, int]]] = field(default_factory=list)   # None: any word
    skips: list[list[int]] = field(default_factory=list)
    accept: dict[int, str] = field(default_factory=dict)
    roots: list[int] = field(default_factory=list)
    alphabet: set[bytes] = field(default_factory=set)
    memo: dict = field(default_factory=dict)

    def _node(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _chain(self, items: list, node: int) -> int:
        for kind, *x in items:
            if kind == "opt":
                end = self._chain(x[0], node)
                out = self._node()
                self.skips[node].append(out)
                self.skips[end].append(out)
                node = out
            elif kind == "any":
                ends = [node] if x[0] == 0 else []
                for i in range(x[1]):
                    nxt = self._node()
                    self.edges[node].append((None, nxt))
                    node = nxt
                    if i + 1 >= x[0]:
                        ends.append(node)
                out = self._node()
                for e in ends:
                    self.skips[e].append(out)
                node = out
            else:
                some = frozenset([x[0]]) if kind == "word" else x[0]
                self.alphabet |= some
                nxt = self._node()
                self.edges[node].append((some, nxt))
                node = nxt
        return node

    def add(self, label: str, items: list) -> None:
        root = self._node()
        self.roots.append(root)
        self.accept[self._chain(items, root)] = label

    def closed(self, nodes) -> frozenset:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for n in self.skips[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def step(self, state: frozenset, word: bytes) -> frozenset:
        key = (state, word if word in self.alphabet else None)
        nxt = self.memo.get(key)
        if nxt is None:
            nxt = self.memo[key] = self.closed({to for n in state for some, to in self.edges[n] if some is None or word in some})
        return nxt

    def first_words(self) -> set[bytes]:
        """Words a match can begin with; a template must begin with wording."""
        out: set[bytes] = set()
        for n in self.closed(self.roots):
            for some, _ in self.edges[n]:
                if some is None:
                    raise ValueError("a template must begin with a word, not a free region")
                out |= some
        return out

    def match(self, words, at: int) -> dict[str, int]:
        """Labels of templates that match from word ``at``, with the end of their longest match."""
        state, found, i = self.closed(self.roots), {}, at
        while state:
            for n in state & self.accept.keys():
                if i > at:
                    found[self.accept[n]] = i
            if i >= len(words):
                break
            state = self.step(state, words[i])
            i += 1
        return found


def build(base: dict[str, str], templates: dict[str, str]) -> Automaton:
    auto = Automaton()
    for prefix, group in (("b:", base), ("t:", templates)):
        for label, text in group.items():
            auto.add(prefix + label, parse(text))
    auto.first_words()
    return auto


class _Words:
    """Words of one text, decoded only where the automaton looks."""

    def __init__(self, data, starts, ends):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self):
        return len(self.starts)

    def __getitem__(self, i):
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of every whole text, one row per input row.

    ``score`` is 1 where a whole template matches, 0.5 where only a base
    phrase stands, else 0. Every template or phrase keeps its longest match
    per start in ``matches`` (label, first word, word after the last)."""

    def run(batches):
        auto = build(base, templates)
        first = np.array(sorted(auto.first_words()), object)
        raw = b"".join(first)
        ends = np.cumsum([len(w) for w in first]).astype(np.int64) if len(first) else np.empty(0, np.int64)
        begin = np.unique(span_hashes(np.frombuffer(raw, np.uint8), ends - np.array([len(w) for w in first], np.int64), ends)) \
            if len(first) else np.empty(0, np.uint64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n = batch.num_rows
            counts = np.zeros(n, np.int64)
            hits: dict[int, list[tuple[str, int, int]]] = {}
            for lo, hi in chunks(offsets):
                part = LOWER[data[offsets[lo]:offsets[hi]]]
                starts, stops, rows = word_spans(part, offsets[lo:hi + 1] - offsets[lo], WORD_BYTE)
                counts[lo:hi] = np.bincount(rows, minlength=hi - lo)
                bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
                for at in np.flatnonzero(np.isin(span_hashes(part, starts, stops), begin)):
                    row = rows[at]
                    a, b = bounds[row], bounds[row + 1]
                    for label, end in auto.match(_Words(part, starts[a:b], stops[a:b]), int(at - a)).items():
                        hits.setdefault(lo + int(row), []).append((label, int(at - a), end))
            cols: dict[str, list] = {k: [] for k in ("n_base", "first", "last", "base", "labels", "score", "matches")}
            for i in range(n):
                found = sorted(hits.get(i, ()), key=lambda m: (m[1], m[0]))
                places = [m[1] for m in found if m[0][:2] == "b:"]
                names = {m[0][2:] for m in found if m[0][:2] == "b:"}
                own = {m[0][2:] for m in found if m[0][:2] == "t:"}
                cols["n_base"].append(len(places))
                cols["first"].append(min(places, default=None))
                cols["last"].append(max(places, default=None))
                cols["base"].append(",".join(sorted(names)))
                cols["labels"].append(",".join(sorted(names | own)))
                cols["score"].append(1.0 if own else 0.5 if names else 0.0)
                cols["matches"].append([{"label": m[0][2:], "start": m[1], "end": m[2]} for m in found])
            ints = pa.int64()
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", ints), ("end", ints)]))
            yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(cols["n_base"], ints), pa.array(cols["first"], ints),
                                   pa.array(cols["last"], ints), pa.array(cols["base"], pa.string()),
                                   pa.array(cols["labels"], pa.string()), pa.array(cols["score"], pa.float64()),
                                   pa.array(cols["matches"], kind)],
                                  names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("matches")


def _oracle() -> str:
    words = {k: [w.decode() for w in words_of(v)] for k, v in BASE.items()}
    at = {k: " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(ws)) for k, ws in words.items()}
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {c}) AS p_{j}" for j, c in enumerate(at.values()))
    allp = " || ".join(f"p_{j}" for j in range(len(at)))
    base = ", ".join(f"CASE WHEN len(p_{j}) > 0 THEN '{k}' END" for j, k in enumerate(at))
    own = ", ".join(f"CASE WHEN regexp_matches(s, ' {regex(parse(t))}') THEN '{k}' END" for k, t in TEMPLATES.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {places} FROM w),
l AS (SELECT doc_id, len(w) AS n_words, {allp} AS places,
        list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{own}], lambda x: x IS NOT NULL) AS o FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word,
       list_max(places) - 1 AS last_word, array_to_string(list_sort(b), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(b || o)), ',') AS labels,
       CASE WHEN len(o) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM l"""


ORACLE = _oracle()
