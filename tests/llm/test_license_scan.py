"""Operator 1: the automaton against regular expressions, edge rows, and the query against its SQL."""

import random
import re

import pytest

from rolloutlab.llm import license_scan as ls
from rolloutlab.plans.compare import compare, duck


def test_automaton_equals_regular_expression():
    template = "a <<var;match=b|c>> <<beginOptional>>d <<beginOptional>>e<<endOptional>> f<<endOptional>> <<var;words=1-2>> g"
    items = ls.parse(template)
    auto, pattern = ls.build({}, {"t": template}), re.compile(ls.regex(items))
    rng = random.Random(0)
    hits = 0
    for _ in range(6000):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        got = "t:t" in auto.match([w.encode() for w in words], 0)
        want = pattern.match("".join(w + " " for w in words)) is not None
        assert got == want, words
        hits += got
    assert hits > 5


def filled(items, rng):
    """Words of a random text that the template accepts."""
    out = []
    for kind, *x in items:
        if kind == "word":
            out.append(x[0].decode())
        elif kind == "one":
            out.append(rng.choice(sorted(x[0])).decode())
        elif kind == "any":
            out += [f"holder{rng.randrange(9)}" for _ in range(rng.randint(*x))]
        elif rng.random() < 0.5:
            out += filled(x[0], rng)
    return out


@pytest.mark.parametrize("label", sorted(ls.TEMPLATES))
def test_whole_wording_is_accepted_and_a_changed_word_is_judged_as_the_regular_expression_does(label):
    items, rng = ls.parse(ls.TEMPLATES[label]), random.Random(label)
    auto, pattern = ls.build({}, {label: ls.TEMPLATES[label]}), re.compile(ls.regex(items))
    refused = 0
    for _ in range(60):
        words = filled(items, rng)
        assert auto.match([w.encode() for w in words + ["more"]], 0).get("t:" + label, 0) >= len(words)
        words[rng.randrange(len(words))] = "changed"
        got = "t:" + label in auto.match([w.encode() for w in words], 0)
        assert got == (pattern.match("".join(w + " " for w in words)) is not None), words
        refused += not got
    assert refused > 10


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("text, labels", [
    (MIT, "mit-text"),
    (MIT.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "ACME, INC. OR ITS AUTHORS"), "mit-text"),
    (MIT.replace("WITHOUT WARRANTY", "WITH WARRANTY"), ""),
    (MIT[:MIT.index("THE SOFTWARE IS")], ""),
    (MIT.replace(", free of charge,", ""), ""),
    (GPL, "gpl-3.0-header"),
    (GPL.replace(", or\n(at your option) any later version", ""), "gpl-3.0-header"),
    (GPL.replace("General", "Lesser General"), "lgpl-3.0-header"),
    (GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), "gpl-2.0-header"),
    (GPL.replace("WITHOUT ANY WARRANTY", "WITH A WARRANTY"), ""),
    (APACHE, "apache-2,apache-2.0-header,apache-2.0-notice"),
    (APACHE.replace("Unless", "Even if"), "apache-2,apache-2.0-notice"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0-header"),
])
def test_real_wording(text, labels):
    auto = ls.build(ls.BASE, ls.TEMPLATES)
    words = ls.words_of("(c) 2020 someone " + text + " end")
    assert ",".join(sorted({k[2:] for at in range(len(words)) for k in auto.match(words, at)})) == labels


@pytest.mark.parametrize("bad", ["<<endOptional>> x", "<<beginOptional>> x", "a <<what>>"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        ls.parse(bad)


def test_template_must_begin_with_wording():
    with pytest.raises(ValueError):
        ls.build({}, {"t": "<<var;words=0-3>> a"})


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "Under the MIT-License; under THE mit license", 2), (3, "x", 3), (None, "CC BY-NC 4.0", 4),
            (5, "word " * 50_000 + "apache license, version 2", 5), (6, "under the mit", 6), (6, "under the mit", 6),
            (7, "This work is licensed under the GNU General Public License, version 3 or any later version", 7)]
    out = ls.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, labels int")).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in out}
    assert by[1, 0].labels == "" and by[1, 0].first_word is None and by[1, 0].score == 0.0
    two = by[3, 8]
    assert (two.n_base, two.first_word, two.last_word, two.base_labels) == (2, 0, 4, "mit")
    far = by[5, 50_004]
    assert (far.first_word, far.base_labels) == (50_000, "apache-2")
    assert by[7, 16].labels == "gpl-3.0-notice" and by[7, 16].base_labels == ""
    assert sum(r.doc_id == 6 for r in out) == 2
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    res = compare(spark, duck(sf), "op1", ls.op1_license_scan, ls.ORACLE, sf)
    assert res["status"] == "match", res
