import re
import textwrap

from helpers import documents

from surfex.llm.license_rules import _HINT, RULES, SENTENCES, recognise
from surfex.llm.queries import QUERIES


def sentences(text):
    for pattern, mark in ((r"([.!?:;])[ \t\n\x0b\f\r]+", "\\1\x01"), (r"\n[ \t\n\x0b\f\r]*\n", "\x01"), (r"\n([ \t]*([0-9]+\.|[*-]) |[A-Z][a-z])", "\x01\\1")):
        text = re.sub(pattern, mark, text)
    out = []
    for s in text.split("\x01"):
        s = re.sub(r"^[ \t\n\x0b\f\r]*([0-9]+\.|[*-])[ \t\n\x0b\f\r]", "", "".join(c.lower() if c.isascii() else c for c in s))
        out.append(re.sub("[^a-z0-9]+", " ", s).strip(" "))
    names = {v: k for k, v in SENTENCES.items()}
    return [names[s] for s in out if s in names]


def licences(ids):
    def met(rule):
        rest = iter(ids)
        return all(any(x == y for y in rest) for x in rule)
    return sorted({n for n, r in RULES if met(r) and not any(m != n and len(q) > len(r) and q[:len(r)] == r and met(q) for m, q in RULES)})


BSD = """Copyright (c) 2020, Someone.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""
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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
"""


def test_rules(spark):
    texts = [BSD, BSD + NAMES, MIT, NAMES + BSD, "x |\nLicensed under the Apache License, Version 2.0.\nthen", "Licensed under CC BY-NC 4.0.", None, "",
             "released under the mit license! " * 30_000, "a license to nothing", BSD + "Released under the MIT License.\nIt is"]
    got = {r.doc_id: (r.sentences, r.licences) for r in recognise(documents(spark, texts)).collect()}
    assert [got[i][0] for i in range(len(texts))] == [sentences(t or "") for t in texts]
    assert [got[i][1] for i in range(len(texts))] == [licences(got[i][0]) for i in range(len(texts))]
    assert [got[i][1] for i in range(6)] == [["BSD-2-Clause"], ["BSD-3-Clause"], ["MIT"], ["BSD-2-Clause"], ["Apache-2.0"], ["CC-BY-NC-4.0"]]
    assert recognise(documents(spark, [])).count() == 0 and recognise(documents(spark, [(None, "x"), (1, MIT), (1, MIT)])).count() == 3


def test_hint_is_in_every_sentence():
    assert all(re.search(_HINT, s) for s in SENTENCES.values()) and {s for _, r in RULES for s in r} == set(SENTENCES)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_license_rules"](spark, folder).collect()
    assert len(rows) == len(texts) and sum(bool(r.licences) for r in rows) > 5
    for r in rows:
        own = sentences(texts[r.doc_id])
        assert (r.n_sentences, r.sentence_ids, r.licences) == (len(own), ",".join(own), ",".join(licences(own)))


AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL = """This program is free software{}you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{}either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
FULL = [("MIT", MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License"), ("ISC", ISC), ("Apache-2.0", APACHE),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("BSD-2-Clause", BSD + "\n" + AS_IS_BSD), ("BSD-3-Clause", BSD + NAMES + "\n" + AS_IS_BSD),
        ("GPL-2.0", "This work is licensed under the GNU General Public License version 2."), ("GPL-3.0", "This work is licensed under the GNU General Public License version 3."),
        ("GPL-2.0-or-later", GPL.format("; ", "; ", 2)), ("GPL-3.0-or-later", GPL.format(": ", ", ", 3)), ("MPL-2.0", MPL),
        ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")]


def test_public_texts_plain_wrapped_and_commented(spark):
    assert {n for n, _ in FULL} == {n for n, _ in RULES}
    texts = []
    for name, text in FULL:
        texts.append((name, f"Copyright (c) 2020 Someone\n\n{text}\n\ncode"))
        blocks = [" ".join(b.split()) for b in re.split(r"\n\s*\n|\n(?=\d\.)", text)]
        for width in (24, 40, 57, 72, 79, 1000):
            lines = "\n\n".join(textwrap.fill(b, width, break_long_words=False, break_on_hyphens=False) for b in blocks).split("\n")
            texts.append((name, "Copyright (c) 2020 Someone\n\n" + "\n".join(lines) + "\n\ncode"))
            for head, mark, end in (("import x\n\n", "#", "\n\ny = 1"), ("package x\n", "//", "\n\nfunc"), ("/*\n", " *", "\n */\nint x"), ("/* Copyright (c) Someone\n *\n", " *", " */\nint x"), ("", "--", "\nselect x")):
                texts.append((name, head + "\n".join(f"{mark} {line}".rstrip() for line in lines) + end))
                texts.append((name, (head + "\n".join(f"{mark} {line}".rstrip() for line in lines) + end).replace("\n", "\r\n")))
    found = {r.doc_id: r.licences for r in recognise(documents(spark, [t for _, t in texts])).collect()}
    assert not [(n, found[i], t) for i, (n, t) in enumerate(texts) if found[i] != [n]]


def test_words_around_a_notice_are_not_part_of_it(spark):
    texts = ["# it is not\n# released under the MIT License\n# at all", "This is not licensed under the MIT License", "// Licensed under the MIT License\n// or another", APACHE.replace("express", "clear")]
    assert [r.licences for r in recognise(documents(spark, texts)).sort("doc_id").collect()] == [[]] * 4
