import itertools
import os
import random

import pytest

from engramspark.llm import licenses as L

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the MIT License.", ["MIT"]),
        ("Some words here.\nLicensed under the Apache Licence, version 2.0.\nMore words", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Licensed under the GNU Lesser General Public License v2.1 or later.", ["LGPL-2.1-or-later"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("# SPDX-License-Identifier: Apache-2.0 OR MIT\nimport x", ["apache-2.0 OR mit"]),
        ("RELEASED UNDER THE MIT LICENSE!!", ["MIT"]),
        (MIT, ["MIT"]),
        (BSD, ["BSD-2-Clause"]),
        (BSD + ENDORSE, ["BSD-3-Clause"]),
        (MIT + "\nprose between. And more.\n\n" + BSD, ["MIT", "BSD-2-Clause"]),
        ("A licence to kill is no licence.", []),
        ("", []),
    ],
)
def test_texts(text, want):
    found = L.licences(text)
    assert [f.licence for f in found] == want
    assert all(0 <= f.start < f.end <= len(text) for f in found)


def test_order_of_rules():
    """The longer rule wins, and what it used no other rule sees."""
    assert [f.sentences for f in L.licences(BSD + ENDORSE)] == [("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    assert len({r.sequence for r in L.RULES}) == len(L.RULES) - 0


def test_every_rule_names_known_sentences():
    assert {s for r in L.RULES for s in r.sequence} <= set(L.SENTENCES)


def test_table(spark, odd, none):
    rows = L.scan_licences(odd).collect()
    assert len(rows) == odd.count() and all(r.licences == [] for r in rows)
    docs = spark.createDataFrame([(1, "x " * 5000 + "\nReleased under the MIT License.\n" + "y " * 5000)], "doc_id long, text string")
    (r,) = L.scan_licences(docs).collect()
    assert [(x.licence, x.start) for x in r.licences] == [("MIT", 10001)]
    assert L.scan_licences(none).collect() == []


def test_brute_force(spark, sf):
    """Every planted line is found where it stands, and nothing else."""
    import re

    lines = re.compile(r"Released under the MIT License|Licensed under the Apache License, Version 2\.0|Licensed under CC BY-NC 4\.0|licensed under the GNU General Public License, version 3", re.I)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: len(r.licences) for r in L.scan_licences(docs).collect()}
    assert got == {r.doc_id: len(lines.findall(r.text)) for r in docs.collect()}


#: A text for each known sentence, which holds nothing else.
ALONE = {
    "spdx": "SPDX-License-Identifier: MIT",
    "mit-note": "Released under the MIT License.",
    "mit-name": "The MIT License",
    "mit-grant": MIT.split("\n\n")[2],
    "mit-keep": MIT.split("\n\n")[3],
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.',
    "apache-note": "Licensed under the Apache License, Version 2.0.",
    "apache-use": "You may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-grant": BSD.split("\n\n")[0],
    "bsd-source": BSD.split("\n\n")[1],
    "bsd-binary": BSD.split("\n\n")[2],
    "bsd-endorse": ENDORSE,
    "bsd-warranty": 'This software is provided by the copyright holders "as is" and any express or implied warranties are disclaimed.',
    "bsd-note": "Available under the 3-Clause BSD License.",
    "gpl-note": "Published under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "gpl-either": "either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl-note": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at here.",
    "mpl-short": "Provided under the Mozilla Public License 2.0.",
    "cc-note": "This work is published under CC BY 4.0.",
    "cc0-note": "Released under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public\ndomain.",
    "all-rights": "All rights reserved.",
}


@pytest.mark.parametrize("sentence", sorted(L.SENTENCES))
def test_sentence_alone(sentence):
    """A sentence is known in a text that holds nothing else."""
    assert [k.sentence for k in L.known_sentences(ALONE[sentence])] == [sentence]


@pytest.mark.parametrize("rule", L.RULES, ids=lambda r: "+".join(r.sequence))
def test_rule_alone(rule):
    assert [f.sentences for f in L.licences("\n\n".join(ALONE[s].strip() for s in rule.sequence))] == [rule.sequence]


@pytest.mark.parametrize(
    "text, want",
    [("This work is published under CC BY 4.0.", "CC-BY-4.0"), ("Available under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Released under CC0 1.0.", "CC0-1.0"), ("Available under Creative Commons Attribution 4.0.", "CC-BY-4.0")],
)
def test_notes_without_the_word_licence(text, want):
    assert [f.licence for f in L.licences(text)] == [want]


COMMON = "/usr/share/common-licenses/"
WHOLE = {"GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GFDL-1.2": "GFDL-1.2"}


@pytest.mark.skipif(not all(os.path.exists(COMMON + f) for f in WHOLE.values()), reason="no public licence texts on this machine")
@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_licences(name):
    """A whole licence is told apart from its relatives, wherever it stands, however its lines break; a third of it is not it."""
    with open(COMMON + WHOLE[name], errors="replace") as f:
        text = f.read()
    assert "".join(L.sentence_hashes(text)) == L.WHOLE[name]
    told = [f.licence for f in L.licences("Some prose. More of it.\n\n" + text + "\n\nReleased under the MIT License.\n")]
    assert told == [name, "MIT"]
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    assert [f.licence for f in L.licences("\n\n".join(paragraphs).upper())] == [name]
    assert all(f.sentences != ("whole text",) for f in L.licences("\n\n".join(paragraphs[: len(paragraphs) // 3])))


@pytest.mark.skipif(not os.path.exists(COMMON + "GPL-2"), reason="no public licence texts on this machine")
def test_two_whole_licences():
    texts = [open(COMMON + f, errors="replace").read() for f in ("MPL-2.0", "GPL-2")]
    assert [f.licence for f in L.licences("\n\n".join(texts))] == ["MPL-2.0", "GPL-2.0"]


def test_increasing():
    for s in range(100):
        r = random.Random(s)
        x = [r.randrange(8) for _ in range(r.randint(0, 9))]
        got = L._increasing(x)
        assert all(a < b and x[a] < x[b] for a, b in zip(got, got[1:]))
        best = max((len(c) for n in range(len(x) + 1) for c in itertools.combinations(x, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best


def test_long_sentences():
    """A sentence of any length is looked up."""
    long = "This software is provided by " + "x" * 190 + " as is and any express or implied warranties" + " and so on" * 5000 + "."
    assert [k.sentence for k in L.known_sentences(long)] == ["bsd-warranty"]
    assert L.licences("word " * 400_000 + "\nReleased under the MIT License.")[0].licence == "MIT"
