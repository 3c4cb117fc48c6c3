"""Licence recognition by sentences.

A text is cut into sentences, and into lines. Each is normalised (lower case, one space between words, British and American
spellings made one, no punctuation at its ends, copyright holders and version numbers lifted out) and looked up among the
sentences that licences are made of. The identifiers found, in text order, are then matched against ordered rules: a rule is
a sequence of identifiers that must follow each other with at most ``gap`` other known sentences between, and what a rule
has consumed no later rule sees. Longer rules come first, so the three-clause form is not taken for the two-clause one.

Before these come whole licences: ``licence_table`` holds the hashes of the normalised sentences of well-known licences in
their order, made by ``sentence_hashes`` from their public texts. The rule of such a licence is its whole sequence, of which
``share`` must follow each other in a text; it consumes what lies between. A text that holds a whole licence twice is told so
once.

Edge cases: null and empty texts have no licence; whole texts and sentences are read, of any length; repeated rows give equal rows; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame

from .common import by_batch, bytes_of
from .licence_table import WHOLE

_CUT = re.compile(r"(?<=[.;!?])[\x20\t\r\n]+|(?<=:)[\x20\t\r]*\n\s*|\n[\x20\t\r]*\n\s*")
_LINE = re.compile(r"\n")
_EDGE = " \t\r\n\v\f.,;:!?\"'()[]{}<>*#/-|&$%~=_`"
_LICENCE, _SUB = re.compile(r"\blicen[cs](e|es|ed|ing|ee|or)\b"), re.compile(r"\bsub-?licens")
_MARKS, _BEFORE = re.compile(r"[\"'“”‘’`*#|]|//+"), re.compile(r" ([,;:.)])")

_V = r"(?:v|ver|version)?\.? ?(?P<v>\d+(?:\.\d+)*)"
#: identifier -> pattern that a whole normalised sentence must match
SENTENCES: dict[str, str] = {
    "spdx": r"spdx-licens(?:e)?-identifier: ?(?P<id>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)",
    "mit-note": r"(?:this \w+(?: \w+)? is )?(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: \(?expat\)?)? licens(?:e|es)",
    "mit-name": r"(?:the )?mit license(?: \(mit\))?",
    "mit-grant": r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
    "mit-keep": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": r"the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit-liable": r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": r"the software is provided as is and the author disclaims all warranties with regard to this software.*",
    "apache-note": rf"(?:this \w+(?: \w+)? is )?(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licens(?:e|es),? ?(?:{_V})?(?: \(the license\))?",
    "apache-use": r"you may not use this file except in compliance with the license",
    "apache-copy": r"you may obtain a copy of the license at(?:: ?)?(?: ?https?: ?www\.apache\.org/licenses/license-2\.0)?",
    "apache-basis": r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "bsd-grant": r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": r"(?:1[.)] |a[.)] )?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": r"(?:2[.)] |b[.)] )?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": r"(?:3[.)] |c[.)] )?neither the name of .{1,200}? nor the names of (?:its|any|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": r"this software is provided by .{1,200}? as is and any express or implied warranties.*",
    "bsd-note": r"(?:this \w+(?: \w+)? is )?(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:(?P<v>[234])-clause |(?:new|simplified|revised|modified) )?bsd(?: (?P<w>[234])-clause)? licens(?:e|es)",
    "gpl-note": rf"(?:this \w+(?: \w+)? is )?(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?gnu (?P<k>lesser |library |affero )?general public licens(?:e|es),? ?(?:{_V})?(?P<later>,? (?:or|and) (?:\(at your option\) )?(?:any )?later(?: versions?)?)?",
    "gpl-free": r"(?:this (?:program|library|software)|.{1,80}?) is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?P<k>lesser |library |affero )?general public license as published by the free software foundation[;,:]?(?: either version (?P<v>\d+(?:\.\d+)?)(?: of the license)?(?P<later>,? or \(at your option\) any later version)?)?",
    "gpl-either": r"either version (?P<v>\d+(?:\.\d+)?)(?: of the license)?,? or \(at your option\) any later version",
    "gpl-hope": r"(?:this (?:program|library|software)|.{1,80}?) is distributed in the hope that it will be useful, but without any warranty",
    "gpl-copy": r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|software).*",
    "mpl-note": rf"this source code form is subject to the terms of the mozilla public license, {_V}",
    "mpl-obtain": r"if a copy of the mpl was not distributed with this file, you can obtain one at .*",
    "mpl-short": rf"(?:this \w+(?: \w+)? is )?(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mozilla public license,? ?(?:{_V})?",
    "cc-note": rf"(?:this \w+(?: \w+)? is )?(?:released|licensed|distributed|available|published|provided) under (?:an? |the )?(?:terms of (?:the )?)?(?:cc|creative commons)[ -](?P<k>by(?:-(?:nc-sa|nc-nd|nc|sa|nd))?|attribution(?:-noncommercial)?(?:-(?:sharealike|noderivatives|noderivs))?) ?(?:{_V})?(?: international| unported)?(?: license)?",
    "cc0-note": r".{0,80}?(?:cc0(?: ?1\.0)?|creative commons zero)(?: universal)?(?: license| public domain dedication)?",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "all-rights": r"(?:copyright .{0,120}?)?all rights reserved",
}
_COMPILED = {k: re.compile(v) for k, v in SENTENCES.items()}
#: Matches what any of them does, in one go.
_ANY = re.compile("|".join(f"(?:{re.sub('[?]P<[a-z]+>', '?:', v)})" for v in SENTENCES.values()))


class Rule(NamedTuple):
    sequence: tuple[str, ...]
    licence: str


RULES: tuple[Rule, ...] = (
    Rule(("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"), "BSD-3-Clause"),
    Rule(("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    Rule(("mit-grant", "mit-keep", "mit-warranty", "mit-liable"), "MIT"),
    Rule(("apache-note", "apache-use", "apache-copy", "apache-basis"), "Apache-{v}"),
    Rule(("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    Rule(("mit-grant", "mit-keep", "mit-warranty"), "MIT"),
    Rule(("gpl-free", "gpl-either", "gpl-hope", "gpl-copy"), "{k}GPL-{v}-or-later"),
    Rule(("gpl-free", "gpl-hope", "gpl-copy"), "{k}GPL-{v}{later}"),
    Rule(("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    Rule(("mit-grant", "mit-keep"), "MIT"),
    Rule(("apache-note", "apache-use"), "Apache-{v}"),
    Rule(("isc-grant", "isc-warranty"), "ISC"),
    Rule(("gpl-free", "gpl-either"), "{k}GPL-{v}-or-later"),
    Rule(("mpl-note", "mpl-obtain"), "MPL-{v}"),
    Rule(("spdx",), "{id}"),
    Rule(("mit-note",), "MIT"),
    Rule(("apache-note",), "Apache-{v}"),
    Rule(("gpl-note",), "{k}GPL-{v}{later}"),
    Rule(("gpl-free",), "{k}GPL-{v}{later}"),
    Rule(("cc-note",), "CC-{k}-{v}"),
    Rule(("cc0-note",), "CC0-1.0"),
    Rule(("bsd-note",), "BSD-{v}-Clause"),
    Rule(("mpl-note",), "MPL-{v}"),
    Rule(("mpl-short",), "MPL-{v}"),
    Rule(("isc-grant",), "ISC"),
    Rule(("mit-grant",), "MIT-partial"),
    Rule(("bsd-grant",), "BSD-partial"),
    Rule(("unlicense",), "Unlicense"),
)


class Known(NamedTuple):
    sentence: str
    start: int
    end: int
    slots: dict[str, str]


class Found(NamedTuple):
    licence: str
    start: int
    end: int
    sentences: tuple[str, ...]


def normalise(sentence: str) -> str:
    s = sentence.lower()
    if "licen" in s:
        s = _SUB.sub("sublicens", _LICENCE.sub(r"licens\1", s))
    s = " ".join(_MARKS.sub(" ", s).split()).strip(_EDGE)
    return _BEFORE.sub(r"\1", s.replace("( ", "("))


#: Sentences of whole licences that are shorter say too little.
LEAST_WHOLE = 25


def _hash(normal: str) -> str:
    return xxhash.xxh64_hexdigest(normal.encode())[:12]


def sentence_hashes(text: str) -> list[str]:
    """The hashes of a licence's sentences in order, first occurrences."""
    normal = (normalise(text[a:b]) for a, b in _pieces(text, _CUT))
    return list(dict.fromkeys(_hash(s) for s in normal if len(s) >= LEAST_WHOLE and not any(p.fullmatch(s) for p in _COMPILED.values())))


def _sequences() -> dict[str, dict[str, int]]:
    return {k: {v[i : i + 12]: i // 12 for i in range(0, len(v), 12)} for k, v in WHOLE.items()}


def sentence_id(sentence: str) -> tuple[str, dict[str, str]] | None:
    """The identifier of a known sentence and what its slots hold."""
    s = normalise(sentence)
    if len(s) < 3:
        return None
    if len(s) >= LEAST_WHOLE and (h := _hash(s)) in _OF_WHOLE:
        return f"#{h}", {}
    if not _ANY.fullmatch(s):
        return None
    for k, p in _COMPILED.items():
        if m := p.fullmatch(s):
            return k, {a: b.strip() for a, b in m.groupdict().items() if b}
    return None


def _pieces(text: str, cut: re.Pattern, at: int = 0, end: int | None = None):
    end = len(text) if end is None else end
    for m in cut.finditer(text, at, end):
        yield at, m.start()
        at = m.end()
    yield at, end


_WHOLE = _sequences()
_OF_WHOLE = frozenset(h for v in _WHOLE.values() for h in v)


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
        at[k : k + 1] = [i]
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def whole_licences(known: list[Known], used: list[bool], share: float = 0.6) -> list[Found]:
    """The whole licences among known sentences, those with most sentences first; what lies between a licence's first and last is used up."""
    out: list[Found] = []
    left = {k for k, v in _WHOLE.items() if any(x.sentence[1:] in v for x in known)}
    while left:
        best: tuple[int, str, list[int]] = (0, "", [])
        for name in sorted(left):
            v = _WHOLE[name]
            at = [i for i, x in enumerate(known) if not used[i] and x.sentence[1:] in v]
            hit = [at[i] for i in _increasing([v[known[i].sentence[1:]] for i in at])]
            if len(hit) >= share * len(v) and (len(hit), len(hit) / len(v)) > (best[0], best[0] / len(_WHOLE[best[1]]) if best[1] else 0):
                best = (len(hit), name, hit)
        if not best[0]:
            break
        hit = best[2]
        for i in range(hit[0], hit[-1] + 1):
            used[i] = True
        left.discard(best[1])
        out.append(Found(best[1], known[hit[0]].start, known[hit[-1]].end, ("whole text",)))
    return out


def known_sentences(text: str) -> list[Known]:
    """The known sentences of a text in order: sentences as punctuation parts them, and lines, where a sentence holds none."""
    out = []
    for a, b in _pieces(text, _CUT):
        for x, y in ((a, b), *_pieces(text, _LINE, a, b)) if "\n" in text[a:b] else ((a, b),):
            while x < y and text[x] in " \t\r\n":
                x += 1
            while y > x and text[y - 1] in " \t\r\n":
                y -= 1
            if x < y and (found := sentence_id(text[x:y])):
                out.append(Known(found[0], x, y, found[1]))
                if (x, y) == (a, b):
                    break
    return out


def licences(text: str, rules: tuple[Rule, ...] = RULES, gap: int = 2, share: float = 0.6) -> list[Found]:
    """The licences of a text, in order of where they begin."""
    known = known_sentences(text)
    used = [False] * len(known)
    out = whole_licences(known, used, share)
    for r in rules:
        i = 0
        while i < len(known):
            if used[i] or known[i].sentence != r.sequence[0]:
                i += 1
                continue
            at, j = [i], i + 1
            for want in r.sequence[1:]:
                while j < len(known) and j - at[-1] <= gap + 1 and (used[j] or known[j].sentence != want):
                    j += 1
                if j >= len(known) or j - at[-1] > gap + 1:
                    break
                at.append(j)
                j += 1
            if len(at) == len(r.sequence):
                for k in at:
                    used[k] = True
                out.append(Found(_name(r, [known[k] for k in at]), known[at[0]].start, known[at[-1]].end, r.sequence))
            i += 1
    return sorted(out, key=lambda f: (f.start, f.end, f.licence))


_CC = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}


def _name(r: Rule, known: list[Known]) -> str:
    slots: dict[str, str] = {}
    for k in known:
        slots = k.slots | slots
    if "{" not in r.licence:
        return r.licence
    kind = slots.get("k", "")
    if "GPL" in r.licence:
        kind = {"lesser": "L", "library": "L", "affero": "A"}.get(kind, "")
        v = slots.get("v", "")
        v = v + ".0" if v and "." not in v else v
        later = "-or-later" if slots.get("later") else "-only" if v else ""
        return r.licence.format(k=kind, v=v, later=later).replace("GPL--or-later", "GPL").rstrip("-")
    if r.licence.startswith("CC-"):
        kind = "-".join(_CC.get(x, x) for x in kind.split("-")).upper()
    v = slots.get("v") or slots.get("w") or ""
    v = v + ".0" if v.isdigit() and "BSD" not in r.licence else v
    return r.licence.format(k=kind, v=v, id=slots.get("id", "").replace(" or ", " OR ").replace(" and ", " AND ").replace(" with ", " WITH ")).replace("--", "-").rstrip("-")


def scan_licences(docs: DataFrame, gap: int = 2) -> DataFrame:
    """doc_id and the licences found, an array of (licence, start, end, sentences); positions are code points. No shuffle."""

    def each(b):
        return {"doc_id": b.column(0), "licences": [[f._asdict() for f in licences(x.decode("utf-8", "replace"), gap=gap)] for x in b.column(1).to_pylist()]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", bytes_of().alias("raw")), each, f"doc_id {kind}, licences array<struct<licence string, start long, end long, sentences array<string>>>")
