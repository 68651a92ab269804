"""License scan by template markup.

A template is a notice whose words must appear as they are, but for marked regions: ``<<optional>> ... <<end>>`` may be
missing, ``<<one of: a | b c>>`` stands for one of its phrases, and ``<<words: n>>`` for up to n words of any kind
(names, years). Optional regions may hold other regions. A template is compiled into an automaton over words; a text
is accepted from a place on if the automaton reaches its end there. Case and punctuation don't count. References are
templates of how licenses are named without their notice; base phrases are templates without regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from terrasift.llm.common import doc_texts, map_batches

#: Bytes of words are kept (A-Z in lower case); all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_DISCLAIMER = """
this software is provided by <<words: 12>> as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a
particular purpose are disclaimed. in no event shall <<words: 12>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited
to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict
liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage
"""
_BSD = """
redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>><<one of: 1 | a>><<end>> redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>><<one of: 2 | b>><<end>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_FREE = "free software; you can redistribute it and/or modify it under the terms of {} as published by the free software foundation; {} <<optional>>or (at your option) any later version<<end>>"

# The wording of notices as their publishers have it, all of it mandatory but for marked regions.
TEMPLATES = {
    "mit": """
permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the
software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be
included in all copies or substantial portions of the software. the software is provided as is, without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and <<one of: noninfringement | non infringement>>. in no event shall <<words: 12>> be liable for any claim, damages or
other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software
""",
    "isc": """
permission to use, copy, modify, <<one of: and | and or>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. the software is provided as is and <<words: 8>> disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness. in no event shall <<words: 8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use,
data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software
""",
    "bsd-2-clause": _BSD + _DISCLAIMER,
    "bsd-3-clause": _BSD
    + """
<<optional>><<one of: 3 | c>><<end>> neither the name of <<words: 12>> nor the names of <<one of: its | their>> contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
    + _DISCLAIMER,
    "apache-2.0": """
licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at <<words: 8>>
unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either
express or implied. see the license for the specific language governing permissions and limitations under the license
""",
    "gpl-2.0": _FREE.format("the gnu general public license", "<<optional>>either<<end>> version 2 <<optional>>of the license<<end>>"),
    "gpl-3.0": _FREE.format("the gnu general public license", "<<optional>>either<<end>> version 3 <<optional>>of the license<<end>>"),
    "lgpl-2.1": _FREE.format("the gnu lesser general public license", "<<optional>>either<<end>> version 2.1 <<optional>>of the license<<end>>"),
    "lgpl-3.0": _FREE.format("the gnu lesser general public license", "<<optional>>either<<end>> version 3 <<optional>>of the license<<end>>"),
    "agpl-3.0": _FREE.format("the gnu affero general public license", "<<optional>>either<<end>> version 3 <<optional>>of the license<<end>>"),
    "mpl-2.0": """
this source code form is subject to the terms of the mozilla public license, <<one of: v | version>> 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at
""",
    "reserved-notice": "<<one of: copyright | c>> <<optional>><<one of: c | copyright>><<end>> <<words: 12>> all rights reserved",
}

# How texts name a license without its notice.
REFERENCES = {
    "apache-2.0-ref": "apache license <<optional>>version<<end>> 2.0",
    "gpl-2.0-ref": "gnu general public license <<one of: version 2 | v2 | 2 0>>",
    "gpl-3.0-ref": "gnu general public license <<one of: version 3 | v3 | 3 0>>",
    "lgpl-ref": "gnu <<one of: lesser | library>> general public license",
    "agpl-3.0-ref": "gnu affero general public license <<one of: version 3 | v3 | 3 0>>",
    "cc-by-4.0-ref": "<<one of: cc | creative commons>> <<one of: by | attribution>> 4.0 <<optional>>international<<end>>",
    "cc-by-sa-4.0-ref": "<<one of: cc | creative commons>> <<one of: by sa | attribution sharealike>> 4.0 <<optional>>international<<end>>",
    "cc-by-nc-4.0-ref": "<<one of: cc | creative commons>> <<one of: by nc | attribution noncommercial>> 4.0 <<optional>>international<<end>>",
    "mit-ref": "<<one of: the | under>> mit license",
}
#: Scores: a notice's whole mandatory wording, a license that is named, a base phrase alone.
NOTICE, NAMED, PHRASE = 1.0, 0.75, 0.5

_PART = re.compile(r"<<optional>>|<<end>>|<<one of:([^>]*)>>|<<words:\s*(\d+)>>|([^<\s]+)")


@dataclass
class Automaton:
    """Places 0..last; ``step`` by word (None: any word), ``skip`` without one."""

    step: list[dict[bytes | None, set[int]]] = field(default_factory=list)
    skip: list[set[int]] = field(default_factory=list)
    last: int = 0

    def place(self) -> int:
        self.step.append({})
        self.skip.append(set())
        return len(self.step) - 1

    def word(self, at: int, word: bytes | None, to: int) -> None:
        self.step[at].setdefault(word, set()).add(to)

    def reach(self, places: set[int]) -> frozenset[int]:
        todo, seen = list(places), set(places)
        while todo:
            for to in self.skip[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)


def compile_template(markup: str) -> Automaton:
    auto = Automaton()
    at, opened = auto.place(), []
    for part in _PART.finditer(markup):
        phrases, count, word = part.groups()
        if part[0] == "<<optional>>":
            opened.append(at)
        elif part[0] == "<<end>>":
            auto.skip[opened.pop()].add(at)
        elif phrases is not None:
            end = auto.place()
            for phrase in phrases.split("|"):
                here = at
                for each in (words := phrase.lower().encode().split())[:-1]:
                    nxt = auto.place()
                    auto.word(here, each, nxt)
                    here = nxt
                auto.word(here, words[-1], end)
            at = end
        elif count is not None:
            end = auto.place()
            for _ in range(int(count)):
                auto.skip[at].add(end)
                nxt = auto.place()
                auto.word(at, None, nxt)
                at = nxt
            auto.skip[at].add(end)
            at = end
        else:
            for each in words_of(word):
                nxt = auto.place()
                auto.word(at, each, nxt)
                at = nxt
    if opened:
        raise ValueError(f"an optional region isn't closed: {markup}")
    auto.last = at
    return auto


class Matcher:
    """The automaton with sets of places as states, made as texts need them."""

    def __init__(self, markup: str):
        self.auto = compile_template(markup)
        self.first = self.auto.reach({0})
        self.moves: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}
        self.named = {word for step in self.auto.step for word in step if word is not None}
        #: Words that a match may begin with; None if any word may.
        self.starts = {word for place in self.first for word in self.auto.step[place]}

    def move(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        key = (state, word if word in self.named else None)
        if (to := self.moves.get(key)) is None:
            steps = (self.auto.step[p] for p in state)
            to = self.moves[key] = self.auto.reach({t for s in steps for w in {key[1], None} for t in s.get(w, ())})
        return to

    def end(self, words: list[bytes], at: int) -> int:
        """Where the longest match from ``at`` on ends; -1 if there is none."""
        state, found = self.first, -1
        while state:
            if self.auto.last in state:
                found = at
            if at == len(words):
                break
            state = self.move(state, words[at])
            at += 1
        return found


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _places(words: list[bytes], joined: bytes, anchor: bytes) -> list[int]:
    """Places of a word, looked for in the joined text first, as most texts lack it."""
    if anchor not in joined:
        return []
    out, at = [], -1
    try:
        while True:
            out.append(at := words.index(anchor, at + 1))
    except ValueError:
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], references: dict[str, str]):
        self.phrases = {phrase: (Matcher(phrase), label) for phrase, label in phrases.items()}
        self.templates = {label: Matcher(markup) for label, markup in (templates | references).items()}
        self.notices = set(templates)

    def hits(self, matcher: Matcher, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        found = []
        for anchor in matcher.starts:
            for at in range(len(words)) if anchor is None else _places(words, joined, anchor):
                if (end := matcher.end(words, at)) > at:
                    found.append((at, end))
        return sorted(found)

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base = [(at, label) for phrase, (m, label) in self.phrases.items() if b" " + phrase.encode() + b" " in joined for at, _ in self.hits(m, words, joined)]
        spans = [(label, at, end) for label, m in self.templates.items() for at, end in self.hits(m, words, joined)]
        starts = [at for at, _ in base]
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(label for label, _, _ in spans)})
        score = NOTICE if any(label in self.notices for label, _, _ in spans) else NAMED if spans else PHRASE if base else 0.0
        return len(words), len(base), min(starts, default=None), max(starts, default=None), base_labels, labels, score, spans


SCHEMA = (
    "doc_id {0}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, spans array<struct<label: string, start: int, end: int>>"
)


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, references: dict[str, str] | None = None) -> DataFrame:
    """Words, base phrases and accepted templates of each row of ``docs``, without a shuffle.

    Words are runs of ASCII letters (in lower case), digits and non-ASCII characters. ``spans`` has the words that each
    template matched, the longest from each start. ``score`` is NOTICE if a template is accepted, else NAMED if a
    reference is, PHRASE if only a base phrase stands in the text, else 0. Null and empty texts have no words, places null, and empty labels; ids may be null or
    repeat; other columns are not looked at.
    """
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, REFERENCES if references is None else references)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [*[pa.int64()] * 4, *[pa.list_(pa.string())] * 2, pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            rows = [scanner.scan(text.as_py()) for text in batch.column("text")]
            columns = [[*row[:7], [dict(zip(("label", "start", "end"), s, strict=True)) for s in row[7]]] for row in rows]
            arrays = [pa.array([row[i] for row in columns], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    rows = doc_texts(docs)
    return map_batches(rows, scanned, SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))
