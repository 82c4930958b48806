"""Licence scan by template markup: texts with optional and replaceable regions as token automata.

A template is plain wording in which ``<<opt>> .. <</opt>>`` may be left out and ``<<var N>>`` stands
for up to N words of any kind.  It compiles into an automaton over words; a place where its mandatory
opening stands is accepted only if every mandatory word follows exactly.  ``labels`` has the template's
name for each acceptance, next to the short phrases' labels.  A ``text-`` template is a whole licence up to the
end of its disclaimer, a ``header-`` one the notice that a licence asks files to carry, a ``notice-`` one a
sentence that names a licence.

The score is the share of a text's words that lie in an accepted template or a phrase (0 without words).

Nulls and edge cases: a null or empty text has no words, hits or labels (empty strings, score 0); a
null doc_id stays null; repeated rows give repeated rows; empty tables give no rows; no other column is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ALNUM, LOWER, flat, id_array, ids_of, task, text_blocks, word_hashes, words_of

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licences and of the notices that name them.
TEMPLATES = {
    "notice-mit": "released under the mit license",
    "notice-apache-2.0": "licensed under the apache license version 2 0",
    "notice-gpl": "<<opt>>this work is<</opt>> licensed under the <<opt>>gnu<</opt>> general public license <<opt>>version 3<</opt>>",
    "notice-cc-by-nc": "licensed under cc by nc <<opt>>4 0<</opt>>",
    "text-mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<opt>>the software<</opt>> to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express "
        "or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the <<var 12>> be liable for any claim damages or other liability whether in an "
        "action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software"
    ),
    "text-isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
        "provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
        "of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
        "contract negligence or other tortious action arising out of or in connection with the use or performance of this "
        "software"
    ),
    "text-bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce "
        "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution <<opt>><<opt>>3<</opt>> neither the name of <<var 12>> nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission<</opt>> this software is provided by the <<var 12>> as is and any express or implied warranties including "
        "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in "
        "no event shall the <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such "
        "damage"
    ),
    "header-apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at <<var 12>> unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations "
        "under the license"
    ),
    "header-mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at <<var 12>> mozilla org <<opt>>mpl 2 0<</opt>> <<opt>>en us mpl 2 0<</opt>>"
    ),
    "header-gpl": (
        "<<var 8>> is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>>"
        " <<opt>>affero<</opt>> general public license as published by the free software foundation either version <<var 2>> of "
        "the license or at your option any later version <<var 12>> is distributed in the hope that it will be useful but "
        "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license for more details"
    ),
}

MARKUP = re.compile(r"<<opt>>|<</opt>>|<<var (\d+)>>|[^\s<]+")


@dataclass(frozen=True)
class Automaton:
    """States 0 .. final; a word leads from a state along its own edges or the wildcard ones."""

    name: str
    words: tuple[dict[int, int], ...]  # word identity -> next state
    wild: tuple[int, ...]  # next state for any word, or -1
    free: tuple[tuple[int, ...], ...]  # moves without a word
    opening: tuple[int, ...]  # identities of the mandatory words at the start

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accept(self, identities: list[int], start: int, end: int) -> int:
        """Where the longest acceptance from ``start`` ends, or -1."""
        states, found, at = self.closure({0}), -1, start
        final = len(self.words) - 1
        while True:
            if final in states:
                found = at
            if at >= end:
                return found
            word = identities[at]
            states = self.closure({to for s in states if (to := self.words[s].get(word, -1)) >= 0} | {self.wild[s] for s in states if self.wild[s] >= 0})
            if not states:
                return found
            at += 1


def identity(words: list[str]) -> list[int]:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends).tolist()


def compile_template(name: str, markup: str) -> Automaton:
    """Leading optional and replaceable regions change nothing that is accepted; they are left off."""
    words: list[dict[int, int]] = [{}]
    wild, free, opened, opening, fixed = [-1], [set()], [], [], True

    def state() -> int:
        words.append({})
        wild.append(-1)
        free.append(set())
        return len(words) - 1

    for m in MARKUP.finditer(markup):
        token, last = m[0], len(words) - 1
        if token == "<<opt>>":
            opened.append(last)
            fixed = fixed and not opening
        elif token == "<</opt>>":
            free[opened.pop()].add(last)
        elif m[1]:
            fixed = fixed and not opening
            if last:
                start = [last]
                for _ in range(int(m[1])):
                    to = state()
                    wild[start[-1]] = to
                    start.append(to)
                for s in start[:-1]:
                    free[s].add(start[-1])
        else:
            if opened and not opening:
                continue
            (word,) = identity([token])
            words[last][word] = state()
            if fixed:
                opening.append(word)
    return Automaton(name, tuple(words), tuple(wild), tuple(tuple(sorted(x)) for x in free), tuple(opening))


def _places(hashes: np.ndarray, owner: np.ndarray, wanted: list[int]) -> np.ndarray:
    """Starts of the word sequence ``wanted`` inside one document."""
    at = np.flatnonzero(hashes == np.uint64(wanted[0]))
    at = at[at + len(wanted) <= len(hashes)]
    for i, w in enumerate(wanted[1:], 1):
        at = at[hashes[at + i] == np.uint64(w)]
    return at[owner[at] == owner[at + len(wanted) - 1]]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: words, hits and where they stand, labels, score and accepted templates with their places."""
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    short = [(identity(k.split()), label) for k, label in (PHRASES if phrases is None else phrases).items()]

    def run(batches):
        for block in text_blocks(batches):
            buf, offsets = flat(block.column("text"))
            buf = LOWER[buf]
            starts, ends, first = words_of(buf, offsets, ALNUM)
            hashes, n = word_hashes(buf, starts, ends), len(first) - 1
            counts = np.diff(first)
            owner = np.repeat(np.arange(n), counts)
            base: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            hits, low, high = np.zeros(n, np.int64), np.full(n, 2**62), np.full(n, -1)
            covered = np.zeros(len(hashes) + 1, np.int32)
            for wanted, label in short:
                at = _places(hashes, owner, wanted)
                np.add.at(hits, owner[at], 1)
                np.minimum.at(low, owner[at], at - first[owner[at]])
                np.maximum.at(high, owner[at], at - first[owner[at]])
                np.add.at(covered, at, 1)
                np.add.at(covered, at + len(wanted), -1)
                for d in set(owner[at].tolist()):
                    base[d].add(label)
            for a in automata:
                for at in _places(hashes, owner, list(a.opening)).tolist():
                    d = int(owner[at])
                    reach = hashes[at : min(int(first[d + 1]), at + len(a.words))].tolist()  # each word takes a new state
                    end = a.accept(reach, 0, len(reach))
                    if end > 0:
                        more[d].add(a.name)
                        spans[d].append({"template": a.name, "start": at - int(first[d]), "words": end})
                        covered[at] += 1
                        covered[at + end] -= 1
            inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])[first]
            none = hits == 0
            yield pa.record_batch(
                [
                    id_array(ids_of(block)), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)]),
                    pa.array(np.diff(inside) / np.maximum(counts, 1), pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(task(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, accepted array<struct<template:string,start:long,words:long>>")
