"""License scans by template automata.

A template is mandatory words with markup: ``[[ ... ]]`` holds an optional
region (it may nest) and ``{min,max}`` stands for a replaceable region of that
many words.  It is compiled into an automaton over words; a text matches where
the automaton accepts, that is, where every mandatory word stands in order and
nothing but the marked regions differs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, column_bytes, doc_slices

#: Bytes of words once A-Z is lowered: 0-9, a-z and all of non-ASCII code points.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

BASE = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}

#: Label -> templates, notices and whole license texts with their copyright lines and numbering left open.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0 [[ the license ]]",
        "spdx license identifier apache 2.0",
        "you may not use this file except in compliance with the license [[ you may obtain a copy of the license at {0,10} ]] unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2-clause": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-3-clause": [
        "neither the name of {1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc-by": ["licensed under [[ the ]] cc by 4.0 [[ international ]]", "licensed under a creative commons attribution {0,1} international license"],
    "cc-by-nc": ["licensed under [[ the ]] cc by nc [[ 4.0 ]]", "licensed under a creative commons attribution noncommercial {0,3} license"],
    "gpl-3.0": [
        "licensed under the gnu general public license [[ as published by the free software foundation ]] version 3 [[ or [[ at your option ]] any later version ]]",
        "spdx license identifier gpl 3.0 [[ or later ]]",
    ],
    "gpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and {1,8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall {1,8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mit-notice": ["released under the [[ terms of the ]] mit license [[ copyright c {0,8} ]]"],
    "mit-text": [
        "[[ mit license ]] [[ copyright [[ c ]] {0,12} ]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be "
        "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall {1,8} be liable for any claim damages or other liability whether in an action of contract tort or "
        "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
}


class Automaton:
    """A template as states with word edges; every state but the last has its edges and the places it may skip to."""

    def __init__(self, template: str):
        self.edges: list[tuple[bytes | None, int]] = []  # of state i: the word (None: any) that leads on
        self.skips: dict[int, set[int]] = {}
        opened: list[int] = []
        for token in re.findall(r"\[\[|\]\]|\{\d+,\d+\}|\S+", template):
            if token == "[[":
                opened.append(len(self.edges))
            elif token == "]]":
                self._skip(opened.pop(), len(self.edges))
            elif token[0] == "{":
                least, most = map(int, token[1:-1].split(","))
                end = len(self.edges) + most
                for k in range(most):
                    if k >= least:
                        self._skip(len(self.edges), end)
                    self.edges.append((None, len(self.edges) + 1))
            else:
                for word in _WORD.findall(token.lower().encode()):
                    self.edges.append((word, len(self.edges) + 1))
        self.end = len(self.edges)
        self.first = {self.edges[s][0] for s in self._close({0}) if s < self.end}
        if self.end in self._close({0}) or None in self.first:
            raise ValueError("a template must start with a word and hold mandatory ones")
        optional = [(a, b) for a, bs in self.skips.items() for b in bs]
        self.mandatory = {w for i, (w, _) in enumerate(self.edges) if w and not any(a <= i < b for a, b in optional)}

    def _skip(self, a: int, b: int) -> None:
        if a != b:
            self.skips.setdefault(a, set()).add(b)

    def _close(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skips.get(s, ())
        return out

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that starts with words[at], or -1."""
        states, end, i = self._close({0}), -1, at
        while states and i < len(words):
            states = self._close({self.edges[s][1] for s in states if s < self.end and self.edges[s][0] in (None, words[i])})
            i += 1
            if self.end in states:
                end = i
        return end


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        self.by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for word in a.first:
                self.by_first.setdefault(word, []).append((label, a))
        #: The longest mandatory word of each template and phrase: a text without any of them has no match.
        self.probes = {max(a.mandatory, key=lambda w: (len(w), w)) for _, a in self.automata} | {b"license"}

    def scan(self, text: bytes) -> tuple:
        """n_base, first_word, last_word, base labels, labels, covered words."""
        words = _WORD.findall(text)
        starts, base, labels, covered = [], set(), set(), bytearray(len(words))
        for i, word in enumerate(words):
            if word == b"license":
                for phrase, label in BASE.items():
                    a = i - len(phrase) + 1
                    if a >= 0 and tuple(words[a : i + 1]) == phrase:
                        starts.append(a)
                        base.add(label)
                        covered[a : i + 1] = b"\1" * len(phrase)
            for label, automaton in self.by_first.get(word, ()):
                end = automaton.match(words, i)
                if end > 0:
                    labels.add(label)
                    covered[i:end] = b"\1" * (end - i)
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), sum(covered)


def count_words(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each text of a lowered buffer, by the class INSIDE."""
    inside = INSIDE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < off[1:]]
    first[edges] = inside[edges]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the share of a text's words that base phrases and accepted
    templates cover.  A null or empty text has no words, empty labels and score
    0; repeated rows stay; further columns are ignored.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates)
        nothing = (0, None, None, "", "", 0)
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            for i, j in doc_slices(off):
                low, own = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                n = count_words(low, own)
                data = low.tobytes()
                found = []
                for k in range(j - i):
                    text = data[own[k] : own[k + 1]]
                    found.append(scanner.scan(text) if any(p in text for p in scanner.probes) else nothing)
                columns = list(zip(*found, strict=True))
                score = np.array(columns[5]) / np.maximum(n, 1)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(c, t) for c, t in zip(columns[:5], kinds, strict=True)), pa.array(score)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
