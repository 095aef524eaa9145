"""License scans: templates with optional and replaceable regions, compiled into word automata.

In a template ``[[ ... ]]`` is a region that may be missing (regions nest) and ``{{name:min-max}}`` one that stands for
so many words, whatever they are; all other words are mandatory and must follow each other exactly.  An automaton's
states are sets of positions in the template, so that matching takes no backtracking.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, lean, table, text_slices
from siltstone.llm.decontaminate import words_of

# The phrases of the base labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of the two BSD texts.
_BSD_1_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {{provider:1-10}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{provider:1-10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# Wording of public licence texts, whole, and of the notices that refer to them.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache [[software]] license [[version]] 2 0",
        "apache license version 2 0 january 2004",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "released under the apache license [[version 2 0]]",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction",
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {{holders:1-10}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "[[released]] under the [[{{clauses:1-2}} clause]] bsd license",
        "licensed under the [[{{clauses:1-2}} clause]] bsd license",
    ),
    "bsd-2-clause": (_BSD_1_2 + " " + _BSD_END,),
    "bsd-3-clause": (_BSD_1_2 + " [[3]] neither the name of {{holder:1-12}} nor the names of [[its]] [[{{whose:1-3}}]] contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END,),
    "isc": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{author:1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{author:1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "gpl": (
        "licensed under the gnu general public license [[version {{version:1-2}}]]",
        "under the terms of the gnu general public license as published by the free software foundation [[either version {{version:1-2}} [[of the license]]]]",
        "released under the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{version:1-2}} of the license or [[at your option]] any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details [[you should have received a copy of the gnu general public license along with this program [[if not see {{where:1-8}}]]]]",
    ),
    "lgpl": ("under the [[terms of the]] gnu lesser general public license",),
    "agpl": ("under the [[terms of the]] gnu affero general public license",),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0",
        "subject to the terms of the mozilla public license v [[{{version:1-2}}]]",),
    "cc-by": (
        "licensed under [[a]] [[the]] creative commons attribution [[{{variant:1-3}}]] [[{{version:1-2}}]] [[international]] license",
        "licensed under cc by [[{{variant:1-2}}]] {{version:2-2}}",
    ),
    "cc0": ("cc0 1 0 universal", "to the extent possible under law {{holder:1-12}} has waived all copyright and related or neighboring rights"),
    "public-domain": ("this is free and unencumbered software released into the public domain", "[[hereby]] dedicated to the public domain"),
    "reserved": ("copyright [[c]] {{year_and_holder:1-12}} all rights reserved",),
}


class Automaton:
    """Edges: state -> (word or None for any word, next state); ``free``: state -> states reached without a word."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        state, opened = 0, []
        for mark in re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|[^\s\[\]{}]+", template):
            if mark == "[[":
                opened.append(state)
            elif mark == "]]":
                self.free[opened.pop()].append(state)
            elif mark.startswith("{{"):
                least, most = map(int, mark[2:-2].split(":")[1].split("-"))
                first = state
                for k in range(most):
                    state = self._after(state, None)
                    if k + 1 == least:
                        first = state
                skips = range(first, state)
                for s in skips:
                    self.free[s].append(state)
            else:
                state = self._after(state, mark.encode())
        if opened:
            raise ValueError(f"region left open: {template}")
        self.last = state
        self.closed = [self._close(s) for s in range(len(self.free))]
        self.starts = {w for s in self.closed[0] for w, _ in self.edges[s]}
        if None in self.starts or self.last in self.closed[0]:
            raise ValueError(f"a template begins with a mandatory word: {template}")

    def _after(self, state: int, word: bytes | None) -> int:
        self.edges.append([])
        self.free.append([])
        self.edges[state].append((word, len(self.edges) - 1))
        return len(self.edges) - 1

    def _close(self, state: int) -> frozenset[int]:
        got, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in got:
                    got.add(s)
                    todo.append(s)
        return frozenset(got)

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that begins at ``at``, or -1."""
        states, end = self.closed[0], -1
        while True:
            if self.last in states:
                end = at
            if at == len(words) or not states:
                return end
            word = words[at]
            states = frozenset().union(*(self.closed[t] for s in states for w, t in self.edges[s] if w is None or w == word))
            at += 1


@lru_cache(maxsize=4)
def _compiled(templates: tuple) -> dict[bytes, list[tuple[str, Automaton]]]:
    by_start: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, texts in templates:
        for text in texts:
            automaton = Automaton(text)
            for word in automaton.starts:
                by_start.setdefault(word, []).append((label, automaton))
    return by_start


_PHRASES = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())), ("matches", pa.list_(pa.string())), ("match_starts", pa.list_(pa.int64())), ("match_ends", pa.list_(pa.int64()))])


def scan(text: bytes, by_start: dict) -> tuple:
    """Number of words, places and labels of base phrases, and (label, start, end) of template matches."""
    words = words_of(text)
    places, base, found = [], set(), []
    line = b" " + b" ".join(words) + b" "
    for phrase, label in _PHRASES:
        if b" " + b" ".join(phrase) + b" " in line:
            k = len(phrase)
            at = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + k] == phrase]
            places += at
            base.add(label)
    if not by_start.keys().isdisjoint(words):
        taken: dict[str, int] = {}
        for i, w in enumerate(words):
            for label, automaton in by_start.get(w, ()):
                if i >= taken.get(label, 0) and (end := automaton.match(words, i)) > i:
                    found.append((label, i, end))
                    taken[label] = end
    return len(words), sorted(places), sorted(base), found


def _scan(templates: tuple):
    def run(batches):
        by_start = _compiled(templates)
        for whole in batches:
            for batch in text_slices(whole, 1, 8 << 20):
                rows = [(i, n, places, base, [m[0] for m in found], [m[1] for m in found], [m[2] for m in found]) for i, (n, places, base, found) in zip(batch.column(0).to_pylist(), (scan(t, by_start) for t in byte_texts(batch, 1)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, places, base_labels, matches, match_starts, match_ends``.

    ``places`` are the word places of all base phrases, ``matches`` the labels of template matches (of one label they
    don't overlap).  Null and empty texts have none; repeated rows each get theirs; other columns aren't read; an empty
    table gives no rows.
    """
    fixed = tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items())
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(lean(_scan(fixed)), "doc_id long, n_words long, places array<long>, base_labels array<string>, matches array<string>, match_starts array<long>, match_ends array<long>")


def op8_license_templates(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, repeated ones too; null and empty texts have no words, no places and score zero; an empty table gives no rows."""
    found = license_scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "matches")))
    # A phrase alone leaves some doubt, a whole template little, and each further one leaves less.
    doubt = F.pow(F.lit(0.5), F.size("base_labels")) * F.pow(F.lit(0.1), F.size(F.array_distinct("matches")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (F.lit(1.0) - doubt).alias("score"),
    )
