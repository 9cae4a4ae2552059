"""License scans by a generalised suffix automaton of licence words (operator 11)."""

from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import table

#: Phrases whose every occurrence counts, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices and conditions of public licences, as their owners word them.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: Words of a match that goes into chains; words of text between two matches of a chain; and
#: the share of a template's words that a chain must cover.
MATCH, GAP, SHARE = 3, 12, 0.85
#: Bytes of text whose words are listed at once.
_SLICE = 1 << 20

#: Bytes that part words, as blanks. Bytes of other than ASCII characters belong to words.
_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes):
    """Lists of the words of a UTF-8 text, A-Z lower-cased, a slice of the text at a time."""
    text, at = text.lower().translate(_WORD), 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Span(NamedTuple):
    template: int
    first: int
    last: int
    covered: int


class Automaton:
    """All runs of words in ``texts``, in one generalised suffix automaton.

    A state stands for runs of words that end at the same places. ``ends`` are these places
    (text, word) for states with runs of ``match`` words or more, ``phrases`` the phrases that end
    a state's runs.
    """

    def __init__(self, texts: list[bytes], phrases: list[bytes], match: int):
        self.texts = [[w for part in words(t) for w in part] for t in texts]
        self.phrase_size = [sum(len(p) for p in words(t)) for t in phrases]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, text in enumerate(self.texts):
            last = 0
            for i, word in enumerate(text):
                last = self._extended(last, self.ids.setdefault(word, len(self.ids)))
                places[last].append((t, i))
        whole = defaultdict(list)
        for p, phrase in enumerate(phrases):
            last = 0
            for part in words(phrase):
                for word in part:
                    last = self._extended(last, self.ids.setdefault(word, len(self.ids)))
            whole[last].append(p)
        by_size = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        # A phrase ends every run that one of its state's suffix children stands for.
        self.phrases: list[tuple[int, ...]] = [()] * len(self.size)
        for s in by_size:
            self.phrases[s] = (*self.phrases[self.link[s]], *whole[s])
        for s in reversed(by_size):
            places[self.link[s]] += places[s]
        self.ends = [places[s] if self.size[s] >= match else [] for s in range(len(self.size))]

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        return len(self.size) - 1

    def _shortened(self, p: int, word: int) -> int:
        """The state after ``p`` and ``word``, whose longest run is one word longer than that of ``p``."""
        q = self.next[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._shortened(last, word)
        new = self._state(self.size[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._shortened(last, word)
        return new


def statistics(text: bytes, known: Automaton, match: int):
    """Streams a text through the automaton: number of words, places of phrases, long matches.

    At each word the longest run that ends there and stands in some template is known, as
    a state and a length. Where it cannot be extended it is a match: (first word, length,
    state).
    """
    following, link, size, phrases = known.next, known.link, known.size, known.phrases
    state = length = at = 0
    places: list[tuple[int, int]] = []
    matches: list[tuple[int, int, int]] = []
    for part in words(text):
        for word in map(known.ids.get, part):
            at += 1
            if word is None:
                if length >= match:
                    matches.append((at - 1 - length, length, state))
                state = length = 0
                continue
            step = following[state].get(word)
            if step is None:
                if length >= match:
                    matches.append((at - 1 - length, length, state))
                while step is None:
                    # The start knows every word of the templates.
                    state = link[state]
                    step = following[state].get(word)
                length = size[state]
            state = step
            length += 1
            for p in phrases[state]:
                if known.phrase_size[p] <= length:
                    places.append((at - known.phrase_size[p], p))
    if length >= match:
        matches.append((at - length, length, state))
    return at, places, matches


def chains(anchors: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Chains of matches with one template, as (first word, last word, words covered).

    ``anchors`` are (word of the text, word of the template, length) by word of the text. A
    match follows another if it begins later in both and ends later in both, at most
    ``gap`` words of text behind its end; what they share counts once. Each match goes
    into one chain, the best chains first.
    """
    best, before, open_ = [], [], 0
    for i, (at, there, length) in enumerate(anchors):
        score, found = length, -1
        while anchors[open_][0] + anchors[open_][2] + gap < at and open_ < i:
            open_ += 1
        for j in range(open_, i):
            a, t, n = anchors[j]
            if a < at and t < there and a + n + gap >= at:
                new = length - max(0, a + n - at, t + n - there)
                if new > 0 and best[j] + new > score:
                    score, found = best[j] + new, j
        best.append(score)
        before.append(found)
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        j, last = i, anchors[i][0] + anchors[i][2] - 1
        while True:
            used[j] = True
            k = before[j]
            if k < 0 or used[k]:
                break
            j = k
        out.append((anchors[j][0], last, best[i] - (best[k] if k >= 0 else 0)))
    return out


def covered_spans(matches: list[tuple[int, int, int]], known: Automaton, gap: int, share: float) -> tuple[list[Span], float]:
    """Spans of text that cover ``share`` of a template, and the largest share that any chain covers."""
    anchors = defaultdict(list)
    for at, length, state in matches:
        for t, end in known.ends[state]:
            anchors[t].append((at, end - length + 1, length))
    spans, most = [], 0.0
    for t, found in anchors.items():
        for first, last, covered in chains(sorted(found), gap):
            part = min(1.0, covered / len(known.texts[t]))
            most = max(most, part)
            if part >= share:
                spans.append(Span(t, first, last, covered))
    return sorted(spans, key=lambda s: (s.first, s.last, s.template)), most


SPANS = "array<struct<label: string, first_word: long, last_word: long, covered: long, coverage: double>>"
FOUND = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans {SPANS}, score double"


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES,
    match: int = MATCH, gap: int = GAP, share: float = SHARE,
) -> DataFrame:
    """Licence phrases and licence texts in every row's whole text.

    ``phrases`` and ``templates`` are pairs of label and text (phrases: text and label); a
    phrase counts wherever all its words stand one after the other. Templates are found
    by chains of matches of at least ``match`` words that cover ``share`` of their words:
    ``spans`` holds label, first and last word of the text and the words covered. Words
    count from 0. ``score`` is the largest share of a template that a chain covers, and 1
    where a phrase stands.

    A map without shuffle: a text streams through the automaton, which holds the
    templates only, in time linear in its words. Null and empty texts have no words; null
    ids and repeated rows are scanned as any other; an empty table gives no rows; further
    columns are ignored.
    """
    sentences, labels = [t.encode() for t, _ in phrases], [label for _, label in phrases]
    names, texts = [label for label, _ in templates], [t.encode() for _, t in templates]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), span, pa.float64()]

    def scanned(batches):
        known = Automaton(texts, sentences, match)
        for b in batches:
            out = []
            for text in b.column(1):
                n, places, matches = statistics(text.as_py() or b"", known, match)
                spans, most = covered_spans(matches, known, gap, share)
                starts = [at for at, _ in places]
                out.append((
                    n, len(places), min(starts, default=None), max(starts, default=None), sorted({labels[p] for _, p in places}),
                    [{"label": names[s.template], "first_word": s.first, "last_word": s.last, "covered": s.covered, "coverage": s.covered / len(known.texts[s.template])} for s in spans],
                    1.0 if places else most,
                ))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split(" ")[0] for f in _TOP])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(scanned, FOUND)


_TOP = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "score")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), "score",
    )
