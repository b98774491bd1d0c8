"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template. A file is streamed through it: at each word the automaton
knows the longest run of words ending there that some template has (the matching statistics). Runs that can't be made
longer are matches, at all their places in the templates; matches of one template that lie in order, with small gaps,
are chained, and a chain that covers enough of its template is a span: label, first and last word, share covered. Base
phrases are templates as well: a phrase occurs where the automaton's state has it as a suffix.

Words are runs of bytes 0-9, a-z and above 0x7F of the UTF-8 text after lower-casing A to Z, so words count from 0 over
the whole text. A word pair that no template has ends every run there; that is tested for all words of a text at once,
and the automaton steps through the rest. Null and empty texts have no words. Repeated rows are scanned each. A null
doc_id stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.shared import table

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices, and the labels of licences they stand for.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("gpl-family", "this work is licensed under the gnu general public license version 3"),
    ("gpl-family", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-family", "gnu lesser general public license"),
    ("agpl-family", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: The shortest match that may join a chain, in words.
LEAST_MATCH = 3
#: The largest gap in a chain, in words of the text.
LARGEST_GAP = 6
#: The share of a template that a chain must cover.
LEAST_COVERED = 0.75

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Automaton:
    """Generalised suffix automaton. places[state]: (template, last word there) of all occurrences of the state's runs."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extended(last, word)
                self.places[last].add((number, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, above: int, word: int, below: int) -> int:
        """The state of the runs of below that are no longer than one word more than those of above."""
        if self.length[below] == self.length[above] + 1:
            return below
        twin = self._state(self.length[above] + 1, self.link[below], dict(self.next[below]))
        self.link[below] = twin
        while above >= 0 and self.next[above].get(word) == below:
            self.next[above][word] = twin
            above = self.link[above]
        return twin

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new = self._state(self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in self.next[above]:
            self.next[above][word] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._split(above, word, self.next[above][word])
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE):
        all_ = [(label, words_of(text)) for label, text in templates] + [(label, words_of(text)) for text, label in base.items()]
        self.labels = [label for label, _ in all_]
        self.first_base = len(templates)
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in all_ for w in ws}))}

        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                return 0

        self.ids = Ids(vocabulary)
        numbers = [[vocabulary[w] for w in ws] for _, ws in all_]
        self.sizes = [len(ws) for ws in numbers]
        self.automaton = Automaton(numbers)
        self.pairs = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), dtype=bool)
        for ws in numbers:
            self.pairs[ws[:-1], ws[1:]] = True
        self.phrases = self._phrases(numbers)

    def _phrases(self, numbers: list[list[int]]) -> list[list[tuple[int, int]]]:
        """For each state, the base phrases (template, words) that are suffixes of its runs, or may be."""
        a = self.automaton
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t in range(self.first_base, len(numbers)):
            state = length = 0
            for w in numbers[t]:
                state, length = a.step(state, length, w)
            own[state].append((t, length))
        out: list[list[tuple[int, int]]] = [[]] * len(a.next)
        for state in sorted(range(1, len(a.next)), key=lambda s: a.length[s]):
            above = out[a.link[state]] if a.link[state] > 0 else []
            out[state] = above + own[state]
        return out

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Maximal matches (last word, words, state) of two words or more, and places (template, first word) of base phrases."""
        if len(words) < 2:
            return [], []
        ids = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int32, count=len(words))
        at = np.flatnonzero(self.pairs[ids[:-1], ids[1:]]) + 1
        found, places = [], []
        state = length = 0
        before = -1
        a = self.automaton
        for i in at.tolist():
            if i != before + 1:
                if length >= 2:
                    found.append((before, length, state))
                state, length = a.step(0, 0, int(ids[i - 1]))
            was, longest = state, length
            state, length = a.step(state, length, int(ids[i]))
            if length != longest + 1 and longest >= 2:
                found.append((i - 1, longest, was))
            for t, n in self.phrases[state]:
                if n <= length:
                    places.append((t, i - n + 1))
            before = i
        if length >= 2:
            found.append((before, length, state))
        return found, places

    def spans(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template) of chains that cover enough, in order."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for last, n, state in found:
            for t, end in self.automaton.places[state]:
                if t < self.first_base and n >= min(LEAST_MATCH, self.sizes[t]):
                    by_template[t].append((last, end, n))
        out = set()
        for t, own in by_template.items():
            own.sort()
            covered = [n for _, _, n in own]
            back = [-1] * len(own)
            for k, (last, end, n) in enumerate(own):
                j = k - 1
                while j >= 0 and last - n - own[j][0] <= LARGEST_GAP + self.sizes[t]:
                    gap, step = last - n - own[j][0], end - n - own[j][1]
                    # what two matches have in common counts once
                    new = n + min(0, gap, step)
                    if gap <= LARGEST_GAP and new > 0 and end > own[j][1] and last > own[j][0] and covered[j] + new > covered[k]:
                        covered[k], back[k] = covered[j] + new, j
                    j -= 1
            taken: set[int] = set()
            for k in sorted(range(len(own)), key=lambda k: (-covered[k], k)):
                share = covered[k] / self.sizes[t]
                if share < LEAST_COVERED:
                    break
                path = [k]
                while back[path[-1]] >= 0:
                    path.append(back[path[-1]])
                if taken.isdisjoint(path):
                    first = own[path[-1]]
                    out.add((self.labels[t], first[0] - first[2] + 1, own[k][0], min(1.0, share)))
                taken.update(path)
        return sorted(out, key=lambda s: (s[1], s[2], s[0], -s[3]))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Words, base places (label, first word), and template spans of a text."""
        words = words_of(text)
        found, places = self.matches(words)
        return len(words), [(self.labels[t], first) for t, first in places], self.spans(found)


def words_of(text: bytes | str | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_WORDS).split()


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label, first_word) and spans (label, first_word, last_word, covered) of docs (doc_id, text)."""
    place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"label": a, "first_word": b} for a, b in r[1]] for r in rows], place),
                    pa.array([[{"label": a, "first_word": b, "last_word": c, "covered": d} for a, b, c, d in r[2]] for r in rows], span),
                ],
                ["doc_id", "n_words", "base", "spans"],
            )

    schema = "doc_id long, n_words long, base array<struct<label string, first_word long>>, spans array<struct<label string, first_word long, last_word long, covered double>>"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("binary")).mapInArrow(run, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        # a base phrase is a template found whole
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"),
        F.to_json("spans").alias("spans"),
    )
