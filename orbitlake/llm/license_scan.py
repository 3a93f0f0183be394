"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence notices.

The automaton's symbols are words.  A text is streamed through it: at every
word, the longest string of words that ends there and stands in some template,
and its state.  A phrase stands at a place exactly where its state is on the
suffix path of the text's state, so phrases come from the same pass.
Long matches are chained in the order of both text and template, and a chain
that covers enough of its template is a span with that template's label.

Most words of a text are in no template, and most neighbours are neighbours in
none.  Both are seen on hashes, in arrays; only stretches of words whose
neighbours can follow one another are streamed word by word.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns
from .textscan import TermBlock, blocks

#: Phrases and their labels: fixed values of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices of public licences, and one-line declarations, by the label that they give.
NOTICES = {
    "mit-notice": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "released under the MIT License",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "licensed under the Apache License, Version 2.0",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "licensed under the GNU General Public License, version 3",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "licensed under the GNU General Public License, version 2",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-4.0": ["licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0"],
    "cc-by-sa-4.0": ["licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "licensed under CC BY-SA 4.0"],
    "cc-by-nc-4.0": ["licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "licensed under CC BY-NC 4.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Fewest words of a match that is chained, most words of the text between two matches, and the share of a template that a span covers.
LONG, GAP, COVERED = 3, 24, 0.8


def words_of(text: str) -> list[str]:
    """The words of a template, as texts have them."""
    (b,) = blocks(pa.array([text]), kind=TermBlock)
    return [bytes(b.data[lo:hi]).decode() for lo, hi in zip(b.starts, b.ends, strict=True)]


@dataclass
class Automaton:
    """A generalised suffix automaton: transitions, suffix links and longest lengths of the states; 0 is the root."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: By state: (template, words up to its end) of all places where a suffix of its strings ends, and the longest such suffix.
    ends: list[dict[tuple[int, int], int]] = field(default_factory=list)

    def _state(self, moves: dict[str, int], link: int, longest: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _split(self, at: int, to: int, word: str) -> int:
        """The state of the string that ``at`` and ``word`` give, which ``to`` holds among longer ones."""
        clone = self._state(dict(self.next[to]), self.link[to], self.longest[at] + 1)
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def extend(self, last: int, word: str) -> int:
        """The state of ``last``'s longest string with ``word`` behind it."""
        to = self.next[last].get(word)
        if to is not None:
            return to if self.longest[to] == self.longest[last] + 1 else self._split(last, to, word)
        new, at = self._state({}, 0, self.longest[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.longest[to] == self.longest[at] + 1 else self._split(at, to, word)
        return new

    @classmethod
    def of(cls, templates: list[list[str]]) -> Automaton:
        made = cls()
        for words in templates:
            last = 0
            for word in words:
                last = made.extend(last, word)
        made.ends = [{} for _ in made.next]
        for t, words in enumerate(templates):
            state = 0
            for i, word in enumerate(words):
                state = at = made.next[state][word]
                while at > 0:
                    made.ends[at][t, i + 1] = made.longest[at]
                    at = made.link[at]
        for state in sorted(range(1, len(made.next)), key=made.longest.__getitem__):  # links come first
            for place, longest in made.ends[made.link[state]].items():
                made.ends[state].setdefault(place, longest)
        return made

    def step(self, state: int, length: int, word: str) -> tuple[int, int]:
        """State and length of the longest match that ends with ``word``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.longest[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)


@dataclass
class Scanner:
    """Phrases and notices, their automaton, and what of it shows on hashes."""

    templates: list[list[str]]
    labels: list[str]
    n_phrases: int
    long: int
    automaton: Automaton
    #: By state: (length, label) of phrases, and (template, place, length) in notices of matches to chain.
    whole: list[list[tuple[int, str]]]
    parts: list[list[tuple[int, int, int]]]
    vocabulary: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, phrases: dict[str, str], notices: dict[str, list[str]], long: int = LONG) -> Scanner:
        """A template without words is an error; a word alone can be a template."""
        named = [*((label, text) for text, label in phrases.items()), *((label, text) for label, texts in notices.items() for text in texts)]
        templates = [words_of(text) for _, text in named]
        if not all(templates):
            raise ValueError("a template has no words")
        made = Automaton.of(templates)
        whole = [sorted((place, named[t][0]) for (t, place), n in at.items() if t < len(phrases) and n >= place == len(templates[t])) for at in made.ends]
        least = [min(long, len(t)) for t in templates]
        parts = [sorted((t, place, n) for (t, place), n in at.items() if t >= len(phrases) and n >= least[t]) for at in made.ends]
        distinct = sorted({w for t in templates for w in t})
        (b,) = blocks(pa.array([" ".join(distinct)]), kind=TermBlock) if distinct else (None,)
        number = dict(zip(distinct, b.word_hash.tolist(), strict=True)) if b else {}
        vocabulary = np.array(sorted(number.values()), np.uint64)
        place = {w: int(np.searchsorted(vocabulary, np.uint64(h))) for w, h in number.items()}
        pairs = {place[a] * len(vocabulary) + place[c] for t in templates for a, c in zip(t, t[1:], strict=False)}
        return cls(templates, [label for label, _ in named], len(phrases), long, made, whole, parts, vocabulary, np.array(sorted(pairs), np.int64))

    def stretches(self, b: TermBlock) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of all maximal stretches in which every two neighbours are neighbours in a template; of single words where one is a template."""
        n = len(b.starts)
        if not n or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, b.word_hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == b.word_hash
        linked = known[:-1] & known[1:] & (b.word_doc[:-1] == b.word_doc[1:])
        where = np.flatnonzero(linked)
        linked[where] = np.isin(at[where] * len(self.vocabulary) + at[where + 1], self.pairs)
        padded = np.concatenate([[False], linked, [False]])
        first, last = np.flatnonzero(~padded[:-1] & padded[1:]), np.flatnonzero(padded[:-1] & ~padded[1:])
        if any(len(t) == 1 for t in self.templates):
            alone = np.flatnonzero(known & ~padded[:-1] & ~padded[1:])
            first, last = np.append(first, alone), np.append(last, alone)
            order = np.argsort(first)
            first, last = first[order], last[order]
        return first, last

    def stream(self, words: list[str], first: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Of a stretch that starts at word ``first``: (start, label) of phrases, and (text end, template, template end, length) of matches that cannot be longer."""
        state = length = 0
        found, matches = [], []
        going: dict[tuple[int, int], int] = {}
        for i, word in enumerate(words):
            state, length = self.automaton.step(state, length, word)
            now = {}
            for t, place, n in self.parts[state]:
                if min(n, length) >= min(self.long, len(self.templates[t])):
                    now[t, place] = min(n, length)
            matches += [(first + i, t, place, n) for (t, place), n in going.items() if (t, place + 1) not in now]
            going = now
            for n, label in self.whole[state]:
                if n <= length:
                    found.append((first + i + 1 - n, label))
        return found, matches + [(first + len(words), t, place, n) for (t, place), n in going.items()]


def chains(matches: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(words covered, start, end) of the best chain that ends with each of one template's matches (text end, template end, length).

    A match that overlaps the one before it, in the text or in the template,
    counts from behind both overlaps; at most ``gap`` words of the text lie
    between two.  Among equal chains the one that starts last, the tightest, is best.
    """
    matches = sorted(matches)
    ends = [m[0] for m in matches]
    best: list[tuple[int, int]] = []
    for i, (end, place, length) in enumerate(matches):
        top = (length, end - length)
        for j in range(bisect_left(ends, end - length - gap), i):
            over = max(0, ends[j] - (end - length), matches[j][1] - (place - length))
            if over < length and matches[j][1] < place:
                top = max(top, (best[j][0] + length - over, best[j][1]))
        best.append(top)
    return [(covered, start, end) for (covered, start), end in zip(best, ends, strict=True)]


def apart(spans: list[tuple], start: int, end: int) -> bool:
    """Whether a span shares at most half of its words with each of those taken, which are (start, end, ...) in order; it is put among them by the caller."""
    i = bisect_left(spans, (start,))
    return all(2 * (min(end, s[1]) - max(start, s[0])) <= end - start for s in spans[max(0, i - 1) : i + 1])


def covered_spans(scanner: Scanner, matches: list[tuple[int, int, int, int]], covered: float = COVERED, gap: int = GAP) -> tuple[list[dict], float]:
    """Template spans of a text from its long matches, and the greatest share of a notice that any chain covers.

    Of spans that share most of their words, the one with more covered words
    stays (ties: the greater share, then the shorter, then the earlier template):
    a text with one version of a notice is not labelled with another, and each
    copy of a notice is a span.
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for end, t, place, n in matches:
        by_template.setdefault(t, []).append((end, place, n))
    spans, score = [], 0.0
    for t, mine in by_template.items():
        whole = len(scanner.templates[t])
        for n, start, end in chains(mine, gap):
            score = max(score, n / whole)
            if n >= covered * whole:
                spans.append((-n, -n / whole, end - start, t - scanner.n_phrases, start, end))
    kept: list[tuple[int, int, int, float]] = []
    for _, share, _, t, start, end in sorted(spans):
        if apart(kept, start, end):
            insort(kept, (start, end, t, -share))
    return [{"label": scanner.labels[scanner.n_phrases + t], "template": t, "start": start, "end": end, "covered": share} for start, end, t, share in kept], score


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType())])
PHRASE = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())])
SCHEMA = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("phrases", T.ArrayType(PHRASE)), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("score", T.DoubleType())])


def scan_licenses(df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` plus ``n_words``, ``phrases`` (start, label of every place), ``spans`` (covered template spans) and ``score``.

    ``score`` is the greatest covered share of any template, 1 where a phrase
    stands.  Positions are words from 0, ends exclusive.  Whole texts are read;
    null and empty ones have no words, no places and score 0.  A row is judged
    by its text alone, so repeated rows agree.  Columns of the added names are
    replaced, all others kept.
    """
    scanner = Scanner.of(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n_words, places, spans, scores = [np.zeros(0, np.int64)], [], [], []
        for b in blocks(batch.column(text), kind=TermBlock):
            n_words.append(b.n_words)
            found: list[list[dict]] = [[] for _ in range(len(b))]
            matches: dict[int, list[tuple[int, int, int, int]]] = {}
            for first, last in zip(*(x.tolist() for x in scanner.stretches(b)), strict=True):
                doc = int(b.word_doc[first])
                words = [bytes(b.data[b.starts[w] : b.ends[w]]).decode() for w in range(first, last + 1)]
                whole, parts = scanner.stream(words, first - int(b.word_bounds[doc]))
                found[doc] += [{"start": s, "label": label} for s, label in whole]
                matches.setdefault(doc, []).extend(parts)
            judged = {doc: covered_spans(scanner, m) for doc, m in matches.items()}
            places += [sorted(f, key=lambda p: (p["start"], p["label"])) for f in found]
            spans += [judged.get(doc, ([], 0.0))[0] for doc in range(len(b))]
            scores += [1.0 if f else judged.get(doc, ([], 0.0))[1] for doc, f in enumerate(found)]
        return [pa.array(np.concatenate(n_words)), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))), pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))), pa.array(scores, pa.float64())]

    return add_columns(df, SCHEMA, compute)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and covered notices of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = scan_licenses(docs)
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base, own = F.col("phrases.label"), F.col("spans.label")
    return made.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )
