"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every token string of every template (its size is at most twice the templates' tokens, a fixed
list). A document is streamed through it once: each step gives the matching statistic, the length of the longest suffix
of what has been read that occurs in some template. Maximal matches of at least ``min_match`` tokens are chained when
they continue one template within ``max_gap`` document tokens, and a chain that covers ``min_cover`` of its template
labels the document. Places of the base phrases come from the same walk: a phrase is a template of its own, and it ends
where its state, or one on the suffix-link path, is reached with a match of its length.

Nulls: a null text is empty. An empty text has no words, no labels, score 0. Null ids and repeated rows are carried.
Texts are processed whole; memory is that of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm.common import table

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known notices, as texts (fixed values).
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "gpl-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit-short": "Released under the MIT License.",
}
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 4, 0.6

#: A-Z to lower case; every ASCII character that is no letter or digit to a space. Other bytes belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several token strings. end[s] is (string, position) of one occurrence's end."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [(-1, -1)]
        self.ends: dict[int, set[tuple[int, int]]] = {}
        for k, string in enumerate(strings):
            last = 0
            for i, c in enumerate(string):
                last = self._extend(last, c, (k, i))
                self.ends.setdefault(last, set()).add((k, i))
        # every template a state occurs in: pushed up the suffix links, longest first
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends.setdefault(self.link[s], set()).update(self.ends.get(s, ()))

    def _new(self, length: int, link: int, nxt: dict[int, int], end: tuple[int, int]) -> int:
        self.next.append(nxt), self.link.append(link), self.length.append(length), self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c], p = clone, self.link[p]
        return clone

    def _extend(self, last: int, c: int, end: tuple[int, int]) -> int:
        if (q := self.next[last].get(c)) is not None:  # this prefix is in an earlier string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, 0, {}, end), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c], p = cur, self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.phrases, self.names = [(words(k), v) for k, v in phrases.items()], list(templates)
        self.strings = [words(x) for x in templates.values()]
        every = [*self.strings, *(p for p, _ in self.phrases)]
        self.ids = {w: i for i, w in enumerate(sorted({w for s in every for w in s}), 1)}
        self.sizes = [len(s) for s in every]
        self.sam = Automaton([[self.ids[w] for w in s] for s in every])
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        # phrases that end wherever a state is reached with a match of their length: (length, label)
        self.hits: list[list[tuple[int, str]]] = [[] for _ in self.sam.next]
        for p, label in self.phrases:
            s = 0
            for w in p:
                s = self.sam.next[s][self.ids[w]]
            self.hits[s].append((len(p), label))
        for s in sorted(range(1, len(self.sam.next)), key=self.sam.length.__getitem__):
            self.hits[s] += self.hits[self.sam.link[s]]

    def scan(self, text: str | None) -> dict:
        tokens = words(text)
        ids, get, sam = self.ids, self.ids.get, self.sam
        base: list[tuple[int, str]] = []
        chains: dict[int, list[list[int]]] = {}  # template: [document start, end, template start, end, covered]
        if not ids.keys().isdisjoint(tokens):
            at = [i for i, w in enumerate(tokens) if w in ids]
            state = length = 0
            last = -2
            found: list[tuple[int, int, int]] = []  # ends of maximal matches: (document end, length, state)
            for i in at:
                if i != last + 1:
                    if length >= self.min_match:
                        found.append((last, length, state))
                    state = length = 0
                last, c = i, get(tokens[i])
                if c not in sam.next[state]:
                    if length >= self.min_match:
                        found.append((i - 1, length, state))
                    while state and c not in sam.next[state]:
                        state = sam.link[state]
                    length = sam.length[state]
                if (to := sam.next[state].get(c)) is not None:
                    state, length = to, length + 1
                for n, label in self.hits[state]:
                    if n <= length:
                        base.append((i - n + 1, label))
            if length >= self.min_match:
                found.append((last, length, state))
            for end, n, s in found:
                self._chain(chains, end, n, s)
        spans = [(self.names[k], c[0], c[1], c[4] / self.sizes[k]) for k, cs in chains.items() for c in cs]
        good = sorted(x for x in spans if x[3] >= self.min_cover)
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(x[0].removesuffix("-short") for x in good)})
        score = max([min(1.0, x[3]) for x in spans], default=0.0)
        starts = [i for i, _ in base]
        return {"n_words": len(tokens), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(base_labels), "labels": ",".join(labels), "score": max(score, 1.0 if base else 0.0), "spans": good}

    def _chain(self, chains: dict[int, list[list[int]]], end: int, n: int, state: int) -> None:
        """Adds the match to a chain of each template it occurs in, where it continues that template nearby."""
        for k, stop in self.sam.ends[state]:
            if k >= len(self.names):
                continue
            start, begin = end - n + 1, stop - n + 1
            own = chains.setdefault(k, [])
            c = own[-1] if own else None
            if c and c[1] < end and start - c[1] - 1 <= self.max_gap and stop > c[3]:
                fresh = min(n, end - c[1], stop - c[3])
                c[1], c[3], c[4] = end, stop, c[4] + fresh
            elif not c or c[1] < end:
                own.append([start, end, begin, stop, n])


SPAN = "array<struct<template:string,first_word:bigint,last_word:bigint,cover:double>>"


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """A row for each row of df: its id, word and phrase counts, labels, score, and the covered template spans."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPAN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**params)
        span = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
        for b in batches:
            rows = [scanner.scan(x) for x in b.column(1).to_pylist()]
            for r in rows:
                r["spans"] = [dict(zip(("template", "first_word", "last_word", "cover"), x, strict=True)) for x in r["spans"]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], names=[id_col, *kinds])

    return df.select(F.col(id_col), F.col(text).alias("_tf_text")).mapInArrow(run, schema)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.drop("spans")
