"""Licence scans by a positional index of rare tokens.

Each template is a list of words; its key phrases are short passages that must occur. Each template is filed under the
word of its key phrases with the highest IDF over all files, so a file's rare licence words lead to all templates that it
can hold and common words to none. The postings of a template's words, their places in it, are intersected by relative
position: words that imply the same start support the template there. A supported template is kept if its key phrases
stand in the file.

Cases: null text counts as empty and has no words; repeated rows and equal texts get equal answers; an empty table gives
an empty result; other columns are ignored; a text of any length is scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import map_arrow
from clausemill.llm.tokens import ALNUM, pieces, words

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


@dataclass(frozen=True)
class Template:
    """`text` is a passage of the licence; `keys` are phrases of it that must all occur."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Phrases with their labels, and passages of well-known public licences.
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license", "version 2 0")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("cc-by-sa", "Creative Commons Attribution ShareAlike International License", ("attribution sharealike",)),
    Template("boost", "Boost Software License Version 1.0", ("boost software license",)),
)


class Index:
    """The templates as word numbers, their places the postings, and the hash of each word."""

    def __init__(self, templates: tuple[Template, ...], seed: int = 0):
        self.templates = templates
        self.texts = [words_of(t.text) for t in templates]
        self.keys = [[words_of(k) for k in t.keys] for t in templates]
        self.vocabulary = sorted({w for t in self.texts for w in t} | {w for ks in self.keys for k in ks for w in k})
        of = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = [[of[w] for w in t] for t in self.texts]
        self.key_ids = [[[of[w] for w in k] for k in ks] for ks in self.keys]
        hashes = words(pa.array([" ".join(self.vocabulary)]), ALNUM).hashes(seed)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[hashes >> np.uint64(48)] = True

    def filed(self, rank: np.ndarray) -> dict[int, list[int]]:
        """Templates by the rarest word of their key phrases."""
        out: dict[int, list[int]] = {}
        for t, keys in enumerate(self.key_ids):
            out.setdefault(min((w for k in keys for w in k), key=lambda w: rank[w]), []).append(t)
        return out

    def lookup(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Places of the licence words among the words `w`, and their numbers in the vocabulary. Spelling is compared."""
        h = w.hashes()
        at = np.flatnonzero(self.seen[h >> np.uint64(48)])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[slot] == h[at]
        at, ids = at[hit], self.order[slot[hit]]
        same = np.fromiter((w.text(i) == self.vocabulary[k].encode() for i, k in zip(at, ids, strict=True)), bool, len(at)) if len(at) < 1000 else _same(w, at, ids, self.vocabulary)
        return at[same], ids[same]


def _same(w, at: np.ndarray, ids: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """As above for many places: lengths, then bytes column by column."""
    spelled = [v.encode() for v in vocabulary]
    longest = max(map(len, spelled))
    letters = np.zeros((len(spelled), longest), np.uint8)
    for i, s in enumerate(spelled):
        letters[i, : len(s)] = np.frombuffer(s, np.uint8)
    size = np.array([len(s) for s in spelled])[ids]
    same = (w.ends[at] - w.starts[at]) == size
    for k in range(longest):
        inside = same & (k < size)
        same[inside] &= w.data[w.starts[at[inside]] + k] == letters[ids[inside], k]
    return same


def phrase_starts(at: np.ndarray, ids: np.ndarray, phrase: list[int], ends: int) -> np.ndarray:
    """Starts of places where the words of `phrase` stand consecutively; at, ids: the licence words of one text."""
    starts = at[ids == phrase[0]]
    for k, w in enumerate(phrase[1:], 1):
        starts = starts[np.isin(starts + k, at[ids == w], assume_unique=True)]
    return starts[starts + len(phrase) <= ends]


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many of all texts each licence word occurs; the result has a row for each word of the templates at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        total = np.zeros(len(index.vocabulary) + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, text_col):
                w = words(part.column(text_col), ALNUM, lower=True)
                at, ids = index.lookup(w)
                pairs = np.unique(w.doc[at] * len(index.vocabulary) + ids)
                total[:-1] += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
                total[-1] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([*index.vocabulary, ""]), pa.array(total)], names=["word", "n"])

    rows = map_arrow(docs.select(text_col), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, support: float = 0.6) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs.

    support: the part of a template's words that must stand where its start implies. score: the best such part.
    """
    frequency = document_frequencies(docs, text_col, templates)
    n_docs = frequency.get("", 0)
    idf = {w: math.log((1 + n_docs) / (1 + n)) for w, n in frequency.items() if w}
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        rank = np.empty(len(index.vocabulary), np.int64)
        rank[sorted(range(len(rank)), key=lambda i: (-idf.get(index.vocabulary[i], 0.0), index.vocabulary[i]))] = np.arange(len(rank))
        filed = index.filed(rank)
        for batch in batches:
            for part in pieces(batch, text_col):
                w = words(part.column(text_col), ALNUM, lower=True)
                at, ids = index.lookup(w)
                n = len(part)
                bounds = np.searchsorted(at, w.first)
                out = {"n_base": [0] * n, "first": [None] * n, "last": [None] * n, "base": [""] * n, "labels": [""] * n, "score": [0.0] * n}
                for d in np.flatnonzero(np.diff(bounds) > 1):
                    here = slice(bounds[d], bounds[d + 1])
                    found = match(index, filed, rank, at[here] - w.first[d], ids[here], int(w.first[d + 1] - w.first[d]), support)
                    if found:
                        base, every, starts, out["score"][d] = found
                        out["n_base"][d], out["base"][d], out["labels"][d] = len(starts), ",".join(sorted(base)), ",".join(sorted(every))
                        if len(starts):
                            out["first"][d], out["last"][d] = int(starts.min()), int(starts.max())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(w.counts(), pa.int64()), pa.array(out["n_base"], pa.int64()), pa.array(out["first"], pa.int64()), pa.array(out["last"], pa.int64()), pa.array(out["base"]), pa.array(out["labels"]), pa.array(out["score"], pa.float64())],
                    names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


class _Places(dict):
    """Places of a word in one text, found when asked for."""

    def __init__(self, at: np.ndarray, ids: np.ndarray):
        super().__init__()
        self.at, self.ids = at, ids

    def __missing__(self, w: int) -> np.ndarray:
        self[w] = self.at[self.ids == w]
        return self[w]


def match(index: Index, filed: dict[int, list[int]], rank: np.ndarray, at: np.ndarray, ids: np.ndarray, n_words: int, support: float):
    """Base labels, all labels, base starts and the score of one text; None if no template is supported."""
    present = np.unique(ids)
    have = set(present.tolist())
    where = _Places(at, ids)
    base, every, starts, score = set(), set(), [], 0.0
    for t in sorted(t for w in present[np.argsort(rank[present])].tolist() for t in filed.get(w, ())):
        t_ids, template = index.ids[t], index.templates[t]
        if template.base:
            if have.issuperset(t_ids):
                # all postings of the phrase intersected by relative position, rarest word first
                order = sorted(range(len(t_ids)), key=lambda k: rank[t_ids[k]])
                s = where[t_ids[order[0]]] - order[0]
                for k in order[1:]:
                    s = s[np.isin(s + k, where[t_ids[k]])]
                s = s[s >= 0]
                if len(s):
                    base.add(template.label)
                    every.add(template.label)
                    starts.append(s)
                    score = 1.0
            continue
        if not all(have.issuperset(k) and len(phrase_starts(at, ids, k, n_words)) for k in index.key_ids[t]):
            continue
        implied = np.concatenate([where[w] - k for k, w in enumerate(t_ids) if w in have] or [np.zeros(0, np.int64)])
        if len(implied):
            _, votes = np.unique(implied, return_counts=True)
            part = float(votes.max()) / len(t_ids)
            if part >= support:
                every.add(template.label)
                score = max(score, part)
    if not every:
        return None
    return base, every, np.concatenate(starts) if starts else np.zeros(0, np.int64), score
