"""Licence scans of whole texts by a positional index of licence templates.

The index maps each licence word to its places in the templates. A file looks up only those of a template's words that are
rarest among all documents: each place of such a word says where the template would start, and starts that enough of them
agree on, but for a few words put in or left out, are candidates. A candidate counts if enough of the template stands in
its place, by weight of rarity, and all phrases are there that the template can't do without.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the contract: phrases whose every place counts.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


#: Notices as they are found in files and works, and phrases that each must have.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT License.", ("mit license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "either version 3")),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license", "either version 2")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal", ("waived all copyright",)),
)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes whose words are held at a time; a piece ends between words.
PIECE = 4 << 20
#: Words of a template that a file looks up, the share of them that must agree on a start, words that a start may be off by, and
#: the weight of a template that must stand in its place.
RARE, AGREE, SLACK, LEAST = 8, 0.5, 3, 0.8
#: Candidates compared at a time.
AT_ONCE = 256


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower())


class Index:
    """Licence words and phrases as numbers, and the places of words in templates."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [*(words(t.text) for t in templates), *(words(k) for t in templates for k in t.keys), *(words(p) for p in phrases)]
        self.ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        numbers = lambda text: np.array([self.ids[w] for w in words(text)], np.int32)
        self.labels = [t.label for t in templates]
        self.templates = [numbers(t.text) for t in templates]
        self.keys = [[numbers(k) for k in t.keys] for t in templates]
        self.phrases = [(label, numbers(p)) for p, label in phrases.items()]

    def numbers(self, text: str) -> np.ndarray:
        """The number of each word of a text, -1 for words of no template."""
        data, get, out, at = text.encode("utf-8", "replace").lower(), self.ids.get, [], 0
        while at < len(data):
            found = BREAK.search(data, min(at + PIECE, len(data)))
            end = found.start() if found else len(data)
            some = WORD.findall(data, at, end)
            out.append(np.fromiter((get(w, -1) for w in some), np.int32, len(some)))
            at = max(end, at + 1)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after another."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


class Scanner:
    """An index with the rarity of its words among all documents."""

    def __init__(self, index: Index, rarity: np.ndarray, rare: int = RARE, agree: float = AGREE, slack: int = SLACK, least: float = LEAST):
        self.index, self.rarity, self.slack, self.least, self.agree, self.rare = index, rarity, slack, least, agree, rare
        # a template's distinct words, rarest first, each with its places
        self.postings = []
        for t in index.templates:
            distinct = sorted(set(t.tolist()), key=lambda w: (-rarity[w], w))
            self.postings.append([(w, np.flatnonzero(t == w)) for w in distinct])
        # the share of each template's weight that each licence word has: what a file has of it in all bounds what can stand in place
        self.shares = np.zeros((len(index.templates), len(index.ids)))
        for k, t in enumerate(index.templates):
            np.add.at(self.shares[k], t, (rarity[t] + 1e-9) / (rarity[t] + 1e-9).sum())

    def candidates(self, k: int, where: dict[int, np.ndarray]) -> np.ndarray:
        """Starts of template k that enough of its rarest words in the file agree on; where: places of words in the file."""
        postings = self.postings[k]
        known = [(w, at) for w, at in postings if w in where][: self.rare]
        need = max(1, math.ceil(self.agree * min(self.rare, len(postings))))
        if len(known) < need:
            return np.zeros(0, np.int64)
        starts = [np.unique((where[w][:, None] - at[None]).ravel()) for w, at in known]
        every = np.unique(np.concatenate(starts))
        votes = sum((np.searchsorted(s, every + self.slack, "right") > np.searchsorted(s, every - self.slack)).astype(np.int32) for s in starts)
        return every[votes >= need]

    def verified(self, k: int, ids: np.ndarray, starts: np.ndarray) -> tuple[int, float] | None:
        """The start, and weight in place, of the best candidate that has enough of template k and all its key phrases."""
        template, best = self.index.templates[k], None
        weight = self.rarity[template] + 1e-9
        shifts = np.arange(-self.slack, self.slack + 1)
        for lo in range(0, len(starts), AT_ONCE):
            some = starts[lo : lo + AT_ONCE]
            at = some[:, None] + np.arange(-self.slack, len(template) + self.slack)[None]
            window = np.where((at >= 0) & (at < len(ids)), ids[np.clip(at, 0, max(len(ids) - 1, 0))], -1)
            there = np.zeros((len(some), len(template)), bool)
            for s in shifts + self.slack:
                there |= window[:, s : s + len(template)] == template[None]
            share = (there * weight).sum(1) / weight.sum()
            for c in np.argsort(-share, kind="stable"):
                if share[c] < self.least or (best and share[c] <= best[1]):
                    break
                if all(len(places(window[c], key)) for key in self.index.keys[k]):
                    best = int(some[c]), min(1.0, float(share[c]))
                    break
            if best and best[1] >= 1:
                break
        return best

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """Words in a text, (label, first, last word) of the phrases in it, and (label, first, last word, weight) of templates."""
        ids = self.index.numbers(text)
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return len(ids), [], []
        base = [(label, int(p), int(p) + len(phrase) - 1) for label, phrase in self.index.phrases for p in places(ids, phrase)]
        order = known[np.argsort(ids[known], kind="stable")]
        which, first = np.unique(ids[order], return_index=True)
        where = dict(zip(which.tolist(), np.split(order, first[1:]), strict=True))
        found = []
        for k in np.flatnonzero(self.shares[:, which].sum(1) >= self.least - 1e-9).tolist():
            template = self.index.templates[k]
            starts = self.candidates(k, where)
            if len(starts) and (best := self.verified(k, ids, starts)):
                at, share = best
                found.append((self.index.labels[k], max(at, 0), min(at + len(template), len(ids)) - 1, share))
        return len(ids), sorted(base, key=lambda b: (b[1], b[0])), found


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def rarities(docs: DataFrame, index: Index, text_col: str = "text") -> np.ndarray:
    """ln((documents + 1) / (documents with the word + 1)) of each licence word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        count, total = np.zeros(len(index.ids), np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = np.unique(index.numbers(text))
                count[ids[ids >= 0]] += 1
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(count))]), pa.array([total, *count.tolist()])], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counts = {r[0]: r[1] for r in rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()}  # one row a licence word
    return np.log((counts.get(-1, 0) + 1) / (np.array([counts.get(k, 0) for k in range(len(index.ids))]) + 1))


def licence_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of `docs`: doc_id long, n_words long, places array<struct<label, first_word, last_word>> of every
    phrase, found array<struct<label, first_word, last_word, weight>> of the best place of every template that is there.

    Words are runs of digits, letters a to z (after A-Z) and all beyond ASCII. Null and empty texts have no words. Overlapping
    places all count. Rarity is counted over all rows; repeated rows and ids give repeated rows; other columns are not
    read; an empty table gives an empty result. `how`: rare, agree, slack, least of `Scanner`.
    """
    index = Index(templates, phrases)
    rows = _texts(docs, id_col, text_col)
    scanner = Scanner(index, rarities(rows, index), **how)
    place = [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                done = [scanner.scan(t) for t in part.column("text").to_pylist()]
                named = lambda rows, names: [dict(zip(names, r, strict=True)) for r in rows]
                base = pa.array([named(b, ["label", "first_word", "last_word"]) for _, b, _ in done], pa.list_(pa.struct(place)))
                found = pa.array([named(f, ["label", "first_word", "last_word", "weight"]) for _, _, f in done], pa.list_(pa.struct([*place, ("weight", pa.float64())])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _, _ in done], pa.int64()), base, found], ["doc_id", "n_words", "places", "found"])

    span = "label string, first_word bigint, last_word bigint".replace(" ", ": ").replace(",: ", ", ")
    return rows.mapInArrow(run, f"doc_id long, n_words long, places array<struct<{span}>>, found array<struct<{span}, weight: double>>")


def op13_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents. The score is the weight of the best notice, one half where only phrases are."""
    out = licence_scan(table(spark, sf_dir, "documents"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{x}.label") for x in c]))), ",")
    weight = F.coalesce(F.array_max("found.weight"), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        labels("places").alias("base_labels"), labels("places", "found").alias("labels"), F.greatest(weight, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
