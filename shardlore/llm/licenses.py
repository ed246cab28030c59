"""License scans through a positional index of rare template words.

The index maps licence words to their places in the templates. Of each file's licence words those of highest IDF (inverse document frequency over the
whole corpus) are looked up, as many as it takes that no template could have LEAST of its weight in place without one of them. Every
place of such a word votes for an alignment of template and
file, the relative position of the two; the template's other postings are intersected at that
alignment, weighted by IDF, and a template is reported only if enough of its weight stands in place and all its
mandatory key phrases occur in the file. The score is 1 for a base phrase, the largest share of weight in place for a reported template, and half of it for
one that isn't reported.

Base phrases are reported wherever their words stand one after another. Defined results: a null text is
empty and has no words; a null doc_id keeps its row; repeated rows are reported once each; without
rows nothing is returned. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common, text

#: Phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Share of a template's IDF weight that has to stand in place.
LEAST = 0.6
#: Files whose licence words are weighed together.
ROWS = 512


class Template(NamedTuple):
    label: str
    words: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4.0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4.0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4.0", ("cc by nd",)),
    Template("cc-by-4.0", "licensed under cc by 4.0", ("cc by 4",)),
    Template("cc-by-4.0", "creative commons attribution 4.0 international license", ("creative commons attribution 4",)),
    Template("cc0", "cc0 1.0 universal public domain dedication", ("public domain dedication",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a"
        " copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software",
        ("apache license", "except in compliance with the license"),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
        " copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you"
        " can obtain one at http mozilla org mpl 2.0",
        ("mozilla public license",),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by"
        " the free software foundation",
        ("gnu lesser general public license", "free software foundation"),
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published"
        " by the free software foundation",
        ("gnu affero general public license", "free software foundation"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising"
        " from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to"
        " alter it and redistribute it freely",
        ("without any express or implied warranty", "alter it and redistribute it freely"),
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"
        " covered by this license",
        ("any person or organization obtaining a copy",),
    ),
    Template(
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
        ("eclipse public license",),
    ),
    Template("eupl", "licensed under the european union public licence", ("european union public licence",)),
    Template("artistic-2.0", "licensed under the artistic license 2.0", ("artistic license",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license", ("attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", ("attribution noncommercial",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
)

_WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


def split(value: str) -> list[str]:
    """The words of a template or phrase."""
    return _WORDS.findall(value)


class Book:
    """The vocabulary of templates and phrases, and, given document frequencies, the index of rare template words."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        phrases = [p for p, _ in BASE] + [k for t in templates for k in t.keys]
        self.words = sorted({w for s in [*phrases, *(t.words for t in templates)] for w in split(s)})
        self.number = {w: i for i, w in enumerate(self.words)}
        marks = np.array([text.hash_of(w) for w in self.words], np.uint64)
        self.order = np.argsort(marks)
        self.marks = marks[self.order]
        self.texts = [self.ids(t.words) for t in templates]
        self.base = [self.ids(p) for p, _ in BASE]
        self.keys = [[self.ids(k) for k in t.keys] for t in templates]

    def ids(self, phrase: str) -> np.ndarray:
        return np.array([self.number[w] for w in split(phrase)], np.int64)

    def look_up(self, found: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word hash, -1 for others."""
        out = np.full(len(found), -1, np.int16)
        prefix = np.zeros(1 << 16, bool)
        prefix[self.marks >> np.uint64(48)] = True
        likely = np.flatnonzero(prefix[found >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.marks, found[likely]), len(self.marks) - 1)
        same = self.marks[at] == found[likely]
        out[likely[same]] = self.order[at[same]]
        return out

    def weigh(self, documents: int, frequency: dict[int, int]) -> None:
        """Set IDF weights, the postings of the template words, and each word's weight in each template, by ascending IDF."""
        self.idf = np.array([math.log((documents + 1) / (frequency.get(i, 0) + 1)) + 0.1 for i in range(len(self.words))])
        pairs = sorted((int(i), t, q) for t, ids in enumerate(self.texts) for q, i in enumerate(ids))
        self.posted = np.array([p[1:] for p in pairs], np.int64)
        ends = np.searchsorted([p[0] for p in pairs], np.arange(len(self.words) + 1))
        self.low, self.many = ends[:-1], np.diff(ends)
        self.rarity = np.argsort(np.argsort(self.idf, kind="stable"))
        self.weight = np.zeros((len(self.words), len(self.texts)))
        for t, ids in enumerate(self.texts):
            np.add.at(self.weight, (self.rarity[ids], t), self.idf[ids])

    def rarest(self, ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Whether each licence word (by number) is among its file's highest-IDF ones that are looked up."""
        least = np.full(rows, len(self.words))
        enough = LEAST * self.weight.sum(axis=0) - 1e-9
        for low in range(0, rows, ROWS):
            here = slice(*np.searchsorted(row, [low, low + ROWS]))
            there = np.zeros((min(ROWS, rows - low), len(self.words)))
            there[row[here] - low, self.rarity[ids[here]]] = 1
            # The weight of the file's words up to each one; from the first on that makes enough for any template, words are looked up.
            reached = (np.cumsum(there[:, :, None] * self.weight, axis=1) >= enough).any(axis=2)
            least[low : low + ROWS] = np.where(reached[:, -1], reached.argmax(axis=1), len(self.words))
        return self.rarity[ids] >= least[row]

    def phrase(self, ids: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Word numbers at which a phrase begins."""
        n = len(wanted)
        if len(ids) < n:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(ids[: len(ids) - n + 1] == wanted[0])
        for k in range(1, n):
            at = at[ids[at + k] == wanted[k]]
        return at[row[at] == row[at + n - 1]]

    def scan(self, data: np.ndarray, at: np.ndarray) -> dict[str, list]:
        rows = len(at) - 1
        starts, ends, row = text.words(data, at, text.WORD)
        ids = self.look_up(text.hashes(data, starts, ends))
        first = np.searchsorted(row, np.arange(rows + 1))
        places = [self.phrase(ids, row, p) for p in self.base]
        every = np.concatenate(places)
        home = row[every] if len(every) else every
        n_base = np.bincount(home, minlength=rows)
        low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        np.minimum.at(low, home, every - first[home])
        np.maximum.at(high, home, every - first[home])
        base: list[set] = [set() for _ in range(rows)]
        for (_, label), found in zip(BASE, places, strict=True):
            for r in np.unique(row[found]).tolist():
                base[r].add(label)
        labels = [set(s) for s in base]
        score = np.where(n_base > 0, 1.0, 0.0)
        notices = self.align(ids, row, first)
        spans: list[list] = [[] for _ in range(rows)]
        for r, t, begin, share, sure in notices:
            if sure:
                labels[r].add(self.templates[t].label)
                spans[r].append({"label": self.templates[t].label, "first_word": begin, "share": share})
            score[r] = max(score[r], share if sure else share / 2)
        some = n_base > 0
        return {
            "n_words": np.diff(first).tolist(),
            "n_base": n_base.tolist(),
            "first_word": [a if s else None for a, s in zip(low.tolist(), some.tolist(), strict=True)],
            "last_word": [b if s else None for b, s in zip(high.tolist(), some.tolist(), strict=True)],
            "base_labels": [",".join(sorted(s)) for s in base],
            "labels": [",".join(sorted(s)) for s in labels],
            "score": np.clip(score, 0, 1).tolist(),
            "notices": spans,
        }

    def align(self, ids: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float, bool]]:
        """Row, template, first word, share of weight in place, and whether it is certain: the best alignment of each template in each row."""
        known = np.flatnonzero(ids >= 0)
        known = known[self.rarest(ids[known], row[known], len(first) - 1)]
        if not len(known):
            return []
        many = self.many[ids[known]]
        token = np.repeat(known, many)
        posting = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.low[ids[known]], many)
        template, begin = self.posted[posting, 0], token - self.posted[posting, 1]
        votes = np.unique(np.stack([template, row[token], begin]), axis=1)
        out = []
        for t in np.unique(votes[0]).tolist():
            _, home, start = votes[:, votes[0] == t]
            place = start[:, None] + np.arange(len(self.texts[t]))
            inside = (place >= first[home][:, None]) & (place < first[home + 1][:, None])
            same = inside & (ids[np.clip(place, 0, len(ids) - 1)] == self.texts[t])
            share = same @ self.idf[self.texts[t]] / self.idf[self.texts[t]].sum()
            verified = None
            best = np.lexsort((start, -share, home))
            best = best[np.append(True, home[best][1:] != home[best][:-1])]
            for k in best.tolist():
                sure = share[k] >= LEAST
                if sure:
                    if verified is None:
                        verified = set.intersection(*(set(row[self.phrase(ids, row, key)].tolist()) for key in self.keys[t]))
                    sure = int(home[k]) in verified
                out.append((int(home[k]), t, int(start[k] - first[home[k]]), float(share[k]), bool(sure)))
        return out


def frequencies(docs: DataFrame, book: Book) -> tuple[int, dict[int, int]]:
    """The number of documents, and of those that hold each vocabulary word (as many numbers as the vocabulary has words)."""
    common.prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(book.words) + 1, np.int64)
        for batch in batches:
            for part in text.chunks(batch, "text"):
                data, at = text.flat(part.column("text"))
                starts, ends, row = text.words(data, at, text.WORD)
                ids = book.look_up(text.hashes(data, starts, ends))
                known = ids >= 0
                pair = np.unique(ids[known].astype(np.int64) * part.num_rows + row[known])
                seen[:-1] += np.bincount(pair // part.num_rows, minlength=len(book.words))
                seen[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["word", "n"])

    got = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(len(book.words), 0), got


RESULT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double,"
    " notices array<struct<label:string,first_word:bigint,share:double>>"
)


def scan(docs: DataFrame, book: Book | None = None) -> DataFrame:
    """For each document: the base phrases' places, all labels, a score from 0 to 1, and the licence notices found with their first words."""
    book = book or Book()
    book.weigh(*frequencies(docs, book))
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.chunks(batch, "text"):
                found = book.scan(*text.flat(part.column("text")))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(found.values(), types, strict=True))], ["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: licences in all documents."""
    return scan(common.table(spark, sf_dir, "documents"))
