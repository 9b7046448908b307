"""Operator 7: license scans by a positional index of rare tokens.

Templates of license notices are indexed by their rarest words: a posting is a template and a
word's place in it. How rare a licence word is, is counted over all documents. A file looks up
its own occurrences of those words; postings at one relative position support a placement of the
template in the file. A placement counts once the template's mandatory key phrase stands where
it must and at least COVERAGE of its words are in place. A template has VOTES postings more than
such a placement may miss, so each one has VOTES of them in place whichever words are rare. Base phrases are found beside it in the
same pass, at every place. Long texts are read in blocks that overlap by the longest template.

Defined results: a null text counts as empty: no words, empty labels, null places, score 0.
Null doc_ids and repeated rows keep a row each; ties between equally rare words go by the
word. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, notice, mandatory key phrase)
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
VOTES, COVERAGE, BLOCK = 2, 0.8, 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time; no word is cut."""
    at = 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and _FOLD[text[to]] != 32:
            to += 1
        yield words_of(text[at:to])
        at = to


class Index:
    """Postings of each template's rarest words, and the base phrases."""

    def __init__(self, templates: list[tuple[str, str, str]], base: dict[str, str], seen: dict[str, int]):
        self.base = [(tuple(p.encode().split()), label) for p, label in base.items()]
        self.templates, self.postings = [], {}
        for t, (label, notice, phrase) in enumerate(templates):
            words = notice.encode().split()
            key = phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.templates.append((label, words, at, key))
            spare = len(words) - math.ceil(COVERAGE * len(words) - 1e-9)
            for q in sorted(range(len(words)), key=lambda q: (seen.get(words[q].decode(), 0), words[q], q))[: spare + VOTES]:
                self.postings.setdefault(words[q], []).append((t, q))
        self.last = {p[-1] for p, _ in self.base}
        self.wanted = set(self.postings) | self.last
        self.overlap = max(len(w) for _, w, _, _ in self.templates) + max((len(p) for p, _ in self.base), default=0)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, set[str], set[str], float, list[tuple[str, int, float]]]:
        """n_words, n_base, first, last, base labels, labels, score, placements (label, word, coverage)."""
        n, n_base, first, last = 0, 0, None, None
        base: set[str] = set()
        placed: dict[tuple[int, int], float] = {}
        tail: list[bytes] = []
        for new in blocks(text):
            words, off = tail + new, n - len(tail)
            n += len(new)
            if not self.wanted.isdisjoint(words):  # a placement may end in a block that holds none of them
                votes: Counter = Counter()
                for i, w in enumerate(words):
                    if w not in self.wanted:
                        continue
                    if w in self.last and i >= len(tail):
                        for phrase, label in self.base:
                            a = i + 1 - len(phrase)
                            if a >= 0 and tuple(words[a : i + 1]) == phrase:
                                n_base += 1
                                base.add(label)
                                first = off + a if first is None else min(first, off + a)
                                last = off + a if last is None else max(last, off + a)
                    for t, q in self.postings.get(w, ()):
                        votes[t, i - q] += 1
                for (t, d), met in votes.items():
                    label, notice, at, key = self.templates[t]
                    if met < min(VOTES, len(notice)) or d + at < 0 or words[d + at : d + at + len(key)] != key:
                        continue
                    here = sum(0 <= d + q < len(words) and words[d + q] == w for q, w in enumerate(notice)) / len(notice)
                    if here >= COVERAGE:
                        placed[t, off + d] = max(here, placed.get((t, off + d), 0))
            tail = words[-self.overlap :]
        labels = base | {self.templates[t][0] for t, _ in placed}
        score = 1.0 if base else max(placed.values(), default=0.0)
        return n, n_base, first, last, base, labels, score, sorted((self.templates[t][0], d, c) for (t, d), c in placed.items())


def word_counts(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; all documents are counted."""
    small_batches(docs.sparkSession)
    known = {w.encode() for w in vocabulary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                own: set[bytes] = set()
                for words in blocks(x or b""):
                    own |= known.intersection(words)
                total.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).cast("binary")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}  # as many rows as the vocabulary has words


def scan(docs: DataFrame, templates: list | None = None, base: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, placements) of each document."""
    templates, base = templates or TEMPLATES, BASE if base is None else base
    small_batches(docs.sparkSession)
    index = Index(templates, base, word_counts(docs, {w for _, notice, _ in templates for w in notice.split()}, text))
    kind = docs.schema[key].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [index.scan(x or b"") for x in b.column(1).to_pylist()]
            n, n_base, first, last, own, labels, score, placed = zip(*got, strict=True) if got else [()] * 8
            longs = [pa.array(x, pa.int64()) for x in (n, n_base, first, last)]
            names = [pa.array([",".join(sorted(s)) for s in x], pa.string()) for x in (own, labels)]
            at = pa.array([[{"label": a, "word": d, "coverage": c} for a, d, c in x] for x in placed], place)
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, *names, pa.array(score, pa.float64()), at], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "placements"])

    schema = f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, placements array<struct<label:string,word:bigint,coverage:double>>"
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("placements")


def _op7_sql() -> str:
    """The same by joining every word with every place of a template: no index, no blocks."""
    rows = []
    for t, (label, notice, phrase) in enumerate(TEMPLATES):
        words, key = notice.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append(f"({t}, '{label}', '{notice}', {at}, {len(key)})")
    base = ", ".join(f"('{label}', '{phrase}')" for phrase, label in BASE.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(len(w))) AS place, unnest(w) AS word FROM d),
m(t, label, notice, a, n_key) AS (VALUES {", ".join(rows)}), x AS (SELECT t, label, a, n_key, string_split(notice, ' ') AS w FROM m),
tw AS (SELECT t, label, a, n_key, len(w) AS n, unnest(range(len(w))) AS q, unnest(w) AS word FROM x),
h AS (SELECT doc_id, label, CAST(count(*) AS DOUBLE) / n AS coverage FROM k JOIN tw USING (word) GROUP BY doc_id, t, label, n, n_key, place - q HAVING count(*) FILTER (q >= a AND q < a + n_key) = n_key AND count(*) >= {COVERAGE} * n - 1e-9),
b(label, phrase) AS (VALUES {base}), bw AS (SELECT label, phrase, len(string_split(phrase, ' ')) AS n, unnest(range(len(string_split(phrase, ' ')))) AS q, unnest(string_split(phrase, ' ')) AS word FROM b),
f AS (SELECT doc_id, label, place - q AS at_word FROM k JOIN bw USING (word) GROUP BY doc_id, label, phrase, n, place - q HAVING count(*) = n),
fa AS (SELECT doc_id, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY 1),
la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM f UNION ALL SELECT doc_id, label FROM h) GROUP BY 1), sc AS (SELECT doc_id, max(coverage) AS coverage FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1 ELSE coalesce(coverage, 0) END AS score FROM d LEFT JOIN fa USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


OP7_SQL = _op7_sql()
