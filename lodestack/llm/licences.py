"""Licence scan by a positional index of rare licence words.

The index holds, for every licence template, its rarest mandatory words (highest inverse document frequency
over the whole corpus) with their positions in the template. A file's words are looked up in that index; each
hit votes for "template t begins at word p - q". Alignments that have all of these words are verified word by
word: all mandatory key words must stand at their places, and a share of the template must match. As only
mandatory words vote, every alignment that can pass is verified, whatever the frequencies.

Defined results: a null text is empty; an empty text has no words and no matches; very long texts are scanned whole; of equally
rare words the lesser in order is indexed first, which changes no result; matches at one place come in order of their labels; repeated
rows are scanned one by one; other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

#: ASCII is lower-cased before; every byte from 0x80 belongs to a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """key: the mandatory words, as (first, count) ranges of the template; base: part of the fixed contract."""

    label: str
    text: str
    key: tuple[tuple[int, int], ...]
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return WORD.findall(self.text.lower().encode())


#: Labels, public licence phrases, and the ranges of their mandatory words.
TEMPLATES = (
    Template("cc-by", "cc by", ((0, 2),), True),
    Template("gpl", "general public license", ((0, 3),), True),
    Template("reserved", "all rights reserved", ((0, 3),), True),
    Template("agpl-3.0", "gnu affero general public license version 3", ((1, 4),)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ((3, 2),)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ((0, 1), (6, 2))),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ((2, 3),)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ((2, 3),)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ((2, 3),)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ((0, 1), (3, 1))),
    Template("gnu-gpl", "this work is licensed under the gnu general public license version 3", ((6, 4),)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ((0, 4), (9, 2))),
    Template("lgpl", "gnu lesser general public license version 3", ((1, 4),)),
    Template("mit", "released under the mit license", ((3, 2),)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ((0, 6), (9, 3))),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ((6, 3),)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ((4, 2),)),
)

#: Rare mandatory words that are indexed for a template, and the share of its words that must match.
ANCHORS, COVERAGE = 3, 0.6


def document_frequency(df: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, int]:
    """Documents of the whole corpus that have each licence word. The result is as large as the templates' vocabulary, whatever the corpus."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[bytes, int] = defaultdict(int)
        for text in utf8(batch.column(0)):
            for w in vocabulary.intersection(WORD.findall(text.lower())):
                found[w] += 1
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = map_batches(df.select(F.col(text_col).cast("string").alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


def build_index(frequency: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[bytes, list[tuple[int, int]]], list[int]]:
    """word -> [(template, position)], and the votes that each template needs. Ties of frequency go by the word."""
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    needs = []
    for k, t in enumerate(templates):
        words = t.words
        key = [(words[p], p) for a, n in t.key for p in range(a, a + n)]
        rare = sorted({w for w, _ in key}, key=lambda w: (frequency.get(w, 0), w))[: 1 if t.base else ANCHORS]
        places = [(w, p) for w, p in key if w in rare]
        for w, p in places:
            postings[w].append((k, p))
        needs.append(len(places))
    return dict(postings), needs


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, frequency: dict[bytes, int] | None = None) -> DataFrame:
    """One row per input row: the id, n_words, and matches (label, base, first word, words, coverage), ordered by first word and label.

    frequency: document frequencies of the licence words; by default they are counted over df itself.
    """
    postings, needs = build_index(document_frequency(df, text_col, templates) if frequency is None else frequency, templates)
    rare = frozenset(postings)
    known = [(t.label, t.base, t.words, [range(a, a + n) for a, n in t.key]) for t in templates]

    def matches(ws: list[bytes]) -> list[dict]:
        here = rare.intersection(ws)
        if not here:
            return []
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for p, w in enumerate(ws):
            if w in here:
                for t, q in postings[w]:
                    votes[t, p - q] += 1
        out, n = [], len(ws)
        for (t, start), v in votes.items():
            if v < needs[t]:
                continue
            label, base, words, key = known[t]
            if any(not 0 <= start + i < n or ws[start + i] != words[i] for r in key for i in r):
                continue
            same = sum(0 <= start + i < n and ws[start + i] == w for i, w in enumerate(words))
            if same >= COVERAGE * len(words):
                out.append({"label": label, "base": base, "first": start, "words": len(words), "coverage": same / len(words)})
        return sorted(out, key=lambda m: (m["first"], m["label"], m["words"]))

    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [WORD.findall(t.lower()) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array([matches(w) for w in texts], kind)], ["id", "n_words", "matches"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, scan, "id long, n_words long, matches array<struct<label:string,base:boolean,first:long,words:long,coverage:double>>").withColumnRenamed("id", id_col)
