"""Licence scans with a positional rare-token index.

The template library is an index from words to (template, place). A first pass counts in how many documents each
library word stands. A file is then looked up by its rarest library words: for every template, the word of it with
the highest inverse document frequency. Each place of that word in the file, less the word's place in the template,
is where the template would begin; the other postings are intersected by relative position there, and the mandatory
key phrase must stand word for word. DataFrame functions only; everything about a file happens in its row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the lower-cased text (fixed value, with the upper-case letters that lower-casing turns into members).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of well-known licences with their labels and the part that must stand word for word.
TEXTS = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     "redistribute it and or modify it"),
    ("apache-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     "apache license version 2 0"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "for any purpose with or without fee"),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-text", "this work is licensed under a creative commons attribution international license", "creative commons attribution"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
#: Weighted share of a template's words that must stand at their places.
MIN_SHARE = 0.75
#: Score of a base phrase alone.
BASE_SCORE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.key)


TEMPLATES = (*(Template(label, tuple(p.split()), tuple(p.split()), True) for p, label in PHRASES.items()),
             *(Template(label, tuple(t.split()), tuple(k.split()), False) for label, t, k in TEXTS))


def words_of(text: Column) -> Column:
    """The words of a text in order, ASCII letters lower-cased; none for a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def inverse_frequencies(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every library word over all documents; as many rows as the library has words."""
    library = sorted({w for t in templates for w in t.words})
    present = docs.select(F.explode(F.array_intersect(_texts(library), words_of(F.col(text)))).alias("w"))
    counts = {r["w"]: r["n"] for r in present.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in library}


def _places(words: Column, t: Template, idf: dict[str, float]) -> Column:
    """``array<struct<at, share>>``: where the template stands in the words, and the weight of it found there."""
    # Only a word of the key phrase is sure to be there, so the rarest of these is the look-up word.
    anchor = max(range(len(t.key)), key=lambda i: (idf[t.key[i]], -i))
    first = t.key_at + anchor
    weights, whole = [idf[w] for w in t.words], sum(idf[w] for w in t.words)
    kind = "array<struct<at:int,share:double>>"

    def place(i):
        at = i - first
        key = F.slice(words, at + t.key_at + 1, len(t.key)) == _texts(t.key)
        got = F.aggregate(F.sequence(F.lit(0), F.lit(len(t.words) - 1)), F.lit(0.0), lambda a, k: a + F.when(
            F.get(words, at + k) == F.element_at(_texts(t.words), k + 1), F.element_at(F.array(*map(F.lit, weights)), k + 1)).otherwise(0.0))
        fits = (at + t.key_at >= 0) & (at + t.key_at + len(t.key) <= F.size(words))
        share = F.lit(1.0) if t.words == t.key else got / whole
        # The key phrase is tested first, so that a long file pays for the whole template only where it stands.
        return F.when(fits, F.when(key, F.struct(at.cast("int").alias("at"), F.round(share, 6).alias("share"))))

    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == t.key[anchor])
    found = F.filter(F.transform(hits, place), lambda p: p.isNotNull() & (p["share"] >= MIN_SHARE))
    return F.coalesce(F.when(F.array_contains(words, t.key[anchor]), found.cast(kind)), F.array().cast(kind))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every document.

    Base phrases are found wherever their words stand consecutively, overlapping places included. A template of the
    method is found where its key phrase stands and enough of its words, by weight, surround it. The score is the
    best share of a found template, at least ``BASE_SCORE`` with a base phrase, 0 without any. Null ids and repeated
    rows keep one result row each; a null text has no words.
    """
    idf = inverse_frequencies(docs, text, templates)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text)).alias("_words"))
    for i, t in enumerate(templates):
        rows = rows.withColumn(f"_t{i}", _places(F.col("_words"), t, idf))
    base = [i for i, t in enumerate(templates) if t.base]
    starts = F.transform(F.concat(*[F.col(f"_t{i}") for i in base]), lambda p: p["at"].cast("bigint"))

    def labels(which) -> Column:
        found = F.concat(*[F.when(F.size(f"_t{i}") > 0, F.array(F.lit(templates[i].label))).otherwise(F.array().cast("array<string>")) for i in which])
        return F.array_join(F.array_sort(F.array_distinct(found)), ",")

    shares = [F.when(F.size(f"_t{i}") > 0, F.lit(BASE_SCORE) if t.base else F.array_max(F.transform(f"_t{i}", lambda p: p["share"]))).otherwise(0.0)
              for i, t in enumerate(templates)]
    return rows.select(
        "doc_id", F.size("_words").cast("bigint").alias("n_words"), F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(range(len(templates))).alias("labels"),
        F.greatest(*shares).cast(T.DoubleType()).alias("score"))
