"""Licence scan by a positional index of rare words.

Templates are indexed by the words of their mandatory key phrases, with the words' places in the template. Of each text,
the licence words of highest IDF are looked up: as many as leave no template that may stand there without some. Each of
their places proposes where a template would start; the proposals of a template's words are intersected, and what is
left is kept if all key phrases stand at their places from there. Rarity is counted over all documents; it decides how
few places are looked at, never what is found, as a template without one of its key phrases' words can't stand there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_slices, named, raw, words

#: Words of a template, the text's rarest, that are looked up before its key phrases are compared.
RARE = 3


@dataclass(frozen=True)
class Template:
    """keys: phrases that must stand at their places; they are found in text in this order."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[bytes]:
        return words(self.text.encode())

    @property
    def key_places(self) -> list[tuple[int, list[bytes]]]:
        ws, out, at = self.words, [], 0
        for key in self.keys:
            k = words(key.encode())
            at = next(i for i in range(at, len(ws)) if ws[i : i + len(k)] == k)
            out.append((at, k))
        return out


BASE = tuple(Template(label, phrase, (phrase,)) for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")))
# Sentences of public licences.
NOTICES = (
    Template("agpl-notice", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("apache license version 2 0", "except in compliance with the license")),
    Template("bsd-terms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("cc-notice", "This work is licensed under a Creative Commons Attribution", ("creative commons attribution",)),
    Template("gpl-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("isc-terms", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("lgpl-notice", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("work-notice", "This work is licensed under the", ("this work is licensed under",)),
)


class Index:
    """Postings of the words of key phrases, called licence words. idf: rarity of words; words that it lacks are the rarest."""

    def __init__(self, base: tuple[Template, ...], notices: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates = [(t.label, t.words, t.key_places, i < len(base)) for i, t in enumerate((*base, *notices))]
        #: Licence word -> templates that need it, and template -> places of its licence words.
        self.postings: dict[bytes, list[int]] = {}
        self.places: list[dict[bytes, list[int]]] = []
        for i, (_, _, keys, _) in enumerate(self.templates):
            spots: dict[bytes, list[int]] = {}
            for at, k in keys:
                for j, w in enumerate(k):
                    spots.setdefault(w, []).append(at + j)
            self.places.append(spots)
            for w in spots:
                self.postings.setdefault(w, []).append(i)
        self.known = frozenset(self.postings)
        #: Licence words by falling IDF; ties in the words' order.
        self.rank = {w: r for r, w in enumerate(sorted(self.known, key=lambda w: (-idf.get(w, math.inf), w)))}

    def looked_up(self, held: frozenset[bytes]) -> tuple[list[int], list[bytes]]:
        """Of a text's licence words: the templates that have all of theirs there, and the words to look up.

        Words are taken by falling IDF, until each of these templates has RARE of its words among them, or all.
        """
        able = [i for i, spots in enumerate(self.places) if spots.keys() <= held]
        short = {i: min(RARE, len(self.places[i])) for i in able}
        taken = []
        for w in sorted(held, key=self.rank.__getitem__) if able else ():
            if of := [i for i in self.postings[w] if i in short]:
                taken.append(w)
                for i in of:
                    short[i] -= 1
                    if not short[i]:
                        del short[i]
                if not short:
                    break
        return able, taken

    def scan(self, ws: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(template, start, share of its words that stand at their places) of every place with all key phrases."""
        able, taken = self.looked_up(self.known.intersection(ws))
        if not able:
            return
        found: dict[bytes, list[int]] = {w: [] for w in taken}
        for at, w in enumerate(ws):
            if w in found:
                found[w].append(at)
        for i in able:
            _, ts, keys, _ = self.templates[i]
            starts: set[int] | None = None
            for w in taken:
                for j in self.places[i].get(w, ()):
                    here = {at - j for at in found[w]}
                    starts = here if starts is None else starts & here
            for start in starts or ():
                if all(start + at >= 0 and ws[start + at : start + at + len(k)] == k for at, k in keys):
                    yield i, start, sum(0 <= start + j < len(ws) and ws[start + j] == t for j, t in enumerate(ts)) / len(ts)


def rarity(df: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, float]:
    """IDF of the vocabulary's words over all texts; each task gives one count for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            for x in raw(batch.column(0)):
                n += 1
                seen.update(vocabulary.intersection(words(x)))
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    rows = df.select(named(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r.word is None else bytes(r.word): r.n for r in rows}
    total = counts.pop(None, 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def with_licenses(df: DataFrame, text: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """df with n_words, matches (label, first word's number, share of words, base or not), all places in each whole text.

    Null and empty texts have no words and no matches; of long ones every word is read, and a text's places of looked up
    words are held at once. Words of equal IDF are looked up in the words' order, matches stand by start, then template.
    Rows, repeated ones too, and other columns stay; a clashing new name gets underscores in front. An empty table gives
    an empty frame. No shuffle but that of the templates' words' counts.
    """
    match = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("base", T.BooleanType())])
    names = [free_name(df.columns, c) for c in ("n_words", "matches")]
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(match))])
    at = df.columns.index(text)
    idf = rarity(df, text, {w for t in (*base, *notices) for w in t.words})
    arrow = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))

    def start():
        index = Index(base, notices, idf)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, found = [], []
            for x in raw(batch.column(at)):
                ws = words(x)
                n.append(len(ws))
                found.append([{"label": index.templates[i][0], "start": s, "share": share, "base": index.templates[i][3]} for i, s, share in sorted(index.scan(ws), key=lambda m: (m[1], m[0]))])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(found, arrow)], names=schema.names)

        return one

    return map_slices(df, start, schema)


def labelled(documents: DataFrame) -> DataFrame:
    """score is the best match's share of template words: 1 for a base phrase, 0 without a match."""
    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    return with_licenses(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
