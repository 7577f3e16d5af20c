"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a window of a text's words; a template is a set of word pairs. The join finds every block that holds at least
a threshold share of a template's pairs (containment). Pairs are ordered by how many documents of the whole corpus hold
them, rarest first. Three filters, none of which can lose a match, leave few blocks to be compared: a block that reaches
the threshold must hold one of the template's rarest pairs, as many as may be missing and one more (prefix); it must have
enough words (length); and a pair met at place i of the order leaves at most the pairs after it (position).

Blocks are as wide as the template, and one starts at every place, so no match depends on where blocks are cut. Per
document, the best containment for each template is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table, whole

#: Characters of words: ASCII letters and digits, and everything beyond ASCII; upper case is lowered before.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CONTAINMENT = 0.8

#: A place where these words stand one after the other has the label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Usual notices of well-known licenses, and their labels. A label may have several.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation either version of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                   "http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Pair = tuple[str, str]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Template(NamedTuple):
    label: str
    words: int
    #: Its pairs by place in the corpus order, rarest first.
    pairs: tuple[Pair, ...]
    #: Pairs that a block must hold, of them all.
    needed: int


def ordered(templates: Iterator[tuple[str, str]], frequency: Mapping[Pair, int], containment: float) -> list[Template]:
    """Templates with their pairs in corpus order; pairs of equal frequency go by their words."""
    out = []
    for label, text in templates:
        words = words_of(text)
        pairs = sorted(set(zip(words, words[1:])), key=lambda p: (frequency.get(p, 0), p))
        out.append(Template(label, len(words), tuple(pairs), math.ceil(containment * len(pairs) - 1e-9)))
    return out


class Scanner:
    """Finds, for a text's words, every block that holds enough of a template."""

    def __init__(self, templates: list[Template]) -> None:
        self.templates = templates
        self.places: list[dict[Pair, int]] = [{p: i for i, p in enumerate(t.pairs)} for t in templates]
        #: For a prefix pair, the templates that it can start a match with, and its place there.
        self.prefixes: dict[Pair, list[tuple[int, int]]] = {}
        for n, t in enumerate(templates):
            for i, p in enumerate(t.pairs[: len(t.pairs) - t.needed + 1]):
                self.prefixes.setdefault(p, []).append((n, i))
        self.seconds: dict[str, set[str]] = {}
        for a, b in self.prefixes:
            self.seconds.setdefault(a, set()).add(b)

    def scan(self, words: list[str]) -> dict[int, list[tuple[float, int, int]]]:
        """template number -> (containment, first word, words) of its blocks at or above the threshold, in order."""
        if self.seconds.keys().isdisjoint(words):
            return {}
        met: dict[int, set[int]] = {}
        for i in range(len(words) - 1):
            after = self.seconds.get(words[i])
            if after and words[i + 1] in after:
                for n, _ in self.prefixes[words[i], words[i + 1]]:
                    met.setdefault(n, set()).add(i)
        found = {}
        for n, places in met.items():
            blocks = self.blocks(n, words, places)
            if blocks:
                found[n] = blocks
        return found

    def blocks(self, n: int, words: list[str], places: set[int]) -> list[tuple[float, int, int]]:
        """Of blocks that overlap, the one that holds most of the template, and of such the first."""
        t, order = self.templates[n], self.places[n]
        width = min(t.words, len(words))
        # Blocks that hold a prefix pair: starts from width - 2 before it to its own place, each looked at once.
        last = len(words) - width
        starts = sorted({min(s, last) for i in places for s in range(max(0, i - width + 2), i + 1)})
        enough = []
        for s in starts if width - 1 >= t.needed else ():  # length: else too few words for the pairs that are needed
            held, first = set(), len(t.pairs)
            for pair in zip(words[s : s + width - 1], words[s + 1 : s + width]):
                place = order.get(pair)
                if place is not None:
                    held.add(place)
                    first = min(first, place)
            # Position: nothing before the rarest pair held is there, so that many can be at most.
            if len(t.pairs) - first >= t.needed and len(held) >= t.needed:
                enough.append((-len(held), s))
        # A block that is taken rules out the starts around it.
        taken: list[tuple[int, int]] = []
        free = [True] * (len(words) + 1)
        for held, s in sorted(enough):
            if free[s]:
                taken.append((s, -held))
                for i in range(max(0, s - width + 1), min(len(words), s + width)):
                    free[i] = False
        return [(held / len(t.pairs), s, width) for s, held in sorted(taken)]


class Phrases:
    def __init__(self, phrases: Mapping[str, str]) -> None:
        self.by_first: dict[str, list[tuple[list[str], str]]] = {}
        for phrase, label in phrases.items():
            words = phrase.split()
            self.by_first.setdefault(words[0], []).append((words, label))

    def places(self, words: list[str]) -> list[tuple[int, str]]:
        """Every start of a phrase, with its label."""
        if self.by_first.keys().isdisjoint(words):
            return []
        return [(i, label) for i, w in enumerate(words) for phrase, label in self.by_first.get(w, ()) if words[i : i + len(phrase)] == phrase]


def pair_frequencies(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES) -> dict[Pair, int]:
    """How many documents hold each pair of the templates: counted over all documents, as many numbers as templates have pairs."""
    wanted = {p for _, t in templates for w in [words_of(t)] for p in zip(w, w[1:])}
    starts = {a for a, _ in wanted}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text_ in batch["text"]:
                words = words_of(text_)
                if not starts.isdisjoint(words):
                    counts.update({p for p in zip(words, words[1:]) if p in wanted})
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"]).astype({"n": "int64"})

    each = docs.select(F.col(quoted(text)).alias("text")).mapInPandas(run, "a string, b string, n long")
    return {(r.a, r.b): r.n for r in each.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


MATCH = "array<struct<label:string,containment:double,first_word:long,n_words:long>>"


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, phrases: Mapping[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per row: ``key``, n_words, phrases (start, label) and matches, every block of every template.

    Of blocks of a template that overlap, the one that holds most of it counts, of equal ones the first. Null and empty texts have nothing. Keys may be null or repeat; other columns are not
    looked at. No rows give no rows.
    """
    if any(len(words_of(t)) < 2 for _, t in templates):
        raise ValueError("a template needs two words")
    ready = ordered(iter(templates), pair_frequencies(docs, text, templates), containment)
    said = dict(PHRASES if phrases is None else phrases)
    rows = docs.select(F.col(quoted(key)).alias("key"), whole(F.col(quoted(text))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, finder = Scanner(ready), Phrases(said)
        for batch in batches:
            out = []
            for text_ in batch["text"]:
                words = words_of(text_)
                places = [{"first_word": i, "label": x} for i, x in finder.places(words)]
                found = [
                    {"label": ready[n].label, "containment": c, "first_word": s, "n_words": w} for n, blocks in sorted(scanner.scan(words).items()) for c, s, w in blocks
                ]
                out.append((len(words), places, found))
            yield pd.DataFrame(out, columns=["n_words", "phrases", "matches"]).assign(key=batch["key"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInPandas(run, f"key {kind}, n_words long, phrases array<struct<first_word:long,label:string>>, matches {MATCH}")
    return found.withColumnRenamed("key", key)


def op7_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("phrases.first_word")
    labels = F.array_union(F.col("phrases.label"), F.col("matches.label"))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("phrases.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size("matches") > 0, F.array_max("matches.containment")).otherwise(0.0).alias("score"),
    )


def _templates_sql() -> str:
    return ", ".join(f"({n}, '{label}', '{' '.join(words_of(t))}')" for n, (label, t) in enumerate(TEMPLATES))


OP7_SQL = rf"""
WITH t AS (SELECT n, label, w, len(w) AS width FROM (SELECT n, label, string_split(t, ' ') AS w FROM (VALUES {_templates_sql()}) v(n, label, t))),
tp AS (SELECT DISTINCT n, label, width, w[i] || ' ' || w[i + 1] AS p FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
tn AS (SELECT n, label, width, count(*) AS pairs FROM tp GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
l AS (SELECT r, i, x, lead(x, 1) OVER q AS x1, lead(x, 2) OVER q AS x2, lead(x, 3) OVER q AS x3 FROM k WINDOW q AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, x || ' ' || x1 AS p FROM l WHERE x1 IS NOT NULL),
h0 AS (SELECT r, n, width, i, p FROM g JOIN tp USING (p)),
o AS (SELECT r, n FROM h0 JOIN tn USING (n) GROUP BY r, n, pairs HAVING count(DISTINCT p) >= ceil({CONTAINMENT} * pairs - 1e-9)),
h AS (SELECT h0.* FROM h0 JOIN o USING (r, n)),
s AS (SELECT DISTINCT r, n, width, unnest(range(greatest(1, i - width + 2), i + 1)) AS s FROM h),
c AS (SELECT s.r, s.n, s.s, count(DISTINCT p) AS held FROM s JOIN h ON s.r = h.r AND s.n = h.n AND h.i BETWEEN s.s AND s.s + s.width - 2 GROUP BY ALL),
m AS (SELECT r, label, max(held / pairs) AS best FROM c JOIN tn USING (n) WHERE held >= ceil({CONTAINMENT} * pairs - 1e-9) GROUP BY ALL),
f AS (SELECT r, i - 1 AS place, label FROM l JOIN (VALUES {
    ", ".join(str((*(p.split() + [None] * 4)[:4], label)).replace("None", "NULL") for p, label in PHRASES.items())}) v(a, b, c, d, label)
  ON x = a AND (b IS NULL OR x1 = b) AND (c IS NULL OR x2 = c) AND (d IS NULL OR x3 = d)),
fa AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY r),
la AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM f UNION ALL SELECT r, label FROM m) GROUP BY r),
ma AS (SELECT r, max(best) AS score FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN fa USING (r) LEFT JOIN la USING (r) LEFT JOIN ma USING (r)
"""
