"""License scans by diagonal voting.

Templates are license notices and short phrases, as lists of words. Every
rolling pair of words of a text, hashed, is joined with the places of equal
pairs in the templates; a pair of a notice also has to stand in four equal
words. Each hit is a vote for a diagonal, the place in the text less the
place in the template: a text that holds the template from some place on has
all its votes on one diagonal, and a word put in or left out moves the rest
to a neighbouring one. Votes are summed by diagonal where the text lies, so
that only diagonals are shuffled. Neighbouring diagonals whose spans lie next
to each other are merged, and a span is verified by the share of the
template's words that it covers and the share of its own words that match.

A phrase counts only where all its words stand on one diagonal: those places
are the base places. Equality of words is tested on the words themselves, so
a clash of hashes adds nothing.

Everything is DataFrame work. The templates are broadcast: they are an
argument of at most ``MOST_WORDS`` words, and more raise.

Defined cases: a null or empty text has no words, no places, empty labels
and score 0. Every input row gives one row, also rows of equal or null ids.
A text of one word has no pair and so no vote. Ties and repeated places all
count. An empty table gives no rows. Only the id and text columns are read.
A text is a row of words while it is read, so a very long text needs memory
in proportion to its own length.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words of texts that have been lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a vote for a notice, and for a phrase.
VOTE, PHRASE_VOTE = 4, 2
#: Diagonals so far apart, with spans so far apart, are merged.
DRIFT, GAP = 12, 24
#: Share of a notice that a span must cover, and of the span that must match. A notice of fewer than SHORT words must be whole.
COVERED, DENSE, SHORT = 0.7, 0.5, 24
#: Words of all templates, which bounds the broadcast table.
MOST_WORDS = 20_000


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    phrase: bool

    @property
    def vote(self) -> int:
        return PHRASE_VOTE if self.phrase else VOTE


def template(label: str, text: str, phrase: bool = False) -> Template:
    found = tuple(re.findall(WORD, re.sub("[A-Z]", lambda c: c[0].lower(), text)))
    if len(found) < (PHRASE_VOTE if phrase else VOTE):
        raise ValueError(f"template {label} is too short: {' '.join(found)}")
    return Template(label, found, phrase)


# Phrases and the labels that they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Public license notices.
NOTICES = {
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "gpl": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        """You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "mit": [
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies."""
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
TEMPLATES = [template(label, text, phrase=True) for text, label in PHRASES.items()] + [template(label, text) for label, texts in NOTICES.items() for text in texts]


def lower_words(text: Column) -> Column:
    """The words of a text with A to Z lower-cased. Other letters may change as
    ``lower`` changes them, but never to ASCII words: the one letter that would
    become ``k`` is put as another one before."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def votes(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, n_words, template, diagonal, at)``, written: the template places ``at``
    that vote for each diagonal, and at least one row for each input row, if need be of null template."""
    if sum(len(t.words) for t in templates) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of templates")
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), lower_words(F.col(text_col)).alias("words"))
    word = lambda i: F.get("words", i)
    gram = lambda w, i: F.struct(i.alias("place"), F.xxhash64(w, word(i + 1)).alias("pair"), F.concat(F.concat_ws(" ", w, *(word(i + j) for j in range(1, VOTE))), F.lit(" ")).alias("gram"))
    grams = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.inline_outer(F.transform("words", gram)))
    said = [(n, at, *t.words[at : at + 2], " ".join(t.words[at : at + t.vote]) + " ") for n, t in enumerate(templates) for at in range(len(t.words) - t.vote + 1)]
    known = spark.createDataFrame(said, "template int, at int, first string, second string, said string").select("template", "at", "said", F.xxhash64("first", "second").alias("pair"))
    hits = grams.join(F.broadcast(known), (grams["pair"] == known["pair"]) & F.startswith("gram", "said"), "left")
    hits = hits.where("template is not null or coalesce(place, 0) = 0")
    return written(hits.groupBy("row", "doc_id", "n_words", "template", (F.col("place") - F.col("at")).cast("long").alias("diagonal")).agg(F.array_sort(F.collect_list("at")).alias("at")), "license-votes")


def spans(voted: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``(row, doc_id, n_words, label, first, last, coverage, density, verified)``: the
    spans of notices, of neighbouring diagonals merged. The spans of a text and a template are
    put in order together, which are never more than the text has words."""
    meta = voted.sparkSession.createDataFrame([(n, t.label, len(t.words)) for n, t in enumerate(templates) if not t.phrase], "template int, label string, length int")
    covered = F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + VOTE - 1))))
    found = voted.where("template is not null").join(F.broadcast(meta), "template").withColumn("covered", covered)
    found = found.withColumn("first", F.col("diagonal") + F.array_min("covered")).withColumn("last", F.col("diagonal") + F.array_max("covered"))
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = reached.isNull() | (F.col("first") > reached + GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT)
    merged = (
        found.withColumn("part", F.sum(apart.cast("int")).over(order))
        .groupBy("row", "doc_id", "n_words", "template", "part", "label", "length")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("matched"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    shared = merged.withColumn("coverage", F.col("matched") / F.col("length")).withColumn("density", F.least(F.lit(1.0), F.col("matched") / (F.col("last") - F.col("first") + 1)))
    good = (F.col("coverage") >= F.when(F.col("length") < SHORT, 1.0).otherwise(COVERED)) & (F.col("density") >= DENSE)
    return shared.select("row", "doc_id", "n_words", "label", "first", "last", "coverage", "density", good.alias("verified"))


def places(voted: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``(row, doc_id, n_words, label, place)``: where a phrase stands with all its words."""
    meta = voted.sparkSession.createDataFrame([(n, t.label, len(t.words) - PHRASE_VOTE + 1) for n, t in enumerate(templates) if t.phrase], "template int, label string, needed int")
    return voted.join(F.broadcast(meta), "template").where(F.size("at") == F.col("needed")).select("row", "doc_id", "n_words", "label", F.col("diagonal").alias("place"))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``base_labels`` are those of phrases, ``labels`` also those of verified
    spans. ``score`` is 1 with a base place, and otherwise the lesser of
    coverage and density of the best span, verified or not.
    """
    voted = votes(docs, templates, id_col, text_col)
    key = ["row", "doc_id", "n_words"]
    nothing = F.lit(None)
    texts = voted.select(*key, nothing.cast("string").alias("base"), nothing.cast("long").alias("place"), nothing.cast("string").alias("label"), F.lit(0.0).alias("score"))
    base = places(voted, templates).select(*key, F.col("label").alias("base"), "place", "label", F.lit(1.0).alias("score"))
    whole = spans(voted, templates).select(*key, nothing.cast("string"), nothing.cast("long"), F.when(F.col("verified"), F.col("label")), F.least("coverage", "density"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        texts.union(base)
        .union(whole)
        .groupBy(*key)
        .agg(F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"), joined("base").alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"))
        .drop("row")
    )


def sql(templates: list[Template] = TEMPLATES) -> str:
    """The rows of ``scan`` over ``documents``, for DuckDB."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = ", ".join(f"({n}, '{t.label}', {quoted(t.words)}, {str(t.phrase).lower()})" for n, t in enumerate(templates))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {known}) AS x(template, label, tw, phrase)
), w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), four AS (
  SELECT row, place, w[place + 1:place + {VOTE}] AS g FROM (SELECT row, w, unnest(range(0, len(w) - {VOTE - 1})) AS place FROM w)
), tfour AS (
  SELECT template, label, len(tw) AS length, spot, tw[spot + 1:spot + {VOTE}] AS g FROM (SELECT *, unnest(range(0, len(tw) - {VOTE - 1})) AS spot FROM t WHERE NOT phrase)
), vote AS (SELECT row, template, label, length, place - spot AS diagonal, unnest(range(spot, spot + {VOTE})) AS c FROM four JOIN tfour USING (g)
), diag AS (SELECT row, template, label, length, diagonal, list(DISTINCT c) AS covered, diagonal + min(c) AS first, diagonal + max(c) AS last FROM vote GROUP BY row, template, label, length, diagonal
), mark AS (
  SELECT *, CASE WHEN max(last) OVER o IS NULL OR first > max(last) OVER o + {GAP} OR abs(diagonal - lag(diagonal) OVER p) > {DRIFT} THEN 1 ELSE 0 END AS apart FROM diag
  WINDOW p AS (PARTITION BY row, template ORDER BY first, diagonal), o AS (PARTITION BY row, template ORDER BY first, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), part AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY first, diagonal) AS part FROM mark
), span AS (
  SELECT row, label, length, len(list_distinct(flatten(list(covered)))) AS matched, min(first) AS first, max(last) AS last FROM part GROUP BY row, template, part, label, length
), rated AS (SELECT row, label, length, matched / length AS coverage, least(1.0, matched / (last - first + 1)) AS density FROM span
), base AS (
  SELECT row, label, unnest(list_filter(range(0, len(w) - len(tw) + 1), lambda i: w[i + 1:i + len(tw)] = tw)) AS place FROM w, t WHERE phrase
), seen AS (
  SELECT row, NULL AS base, NULL AS place, NULL AS label, 0.0::DOUBLE AS score FROM w
  UNION ALL SELECT row, label, place, label, 1.0 FROM base
  UNION ALL SELECT row, NULL, NULL, CASE WHEN density >= {DENSE} AND coverage >= CASE WHEN length < {SHORT} THEN 1.0 ELSE {COVERED} END THEN label END, least(coverage, density) FROM rated
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(place) AS n_base, CAST(min(place) AS BIGINT) AS first_word, CAST(max(place) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT base, ',' ORDER BY base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, max(score) AS score
FROM w JOIN seen USING (row) GROUP BY row, doc_id, w
"""
