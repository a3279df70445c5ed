"""Licence scans: normal text against licence templates by the Dice coefficient of word bigrams, in DataFrame functions only.

Units are the lines of a text and, if it has several, the whole text.  Normal form: lower case, everything but ``a-z`` and
``0-9`` a space.  A unit's bigrams are its pairs of neighbouring words, with repeats; with x and y bigrams of which s are
common, Dice is ``2 s / (x + y)``.  For a coefficient of t the sizes must lie within ``x t / (2 - t) <= y <= x (2 - t) / t``,
so most templates are left out by size, and units that fit no template are left before their words are split.  A unit that
reaches t shares at least ``y t / (2 - t)`` of a template's y bigrams, so it has one of any set of the others and one more;
texts and lines with none of these are left first.  Each unit goes to its best template, the first by name if equal.

A unit of one word has no bigram and matches nothing; null and empty texts have no units.  Rows of equal id, or of null id,
are reported together.  Texts are scanned whole; further columns are not read.  There is one small shuffle, of the matches.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import texts

LEAST = 0.8

# Public licence notices by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def _bigrams(text: str) -> list[str]:
    """A template's bigrams, the second and later occurrence of one told apart by a number."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [f"{p}#{pairs[:i].count(p)}" for i, p in enumerate(pairs)]


def _signs(text: str, least: float) -> list[str]:
    """Bigrams of a template of which every matching unit has one: as many as it may lack and one more, those with the
    longest words, which are the rarest."""
    bigrams = [b.split("#")[0] for b in _bigrams(text)]
    shared = math.ceil(len(bigrams) * least / (2 - least) - 1e-9)
    return sorted(bigrams, key=lambda b: (-max(map(len, b.split(" "))), b))[: len(bigrams) - shared + 1]


def _has_any(text: Column, parts: set[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(part)) for part in sorted(parts)], F.lit(False))


def _may_have(text: Column, signs: set[str]) -> Column:
    """Whether a text, not yet in normal form, may have one of the signs: has a long word of one, or a sign of short
    words with anything but letters and digits between them."""
    long_words = {max(sign.split(" "), key=len) for sign in signs}
    long_words = {word for word in long_words if len(word) > 5}
    short = sorted(sign for sign in signs if not long_words & set(sign.split(" ")))
    pattern = "|".join(sign.replace(" ", "[^a-z0-9]+") for sign in short)
    return _has_any(text, long_words) | (text.rlike(pattern) if short else F.lit(False))


def _fits(size: Column, least: float, templates: list[tuple[str, str]]) -> Column:
    """Whether a unit of ``size`` bigrams has a template within the size bounds."""
    fits = F.lit(False)
    for count in sorted({len(_bigrams(text)) for _, text in templates}):
        fits = fits | ((size * least <= count * (2 - least)) & (size * (2 - least) >= count * least))
    return fits


def found(docs: DataFrame, least: float = LEAST, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licences found: ``doc_id``, ``licence``, the best coefficient ``dice`` and the number of matching units."""
    signs = {sign for _, text in templates for sign in _signs(text, least)}
    # explode(array(..)) gives a column of its own, which later functions read instead of computing it again.
    lower = texts(docs).select("doc_id", F.explode(F.array(F.lower("text"))).alias("lower"))
    lower = lower.where(_may_have(F.col("lower"), signs))
    normal = F.regexp_replace("lower", "[^a-z0-9\n]+", " ")
    lines = F.filter(F.transform(F.split(normal, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    rows = lower.select("doc_id", F.explode(F.array(lines)).alias("lines"))
    size = lambda unit: F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit("")))  # noqa: E731 bigrams, in a normal unit
    whole_size = F.aggregate("lines", F.lit(0), lambda total, line: total + size(line) + 1) - 1
    whole = F.when(
        (F.size("lines") > 1) & _fits(whole_size, least, templates), F.array(F.array_join("lines", " "))
    ).otherwise(F.array().cast("array<string>"))
    fitting = F.filter("lines", lambda line: (size(line) > 0) & _fits(size(line), least, templates) & _has_any(line, signs))
    units = rows.select("doc_id", F.explode(F.concat(fitting, whole)).alias("unit"))
    words = units.select("doc_id", F.explode(F.array(F.split("unit", " "))).alias("words"))
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    pairs = words.select("doc_id", F.explode(F.array(F.array_sort(pairs))).alias("pairs"))
    numbered = F.transform("pairs", lambda p, i: F.concat(p, F.lit("#"), (i - F.array_position("pairs", p) + 1).cast("string")))
    bigrams = pairs.select("doc_id", F.explode(F.array(numbered)).alias("bigrams"))
    known = F.array(*(
        F.struct(
            F.lit(licence).alias("licence"), F.lit(len(_bigrams(text))).alias("size"),
            F.array(*(F.lit(b) for b in _bigrams(text))).alias("bigrams"),
        )
        for licence, text in templates
    ))
    size_of = F.size("bigrams")
    candidates = F.filter(
        known, lambda t: (size_of * least <= t["size"] * (2 - least)) & (size_of * (2 - least) >= t["size"] * least)
    )
    scored = F.transform(
        candidates,
        lambda t: F.struct(
            (F.lit(-2.0) * F.size(F.array_intersect("bigrams", t["bigrams"])) / (size_of + t["size"])).alias("minus"),
            t["licence"].alias("licence"),
        ),
    )
    best = bigrams.select("doc_id", F.array_min(scored).alias("best")).where(F.col("best.minus") <= -least)
    return best.groupBy("doc_id", F.col("best.licence").alias("licence")).agg(
        (-F.min("best.minus")).alias("dice"), F.count("*").alias("n_units")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(least: float = LEAST) -> str:
    """The same rows in DuckDB's SQL."""
    values = ", ".join(f"({number}, {_quoted(licence)}, {_quoted(text)})" for number, (licence, text) in enumerate(TEMPLATES))
    return rf"""
WITH templates(number, licence, text) AS (VALUES {values}),
lines AS (
  SELECT r, doc_id, i, trim(line, ' ') AS unit FROM (
    SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (
      SELECT row_number() OVER () AS r, doc_id,
             string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS parts
      FROM documents))
  WHERE trim(line, ' ') <> ''),
units AS (
  SELECT row_number() OVER () AS u, doc_id, string_split(unit, ' ') AS words FROM (
    SELECT doc_id, unit FROM lines
    UNION ALL
    SELECT any_value(doc_id), string_agg(unit, ' ' ORDER BY i) FROM lines GROUP BY r HAVING count(*) > 1)),
unit_pairs AS (
  SELECT u, doc_id, len(words) - 1 AS size, unnest(list_zip(words[:-2], words[2:])) AS pair FROM units WHERE len(words) > 1),
unit_bigrams AS (
  SELECT u, doc_id, size, pair[1] || ' ' || pair[2] AS bigram,
         row_number() OVER (PARTITION BY u, pair[1], pair[2]) AS k FROM unit_pairs),
split_templates AS (
  SELECT number, licence, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS words FROM templates),
template_pairs AS (
  SELECT number, licence, len(words) - 1 AS size, unnest(list_zip(words[:-2], words[2:])) AS pair FROM split_templates),
template_bigrams AS (
  SELECT number, licence, size, pair[1] || ' ' || pair[2] AS bigram,
         row_number() OVER (PARTITION BY number, pair[1], pair[2]) AS k FROM template_pairs),
scored AS (
  SELECT u, any_value(b.doc_id) AS doc_id, licence, number,
         CAST(2 * count(*) AS DOUBLE) / (any_value(b.size) + any_value(t.size)) AS dice
  FROM unit_bigrams b JOIN template_bigrams t USING (bigram, k) GROUP BY u, licence, number),
best AS (
  SELECT doc_id, licence, dice, row_number() OVER (PARTITION BY u ORDER BY dice DESC, licence) AS place
  FROM scored WHERE dice >= {least})
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_units FROM best WHERE place = 1 GROUP BY doc_id, licence"""
