"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams, in Spark expressions.

Text is lower-cased and every run of other characters than a-z and 0-9 becomes one space. The units of a
document are its lines and the document as a whole, so a one-line notice and a licence file are both seen. A unit
and a template are sets of word bigrams; Dice is 2 * shared / (size + size). For a threshold t, a template of n
bigrams can only match units of n*t/(2-t) to n*(2-t)/t bigrams, so most pairs are never compared, and a text
without any of the bigrams that every match must have is not taken apart. A unit takes its best template (ties: the
smaller name). Nothing is shuffled.

Null or empty texts have no match. Rows are judged one by one, so repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.tables import table

THRESHOLD = 0.75

# Notices as the licences' own stewards word them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams_of(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def compiled(templates: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[str, list[str], int, int]]:
    """name, bigrams, least and most bigrams that a matching unit can have."""
    out = []
    for name, text in templates:
        grams = bigrams_of(text)
        out.append((name, grams, math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9), math.floor(len(grams) * (2 - threshold) / threshold + 1e-9)))
    return out


def needed(templates: tuple[tuple[str, str], ...], threshold: float) -> str:
    """A pattern that every matching text contains. A match shares at least n*t/(2-t) of a template's n bigrams, so it
    has one of any set of more than the rest; the longest bigrams make the rarest such set. Its words may stand on two lines."""
    grams = set()
    for _, own, least, _ in compiled(templates, threshold):
        grams |= set(sorted(own, key=lambda g: (-len(g), g))[: len(own) - least + 1])
    by_letter: dict[str, list[str]] = {}
    for g in sorted(grams):
        by_letter.setdefault(g[0], []).append(g[1:].replace(" ", r"[ \n]+"))
    return r"(?:^|[ \n])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + r")(?:$|[ \n])"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and hits: for every unit that matches, line (from 0; -1: the whole text), license and dice."""
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"))
            for name, grams, low, high in compiled(templates, threshold)
        ]
    )
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9\n]+", " ")
    plain = docs.select("doc_id", text.alias("text"))
    empty = F.expr("cast(array() as array<string>)")
    lines = plain.select("doc_id", F.when(F.col("text").rlike(needed(templates, threshold)), F.split("text", "\n")).otherwise(empty).alias("lines"))
    # a document of one line is that line
    units = lines.select(
        "doc_id", F.when(F.size("lines") > 1, F.array_append("lines", F.array_join("lines", " "))).otherwise(F.col("lines")).alias("units"), F.size("lines").alias("n_lines")
    )

    def grams(unit: Column) -> Column:
        w = F.filter(F.split(unit, " "), lambda x: x != "")
        pairs = F.transform(F.array(w), lambda v: F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.size(v)), lambda a, b: F.concat_ws(" ", a, b)))
        return F.array_distinct(F.filter(F.get(pairs, F.lit(0)), lambda x: x.contains(" ")))

    sets = units.select("doc_id", "n_lines", F.transform("units", grams).alias("sets"))

    def best(s: Column, i: Column) -> Column:
        fit = F.filter(known, lambda t: (F.size(s) >= t["low"]) & (F.size(s) <= t["high"]))
        scored = F.transform(
            fit, lambda t: F.struct((-2.0 * F.size(F.array_intersect(s, t["grams"])) / (F.size(s) + t["n"])).alias("minus"), t["name"].alias("name"))
        )
        top = F.array_min(scored)
        return F.struct(F.when(i < F.col("n_lines"), i).otherwise(-1).alias("line"), top["name"].alias("license"), (-top["minus"]).alias("dice"))

    return sets.select("doc_id", F.filter(F.transform("sets", best), lambda h: h["dice"] >= threshold).alias("hits"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its licences, how many units match, and its best match."""
    hits = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.array_min(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("minus"), h["license"].alias("license"), h["line"].alias("line"))))
    return hits.select("doc_id", "hits", top.alias("top")).select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
        F.col("top.license").alias("best_license"),
        F.col("top.line").cast("long").alias("best_line"),
        F.round(-F.col("top.minus"), 9).alias("best_dice"),
    )


def _op1_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({quoted(n)}, [{', '.join(map(quoted, bigrams_of(t)))}])" for n, t in TEMPLATES)
    return rf"""
WITH templates(name, grams) AS (VALUES {values}),
lines AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS ls FROM documents),
units AS (
  SELECT doc_id, unnest(ls) AS unit, unnest(range(len(ls))) AS line FROM lines
  UNION ALL SELECT doc_id, array_to_string(ls, ' '), -1 FROM lines WHERE len(ls) > 1),
words AS (SELECT doc_id, line, list_filter(string_split(unit, ' '), lambda x: x <> '') AS w FROM units),
sets AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM words),
scored AS (
  SELECT doc_id, line, name, 2.0::DOUBLE * len(list_intersect(s, grams)) / (len(s) + len(grams)) AS dice
  FROM sets JOIN templates ON list_has_any(s, grams)),
best AS (
  SELECT doc_id, line, name, dice FROM scored WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, name) = 1),
per AS (
  SELECT doc_id, count(*) AS n_hits, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses,
    first(name ORDER BY dice DESC, name, line) AS best_license, first(line ORDER BY dice DESC, name, line) AS best_line, max(dice) AS dice
  FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses, best_license, CAST(best_line AS BIGINT) AS best_line, round(dice, 9) AS best_dice
FROM documents LEFT JOIN per USING (doc_id)
"""


OP1_SQL = _op1_sql()
