"""Licence texts and notices in documents, by Dice coefficient over word bigrams.

Normalised text (lower case, everything but ASCII letters and digits a space) is compared with licence
templates: 2 |A and B| / (|A| + |B|) over the sets of word bigrams. A text is looked at whole, by line, and
by runs of one to six paragraphs (of several lines, between blank lines), as licences stand alone, as
notices in other text, or wrapped above code; comment marks are no words. Bounds prune templates before any set is
built: a coefficient of at least t needs set sizes within a factor of t / (2 - t), and a unit has as
many bigrams at most as words less one.

All work is one projection of built-in functions; the templates are literals, a parameter of a bounded
number. Defined cases: null and empty texts match nothing; a single word is its own only bigram; of
equal coefficients the first template by name counts; a text without blank lines has no paragraphs;
repeated rows and other columns are kept, but for one named like the result; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import let, unused

THRESHOLD = 0.8
MAX_TEMPLATES = 500
RUN = 6  # paragraphs
BLANK = r"\n[ \t\r]*+\n[ \t\r\n]*+"

# Notices and short texts of public licences, by SPDX-like name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "reserved": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Complete texts of licences, without copyright lines; those of the GPL family with all they are published with.
TEMPLATES |= {path.stem: path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def normal_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])}) or words


def words_of(unit: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def bigrams_of(words: Column) -> Column:
    """Distinct bigrams of a non-empty array of words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1]))
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(pairs))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Set sizes that can reach the threshold with a set of ``size``."""
    ratio = threshold / (2 - threshold)
    return math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)


def anchors(grams: list[str], threshold: float) -> set[str]:
    """Words, long ones first, one of which is in a common bigram of any set that reaches the threshold."""
    low = bounds(len(grams), threshold)[0]
    least = math.ceil(threshold * (low + len(grams)) / 2 - 1e-9)
    within: dict[str, set[str]] = {}
    for g in grams:
        for w in g.split():
            within.setdefault(w, set()).add(g)
    chosen: set[str] = set()
    covered: set[str] = set()
    for word in sorted(within, key=lambda w: (-len(w), w)):
        if len(covered) > len(grams) - least:
            break
        chosen.add(word)
        covered |= within[word]
    return chosen


def literal(strings: list[str]) -> Column:
    """An array of strings without commas, folded to a constant."""
    return F.split(F.lit(",".join(strings)), ",")


MATCH = "struct<dice:double,license:string,unit:int,paragraphs:int>"


def find_licenses(
    docs: DataFrame, *, text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, into: str = "licenses"
) -> DataFrame:
    """``docs`` with the array ``into`` of (dice, license, unit, paragraphs): the best template of each unit that
    reaches the threshold. Unit 0 is the whole text, further ones are its lines from 1 on (of a text of one line, only
    unit 0). Then come runs of ``paragraphs`` paragraphs, ``unit`` being the first of them, from 1 on; a run that is
    the whole text or one line isn't listed again."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    sets = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    ranges = {name: bounds(len(grams), threshold) for name, grams in sets.items()}
    # one literal each, as the long texts have thousands of bigrams
    anchor = literal(sorted(set().union(*(anchors(g, threshold) for g in sets.values()))))
    arrays = {name: literal(grams) for name, grams in sets.items()}
    none = F.lit(None).cast(MATCH)

    def best(grams: Column, unit: Column, run: Column) -> Column:
        found = []
        for name, (low, high) in ranges.items():
            common = F.size(F.array_intersect(grams, arrays[name]))
            dice = F.lit(2.0) * common / (F.size(grams) + len(sets[name]))
            match = F.struct((-dice).alias("dice"), F.lit(name).alias("license"), unit.cast("int").alias("unit"), run.cast("int").alias("paragraphs"))
            found.append(F.when(F.size(grams).between(low, high), match).otherwise(none))
        least = F.array_min(F.filter(F.array(*found), lambda m: m["dice"] <= -threshold))
        return let(least, lambda m: F.when(m.isNotNull(), F.struct((-m["dice"]).alias("dice"), m["license"], m["unit"], m["paragraphs"])).otherwise(none))

    def judged(words: Column, number: Column, run: Column) -> Column:
        return F.when(F.arrays_overlap(words, anchor), let(bigrams_of(words), lambda g: best(g, number, run))).otherwise(none)

    def by_line(text: Column) -> Column:
        return F.transform(F.split(text, "\n"), lambda line, i: let(words_of(line), lambda w: judged(w, i + 1, F.lit(0))))

    def by_paragraph(text: Column) -> Column:
        """Runs with an anchor word; the words of a paragraph are made once."""

        def of(paragraph: Column) -> Column:
            return let(words_of(paragraph), lambda w: F.struct(
                w.alias("words"), F.arrays_overlap(w, anchor).alias("anchored"), F.contains(paragraph, F.lit("\n")).alias("long")
            ))

        def runs(listed: Column) -> Column:
            def first(p: Column, at: Column) -> Column:
                most = F.least(F.lit(RUN), F.size(listed) - at)
                return F.transform(F.sequence(F.lit(1), most), lambda k: F.struct((at + 1).alias("unit"), k.alias("run")))

            def worth(x: Column) -> Column:
                several = ((x["run"] > 1) | F.get(listed, x["unit"] - 1)["long"]) & (x["run"] < F.size(listed))
                return several & F.exists(F.slice(listed, x["unit"], x["run"]), lambda p: p["anchored"])

            def verdict(x: Column) -> Column:
                words = F.flatten(F.transform(F.slice(listed, x["unit"], x["run"]), lambda p: p["words"]))
                return let(words, lambda w: judged(w, x["unit"], x["run"]))

            return F.transform(F.filter(F.flatten(F.transform(listed, first)), worth), verdict)

        return let(F.transform(F.split(text, BLANK), of), runs)

    own, anchored = unused("_words", docs), unused("_anchored", docs)
    words, text = F.col(own), F.coalesce(F.col(text_col), F.lit(""))
    nothing = F.array().cast(f"array<{MATCH}>")
    lines = F.when(F.contains(text, F.lit("\n")), by_line(text)).otherwise(nothing)
    parts = F.when(F.rlike(text, F.lit(BLANK)), by_paragraph(text)).otherwise(nothing)
    found = F.filter(F.concat(F.array(judged(words, F.lit(0), F.lit(0))), lines, parts), lambda m: m.isNotNull())
    marked = docs.withColumn(own, words_of(text)).withColumn(anchored, F.arrays_overlap(own, anchor))
    return marked.withColumn(into, F.when(F.col(anchored), found).otherwise(nothing)).drop(own, anchored)
