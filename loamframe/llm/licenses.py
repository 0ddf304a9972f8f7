"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text's units are its lines, its blocks between blank lines and, if it is short
enough, the text as a whole.  A unit is lower-cased, everything but letters and
digits becomes one space, and the set of its word bigrams is compared with each
template's: 2 * common / (sizes added).  At a threshold t only templates of
between t / (2 - t) and (2 - t) / t times the unit's size can reach it.  Units whose
numbers of words and of distinct words fit no template are left out before their
bigrams are made, and pairs of a unit and a template before these are compared.

A notice inside a longer line, or wrapped over lines of a longer block, is found by
windows: runs of the whole text's words that begin and end with a bigram of the
template and have at most (2 - t) / t times its size, scored by the same measure.
They only add licences that no unit of the document gives; n_units then counts the distinct
windows of the best score.  A notice of one word is sought in units alone.

Notices of different licences share most of their words, so the coefficient alone does not tell them
apart.  A template's telling bigrams are those that no other licence has in any of its templates ("gnu affero", "by nc").  A match must
hold at least half of them and, if the licence's name ends in a version, the version's numbers.  A unit goes to the
licence of its highest coefficient alone, and so do windows that overlap; ties go to the first name.  Lines of the form
SPDX-License-Identifier are parsed, not scored: each identifier that `SPDX` knows is a match of 1, all others are none,
and the rest of the text is scanned without these lines.  Whole licence texts are found by their paragraphs.

All is DataFrame expressions.  Defined results: null or empty texts and units
without words match nothing; very long texts are scanned whole; a unit of one word
has that word as its only bigram; equal units of a text count once; rows with one
id are one document; null ids are scanned as one document; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices by licence; public texts, fixed values.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
    "public-domain": ("This work is released into the public domain.",),
    "proprietary": ("All rights reserved.",),
}
#: Licences by the beginning of an SPDX identifier in lower case, longer ones first; fixed values.
SPDX: Mapping[str, str] = {
    "cc-by-nc-nd-": "CC-BY-NC-ND",
    "cc-by-nc-sa-": "CC-BY-NC-SA",
    "apache-2.0": "Apache-2.0",
    "unlicense": "Unlicense",
    "cc-by-nc-": "CC-BY-NC",
    "cc-by-nd-": "CC-BY-ND",
    "cc-by-sa-": "CC-BY-SA",
    "cc0-1.0": "CC0-1.0",
    "bsl-1.0": "BSL-1.0",
    "epl-2.0": "EPL-2.0",
    "mpl-2.0": "MPL-2.0",
    "cc-by-": "CC-BY",
    "agpl-": "AGPL",
    "lgpl-": "LGPL",
    "bsd-": "BSD",
    "gpl-": "GPL",
    "isc": "ISC",
    "mit": "MIT",
}
#: A line's identifiers, and what stands between them.
SPDX_LINE = r"(?i)SPDX-License-Identifier[ \t]*:[ \t]*([^\n\r]*)"
SPDX_BETWEEN = r"[^A-Za-z0-9.+-]+"
#: What a version's bigram adds to the number of telling bigrams that are met.
VERSION = 1000
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Normalised words of a text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words; of a single word, the word."""
    n = F.size(w)
    return F.when(n < 2, w).otherwise(F.array_distinct(pairs_of(w)))


def telling_parts(notices: list[list[str]], threshold: float, least_letters: int = 7) -> list[tuple[str, ...]]:
    """Words and bigrams of which every unit that reaches the threshold with one of the notices holds at least one.

    Of each notice more bigrams are covered than a match can lack: by a few long
    words that many notices share, and by single bigrams where these are not enough.
    """
    pairs = [set(zip(n, n[1:], strict=False)) or {(n[0],)} for n in notices]
    need = [len(p) - math.ceil(threshold / (2 - threshold) * len(p) - 1e-9) + 1 for p in pairs]
    held: list[set] = [set() for _ in notices]
    chosen: set[tuple[str, ...]] = set()

    def gain(word: str) -> int:
        new = (len({x for x in p if any(word in w for w in x)} - h) for p, h in zip(pairs, held, strict=True))
        return sum(min(k, max(0, n - len(h))) for k, n, h in zip(new, need, held, strict=True))

    words = sorted({w for n in notices for w in n if len(w) >= least_letters}, key=lambda w: (-len(w), w))
    while words and gain(best := max(words, key=gain)):
        chosen.add((best,))
        for p, h in zip(pairs, held, strict=True):
            h |= {x for x in p if any(best in w for w in x)}
    for p, h, n in zip(pairs, held, need, strict=True):
        chosen.update(sorted(p - h, key=lambda x: (-len("".join(x)), x))[: max(0, n - len(h))])
    return sorted(chosen)


def holds_any(text: Column, parts: list[tuple[str, ...]]) -> Column:
    """Whether a text holds one of the parts in any case; the text is lower-cased once."""

    def found(low: Column) -> Column:
        return reduce(or_, [F.contains(low, F.lit(p[0])) if len(p) == 1 else low.rlike(r"[^\p{L}\p{N}]+".join(p)) for p in parts])

    return F.exists(F.array(F.lower(text)), found)


def pairs_of(w: Column) -> Column:
    """Bigrams of an array of words, one for each place."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def stretches(texts: DataFrame, anchors: list[str], longest: int) -> DataFrame:
    """id, doc, p and bigram of the texts (id, text) near anchors, the bigrams of which each window must hold one.

    A text is cut into blocks of the longest window's width.  A window with an
    anchor begins in its block or the one before and ends there or in the next.
    """
    first = sorted({a.split(" ")[0] for a in anchors})

    def near(w: Column) -> Column:
        """Blocks that hold an anchor, and those beside them."""
        told = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.when(a.isin(first), F.concat(a, F.lit(" "), b).isin(anchors)))
        own = F.array_distinct(F.array_compact(F.transform(told, lambda x, i: F.when(x, F.floor(i / longest).cast("int")))))
        return F.array_distinct(F.flatten(F.transform(own, lambda b: F.array(b - 1, b, b + 1))))

    # words are made once: the array of one element binds them, and exploding it ends the projection
    once = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(w.alias("w"), near(w).alias("near")))
    placed = texts.select("id", F.xxhash64("text").alias("doc"), F.explode(once).alias("x"))
    blocks = placed.select("id", "doc", "x.w", F.explode("x.near").alias("at")).where("at >= 0")
    cut = blocks.select("id", "doc", "at", F.slice("w", F.col("at") * longest + 1, F.lit(longest + 1)).alias("w"))
    return cut.select("id", "doc", "at", F.posexplode(pairs_of(F.col("w"))).alias("p", "bigram")).select("id", "doc", (F.col("at") * longest + F.col("p")).alias("p"), "bigram")


def enough(told: Column) -> Column:
    """Whether a match holds half of its template's telling bigrams, and the version if the licence has one."""
    return (told % VERSION >= F.col("half")) & (told >= F.col("version"))


def windows(placed: DataFrame, entries: DataFrame, threshold: float, longest: int) -> DataFrame:
    """Best windows of placed bigrams (id, doc, p, bigram) as id, license, dice and unit.

    A text's bigrams that a template holds are dealt to blocks of the longest window's
    width, each to its own and the one before, so that a window lies in the block of its start.
    """
    width = F.ceil(F.col("m") * (2 - threshold) / threshold - 1e-9).cast("int")
    met = placed.join(entries.where(F.contains("bigram", F.lit(" "))), "bigram").withColumn("width", width)
    own = F.floor(F.col("p") / F.col("width"))
    hit = F.struct("p", F.xxhash64("bigram").alias("b"), F.col("told").alias("t"))
    met = met.select("id", "doc", "license", "template", "m", "half", "version", "width", hit.alias("hit"), F.explode(F.array(own - 1, own)).alias("block"))
    groups = met.groupBy("id", "doc", "license", "template", "m", "half", "version", "width", "block").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    groups = groups.where(F.size(F.array_distinct("hits.b")) >= F.col("m") * threshold / (2 - threshold) - 1e-9)

    def best(start: Column) -> Column:
        """The best window that begins at a hit: dice, the bigrams met, start and end."""
        none = F.struct(
            F.array().cast("array<bigint>").alias("seen"), F.lit(0).alias("k"), F.lit(0).alias("told"), F.lit(0.0).alias("dice"), F.lit(0).cast("bigint").alias("unit"), F.lit(0).cast("bigint").alias("end")
        )

        def longer(a: Column, x: Column) -> Column:
            known = F.array_contains(a.seen, x.b)
            seen = F.when(known, a.seen).otherwise(F.concat(a.seen, F.array(x.b)))
            told = a.told + F.when(known, 0).otherwise(x.t)
            dice = 2.0 * F.size(seen) / (x.p - start.p - a.k + F.size(seen) + F.col("m"))
            better = (dice > a.dice) & enough(told)
            return F.struct(
                seen.alias("seen"),
                (a.k + 1).alias("k"),
                told.alias("told"),
                F.when(better, dice).otherwise(a.dice).alias("dice"),
                F.when(better, F.xxhash64(seen)).otherwise(a.unit).alias("unit"),
                F.when(better, x.p.cast("bigint")).otherwise(a.end).alias("end"),
            )

        inside = F.filter("hits", lambda x: (x.p >= start.p) & (x.p < start.p + F.col("width")))
        return F.aggregate(inside, none, longer, lambda a: F.struct(a.dice.alias("dice"), a.unit.alias("unit"), start.p.cast("bigint").alias("start"), a.end.alias("end")))

    starts = F.filter("hits", lambda x: F.floor(x.p / F.col("width")) == F.col("block"))
    found = groups.select("id", "doc", "license", F.explode(F.transform(starts, best)).alias("best")).where(F.col("best.dice") >= threshold)
    found = found.select(F.struct("id", "doc").alias("text"), "license", "best.*")
    # a window gives way to a better one of another licence that it overlaps; both lie in one of two blocks of the longest width
    block = F.array_distinct(F.array(F.floor(F.col("start") / longest), F.floor(F.col("end") / longest)))
    dealt = found.select("*", F.explode(block).alias("block"))
    others = dealt.select("text", "block", *[F.col(c).alias(f"o_{c}") for c in ("license", "dice", "start", "end")])
    stronger = (F.col("o_dice") > F.col("dice")) | ((F.col("o_dice") == F.col("dice")) & (F.col("o_license") < F.col("license")))
    over = (F.col("o_license") != F.col("license")) & (F.col("o_start") <= F.col("end")) & (F.col("o_end") >= F.col("start"))
    lost = dealt.join(others, ["text", "block"]).where(stronger & over).select("text", "license", "start", "end").distinct()
    return found.join(lost, ["text", "license", "start", "end"], "left_anti").select("text.id", "license", "dice", "unit")


def known_bigrams(spark: SparkSession, templates: Mapping[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """The templates (license, template, w, b, m) and their bigrams, told 1 if telling and VERSION if they are the version's."""
    rows = [(name, k, text) for name, texts in sorted(templates.items()) for k, text in enumerate(texts)]
    known = spark.createDataFrame(rows, "license string, template int, notice string").withColumn("w", words(F.col("notice")))
    known = known.select("license", "template", "w", bigrams(F.col("w")).alias("b")).withColumn("m", F.size("b")).where("m > 0")
    entries = known.select("license", "template", "m", F.explode("b").alias("bigram"))
    shared = entries.groupBy("bigram").agg(F.count_distinct("license").alias("licenses"))
    version = F.regexp_replace(F.regexp_extract("license", r"-(\d+\.\d+)$", 1), r"\.", " ")
    entries = entries.join(shared, "bigram").withColumn("told", (F.col("licenses") == 1).cast("int") + F.when(F.col("bigram") == version, VERSION).otherwise(0))
    sums = entries.groupBy("license", "template").agg(
        F.ceil(F.sum(F.col("told") % VERSION) / 2).cast("int").alias("half"), F.max(F.when(F.col("told") >= VERSION, VERSION).otherwise(0)).alias("version")
    )
    return known, entries.join(sums, ["license", "template"]).select("license", "template", "m", "bigram", "told", "half", "version")


def declared(texts: DataFrame) -> DataFrame:
    """id, license and unit of SPDX lines' known identifiers."""
    names = F.split(F.lower("expression"), SPDX_BETWEEN)
    lines = texts.where(F.contains(F.lower("text"), F.lit("spdx-license-identifier"))).select("id", F.explode(F.regexp_extract_all("text", F.lit(SPDX_LINE), F.lit(1))).alias("expression"))
    each = lines.select("id", F.xxhash64("expression").alias("unit"), F.explode(names).alias("name"))
    found = F.coalesce(*[F.when(F.startswith("name", F.lit(k)) if k.endswith("-") else F.col("name") == k, F.lit(v)) for k, v in SPDX.items()])
    return each.select("id", "unit", found.alias("license")).where("license IS NOT NULL").distinct()


def scan(df: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: id, license, dice (the best) and n_units (units that match).

    templates is a parameter and so of bounded size.
    """
    known, entries = known_bigrams(df.sparkSession, templates)
    limits = known.agg(F.min("m").alias("least"), F.max("m").alias("most"), F.array_distinct(F.flatten(F.collect_list("b"))).alias("all")).first()
    if limits.least is None:
        return df.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_units")).limit(0)
    low, high = limits.least * threshold / (2 - threshold), limits.most * (2 - threshold) / threshold
    every = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = F.when(F.contains(F.lower("text"), F.lit("spdx-license-identifier")), F.regexp_replace("text", SPDX_LINE, "")).otherwise(F.col("text"))
    blocks = F.when(F.regexp_like("text", F.lit(r"\n\s*\n")), F.split("text", r"\n\s*\n")).otherwise(F.array().cast("array<string>"))
    notices = [r.w for r in known.select("w").collect()]
    telling = telling_parts(notices, threshold)
    whole = F.when(F.contains("text", F.lit("\n")), F.array("text")).otherwise(F.array().cast("array<string>"))
    texts = every.where(holds_any(F.col("text"), telling)).select("id", scored.alias("text"))
    units = texts.select("id", F.explode(F.array_distinct(F.concat(F.split("text", "\n"), blocks, whole))).alias("unit"))
    units = units.where(holds_any(F.col("unit"), telling))
    # n words of which d are distinct have at most n - 1 and at least d - 1 distinct bigrams
    bounded = (F.size("w") > 0) & (F.greatest(F.lit(1), F.size("w") - 1) >= low - 1e-9) & (F.size(F.array_distinct("w")) - 1 <= high + 1e-9)
    sized = units.withColumn("w", words(F.col("unit"))).where(bounded).select("id", F.array_join("w", " ").alias("unit"), bigrams(F.col("w")).alias("b"))
    fit = sized.where(F.size("b").between(low - 1e-9, high + 1e-9) & F.arrays_overlap("b", F.array(*map(F.lit, limits["all"])))).select("id", F.xxhash64("unit").alias("unit"), "b").distinct()
    fits = (F.col("n") >= F.col("m") * threshold / (2 - threshold) - 1e-9) & (F.col("n") <= F.col("m") * (2 - threshold) / threshold + 1e-9)
    met = fit.select("id", "unit", F.size("b").alias("n"), F.explode("b").alias("bigram")).join(entries, "bigram").where(fits)
    dice = met.groupBy("id", "unit", "license", "template", "n", "m", "half", "version").agg(F.count(F.lit(1)).alias("common"), F.sum("told").alias("told"))
    dice = dice.withColumn("dice", 2 * F.col("common") / (F.col("n") + F.col("m"))).where((F.col("dice") >= threshold) & enough(F.col("told")))
    best = dice.groupBy("id", "unit").agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    best = best.select("id", "unit", "best.license", (-F.col("best.less")).alias("dice")).unionByName(declared(every).withColumn("dice", F.lit(1.0)))
    longest = math.ceil(limits.most * (2 - threshold) / threshold - 1e-9)
    anchors = sorted(r.bigram for r in entries.where(F.contains("bigram", F.lit(" ")) & ((F.col("told") % VERSION > 0) | (F.col("half") == 0))).select("bigram").distinct().collect())
    inner = windows(stretches(texts, anchors, longest), entries, threshold, longest)
    inner = inner.groupBy("id", "license", "dice").agg(F.count_distinct("unit").alias("n_units")).select("id", "license", F.lit(False).alias("natural"), "dice", "n_units")
    outer = best.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_units")).select("id", "license", F.lit(True).alias("natural"), "dice", "n_units")
    found = outer.unionByName(inner).groupBy("id", "license").agg(F.max(F.struct("natural", "dice", "n_units")).alias("best")).select("id", "license", "best.dice", "best.n_units")
    return found.withColumnRenamed("id", id_col)
