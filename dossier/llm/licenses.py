"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Lines, paragraphs, whole texts and windows of a template's own size are the units, so a notice is found whether it
stands alone, is wrapped, sits in comments or lies inside a sentence. Line ends of any kind are one, and comment marks
before a line are no text. A Dice coefficient of t or more needs bigram counts within a factor of (2 - t) / t of each
other, so a unit's size rules out most templates before any bigram is compared, and units outside every template's bounds
before any bigram is made. A window is looked at only where a template's bigrams lie as densely as the threshold asks.
Only DataFrame functions run here.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dice coefficient from which a unit counts as the template.
THRESHOLD = 0.8

# Wordings of licence notices, as their publishers give them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}


def normal(text: str) -> list[str]:
    """Words of a template, normalised as the scan normalises texts."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def bigrams(text: str) -> list[str]:
    words = normal(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def guard(grams: list[list[str]], threshold: float) -> tuple[list[str], list[str]]:
    """Words and bigrams of which a text must hold at least one to hold a unit that reaches the threshold.

    A unit that reaches t shares at least t / (2 - t) of a template's bigrams. So if more than the rest of them touch
    some chosen words, one of those words occurs. Long words come first, as few texts hold them; where they do not
    suffice, bigrams are chosen themselves. A word inside of which another chosen word lies adds nothing.
    """
    words: set[str] = set()
    pairs: set[str] = set()
    for own in grams:
        spare = len(own) - math.ceil(threshold / (2.0 - threshold) * len(own) - 1e-9)
        left = set(own)
        for w in sorted({w for g in own for w in g.split() if len(w) > 5}, key=lambda w: (w not in words, -len(w), w)):
            if len(own) - len(left) > spare:
                break
            words.add(w)
            left -= {g for g in left if w in g.split()}
        for g in sorted(left, key=lambda g: (-len(g), g)):
            if len(own) - len(left) > spare:
                break
            pairs.add(g)
            left.discard(g)
    return sorted(w for w in words if not any(x != w and x in w for x in words)), sorted(pairs)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Bigrams of an array of words in order."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))


#: What may stand before a line of a comment.
COMMENT = r"(?m)^[ \t]*(?://+|#+|\*+|--+|;+|/\*+|<!--)"


def _windows(texts: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, license, dice) of the best windows of texts (doc_id, text): as many bigrams in a row as a template has.

    A window's coefficient is the share of the template's bigrams that it holds. Where the k-th of a template's bigrams
    from some place on lies beyond the window, fewer than k are in it; only other places are counted.
    """
    spark = texts.sparkSession
    own = [(name, n, len(bigrams(t)), i, g) for name, ts in templates.items() for n, t in enumerate(ts) for i, g in enumerate(bigrams(t))]
    wanted = F.broadcast(spark.createDataFrame(own, "license string, n int, m int, g int, gram string"))  # the templates' bigrams: a fixed list
    placed = texts.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(_grams(_words(F.col("text")))).alias("pos", "gram"))
    hits = placed.join(wanted, "gram").groupBy("doc_id", "row", "license", "n", "m").agg(F.array_sort(F.collect_set(F.struct("pos", "g"))).alias("hits"))
    need = F.ceil(F.col("m") * threshold - 1e-9).cast("int")
    end = lambda x: x["pos"] + F.col("m") - 1

    def held(x: Column, i: Column) -> Column:
        inside = F.filter(F.slice("hits", i + 1, F.col("m")), lambda y: y["pos"] <= end(x))
        dense = F.coalesce(F.get("hits", i + need - 1)["pos"] <= end(x), F.lit(False))
        return F.when(dense, F.size(F.array_distinct(F.transform(inside, lambda y: y["g"])))).otherwise(0)

    best = hits.where(F.size("hits") >= need).select("doc_id", "license", (F.array_max(F.transform("hits", held)) / F.col("m")).alias("dice"))
    return best.where(F.col("dice") >= threshold)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_units), a row per document and licence found in it.

    dice is the best of the document's units (distinct lines, paragraphs between blank lines, the whole text) and
    windows, n_units how many units reach the threshold, 0 where only a window does. Bigrams count once a unit. Null,
    empty and wordless texts have no unit; texts of any length are scanned whole; rows that repeat a doc_id add up; null
    doc_ids form one document. Other columns are ignored, whatever their names. An empty table gives an empty result.
    ``templates`` names the wordings of each licence; the built-in ones are the usual notices, and full texts can be given.
    """
    grams = [(name, bigrams(t)) for name, texts in templates.items() for t in texts]
    room = (2.0 - threshold) / threshold + 1e-9  # sizes at the bound itself stay in
    least = min(len(g) for _, g in grams) / room
    most = max(len(g) for _, g in grams) * room
    text = F.col("text")
    words, pairs = guard([g for _, g in grams], threshold)
    may = F.lit(False)
    for w in words:
        may |= F.col("low").contains(w)
    if pairs:
        may |= text.rlike("(?i)" + "|".join(p.replace(" ", "[^A-Za-z0-9]+") for p in pairs))
    # The generator makes the lower-case text once; a plain column would be made anew for every word.
    lowered = docs.where(text.isNotNull()).select("doc_id", "text", F.explode(F.array(F.lower(text))).alias("low"))
    texts = lowered.where(may).select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    bare = F.regexp_replace(text, COMMENT, "")
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(bare, r"\n[ \t]*\n"), F.array(text)))
    # A unit of n characters has fewer than n / 2 + 1 words; a bigram set is at most as large as the words. Units too
    # short for the smallest template go before they are split into words.
    units = F.filter(units, lambda u: F.length(u) >= int(least))
    found = texts.select("doc_id", F.explode(units).alias("unit"))
    found = found.select("doc_id", _words(F.col("unit")).alias("words")).where(F.size("words") > least)
    found = found.where(F.size("words") >= 2).select("doc_id", F.array_distinct(_grams(F.col("words"))).alias("grams"))
    size = F.size("grams")
    found = found.where(size.between(least, most))

    def dice(g: list[str]) -> Column:
        near = size.between(len(g) / room, len(g) * room)
        return F.when(near, 2.0 * F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / (size + len(g))).otherwise(0.0)

    scores = []
    for name in templates:
        own = [dice(g) for n, g in grams if n == name]
        scores.append(F.struct(F.lit(name).alias("license"), (F.greatest(*own) if len(own) > 1 else own[0]).alias("dice")))
    hits = found.select("doc_id", F.explode(F.array(*scores)).alias("hit")).where(F.col("hit.dice") >= threshold)
    hits = hits.select("doc_id", "hit.license", "hit.dice", F.lit(1).alias("unit"))
    every = hits.unionByName(_windows(texts, templates, threshold).withColumn("unit", F.lit(0)))
    return every.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("unit").cast("long").alias("n_units"))
