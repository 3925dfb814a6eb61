"""License scan with DataFrame operations only.

Texts are lower-cased and cut into words of letters and digits. Templates of any length from two words on fall into classes
1, 2, 3, 4, 6, 8, 12, 16 and so on: class c takes those of at most c + 1 words. Windows of 2c words start at every c-th word,
so that a template of class c lies whole in one. A window's signature are BANDS minwise values over its word pairs, each a
band of its own; windows that share a band with a template of their class are candidates, and exact containment of the
template's pairs decides. A template fills a third of the pairs of its window at least (the shortest of a class c > 4 has
2c / 3 of 2c), so bands miss a whole one with at most (2 / 3) ** 24 = 0.00006; one contained to 0.8 has similarity 0.25 or
more with its window and is missed with at most 0.75 ** 24 = 0.001.

A window that holds the share `least` of a template holds at least one of any k + 1 of its pairs, if a share of `least`
lets k be absent. So each template names its k + 1 rarest pairs (in the fewest templates, with the most letters), and
windows without a named pair of their class are dropped before signatures are made; this drops no match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 24
LEAST = 0.8
BROADCAST_ROWS = 200_000

# Wording of public license notices, by SPDX-like name.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's argument isn't put in place of each mention, as columns are."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs(own: Column) -> Column:
    """Hashes of neighbouring words, in order."""
    return let(own, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y)))


def minima(hashes: Column) -> Column:
    """(band, value) of every band."""
    return let(hashes, lambda own: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(own, lambda h: F.xxhash64(h, j))).alias("value"))))


def class_of(n_words: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16, ... that is n_words - 1 or more."""
    if n_words <= 4:
        return max(1, n_words - 1)
    c = 4
    while c + 1 < n_words:
        c = c * 3 // 2 if c & (c - 1) == 0 else c * 4 // 3
    return c


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(template, w, h): name, words and pairs in order. At most as many rows as texts."""
    given = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in sorted(texts.items())])
    made = spark.range(1).select(F.inline(given)).select("template", words(F.col("text")).alias("w"))
    return made.select("template", "w", pairs(F.col("w")).alias("h"))


def named_pairs(fixed: list[dict], least: float) -> dict[int, set[int]]:
    """By class: pairs of which every window with a match has one."""
    shared = Counter(h for t in fixed for h in set(t["h"]))
    out: dict[int, set[int]] = {}
    for t in fixed:
        letters = {h: len(x) + len(y) for h, x, y in zip(t["h"], t["w"], t["w"][1:], strict=False)}
        m, absent = len(letters), 0
        while absent < m - 1 and (m - absent - 1) / m >= least:
            absent += 1
        out.setdefault(t["class"], set()).update(sorted(letters, key=lambda h: (shared[h], -letters[h], h))[: absent + 1])
    return out


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, *, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(id_col, template, containment, first_word): a row for each template whose pairs a window of a text holds to at
    least the share least; first_word is the start of the first such window of the best share.

    Null, empty and one-word texts match nothing. Repeated rows give repeated matches of the same id, which count once, a
    null id too. Texts are read whole, however long. Templates have two words at least. An empty table or no template
    gives an empty result.
    """
    spark = docs.sparkSession
    if not texts:
        return docs.select(F.col(id_col), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).where("false")
    fixed = [r.asDict() for r in templates(spark, texts).collect()]  # of the templates, not of documents
    for t in fixed:
        if len(t["w"]) < 2:
            raise ValueError(f"template {t['template']} has {len(t['w'])} words")
        t["class"] = class_of(len(t["w"]))
    named = named_pairs(fixed, least)
    listed = lambda hashes: ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in sorted(hashes))
    # of a text: its pairs, and where a named one is
    cut = docs.select(F.col(id_col).alias("id"), pairs(words(F.col(text))).alias("h"))
    cut = cut.withColumn("hits", F.expr(f"filter(transform(h, (x, i) -> struct(x, i)), y -> y.x IN ({listed(set().union(*named.values()))}))")).where(F.size("hits") > 0)
    starts = [f"transform(array_distinct(flatten(transform(filter(hits, y -> y.x IN ({listed(own)})), y -> array(y.i div {c} * {c}, greatest(y.i div {c} - 1, 0) * {c})))), s -> struct({c} AS class, int(s) AS start))" for c, own in sorted(named.items())]
    cut = cut.select("id", "h", F.explode(F.expr(f"flatten(array({', '.join(starts)}))")).alias("x"))
    cut = cut.select("id", "x.class", "x.start", F.array_distinct(F.slice("h", F.col("x.start") + 1, 2 * F.col("x.class") - 1)).alias("h"))
    of_class = F.create_map(*[F.lit(x) for t in fixed for x in (t["template"], t["class"])])
    known = templates(spark, texts).select("template", of_class[F.col("template")].alias("_class"), F.array_distinct("h").alias("own"))
    bands = known.select("template", "_class", "own", F.explode(minima(F.col("own"))).alias("m")).select("template", "_class", "own", F.col("m.band").alias("_band"), F.col("m.value").alias("_value"))
    if len(fixed) * BANDS <= BROADCAST_ROWS:  # a row for each of the caller's templates and each band
        bands = F.broadcast(bands)
    signed = cut.select("*", F.explode(minima(F.col("h"))).alias("m"))
    near = signed.join(bands, (F.col("class") == F.col("_class")) & (F.col("m.band") == F.col("_band")) & (F.col("m.value") == F.col("_value")))
    share = F.size(F.array_intersect("h", "own")) / F.size("own")
    held = near.withColumn("share", share).where(F.col("share") >= least)
    best = held.groupBy("id", "template").agg(F.max("share").alias("containment"), F.max(F.struct("share", -F.col("start"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "template", "containment", (-F.col("best.col2")).cast("long").alias("first_word"))
