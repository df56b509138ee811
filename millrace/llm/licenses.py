"""License scans: MinHash bands over overlapping windows retrieve, containment verifies.

Words are lower-cased runs of letters and digits; a shingle is five of them.  A
text is covered by windows of ``WINDOW`` shingles (WINDOW + 4 words), each
overlapping the next by four words, so every shingle lies in one window.  A
template's windows start at each of its shingles.  A window's signature has
``BANDS`` bands of one MinHash each: the least of its shingles' hashes under the
band's hash function.

Two windows of Jaccard similarity J share a band with probability
1 - (1 - J) ** BANDS.  A window that lies within an unchanged template equals one
of the template's windows (J = 1: certain).  The worst case, a template of a
single shingle in a window of four (J = 1/4), is retrieved with probability
1 - 0.75 ** 16 = 0.99; templates of two and three shingles with 0.99998 and more.

A retrieved place is verified: the part of the template's shingles that the text
holds within one template's length of the window must reach ``THRESHOLD``.

Only DataFrame functions are used.  Windows and bands are rows within one generated
stage, where a band meets the templates by a hash join; only the rows that meet one
leave it.  Templates are handled in blocks of ``BLOCK_KEYS`` band values (or one
template), which bounds what is broadcast; any number of templates is handled by more
scans.  Texts aren't shuffled.

Defined cases: null text and texts of under five words match nothing, nor does a
template of under five words; repeated rows give one match; a template in a
document many times is one row (its best containment, the first place of that);
an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_hash

SHINGLE, WINDOW, BANDS, THRESHOLD, BLOCK_KEYS = 5, 4, 16, 0.8, 20_000

# Public license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id long, license string, text string")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words; empty for fewer words."""
    gram = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), gram)).otherwise(F.array().cast("array<bigint>"))


def signature(h: Column, first: Column) -> Column:
    """The bands of the window that starts at a shingle; the last window may be shorter."""
    return F.array(*[F.least(*[F.when(F.get(h, first + i).isNotNull(), F.xxhash64(F.get(h, first + i), F.lit(band))) for i in range(WINDOW)]) for band in range(BANDS)])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once: as a lambda's variable the optimizer can't copy it into loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _template_windows(h: Column) -> Column:
    last = F.greatest(F.size(h) - WINDOW, F.lit(0))
    keys = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: signature(h, i))))
    return F.struct(F.array_distinct(h).alias("th"), F.size(h).alias("n"), keys.alias("keys"))


def _of_text(body: Callable[[Column], Column]) -> Column:
    return bound(words(F.col("text")), lambda w: bound(shingles(w), body))


def template_index(rows: DataFrame) -> DataFrame:
    """template_id, license, th (distinct shingles), n, keys (band values of all windows)."""
    return rows.select("template_id", "license", _of_text(_template_windows).alias("t")).where("t.n > 0").select("template_id", "license", "t.th", "t.n", "t.keys")


def scan(docs: DataFrame, rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template_id, license, containment, first_word of every match."""
    spark = docs.sparkSession
    index = template_index(rows.select("template_id", "license", "text"))
    block, room = [], BLOCK_KEYS
    out = spark.createDataFrame([], "doc_id long, template_id long, license string, containment double, first_word int")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("key"), F.col(text_col).alias("text"))
    for t in index.toLocalIterator():
        if block and len(t["keys"]) > room:
            out = out.union(_scan_block(spark, src, block, threshold))
            block, room = [], BLOCK_KEYS
        block.append(t)
        room -= len(t["keys"])
    return out.union(_scan_block(spark, src, block, threshold)) if block else out


def _scan_block(spark: SparkSession, src: DataFrame, block: list, threshold: float) -> DataFrame:
    values = spark.createDataFrame([(k, t.template_id) for t in block for k in t["keys"]], "k long, template_id long")  # BLOCK_KEYS at most, or one template's
    shared = spark.createDataFrame([(t.template_id, t.license, t.th, t.n) for t in block], "template_id long, license string, th array<bigint>, n int")
    texts = src.select("doc_id", "key", _of_text(lambda h: h).alias("h")).where(F.size("h") > 0)
    windows = texts.select("doc_id", "key", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1, F.lit(WINDOW))).alias("at"))
    # a window that the text's end cuts off has its first shingle again, which leaves its minima
    own = [F.get("h", F.col("at")), *[F.coalesce(F.get("h", F.col("at") + i), F.get("h", F.col("at"))) for i in range(1, WINDOW)]]
    held = windows.select("doc_id", "key", "h", "at", *[c.alias(f"s{i}") for i, c in enumerate(own)])
    bands = F.array(*[F.least(*[F.xxhash64(f"s{i}", F.lit(band)) for i in range(WINDOW)]) for band in range(BANDS)])
    places = held.select("doc_id", "key", "h", "at", F.explode(bands).alias("k"))
    met = places.join(F.broadcast(values), "k").join(F.broadcast(shared), "template_id")
    lo = F.greatest(F.col("at") - F.col("n"), F.lit(0))
    part = F.slice("h", lo + 1, F.col("at") + WINDOW + F.col("n") - lo)
    inside = F.array_intersect("th", part)
    found = met.select("doc_id", "key", "template_id", "license", (F.size(inside) / F.size("th")).alias("containment"), (lo + F.array_position(part, F.get(inside, F.lit(0))) - 1).cast("int").alias("first_word"))
    best = F.min(F.struct((-F.col("containment")).alias("c"), F.col("first_word").alias("w")))
    out = found.where(F.col("containment") >= threshold).groupBy("doc_id", "key", "template_id", "license").agg(best.alias("b"))
    return out.select("doc_id", "template_id", "license", (-F.col("b.c")).alias("containment"), F.col("b.w").alias("first_word"))
