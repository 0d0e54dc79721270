"""License scanning: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

A template is the set of its five-word shingles (lower-cased letters and digits). Templates of up to W shingles, W a power
of two, are looked for in windows of 2W shingles that start every W, so that each occurrence lies whole in a window.
``BANDS`` permutations make bands of one row: a window that holds 0.8 of a template of more than W/2 shingles has a
similarity to it of at least 0.19, so it misses all bands with probability below 0.81^96 < 2e-9. A candidate counts
when the window holds 0.8 or more of the template's shingles exactly. A notice of fewer than five words is one shingle of
all its words, looked for in the same way among the text's shingles of that width.

Only DataFrame functions run, within the row and without a shuffle: a window can share a band's minimum with a
template only if it holds that very shingle, so signatures are computed just for windows that hold one of the templates'
minimal shingles. The templates are a constant of the plan (``TEMPLATES`` and ``SHORT``, or ones given: at most ``MAX_TEMPLATES``).

Defined results: null, empty and short texts have no matches; every row comes back once, repeated rows and null ids too;
other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import let, text_of

WIDTH, BANDS, MAX_TEMPLATES = 5, 96, 200
#: Notices by which texts say their license.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Notices of fewer than ``WIDTH`` words.
SHORT = {"all-rights-reserved": ["All rights reserved."]}


def _upto(low: int, high: Column) -> Column:
    return F.when(high >= low, F.sequence(F.lit(low), high)).otherwise(F.array().cast("array<int>"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def shingles(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the shingles at every word of the text, in order."""
    return let(words_of(text), lambda w: F.transform(_upto(0, F.size(w) - width), lambda i: F.xxhash64(*(w[i + k] for k in range(width)))))


def _signature(window: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(F.transform(window, lambda h: F.xxhash64(h, j))))


def _minimal(window: Column, bands: int) -> Column:
    """The shingles that give the signature's values."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(F.transform(window, lambda h: F.struct(F.xxhash64(h, j).alias("v"), h.alias("h"))))["h"])


def by_width(spark: SparkSession, templates: dict[str, list[str]]) -> dict[int, dict[str, list[str]]]:
    """The templates by the width of their shingles: ``WIDTH``, or all words of a shorter one."""
    rows = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    found: dict[int, dict[str, list[str]]] = {}
    for r in spark.createDataFrame(rows, "name string, text string").withColumn("n", F.size(words_of(F.col("text")))).collect():
        if not r.n:
            raise ValueError(f"template without words: {r.name}")
        found.setdefault(min(r.n, WIDTH), {}).setdefault(r.name, []).append(r.text)
    return found


def prepare(spark: SparkSession, templates: dict[str, list[str]], bands: int = BANDS, width: int = WIDTH) -> list:
    """name, shingle set, signature and minimal shingles of each template."""
    rows = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    own = spark.createDataFrame(rows, "name string, text string").withColumn("s", F.array_distinct(shingles(F.col("text"), width)))
    found = own.select("name", "s", _signature(F.col("s"), bands).alias("sig"), _minimal(F.col("s"), bands).alias("low")).collect()
    if short := [r.name for r in found if not r.s]:
        raise ValueError(f"templates of fewer than {width} words: {short}")
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: id, licenses (distinct names in order), matches (license, window's first word, containment)."""
    spark = docs.sparkSession
    known = {width: prepare(spark, own, bands, width) for width, own in sorted(by_width(spark, templates or TEMPLATES | SHORT).items())}
    longs = lambda x: F.array(*(F.lit(int(v)).cast("long") for v in x))
    kind = "array<struct<license:string,at:int,containment:double>>"

    def of_class(sh: Column, step: int, members: list) -> Column:
        low = longs(sorted({h for t in members for h in t.low}))
        have = F.array(*(F.struct(F.lit(t.name).alias("name"), longs(t.s).alias("s"), longs(t.sig).alias("sig")) for t in members))
        near = F.filter(_upto(0, F.size(sh) - 1), lambda i: F.array_contains(low, sh[i]))
        first = lambda i: (F.floor(i / step) * step).cast("int")
        starts = F.array_sort(F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(first(i), F.greatest(F.lit(0), first(i) - step))))))

        def of_window(at: Column) -> Column:
            def verified(win: Column) -> Column:
                def of_signature(sig: Column) -> Column:
                    meets = lambda t: F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: sig[j] == t["sig"][j])
                    share = lambda t: F.size(F.array_intersect(win, t["s"])) / F.size(t["s"])
                    candidates = F.transform(F.filter(have, meets), lambda t: F.struct(t["name"].alias("license"), at.alias("at"), share(t).alias("containment")))
                    return F.filter(candidates, lambda m: m["containment"] >= percent / 100)

                return let(_signature(win, bands), of_signature)

            return let(F.slice(sh, at + 1, 2 * step), verified)

        return F.flatten(F.transform(starts, of_window)).cast(kind)

    def of_width(width: int, members: list) -> Column:
        classes: dict[int, list] = {}
        for t in members:
            classes.setdefault(1 << (len(t.s) - 1).bit_length(), []).append(t)
        every = longs(sorted({h for t in members for h in t.low}))
        parts = lambda sh: F.concat(*(of_class(sh, step, own) for step, own in sorted(classes.items())))
        return let(shingles(text_of(text_col), width), lambda sh: F.when(F.arrays_overlap(sh, every), parts(sh)).otherwise(F.array().cast(kind)))

    found = F.concat(*(of_width(width, members) for width, members in known.items()))
    out = docs.select(F.col(id_col), found.alias("matches"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.select(id_col, names.alias("licenses"), F.array_sort("matches").alias("matches"))
