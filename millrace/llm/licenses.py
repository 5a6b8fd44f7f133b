"""License scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame functions only.

A template of w words is looked for in windows of w' + s words that start every s words, where w' is w rounded up to a
length class and s a quarter of it: an occurrence lies in some window as a whole. Each window that can
match has its MinHash signature cut into bands; templates with an equal band are retrieved, and verified by the share of
their five-word shingles that the window holds.

A window can only match if it holds one of the words that `anchors` picks: each template has so many shingles with such a word
that no share of shingles that suffices can do without. That loses nothing and leaves few windows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle; the least share of a template's shingles that a window must hold.
SHINGLE, CONTAINMENT = 5, 0.8
#: Templates, at most: their bands are broadcast.
MAX_TEMPLATES = 10_000
#: The chance, at most, that no band of a window that matches is equal to the template's.
MISS = 1e-6
WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"

#: Short notices of public licenses (fixed values).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
}


def words(text: str) -> list[str]:
    """The words of a template, as WORD finds them in a text."""
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


def geometry(n: int) -> tuple[int, int]:
    """(window, step) in words for templates of n words: n is rounded up to a class, a quarter of which is the step."""
    cls = SHINGLE
    while cls < n:
        cls = cls + max(1, cls // 8)
    step = max(1, cls // 4)
    return cls + step, step


def bands(n: int) -> int:
    """Bands of one row that leave a match of n words unnoticed with chance MISS at most."""
    own, held = n - SHINGLE + 1, geometry(n)[0] - SHINGLE + 1
    common = math.ceil(CONTAINMENT * own - 1e-9)
    return math.ceil(math.log(MISS) / math.log(1 - common / (own + held - common))) if common < own + held - common else 1


def anchors(templates: dict[str, list[str]]) -> list[str]:
    """Words one of which every match has: of each template, more shingles hold one than a match may lack."""
    chosen: list[str] = []
    for own in sorted(templates.values(), key=len):
        shingles = [own[i : i + SHINGLE] for i in range(len(own) - SHINGLE + 1)]
        spare = len(shingles) - math.ceil(CONTAINMENT * len(shingles) - 1e-9)
        for word in ["", *sorted(set(own), key=lambda w: (-len(w), w))]:
            if sum(any(w in chosen for w in s) for s in shingles) > spare:
                break
            if word:
                chosen.append(word)
    return sorted(set(chosen))


def _shingles(window: Column) -> Column:
    starts = F.slice(F.sequence(F.lit(1), F.size(window)), F.lit(1), F.greatest(F.size(window) - SHINGLE + 1, F.lit(0)))
    return F.transform(starts, lambda i: F.array_join(F.slice(window, i, SHINGLE), " "))


def _signature(shingles: str) -> Column:
    """The least hash of a set of shingles under each of the hash functions that column `bands` counts."""
    return F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license and containment: the templates that some window of a document's whole text holds to at least CONTAINMENT.

    One row for each id and license, with the largest containment. Null, empty and short texts match nothing; rows that repeat an id
    are one document. Null ids are one document. Other columns don't matter, and an empty table gives an empty one. Templates need SHINGLE words at least.
    """
    spark = docs.sparkSession
    templates = {k: words(v) for k, v in (notices or NOTICES).items()}
    if not templates or len(templates) > MAX_TEMPLATES or min(map(len, templates.values())) < SHINGLE:
        raise ValueError(f"1 to {MAX_TEMPLATES} templates of {SHINGLE} words or more, please")
    shapes = sorted({geometry(len(w)) for w in templates.values()})
    n_bands = {shape: max(bands(len(w)) for w in templates.values() if geometry(len(w)) == shape) for shape in shapes}
    seek = anchors(templates)

    rows = [F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, w)).alias("words"), F.lit(geometry(len(w))[0]).alias("window"), F.lit(n_bands[geometry(len(w))]).alias("bands")) for k, w in templates.items()]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.license", "t.window", "t.bands", F.array_distinct(_shingles(F.col("t.words"))).alias("own"))
    table = table.select("license", "window", "own", F.posexplode(_signature("own")).alias("band", "value"))

    lowered = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    may = F.lit(False)
    for word in seek:
        may = may | F.contains("text", F.lit(word))
    # No filters on these columns: pushed down, they would find the words anew for every word.
    found = lowered.where(may).select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    found = found.withColumn("at", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(seek), i))))

    def starts(window: int, step: int) -> Column:
        """Of the windows with a word of `seek` in them."""
        ends = F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.ceil((p - window + 1) / step), F.lit(0)).cast("int"), F.floor(p / step).cast("int"))))
        return F.transform(F.array_distinct(ends), lambda k: F.struct(F.lit(window).alias("window"), F.lit(n_bands[(window, step)]).alias("bands"), (k * step).alias("start")))

    windows = found.select("doc_id", "words", F.explode(F.concat(*(starts(*s) for s in shapes))).alias("w"))
    windows = windows.select("doc_id", "w.window", "w.bands", F.slice("words", F.col("w.start") + 1, F.col("w.window")).alias("words"))
    windows = windows.select("doc_id", "window", "bands", F.array_distinct(_shingles(F.col("words"))).alias("held"))
    windows = windows.select("doc_id", "window", "held", F.posexplode(_signature("held")).alias("band", "value"))
    met = windows.join(F.broadcast(table), ["window", "band", "value"])
    contained = (F.size(F.array_intersect("own", "held")) / F.size("own")).alias("containment")
    return met.select("doc_id", "license", contained).where(F.col("containment") >= CONTAINMENT).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def brute_sql(notices: dict[str, str] | None = None) -> str:
    """DuckDB SQL for the same, comparing every template with every window."""
    rows = ", ".join("('{}', '{}', {}, {})".format(k, " ".join(words(v)), *geometry(len(words(v)))) for k, v in (notices or NOTICES).items())
    shingles = "list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: array_to_string(({0})[i:i+4], ' '))"
    return f"""
WITH t0(license, text, win, step) AS (VALUES {rows}),
t1 AS (SELECT license, win, step, string_split(text, ' ') AS w FROM t0),
t AS (SELECT license, win, step, list_distinct({shingles.format('w')}) AS own FROM t1),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+(?:[.+-][\\p{{L}}\\p{{N}}]+)*') AS w FROM documents),
e AS (SELECT doc_id, w, {shingles.format('w')} AS s FROM d WHERE len(w) >= 5),
x AS (SELECT e.doc_id, t.license, len(list_intersect(t.own, e.s)) / len(t.own) AS overall, e.s, t.own, t.win, t.step FROM e, t),
y AS (SELECT doc_id, license, s, own, win, unnest(range(0, len(s), step)) AS start FROM x WHERE overall >= {CONTAINMENT}),
z AS (SELECT doc_id, license, len(list_intersect(own, s[start+1:start+win-4])) / len(own) AS containment FROM y)
SELECT doc_id, license, max(containment) AS containment FROM z WHERE containment >= {CONTAINMENT} GROUP BY ALL
"""
