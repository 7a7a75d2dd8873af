"""License scans: MinHash bands over text windows find templates, containment decides."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import shingle_hashes, text_of
from tabloom.operators.shared import quoted

WIDTH, PERCENT = 5, 75
#: A qualifying window stays without a common band at most this often.
MISS = 1e-6
#: All templates' shingles together; they are part of the plan.
MOST_SHINGLES = 20_000

#: Notices by SPDX name. Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bands_for(sizes: int, window: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Bands of one MinHash value such that a qualifying window is missed at most ``miss`` often.

    A template of ``sizes`` shingles with ``percent`` percent of them in a window has at
    least this Jaccard similarity with it, and each band agrees with that probability.
    """
    common = percent / 100 * sizes
    similarity = common / (window + sizes - common)
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, license, template, containment, n_windows, first_word: a row for each find.

    Templates are grouped by size: up to 1, 2, 4, 8 ... shingles. For a group of up to s
    shingles the text's shingles go into windows of 2 s, each half over the next, so that
    every run of s lies whole in a window. Windows that share a MinHash band with a template
    are candidates; those with at least ``percent`` percent of its shingles are finds.
    ``containment`` is the highest of a document's windows, ``first_word`` where the first of
    them begins (from 0), ``template`` the template's place in the list.

    A band can only agree if the window has a shingle of the template, so texts and windows
    without any template's shingle are passed over before hashing; nothing is lost by it.

    Null, empty and short texts have no shingles and no finds. Templates shorter than
    ``width`` words are refused, and so are lists with over `MOST_SHINGLES` shingles (scan in
    several calls). Null keys, repeated rows: each row is judged by itself. Extra columns are
    ignored. Documents move only as finds.
    """
    spark = df.sparkSession
    listed = _templates(spark, templates, width)
    groups: dict[int, list[tuple[int, str, list[int]]]] = defaultdict(list)
    for place, name, hashes in listed:
        if not hashes:
            raise ValueError(f"template {place} has fewer than {width} words")
        groups[1 << (len(hashes) - 1).bit_length()].append((place, name, hashes))
    every = sorted({h for _, _, hashes in listed for h in hashes})
    if len(every) > MOST_SHINGLES:
        raise ValueError("too many templates for one call")
    if not every:
        raise ValueError("no templates")

    rows = df.select(quoted(key).alias("_tl_key"), F.monotonically_increasing_id().alias("_tl_row"), words(text_of(text)).alias("w"))
    rows = rows.withColumn("n", F.size("w")).select("_tl_key", "_tl_row", shingle_hashes(F.col("w"), F.col("n"), width).alias("h"))
    rows = rows.where(F.arrays_overlap("h", F.array(*[F.lit(h) for h in every])))
    cuts = []
    for size, members in sorted(groups.items()):
        own = F.array(*[F.lit(h) for h in sorted({h for _, _, hashes in members for h in hashes})])
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("h") / size).cast("int") - 2, F.lit(0)))
        cut = _windows(starts, size)
        cuts.append(_touched(cut, own))
    windows = rows.select("_tl_key", "_tl_row", F.explode(F.concat(*cuts)).alias("c")).select("_tl_key", "_tl_row", "c.size", "c.at", "c.win")

    def banded(table: DataFrame) -> DataFrame:
        bands = F.create_map(*[F.lit(x) for size, members in groups.items() for x in (size, max(bands_for(len(h), 2 * size, percent) for _, _, h in members))])
        wide = table.withColumn("band", F.explode(F.sequence(F.lit(1), F.element_at(bands, F.col("size")))))
        return wide.withColumn("value", F.array_min(F.transform("win", lambda h: F.xxhash64(h, "band"))))

    schema = "template int, license string, size int, win array<bigint>"
    known = banded(spark.createDataFrame([(p, n, 1 << (len(h) - 1).bit_length(), sorted(set(h))) for p, n, h in listed], schema)).withColumnRenamed("win", "shingles")
    pairs = banded(windows).join(known, ["size", "band", "value"]).select("_tl_key", "_tl_row", "at", "win", "template", "license", "shingles")
    pairs = pairs.dropDuplicates(["_tl_row", "at", "template"])
    common = F.size(F.array_intersect("win", "shingles"))
    finds = pairs.where(100 * common >= percent * F.size("shingles")).withColumn("containment", common / F.size("shingles"))
    out = finds.groupBy("_tl_row", "template", "license").agg(
        F.first("_tl_key").alias(key), F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("at").cast("long").alias("first_word")
    )
    return out.select(quoted(key).alias(key), "license", "template", "containment", "n_windows", "first_word")


def _windows(starts: Column, size: int) -> Column:
    def window(i: Column) -> Column:
        at = i * F.lit(size)
        return F.struct(F.lit(size).alias("size"), at.alias("at"), F.slice("h", at + 1, F.lit(2 * size)).alias("win"))

    return F.transform(starts, window)


def _touched(windows: Column, own: Column) -> Column:
    return F.filter(windows, lambda w: F.arrays_overlap(w["win"], own))


def _templates(spark: SparkSession, templates: list[tuple[str, str]], width: int) -> list[tuple[int, str, list[int]]]:
    """(place, name, hashes) of the templates, hashed as the texts are."""
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "place int, name string, text string")
    table = table.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    return [(r["place"], r["name"], r["h"]) for r in table.select("place", "name", shingle_hashes(F.col("w"), F.col("n"), width).alias("h")).orderBy("place").collect()]
