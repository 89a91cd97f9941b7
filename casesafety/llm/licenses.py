"""License scans with DataFrame functions only: sparse TF-IDF cosine of headers and licence files to templates,
then inheritance from the nearest directory above that has a licence file.

A file's units are its lines, every run of up to ``MOST_LINES`` lines and ``MOST_WORDS`` words (a notice is wrapped at some column, and stands in
a comment or a paragraph), and, in a file named LICENSE, LICENCE, COPYING or NOTICE, also its whole text.
Terms are lower-case words and numbers. Each unit is compared with each template by the cosine of
term counts times idf = ln((1 + lines) / (1 + lines with the term)) + 1, over all terms of all lines of all files. A unit names the best
template's licence of at least ``threshold`` (ties: the template of more words, then the first by name). Templates that share ``ALIKE`` or
more of their terms are told apart by the others: a unit can't name one without having all terms that tell it from those like it (``library``, ``lesser`` and
``3``, say), so the first lines of a notice that several licences share name none of them. Of a file's units the best one
gives the file's own licence; but one whose terms are a part of another's (``HOLDS``) gives way where a unit names that other one and isn't near the first. A file
without a licence takes that of the licence file in its own directory or the nearest one above it.

Units are pre-selected without loss: of each template's terms, rarest first, so many are needed that the
rest weighs less than the threshold; a unit with none of these has a smaller cosine. Runs of lines are laid out only around lines that have one.

Null and empty texts have no units; a null path is a file in no directory; a null ``key`` is one like any other, and rows that
share a key are told apart by path and text. Rows that repeat are reported each; long texts are read whole, line by line; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Short notices by which works name their licence, and the openings of the licences' own texts. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Licences whose text holds all of another's: the one that has more terms, and the one it holds. Fixed values.
HOLDS = (("BSD-3-Clause", "BSD-2-Clause"),)
#: Share of their terms that templates of different licences have in common if they are alike.
ALIKE = 0.7
#: Lines that a wrapped notice takes, at most.
MOST_LINES = 7
#: Words of a run of two lines or more, at most; the longest template has 37.
MOST_WORDS = 64
#: Terms of the units that are compared, whose idf is broadcast, at most.
BROADCAST_TERMS = 200_000
#: Names of licence files, without what follows a dot.
FILES = ("license", "licence", "copying", "notice")


def terms(text):
    """Lower-case words and numbers of a text column."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def telling_terms() -> list[set[str]]:
    """For each template its terms that one like it, of another licence, lacks."""
    words = [set(re.findall(r"[a-z0-9]+", text.lower())) for _, text in TEMPLATES]
    like = lambda i, j: TEMPLATES[i][0] != TEMPLATES[j][0] and len(words[i] & words[j]) >= ALIKE * len(words[i] | words[j])
    return [set().union(*[a - words[j] for j in range(len(words)) if like(i, j)]) for i, a in enumerate(words)]


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(TEMPLATES)), "template int, t struct<license: string, text: string>")
    tells = spark.createDataFrame([(k, sorted(t)) for k, t in enumerate(telling_terms())], "k int, telling array<string>")
    counted = rows.select("template", "t.license", F.explode(terms(F.col("t.text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("n"))
    return counted.join(tells, F.col("template") == F.col("k")).select("template", "license", "term", "n", F.array_contains("telling", F.col("term")).cast("int").alias("tells"), F.size("telling").alias("must"))


def _lines(files: DataFrame) -> DataFrame:
    """(row, lines, words): the terms of each line of a file, and, of a licence file, those of the whole text."""
    whole = F.when(F.col("is_license_file"), terms(F.col("text")))
    # By explode of one element, so that the optimiser doesn't put the splitting into each of the expressions that read the lines.
    return files.where("text is not null").select("row", whole.alias("words"), F.explode(F.array(F.transform(F.split("text", "\n"), terms))).alias("lines"))


def _units(lines: DataFrame, anchors: Column) -> DataFrame:
    """(row, unit, words) of the units that have one of ``anchors``: unit 0 is a licence file's whole text, the others are runs of lines, ``MOST_LINES`` numbers for each first line."""
    telling = lines.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(F.arrays_overlap(x, anchors), i)), lambda i: i.isNotNull())).where((F.size("at") > 0) | F.arrays_overlap("words", anchors))
    starts = lambda i: F.sequence(F.greatest(F.lit(0), i - (MOST_LINES - 1)), i)
    runs = lambda i: F.flatten(F.transform(starts(i), lambda a: F.transform(F.sequence(i, F.least(a + MOST_LINES, F.size("lines")) - 1), lambda z: a * MOST_LINES + (z - a) + 1)))
    first = lambda n: F.floor((n - 1) / MOST_LINES).cast("int")
    more = lambda n: ((n - 1) % MOST_LINES).cast("int")
    run = lambda n: F.slice("lines", first(n) + 1, more(n) + 1)
    # A run begins and ends with a line that has words (the others are the same runs), and isn't longer than a notice may be.
    whole = lambda n: (F.size(F.get("lines", first(n))) > 0) & (F.size(F.get("lines", first(n) + more(n))) > 0) & ((more(n) == 0) | (F.aggregate(run(n), F.lit(0), lambda a, x: a + F.size(x)) <= MOST_WORDS))
    numbers = F.filter(F.array_distinct(F.flatten(F.transform("at", runs))), whole)
    # Only a run's own words leave the file's row.
    joined = telling.select("row", F.explode(F.transform(numbers, lambda n: F.struct(n.alias("unit"), F.flatten(run(n)).alias("words")))).alias("u")).select("row", "u.unit", "u.words")
    return joined.unionByName(telling.where(F.arrays_overlap("words", anchors)).select("row", F.lit(0).alias("unit"), "words"))


def own_licenses(files: DataFrame, threshold: float) -> DataFrame:
    """(row, license, cosine) of the files (row, text, is_license_file) that name a licence themselves."""
    spark = files.sparkSession
    vocabulary = staged(_templates(spark), "templates")
    lines = _lines(files)
    full = lines.select(F.explode("lines").alias("words")).where(F.size("words") > 0)
    seen = full.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("term"))
    counts = staged(seen.groupBy("term").agg(F.count("*").alias("units")), "counts")  # '' counts the lines
    total = F.lit((counts.where("term = ''").agg(F.sum("units")).first()[0] or 0) + 1)
    rarity = (F.log(total / (F.coalesce("units", F.lit(0)) + 1)) + 1).alias("idf")
    weights = vocabulary.join(counts, "term", "left").select("template", "license", "term", "n", "tells", "must", rarity).withColumn("w", F.col("n") * F.col("idf"))
    square = Window.partitionBy("template")
    weights = weights.withColumns({"norm": F.sqrt(F.sum(F.col("w") * F.col("w")).over(square)), "length": F.sum("n").over(square)})
    rest = F.sum(F.col("w") * F.col("w")).over(square.orderBy("w", "term")) / (F.col("norm") * F.col("norm"))
    weights = staged(weights.withColumn("anchor", F.sqrt(rest) >= threshold - 1e-9), "weights")
    anchors = F.array(*[F.lit(r["term"]) for r in weights.where("anchor").select("term").distinct().orderBy("term").collect()])  # a fixed list
    tells = staged(_units(lines, anchors), "units")  # few, and read several times below

    each = staged(tells.select("row", "unit", F.explode("words").alias("term")).groupBy("row", "unit", "term").agg(F.count("*").alias("tf")), "terms")
    known = staged(each.select("term").distinct().join(counts, "term").select("term", rarity), "idf")
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    valued = each.join(known, "term").withColumn("v", F.col("tf") * F.col("idf"))
    norms = valued.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("unit_norm"))
    dots = valued.join(F.broadcast(weights.select("template", "license", "term", "w", "norm", "length", "tells", "must")), "term").groupBy("row", "unit", "template", "license", "norm", "length", "must").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.sum("tells").alias("told")).where("told = must")
    cosines = dots.join(norms, ["row", "unit"]).select("row", "unit", "license", "length", F.round(F.col("dot") / (F.col("norm") * F.col("unit_norm")), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    rank = F.struct((-F.col("cosine")).alias("less"), (-F.col("length")).alias("shorter"), "license")
    near = [F.coalesce(F.bool_or(F.col("license") == less), F.lit(False)).alias(f"less{k}") for k, (_, less) in enumerate(HOLDS)]
    named = cosines.groupBy("row", "unit").agg(F.min(rank).alias("b"), *near)
    held = [F.min(F.when((F.col("b.license") == more) & ~F.col(f"less{k}"), F.col("b"))).alias(f"more{k}") for k, (more, _) in enumerate(HOLDS)]
    best = named.groupBy("row").agg(F.min("b").alias("b"), *held)
    for k, (_, less) in enumerate(HOLDS):
        best = best.withColumn("b", F.when((F.col("b.license") == less) & F.col(f"more{k}").isNotNull(), F.col(f"more{k}")).otherwise(F.col("b")))
    return best.select("row", "b.license", (-F.col("b.less")).alias("cosine"))


def scan(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(key, path, license, cosine, origin, origin_dir) for each of ``files`` (key, path, text).

    origin: 'file' for a licence of its own, 'directory' for an inherited one (origin_dir says from where), else null.
    """
    name = F.lower(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    named = files.select("key", "path", "text", F.xxhash64("key", "path", "text").alias("row"), F.coalesce(name.isin(*FILES), F.lit(False)).alias("is_license_file"), folder.alias("dir"))
    own = staged(own_licenses(named, threshold), "licenses")
    places = staged(named.drop("text"), "places")
    marked = places.join(own, "row", "left")
    given = marked.where("is_license_file and license is not null and dir is not null").groupBy(F.col("dir").alias("up")).agg(F.min("license").alias("dir_license"))
    # Directories, not files, look upwards; a hot root is met once by each directory below it.
    dirs = places.where("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.split("dir", "/").alias("s")).select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.concat_ws("/", F.slice("s", 1, n)))).alias("up"))
    nearest = above.join(given, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "dir_license")).alias("g")).select("dir", "g.up", "g.dir_license")
    full = marked.join(nearest, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "file").when(F.col("dir_license").isNotNull(), "directory")
    return full.select("key", "path", F.coalesce("license", "dir_license").alias("license"), "cosine", origin.alias("origin"), F.when(origin == "directory", F.col("up")).alias("origin_dir"))
