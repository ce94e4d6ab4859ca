"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Words are weighted by how few of all files have them.  A unit of text (a line,
a run of neighbouring lines, or a whole file) is compared with each template
by the cosine of the weighted counts.  A unit that holds none of a template's
heavier words cannot reach the threshold, so only lines with such a word are
compared; nothing that could reach it is left out.

A file that is like a template as a whole is a licence file and licenses its
directory.  A file with a header like a template has that licence.  Any other
inherits from the nearest directory above it that has one; directories are
joined with their ancestors, each once, however many files they hold.

Templates are a short list given by the caller, which alone bounds what is
held in the plan.  Null texts are empty; a file without a path has no
directory.  Rows of one path and one text are one file and get one answer each;
ties go to the least licence name.  Empty tables give empty tables; columns
that are not named are not read.  Files are read whole.
"""

import json
import math
import re
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Least cosine of a header, and of a whole file, to a template.
HEADER = 0.6
WHOLE = 0.5
#: Names of licence files; they need only a header's likeness in any unit.
LICENCE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright)([-_.].*)?$"

#: Standard notices, by the public identifiers of their licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or "
                     "without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: ASCII but letters and digits parts words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return [w for w in re.split(APART, text.lower()) if w]


def _words(column):
    return F.filter(F.split(F.lower(column), APART), lambda w: w != "")


def _table(spark, rows, schema):
    """A short list as a table whose size the planner knows."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _strings(values):
    return F.from_json(F.lit(json.dumps(sorted(values))), "array<string>")


def weights(files, templates, least):
    """(word weights, weight of any other word, template vectors, words one of which a unit needs to reach ``least``).

    Counts go over all files; what comes back is bounded by the templates' words.
    """
    counts = [Counter(words_of(text)) for _, text in templates]
    vocabulary = sorted({w for c in counts for w in c})
    rows = files.agg(F.count("*")).first()[0]
    have = files.select(F.explode(F.array_intersect(F.split(F.lower("text"), APART), _strings(vocabulary))).alias("word"))
    number = {r.word: r["count"] for r in have.groupBy("word").count().collect()}
    idf = {w: math.log((rows + 1) / (number.get(w, 0) + 1)) + 1 for w in vocabulary}
    other = math.log(rows + 1) + 1
    vectors, needed = [], set()
    for c in counts:
        vector = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vector = {w: v / norm for w, v in vector.items()}
        vectors.append(vector)
        below = 0.0
        for w, v in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            below += v * v
            if below >= least * least:
                needed.add(w)
    return idf, other, vectors, needed


def likeness(units, key, idf, other, vectors, templates):
    """The best template of each unit: ``key`` columns, license, score.  ``units``: key columns and ``words``."""
    spark = units.sparkSession
    known = _table(spark, [{"word": w, "idf": v} for w, v in idf.items()], "word string, idf double")
    parts = _table(spark, [{"word": w, "template": i, "license": templates[i][0], "part": v} for i, vector in enumerate(vectors) for w, v in vector.items()],
                   "word string, template int, license string, part double")
    counted = units.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").count()
    weighted = counted.join(known, "word", "left").select(
        *key, "word", ((1 + F.log("count")) * F.coalesce("idf", F.lit(other))).alias("weight"))
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighted.join(parts, "word").groupBy(*key, "template", "license").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    scored = dots.join(norms, list(key)).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    best = scored.groupBy(*key).agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    return best.select(*key, F.col("best.license").alias("license"), (-F.col("best.col1")).alias("score"))


def _directory(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(docs, path="path", text="text", keep=(), templates=TEMPLATES, header=HEADER, whole=WHOLE):
    """For every row ``keep``, path, license, via (file, header or inherited), score of a file's own text, and licence_dir inherited from."""
    rows = docs.select(*keep, F.col(path).cast("string").alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("file", F.xxhash64(F.col("path").isNull(), "path", "text"))
    files = rows.select("file", "path", "text")
    idf, other, vectors, needed = weights(files, templates, min(header, whole))
    need = _strings(needed)
    likely = files.where(F.arrays_overlap(F.split(F.lower("text"), APART), need)).groupBy("file").agg(
        F.first("path").alias("path"), F.first("text").alias("text"))
    lines = likely.select("file", F.posexplode(F.split("text", "\n")).alias("line", "body")).select(
        "file", "line", _words("body").alias("words")).where(F.arrays_overlap("words", need))
    runs = lines.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    runs = runs.groupBy("file", "run").agg(F.flatten(F.sort_array(F.collect_list(F.struct("line", "words")))["words"]).alias("words"),
                                           F.count("*").alias("n")).where("n > 1")
    units = lines.select("file", F.lit("line").alias("kind"), F.col("line").alias("at"), "words").unionByName(
        runs.select("file", F.lit("run").alias("kind"), F.col("run").cast("int").alias("at"), "words")).unionByName(
        likely.select("file", F.lit("whole").alias("kind"), F.lit(0).alias("at"), _words("text").alias("words")))
    found = likely.select("file", "path").join(likeness(units, ["file", "kind", "at"], idf, other, vectors, templates), "file")
    named = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1).rlike(LICENCE_NAME)
    is_file = (F.col("kind") == "whole") & (F.col("score") >= whole) | named & (F.col("score") >= header)
    found = found.withColumn("is_file", is_file).where(F.col("is_file") | (F.col("kind") != "whole") & (F.col("score") >= header))
    own = found.groupBy("file").agg(
        F.min(F.struct(~F.col("is_file"), -F.col("score"), "license")).alias("own"), F.first("path").alias("own_path"))
    own = own.select("file", "own_path", (~F.col("own.col1")).alias("is_file"), (-F.col("own.col2")).alias("score"), F.col("own.license").alias("license"))

    # directories: those that hold a licence file, and for every directory the nearest of them at or above it
    licensed = own.where("is_file AND own_path IS NOT NULL").groupBy(_directory("own_path").alias("above")).agg(
        F.min(F.struct(-F.col("score"), "license")).alias("best")).select("above", F.col("best.license").alias("inherited"))
    folders = rows.where("path IS NOT NULL").select(_directory("path").alias("folder")).distinct()
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    ladder = folders.select("folder", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("above"))
    nearest = ladder.join(licensed, "above").groupBy("folder").agg(
        F.max_by(F.struct("above", "inherited"), F.length("above")).alias("nearest")).select(
        "folder", F.col("nearest.above").alias("licence_dir"), F.col("nearest.inherited").alias("inherited"))

    out = rows.drop("text").withColumn("folder", _directory("path")).join(own.drop("own_path"), "file", "left").join(nearest, "folder", "left")
    via = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(*keep, "path", F.coalesce("license", "inherited").alias("license"), via.alias("via"), "score",
                      F.when(F.col("license").isNull(), F.col("licence_dir")).alias("licence_dir"))
