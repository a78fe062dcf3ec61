"""Licence notices in texts, by DataFrame functions.

Places that hold enough of a template's word bigrams and trigrams, wrapped over lines or not, are found first.
Sparse logistic regression over these grams then names a place's licence family. Its classes
include `unknown`, trained on scrambled notices, and its probabilities are tempered on notices it has not
seen. A family is reported only where enough of one of its templates stands and the model names it there.
The model is fitted in the driver from the templates alone, so its size doesn't depend on the corpus.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# Usual short notices of each family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "This material is confidential and may not be reproduced without prior written permission."],
    "public-domain": ["This work has been released into the public domain.", "This is free and unencumbered software released into the public domain."],
}
UNKNOWN = "unknown"
LEAST_PROBABILITY = 0.5
LEAST_SHARE = 0.7
#: A notice may be so many times as long as its template (and 16 words), by words put in.
REACH = 4
_WORD = r"[^\p{L}\p{N}]+"
_TOKEN = "[0-9a-zª-￿]+"


def grams(text: str) -> list[str]:
    """Distinct bigrams and trigrams of lower-cased words of letters and digits."""
    words = [w for w in re.split(r"[^0-9a-zª-￿]+", text.lower()) if w]
    return sorted({" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)})


@cache
def model() -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(classes, vocabulary, weights by class and gram, intercepts); unknown is the last class."""
    rng = random.Random(7)
    classes = [*TEMPLATES, UNKNOWN]
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)})
    column = {g: k for k, g in enumerate(vocabulary)}
    every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]

    def cases(n: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = [], []
        for c, name in enumerate(classes):
            for k in range(n):
                if name == UNKNOWN:
                    start = rng.randrange(len(every))
                    words = rng.sample(every, min(rng.randrange(1, 30), len(every))) if k % 3 else every[start : start + 3]
                else:
                    words = rng.choice(TEMPLATES[name]).split()
                    words = [w for w in words if rng.random() > 0.05]
                    words = ["copyright"] * rng.randrange(2) + words + rng.sample(every, rng.randrange(4))
                row = np.zeros(len(vocabulary))
                row[[column[g] for g in grams(" ".join(words)) if g in column]] = 1
                x.append(row)
                y.append(c)
        return np.array(x), np.array(y)

    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = cases(60)
    w, b, goal = np.zeros((len(classes), len(vocabulary))), np.zeros(len(classes)), np.eye(len(classes))[y]
    b[-1] = 1.0
    for _ in range(150):
        gap = probabilities(x @ w.T + b) - goal
        w -= 2.0 * (gap.T @ x / len(x) + 2e-4 * w)
        b -= 0.5 * gap.mean(0)
    x, y = cases(60)
    z = x @ w.T + b
    temper = min(np.linspace(0.25, 4, 61), key=lambda t: -np.log(probabilities(z / t)[np.arange(len(y)), y] + 1e-12).mean())
    return classes, vocabulary, w / temper, b / temper


def notices(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, share), a row for each licence notice.

    Texts are documents (doc_id, text). A notice may be wrapped over lines; lines without a word part it.
    paragraph: the line, counted from 0, in which it begins. share: the part of a template's grams that it has, of
    the family's template with the largest part. Notices of one family don't overlap. Null and empty texts have no
    notice; rows that repeat a doc_id are read each; of equal probabilities the family first by name wins.
    """
    spark = documents.sparkSession
    classes, vocabulary, w, b = model()
    templates = [(c, t, len(grams(t)), len(re.findall(_TOKEN, t.lower()))) for c, ts in TEMPLATES.items() for t in ts]
    # Trigrams are met by their first two words, so a text has one row a word to look up.
    parts = [g.split(" ") for g in vocabulary]
    met = [(" ".join(x[:2]), x[2] if len(x) > 2 else None, k, [i for i, (_, t, _, _) in enumerate(templates) if vocabulary[k] in grams(t)]) for k, x in enumerate(parts)]
    keys = spark.createDataFrame(met, "pair string, last string, gram int, held array<int>")
    kinds = spark.createDataFrame([(i, c, n, REACH * m + 16) for i, (c, _, n, m) in enumerate(templates)], "template int, family string, size int, reach int")
    weights = spark.createDataFrame([(k, *map(float, w[:, k])) for k in range(len(vocabulary))], "gram int, " + ", ".join(f"w{c} double" for c in range(len(classes))))

    def line_tokens(line, k):
        found = F.filter(F.split(line, _WORD), lambda x: x != "")
        found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))  # no gram goes over a null
        return F.transform(found, lambda x: F.struct(k.alias("line"), x.alias("word")))

    tokens = F.flatten(F.transform(F.split(F.lower("text"), "\n"), line_tokens))
    n = F.greatest(F.size("tokens"), F.lit(1))
    pairs = F.zip_with("tokens", F.slice("tokens", 2, n), lambda x, y: F.struct(x["line"].alias("line"), F.concat(x["word"], F.lit(" "), y["word"]).alias("pair")))
    triples = F.zip_with(pairs, F.slice("tokens", 3, n), lambda x, y: F.struct(x["line"].alias("line"), x["pair"].alias("pair"), y["word"].alias("third")))
    worded = documents.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"))
    words = worded.select("doc_id", "row", F.posexplode(triples).alias("pos", "x")).select("doc_id", "row", "pos", "x.line", "x.pair", "x.third")
    hits = words.join(F.broadcast(keys), "pair").where("last is null or last = third").select("doc_id", "row", "pos", "line", "gram", "held")  # the vocabulary is fixed
    hits = written(hits, "hits")

    # Stretches of two reaches, one apart: what begins in a stretch's first half ends in it.
    own = hits.select("row", "pos", "line", "gram", F.explode("held").alias("template")).join(F.broadcast(kinds), "template")
    own = own.select("row", "template", "family", "size", "reach", F.struct("pos", "line", "gram").alias("hit"), F.floor(F.col("pos") / F.col("reach")).alias("half"))
    own = own.withColumn("stretch", F.explode(F.array(F.col("half"), F.col("half") - 1)))
    near = own.groupBy("row", "template", "family", "size", "reach", "stretch").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    near = near.where(F.size(F.array_distinct(F.col("hits.gram"))) >= F.col("size") * LEAST_SHARE)

    def held_from(start):
        """Distinct grams within reach of a start, and the place of the last one that is new."""
        within = F.filter("hits", lambda h: (h["pos"] >= start["pos"]) & (h["pos"] < start["pos"] + F.col("reach")))
        none = F.struct(F.expr("cast(array() as array<int>)").alias("seen"), start["pos"].alias("end"))
        step = lambda s, h: F.when(F.array_contains(s["seen"], h["gram"]), s).otherwise(F.struct(F.array_append(s["seen"], h["gram"]).alias("seen"), h["pos"].alias("end")))
        return F.aggregate(within, none, step)

    begins = near.withColumn("start", F.explode(F.filter("hits", lambda h: F.floor(h["pos"] / F.col("reach")) == F.col("stretch")))).withColumn("got", held_from(F.col("start")))
    share = F.size("got.seen") / F.col("size")
    held = begins.select("row", "family", F.struct((-share).alias("order"), (F.col("got.end") - F.col("start.pos")).alias("span"), F.col("start.pos").alias("start"), F.col("got.end").alias("end"), F.col("start.line").alias("line"), share.alias("share")).alias("x")).where(F.col("x.share") >= LEAST_SHARE)
    listed = held.groupBy("row", "family").agg(F.sort_array(F.collect_set("x")).alias("all"))
    # The largest share first, then the shortest; what overlaps one that is taken goes.
    meets = lambda x: lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])
    taken = F.aggregate("all", F.slice("all", 1, 0), lambda s, x: F.when(F.exists(s, meets(x)), s).otherwise(F.array_append(s, x)))
    places = listed.select("row", "family", F.explode(taken).alias("x")).select("row", "family", "x.start", "x.end", "x.line", "x.share")

    place = ["row", "doc_id", "family", "start", "line", "share"]
    inside = places.join(hits.select("row", "doc_id", "pos", "gram"), "row").where("pos between start and end").select(*place, "gram").distinct()
    sums = inside.join(F.broadcast(weights), "gram").groupBy(*place).agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in range(len(classes))])
    logits = F.array(*[F.struct((F.col(f"w{c}") + float(b[c])).alias("z"), F.lit(-c).alias("order"), F.lit(name).alias("name")) for c, name in enumerate(classes)])
    best = sums.withColumn("logits", logits).withColumn("best", F.array_max("logits")).where("best.name = family")
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - F.col("best.z")))
    found = best.select("doc_id", F.col("line").alias("paragraph"), "family", (1 / total).alias("probability"), "share")
    return found.where(F.col("probability") >= LEAST_PROBABILITY)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(table(spark, sf_dir, "documents"))
