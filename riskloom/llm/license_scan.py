"""Licence scans: a trained paragraph classifier over sparse word n-grams.

A multinomial logistic regression learns the families from windows of short
licence templates, alone and among the n-grams of corpus windows, and the class
of no licence from a bounded sample of windows of the corpus.  Only n-grams that
are rare in all plain windows are features, so most windows have none and the
weights are a small table that is joined to the n-grams of the corpus.  A
threshold set on all windows of the held-back documents, by a histogram, makes
everything less certain unknown, and a family is confirmed by the share of a template's n-grams that a window contains.

Windows are 2 * HALF words of the whole text, HALF apart, whatever lines and
comment marks part the words, so every template lies whole in one.  A window
confirms all families that hold CONFIRM of a template, also of the n-grams that
the better matched families lack.  Of overlapping windows the best counts.  Null
and empty texts have no window.  Rows with equal doc_id are scanned one by one.
An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import clean_text, stored, table

MAX_PLAIN = 4000         # corpus windows to learn the class of no licence from; nothing else is sampled
MAX_COMMON = 0.002       # n-grams in a larger share of all plain windows are no features
WINDOW = 14              # words of a training window of a template
HALF = 32                # words from a window of a text to the next
CONFIRM = 0.6            # share of a template's n-grams
FALSE_RATE = 0.001       # of all plain windows of the held-back documents above the threshold
STEPS = 10_000           # of the histogram of probabilities that sets the threshold
FOLDS = 4                # one of so many documents, by a hash of the text, is held back
MIN_TELLING = 2          # word triples of templates
FIT_PARTS = 4            # partitions of the bounded training table
NONE = "none"

# fixed values: notices and telling sentences of common licences
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
)


def words_of(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9\\x{80}-\\x{10ffff}]+"), lambda x: x != "")


def grams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Hashes of word pairs and triples; lower case, letters and digits only.
    The words are bound once, as a lambda's variable."""
    w = words_of(text)

    def of(ws, k):
        n = F.size(ws)
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))) \
            .otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(w), lambda ws: F.concat(*[of(ws, k) for k in sizes])), F.lit(0))


def window_hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (row, text) and n-grams -> row, win, gram and the gram's first word
    in the window, for the n-grams ``wanted``."""
    g = docs.select("row", grams(F.col("text")).alias("grams"))
    n = F.floor((F.size("grams") + 3) / 2)                      # words; the pairs come before the triples
    flat = g.select("row", n.alias("n"), F.posexplode("grams").alias("at", "gram")).join(F.broadcast(wanted.select("gram")), "gram")
    word = F.when(F.col("at") < F.col("n") - 1, F.col("at")).otherwise(F.col("at") - F.col("n") + 1).cast("int")
    flat = flat.select("row", "gram", word.alias("word"))
    near = F.floor(F.col("word") / HALF).cast("int")
    return flat.withColumn("win", F.explode(F.array(near, near - 1))).where("win >= 0") \
        .groupBy("row", "win", "gram").agg(F.min("word").alias("word"))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, line string")


class Classifier:
    def __init__(self, families: list[str], weights: DataFrame, intercepts: list[float], threshold: float):
        self.families, self.weights, self.intercepts, self.threshold = families, weights, intercepts, threshold


def fit(docs: DataFrame) -> tuple[Classifier, DataFrame]:
    """docs (row, text) -> the classifier and ``window_hits`` of its n-grams."""
    spark = docs.sparkSession
    t = templates(spark).withColumn("grams", F.array_distinct(grams(F.col("line"))))
    own = t.select(F.explode("grams").alias("gram")).distinct()
    hits = stored(window_hits(docs, own), "license")
    # a window that holds several word triples of templates is no example of plain text
    telling = t.select(F.explode(grams(F.col("line"), (3,))).alias("gram")).distinct()
    marked = hits.join(F.broadcast(telling), "gram").groupBy("row", "win").count().where(F.col("count") >= MIN_TELLING).select("row", "win")
    plain = stored(hits.join(marked, ["row", "win"], "left_anti").select("row", "win", "gram"), "license")
    aside = F.pmod("key", F.lit(FOLDS)) == 0
    n_words = F.size(words_of(F.col("text")))
    sizes = stored(docs.select("row", F.xxhash64("text").alias("key"), F.when(n_words > 0, F.greatest(F.ceil(n_words / HALF) - 1, F.lit(1)))
                               .otherwise(0).cast("long").alias("windows")), "license")
    every, held = sizes.agg(F.sum("windows"), F.sum(F.when(aside, F.col("windows")))).first()
    own_marked = marked.join(sizes, "row")
    off, off_held = own_marked.agg(F.count(F.lit(1)), F.count_if(aside)).first()
    n, n_aside = max((every or 0) - off, 1), max((held or 0) - off_held, 0)
    seen = plain.groupBy("gram").count().where(F.col("count") > MAX_COMMON * n)
    vocabulary = sorted(r["gram"] for r in own.join(F.broadcast(own.join(seen, "gram", "left_semi")), "gram", "left_anti").collect())
    features = spark.createDataFrame([(g,) for g in vocabulary], "gram long")
    plain = plain.join(F.broadcast(features), "gram").join(sizes.select("row", "key"), "row")
    plain = stored(plain, "license")
    sets = plain.where(~aside).groupBy("row", "key", "win").agg(F.array_sort(F.collect_set("gram")).alias("grams"))
    sample = sets.groupBy("key", "win").agg(F.first("grams").alias("grams")).orderBy(F.xxhash64("key", "win"), "key", "win").limit(MAX_PLAIN).select("grams")
    sample = stored(sample, "license")
    words = F.split("line", " ")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0)), F.lit(3))
    windows = t.select("family", "line", F.explode(starts).alias("at")) \
        .select("family", F.array_join(F.slice(words, F.col("at") + 1, WINDOW), " ").alias("line"))
    windows = windows.unionByName(t.select("family", "line")).select("family", F.array_distinct(grams(F.col("line"))).alias("grams"))
    around = sample.select(F.col("grams").alias("around")).orderBy(F.xxhash64("grams")).limit(4)
    mixed = windows.crossJoin(F.broadcast(around)).select("family", F.array_union("grams", "around").alias("grams"))  # 4 rows
    blank = spark.createDataFrame([(NONE, [])], "family string, grams array<long>")
    rows = windows.unionByName(mixed).unionByName(sample.select(F.lit(NONE).alias("family"), "grams")).unionByName(blank)
    rows = stored(rows.coalesce(FIT_PARTS), "license")
    families = [NONE, *sorted({f for f, _ in TEMPLATES})]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    vec = CountVectorizerModel.from_vocabulary([str(g) for g in vocabulary], inputCol="text_grams", outputCol="features", binary=True)
    learn = vec.transform(rows.withColumn("label", label).withColumn("text_grams", F.col("grams").cast("array<string>")))
    model = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.2, family="multinomial", standardization=False).fit(learn)
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(bias) < len(families):
        coef = np.vstack([coef, np.zeros((len(families) - len(bias), coef.shape[1]))])
        bias = np.concatenate([bias, np.full(len(families) - len(bias), -50.0)])
    weights = spark.createDataFrame([(g, [float(x) for x in coef[:, i]]) for i, g in enumerate(vocabulary)], "gram long, w array<double>")
    out = Classifier(families, weights, [float(x) for x in bias], 0.5)
    # plain windows without any feature have the class of no licence; the others set the threshold
    guess = predict(plain.where(aside), out).where(F.col("family") != NONE)
    bars = guess.groupBy(F.floor(F.col("probability") * STEPS).cast("int").alias("bar")).count().collect()     # STEPS rows at most
    out.threshold = max(out.threshold, threshold_of({r["bar"]: r["count"] for r in bars}, int(FALSE_RATE * n_aside)))
    return out, hits.join(F.broadcast(features), "gram")


def threshold_of(bars: dict[int, int], spare: int) -> float:
    """The lowest threshold that at most ``spare`` of the counted probabilities
    reach, to a bar of the histogram."""
    above = 0
    for bar in sorted(bars, reverse=True):
        above += bars[bar]
        if above > spare:
            return min((bar + 1) / STEPS, 0.999)
    return 0.0


def predict(hits: DataFrame, model: Classifier) -> DataFrame:
    """hits (row, win, gram) -> row, win, z (a logit per family), family, probability."""
    k = len(model.families)
    h = hits.join(F.broadcast(model.weights), "gram")
    sums = h.groupBy("row", "win").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    logit = F.array(*[F.col(f"s{i}") + model.intercepts[i] for i in range(k)])
    s = sums.select("row", "win", logit.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*map(F.lit, model.families))
    return s.select("row", "win", "z", F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("family"),
                    (1 / total).alias("probability"))


def best_of_neighbours(found: DataFrame) -> DataFrame:
    """found without the windows whose neighbour has the family as well, and better."""
    w = Window.partitionBy("row", "family").orderBy("win")
    value = F.struct("contained", "probability", (-F.col("win")).alias("win"))
    near = found.withColumn("own", value).withColumn("before", F.lag("own").over(w)).withColumn("behind", F.lead("own").over(w))
    beaten = lambda c: F.coalesce((F.abs(F.col(c)["win"] + F.col("win")) == 1) & (F.col(c) > F.col("own")), F.lit(False))
    return near.where(~beaten("before") & ~beaten("behind")).drop("own", "before", "behind")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and findings (line_no, family, probability,
    contained, confirmed), by line; family is unknown below the threshold."""
    spark = docs.sparkSession
    # row numbers are read from files: computed anew, they follow the split of the input
    docs = stored(docs.select("doc_id", clean_text().alias("text"), F.monotonically_increasing_id().alias("row")), "license")
    every = docs.select("row", "text")
    model, hits = fit(every)
    hits = stored(hits, "license")
    guess = stored(predict(hits, model), "license")
    t = templates(spark).withColumn("gram", F.explode(F.array_distinct(grams(F.col("line"))))).select("template", "family", "gram") \
        .join(model.weights.select("gram"), "gram")
    whole = t.groupBy("template", "family").agg(F.collect_set("gram").alias("own"))
    whole = whole.join(t.groupBy("family").agg(F.collect_set("gram").alias("every")), "family")
    match = hits.join(F.broadcast(t), "gram").groupBy("row", "win", "family", "template").agg(     # t, whole: fixed templates
        F.collect_set("gram").alias("found"), F.min("word").alias("word"))
    match = match.join(F.broadcast(whole), ["family", "template"]).withColumn("part", F.size("found") / F.size("own"))
    match = stored(match.groupBy("row", "win", "family").agg(
        F.max(F.struct("part", "word", "found", "own", "every")).alias("m")).select("row", "win", "family", "m.*"), "license")
    # families that hold enough of a template, also of what the better ones lack
    logit = F.get("z", F.array_position(F.array(*map(F.lit, model.families)), F.col("family")).cast("int") - 1)
    strong = match.where(F.col("part") >= CONFIRM).join(guess.select("row", "win", "z"), ["row", "win"])
    strong = strong.groupBy("row", "win").agg(F.collect_list(F.struct(
        "part", logit.alias("logit"), "family", "word", "found", "own", "every", (1 / (1 + F.exp(F.col("z")[0] - logit))).alias("probability"))).alias("s"))

    def stands(f, g):
        better = F.struct(g["part"], g["logit"], g["family"]) > F.struct(f["part"], f["logit"], f["family"])
        lacked = F.size(F.array_except(f["own"], g["every"]))
        return ~better | ((lacked > 0) & (F.size(F.array_except(f["found"], g["every"])) >= CONFIRM * lacked))

    sure = strong.select("row", "win", F.explode(F.filter("s", lambda f: F.forall("s", lambda g: stands(f, g)))).alias("f")) \
        .select("row", "win", "f.family", "f.probability", F.col("f.part").alias("contained"), "f.word").where(F.col("probability") >= model.threshold)
    sure = stored(best_of_neighbours(sure), "license")
    covered = sure.select("row", F.explode(F.array(F.col("win") - 1, F.col("win"), F.col("win") + 1)).alias("win")).distinct()
    first = hits.groupBy("row", "win").agg(F.min("word").alias("word"))
    other = guess.where(F.col("family") != NONE).drop("z").join(covered, ["row", "win"], "left_anti") \
        .join(match.select("row", "win", "family", F.col("part").alias("contained")), ["row", "win", "family"], "left") \
        .na.fill(0.0, ["contained"]).join(first, ["row", "win"]) \
        .withColumn("family", F.when(F.col("probability") >= model.threshold, F.col("family")).otherwise("unknown"))
    other = best_of_neighbours(other)
    cols = ["row", "family", "probability", "contained", "word"]
    found = sure.select(*cols, F.lit(True).alias("confirmed")).unionByName(other.select(*cols, F.lit(False).alias("confirmed")))
    found = stored(found, "license")
    lines = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.array_repeat(i, F.size(words_of(x)))))
    lines = every.join(found.select("row").distinct(), "row", "left_semi").select("row", lines.alias("lines"))
    found = found.join(lines, "row").select("row", F.struct(
        F.get("lines", F.col("word")).alias("line_no"), "family", F.round("probability", 6).alias("probability"),
        F.round("contained", 6).alias("contained"), "confirmed").alias("f"))
    per = found.groupBy("row").agg(F.array_sort(F.collect_list("f")).alias("findings"))
    return docs.select("doc_id", "row").join(per, "row", "left").select(
        "doc_id", F.coalesce("findings", F.array().cast(dict(per.dtypes)["findings"])).alias("findings"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    sure = F.filter("findings", lambda f: f["confirmed"])
    return out.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
                      F.size(sure).cast("long").alias("n_confirmed"), F.size("findings").cast("long").alias("n_findings"), "findings")
