"""Licence scans by a trained paragraph classifier, with DataFrame functions on the whole main path.

Paragraphs are lines, and neighbouring lines together where a notice may be wrapped. Which of the notices' words and word pairs they have
are the features of a multinomial logistic regression, made sparse by an L1 penalty and trained on variants of licence notices against every
paragraph of the corpus: those with the same features are one row with a weight. A paragraph is unknown unless its best family beats a threshold
calibrated on all of them, and a family counts only if comparison with the family's notices confirms it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Wordings that give notice of a licence, by SPDX identifier.
NOTICES = {
    "MIT": ["released under the MIT license", "licensed under the MIT license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["licensed under the Apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"],
    "GPL-2.0": ["licensed under the GNU general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license version 2"],
    "GPL-3.0": ["licensed under the GNU general public license version 3", "this work is licensed under the GNU general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license version 3"],
    "LGPL-3.0": ["licensed under the GNU lesser general public license version 3", "you can redistribute it and or modify it under the terms of the GNU lesser general public license"],
    "AGPL-3.0": ["licensed under the GNU affero general public license version 3", "modify it under the terms of the GNU affero general public license"],
    "BSD-3-Clause": ["licensed under the BSD 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "MPL-2.0": ["licensed under the Mozilla public license version 2.0", "this source code form is subject to the terms of the Mozilla public license v 2.0"],
    "ISC": ["licensed under the ISC license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "CC0-1.0": ["released under CC0 1.0 universal public domain dedication", "the person who associated a work with this deed has dedicated the work to the public domain"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under CC BY SA 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under CC BY NC 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
#: Ways to open a notice, for the variants that are trained on.
OPENINGS = ["", "this file is", "this work is", "all code in this repository is", "the text below is"]
FAMILIES = sorted(NOTICES)
#: Share of unknown paragraphs that the threshold lets pass, and the steps it is told in; share of a notice's pairs to find; weight of all unknown paragraphs in training, as a multiple of the variants'.
FALSE_RATE, STEPS, CONFIRM, UNKNOWN_WEIGHT = 1e-3, 10_000, 0.6, 3.0

#: Each notice has one of these words; only lines near one are joined. Words that a notice may have between its first and last line.
ANCHORS, SPAN = "license licensed permission redistribution unencumbered dedicated dedication unlicense".split(), 60


def tokens(paragraph: Column) -> Column:
    """Words of a paragraph: runs of letters, digits and full stops between digits, lower-cased."""
    low = F.lower(paragraph)
    bare = F.regexp_replace(low, r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.]+", " ")
    # without a full stop between digits one pass is enough
    return F.array_remove(F.when(paragraph.rlike(r"[0-9]\.[0-9]"), F.split(bare, " +")).otherwise(F.split(low, r"[^\p{L}\p{N}]+")), "")


def paragraphs(docs: DataFrame, text: str) -> DataFrame:
    """(__row, pos, paragraph) of the lines of ``docs`` that are not blank."""
    return docs.select("__row", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "paragraph")).filter(F.trim("paragraph") != "")


def joined(docs: DataFrame, text: str) -> DataFrame:
    """(__row, pos, n_lines, words) of each run of two or more lines that a notice could be wrapped over.

    A line without words ends a run. Of a run's first line only the last ``SPAN`` words count, of its last the first.
    """
    some = docs.select("__row", F.col(text).alias("t")).filter(F.lower("t").rlike("|".join(ANCHORS)) & F.col("t").contains("\n"))
    some = some.select("__row", F.transform(F.split("t", "\n"), tokens).alias("lines"))
    run = "struct<n_lines:int,words:array<string>>"
    start = lambda w: F.struct(
        F.slice(w, F.greatest(F.size(w) - SPAN + 1, F.lit(1)), SPAN).alias("words"), F.lit(0).alias("inner"), F.lit(1).alias("n"), F.array().cast(f"array<{run}>").alias("out")
    )
    more = lambda a, w: F.struct(
        F.concat(a["words"], w).alias("words"), (a["inner"] + F.size(w)).alias("inner"), (a["n"] + 1).alias("n"),
        F.concat(a["out"], F.array(F.struct((a["n"] + 1).alias("n_lines"), F.concat(a["words"], F.slice(w, 1, SPAN)).alias("words")).cast(run))).alias("out"),
    )
    closed = lambda a: F.struct(a["words"].alias("words"), F.lit(SPAN + 1).alias("inner"), a["n"].alias("n"), a["out"].alias("out"))
    step = lambda a, w: F.when((F.size(w) > 0) & (a["inner"] <= SPAN), more(a, w)).otherwise(closed(a))
    # every line with words begins runs; those without an anchor word are left out
    runs = lambda w, i: F.when(F.size(w) > 0, F.aggregate(F.slice("lines", i + 2, F.lit(SPAN + 2)), start(w), step, lambda a: a["out"])).otherwise(F.array().cast(f"array<{run}>"))
    each = some.select("__row", F.posexplode(F.transform("lines", runs)).alias("pos", "runs")).select("__row", "pos", F.inline("runs"))
    return each.filter(F.arrays_overlap("words", F.array(*map(F.lit, ANCHORS))))


def apart(hits: Column) -> Column:
    """Of overlapping hits (order, pos, n_lines, one) those that come first in order."""
    meet = lambda x, y: (x["pos"] < y["pos"] + y["n_lines"]) & (y["pos"] < x["pos"] + x["n_lines"])
    return F.aggregate(F.array_sort(hits), F.slice(hits, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: meet(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def worded(lines: DataFrame) -> DataFrame:
    """``lines`` with the ``words`` of their ``paragraph``, which an explode keeps from being cut apart once for each use."""
    return lines.withColumn("words", F.explode(F.array(tokens(F.col("paragraph"))))).drop("paragraph")


def featured(lines: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``lines`` with a vector column ``features``: which words and word pairs of the vocabulary their ``words`` have."""
    paired = NGram(n=2, inputCol="words", outputCol="__pairs").transform(lines)
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__grams", outputCol="features", binary=True)
    return counted.transform(paired.withColumn("__grams", F.concat("words", "__pairs"))).drop("__pairs", "__grams")


def present(features: str = "features") -> Column:
    """The numbers of the features that a paragraph has."""
    return F.unwrap_udt(F.col(features))["indices"]


def best_notice(notices: list[tuple[str, list[int]]], on: Column) -> Column:
    """The notice that shares most of its word pairs with the paragraph: struct of share, size and family."""
    each = F.array(*[F.struct(F.lit(k).alias("on"), F.lit(f).alias("family")) for f, k in notices])
    one = lambda k, v: F.struct((F.size(F.array_intersect(k["on"], v)) / F.size(k["on"])).alias("share"), F.size(k["on"]).alias("size"), k["family"].alias("family"))
    return F.transform(F.array(on), lambda v: F.array_max(F.transform(each, lambda k: one(k, v))))[0]


def wordings() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(family, wording) of the notices as they are, and of their variants."""
    notices = [(f, n) for f in FAMILIES for n in NOTICES[f]]
    return notices, [(f, f"{o} {n} {c}".strip()) for f, n in notices for o in OPENINGS for c in ("", "see the license file for details")]


def vocabulary(spark: SparkSession) -> tuple[list[str], list[tuple[str, list[int]]]]:
    """The variants' words and word pairs, which are the features whatever the corpus, and for each notice its family and those that are its word pairs."""
    notices, variants = wordings()
    cut = lambda said: [(r.family, r.words, [" ".join(x) for x in zip(r.words, r.words[1:])]) for r in worded(spark.createDataFrame(said, "family string, paragraph string")).collect()]
    grams = sorted({g for _, w, pairs in cut(variants) for g in w + pairs})
    number = {g: i for i, g in enumerate(grams)}
    return grams, [(f, sorted({number[g] for g in pairs})) for f, _, pairs in cut(notices)]


def prepared(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(__row, pos, n_lines, features) of every line of ``docs`` and of the runs of lines that may be a notice; written, for training and scan alike.

    ``__row`` is a digest of the text, the same for rows with equal texts.
    """
    keyed = docs.select(F.sha2(F.col(text), 256).alias("__row"), F.col(text).alias("t"))
    lines = worded(paragraphs(keyed, "t")).select("__row", "pos", F.lit(1).alias("n_lines"), "words")
    grams, _ = vocabulary(docs.sparkSession)
    return written(featured(lines.unionAll(joined(keyed, "t")), grams).select("__row", "pos", "n_lines", "features"), "paragraphs")


@dataclass
class Model:
    """The regression (class 0 is unknown, then each family), the features that are each notice's word pairs, and the threshold."""

    notices: list[tuple[str, list[int]]]
    fitted: LogisticRegressionModel
    threshold: float = 0.5
    #: Lines of the corpus that it was trained and calibrated on.
    lines: int = 0

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with an array ``p``: of unknown and each family, by their ``features``."""
        return self.fitted.transform(rows).withColumn("p", vector_to_array("probability")).drop("probability")


def threshold(scored: DataFrame, rate: float) -> float:
    """The least multiple of 1 / ``STEPS``, 0.5 at least, that no more than ``rate`` of all rows of ``scored`` (``known``, ``n``) reach."""
    steps = dict(scored.groupBy(F.floor(F.col("known") * STEPS).alias("step")).agg(F.sum("n")).collect())  # STEPS + 1 rows at the most
    over, cut = rate * sum(steps.values()), STEPS + 1
    while cut > STEPS // 2 and steps.get(cut - 1, 0) <= over:
        cut -= 1
        over -= steps.get(cut, 0)
    return cut / STEPS


def train(docs: DataFrame, *, text: str = "text", false_rate: float = FALSE_RATE, rows: DataFrame | None = None) -> Model:
    """A model from the notices' variants and every line of ``docs``, whose threshold follows from every line too. ``rows``: what ``prepared`` gave for them.

    Lines that a notice's words would confirm are left out of both, as they would teach licences as unknown. Each other line
    counts alike, and all together ``UNKNOWN_WEIGHT`` times as much as the variants, however many they are.
    """
    spark = docs.sparkSession
    grams, notices = vocabulary(spark)
    rows = prepared(docs, text=text) if rows is None else rows
    # written first, so that notices are compared with each vector once, not with each line
    kinds = written(rows.filter("n_lines = 1").groupBy("features").agg(F.count(F.lit(1)).alias("n")), "kinds")
    unknown = written(kinds.filter(best_notice(notices, present())["share"] < CONFIRM), "unknown")
    total = unknown.agg(F.sum("n")).first()[0] or 0
    _, variants = wordings()
    examples = worded(spark.createDataFrame([(float(FAMILIES.index(f) + 1), n) for f, n in variants] + [(0.0, "")], "label double, paragraph string"))
    weight = F.col("n") * F.lit(UNKNOWN_WEIGHT * len(variants) / max(1, total))
    data = featured(examples, grams).select("label", F.lit(1.0).alias("weight"), "features").unionAll(unknown.select(F.lit(0.0), weight, "features"))
    data = written(data.coalesce(spark.sparkContext.defaultParallelism), "training")
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=1.0, maxIter=40, standardization=False, weightCol="weight").fit(data)
    model = Model(notices, fitted.setRawPredictionCol("").setPredictionCol(""), lines=total)
    model.threshold = threshold(model.probabilities(unknown).select((1 - F.col("p")[0]).alias("known"), "n"), false_rate)
    return model


def scan(docs: DataFrame, model: Model, *, text: str = "text", into: str = "licences", rows: DataFrame | None = None) -> DataFrame:
    """``docs`` with an array column ``into``: a struct of line, family, probability and share for each licence paragraph.

    line counts from 1 and is the first one of a notice that is wrapped. Null and blank texts have none. A paragraph counts if its
    best family's probability reaches the model's threshold and a notice of the same family is its best match with ``CONFIRM`` of
    its word pairs or more; a line above the threshold without that is reported as family ``unknown``. Of findings that share a
    line the one with most pairs of its notice stays, then the shortest. All columns of ``docs`` stay but one called ``into``.
    ``rows``: what ``prepared`` gave for ``docs``.
    """
    numbered = docs.withColumn("__row", F.sha2(F.col(text), 256))  # rows with equal texts have equal findings
    scored = model.probabilities(prepared(docs, text=text) if rows is None else rows)
    best, family = F.array_max(F.slice("p", 2, len(FAMILIES))), F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(F.slice("p", 2, len(FAMILIES)), F.col("best")).cast("int"))
    hits = scored.withColumn("best", best).filter(F.col("best") >= model.threshold)
    hits = hits.select("__row", "pos", "n_lines", "best", family.alias("family"), best_notice(model.notices, present()).alias("match"))
    agree = (F.col("match")["share"] >= CONFIRM) & (F.col("match")["family"] == F.col("family"))
    one = F.struct((F.col("pos") + 1).alias("line"), F.when(agree, F.col("family")).otherwise("unknown").alias("family"), F.col("best").alias("probability"), F.col("match")["share"].alias("share"))
    order = F.struct((-F.round(F.col("match")["share"] * F.col("match")["size"])).alias("pairs"), F.col("n_lines").alias("length"), (-F.col("pos")).alias("late"))
    hits = hits.filter((F.col("n_lines") == 1) | agree).select("__row", F.struct(order.alias("order"), F.col("pos"), F.col("n_lines"), one.alias("one")).alias("hit"))
    # one run of each first line is enough: the best
    hits = hits.groupBy("__row", F.col("hit.pos").alias("pos"), (F.col("hit.n_lines") == 1).alias("single")).agg(F.min("hit").alias("hit"))
    by = hits.groupBy("__row").agg(F.collect_list("hit").alias("hits"))
    by = written(by.select("__row", F.array_sort(F.transform(apart(F.col("hits")), lambda x: x["one"])).alias("__found")), "licences")
    none = F.array().cast(by.schema["__found"].dataType)
    return numbered.join(by, "__row", "left").withColumn(into, F.coalesce("__found", none)).drop("__row", "__found")
