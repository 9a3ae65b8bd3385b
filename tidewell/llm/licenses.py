"""License scan of paragraphs by a trained classifier; DataFrame and Spark ML functions only.

A paragraph's features are the words and word pairs that occur in the templates, counted sparsely. A multinomial logistic
regression is trained on the templates and on one half of all other lines, with ``unknown`` as a class of its own; the
probability from which a family is believed is calibrated on the other half of them. A believed family is
confirmed by comparison with its templates: the share of a template's word pairs that the paragraph has.

A paragraph can only be confirmed if it has one of a template's anchor words; they are chosen so that the pairs
without them never reach the share that confirms. Paragraphs without an anchor are therefore unknown without further
work, which changes no result.

Defined cases. A paragraph is a line, or a run of neighbouring lines with at most ``LONGEST`` words between its first and
its last one, so that wrapped notices are met at any width; lines without words end a run. Of runs of one family that share
a line, the one that ends first counts, and of these the shortest. Null, empty and blank texts have no paragraphs. Ties
between families go to the first by name. Rows with one id share the notices found under it; a missing id finds none. Very
long lines are read whole. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.llm.common import staged

UNKNOWN = "unknown"
#: Share of a template's word pairs that confirms it.
CONFIRM = 0.8
#: All unknown lines together weigh as much as so many at most, so that more of them do not drown the templates.
UNKNOWN_WEIGHT = 10_000
#: Share of held-out unknown paragraphs that may be believed to be a family.
FALSE_ALARMS = 0.001

# Notices by which works name their licence, in natural order.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "Reserved": (
        "All rights reserved.",
    ),
}
#: Sentences with the same words that are no licence.
CONFUSING = (
    "The driver showed a license and a public version of the terms.",
    "Version 2.0 of the software was released under pressure in general use.",
    "All of the public is free to use this work in any form.",
    "The licensed version of the file is subject to conditions.",
    "A copy of the terms can be found in the library, with or without the source.",
    "Permission to use the work is reserved to any person of the foundation.",
    "Creative work is common, and attribution is free of charge.",
    "The foundation released a statement under the terms of the agreement.",
)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


def _pairs(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _templates() -> Iterator[tuple[str, str]]:
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            yield family, text


#: Words of the longest template; a notice has no more between its first and its last line.
LONGEST = max(len(_WORD.findall(t.lower())) for _, t in _templates())


def anchors(confirm: float = CONFIRM) -> list[str]:
    """Words without which no template reaches the share that confirms it; long words first."""
    chosen: set[str] = set()
    for _, text in _templates():
        pairs = set(_pairs(text))
        for word in sorted(set(_WORD.findall(text.lower())), key=lambda w: (w not in chosen, -len(w), w)):
            without = [p for p in pairs if not chosen.intersection(p.split())]
            if len(without) < confirm * len(pairs):
                break
            chosen.add(word)
    return sorted(chosen)


_ANCHORED = "|".join(map(re.escape, anchors()))


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({_WORD.pattern})"), F.lit(1))


def with_grams(rows: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``pairs`` and ``grams`` (words and pairs)."""
    rows = rows.withColumn("words", words_of(F.col(line)))
    pairs = F.when(F.size("words") > 1, F.zip_with(
        F.slice("words", 1, F.size("words") - 1), F.expr("slice(words, 2, size(words))"), lambda a, b: F.concat_ws(" ", a, b)
    )).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("pairs", pairs)
    return rows.withColumn("grams", F.concat("words", "pairs")).drop("words")


def blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, doc_no, block_no, block): neighbouring lines with words, of which some may confirm a template.

    The pairs of a run are among those of its block, so a block that no template finds its share in holds no notice.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("doc_no"), F.col(text).alias("text"))
    split = F.split(F.lower("text"), r"\n[^a-z0-9]*\n")
    blocks = ids.filter(F.col("doc_id").isNotNull() & F.lower("text").rlike(_ANCHORED)).select(
        "doc_id", "doc_no", F.posexplode(split).alias("block_no", "block")
    )
    near = with_grams(blocks.filter(F.col("block").rlike(_ANCHORED)), "block")
    return near.filter(F.greatest(*(share for _, share in _template_share(F.col("pairs")))) >= CONFIRM).drop("pairs", "grams")


def runs_of(blocks: DataFrame) -> DataFrame:
    """Adds ``first``, ``last`` and ``line``: every line of a block, and every run of lines a wrapped notice can fill.

    Of the outer lines of a run the nearest ``LONGEST`` words are taken.
    """
    near = F.transform(
        F.filter(F.split("block", "\n"), lambda x: x.rlike("[a-z0-9]")),
        lambda x: F.struct(x.alias("line"), words_of(x).alias("words")),
    )
    starts = blocks.withColumn("lines", near).withColumn("first", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)))
    starts = starts.withColumn("ahead", F.slice("lines", F.col("first") + 1, LONGEST + 2)).drop("block", "lines")
    # ends: (last, line) while the words between do not exceed LONGEST.
    head = F.element_at("ahead", 1)["words"]
    seed = F.struct(
        F.lit(0).alias("between"), F.array_join(F.slice(head, F.greatest(F.size(head) - LONGEST + 1, F.lit(1)), LONGEST), " ").alias("so_far"),
        F.array().cast("array<string>").alias("runs"),
    )

    def more(state: Column, x: Column) -> Column:
        run = F.concat_ws(" ", state["so_far"], F.array_join(F.slice(x["words"], 1, LONGEST), " "))
        between = state["between"] + F.size(x["words"])
        return F.when(state["between"] > LONGEST, state).otherwise(F.struct(
            between.alias("between"),
            F.when(between > LONGEST, "").otherwise(F.concat_ws(" ", state["so_far"], F.array_join(x["words"], " "))).alias("so_far"),
            F.concat(state["runs"], F.array(run)).alias("runs"),
        ))

    longer = F.aggregate(F.slice("ahead", 2, LONGEST + 1), seed, more, lambda state: state["runs"])
    every = F.concat(F.array(F.element_at("ahead", 1)["line"]), longer)
    ends = starts.select("doc_id", "doc_no", "block_no", "first", F.posexplode(every).alias("more", "line"))
    return ends.withColumn("last", F.col("first") + F.col("more")).drop("more")


def _template_share(pairs: Column, families: list[str] | None = None) -> list[tuple[str, Column]]:
    """For each template: its family and the share of its pairs among ``pairs``."""
    return [
        (family, F.size(F.array_intersect(pairs, F.array(*map(F.lit, sorted(set(_pairs(text))))))) / len(set(_pairs(text))))
        for family, text in _templates() if families is None or family in families
    ]


class Scanner:
    """A fitted classifier with its threshold."""

    def __init__(self, spark: SparkSession, model: LogisticRegressionModel, families: list[str], threshold: float) -> None:
        self.spark, self.model, self.families, self.threshold = spark, model, families, threshold

    def classify(self, rows: DataFrame) -> DataFrame:
        """Adds ``family``, ``probability`` and ``similarity`` to rows with ``pairs`` and ``grams``."""
        scored = self.model.transform(_vectors(self.spark, rows)).withColumn("p", vector_to_array("probability"))
        best = F.array_max(F.transform(
            F.slice("p", 2, len(self.families)), lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))
        ))
        scored = scored.withColumn("best", best).withColumn(
            "guess", F.element_at(F.array(*map(F.lit, self.families)), F.lit(1) - F.col("best.i"))
        )
        shares = [F.when(F.col("guess") == family, share) for family, share in _template_share(F.col("pairs"))]
        similarity = F.coalesce(F.greatest(*shares, F.lit(0.0)), F.lit(0.0))
        scored = scored.withColumn("similarity", similarity)
        sure = (F.col("best.p") >= self.threshold) & (F.col("similarity") >= CONFIRM)
        return scored.withColumn("family", F.when(sure, F.col("guess")).otherwise(UNKNOWN)).withColumn(
            "probability", F.col("best.p")
        ).drop("best", "guess", "p", "features", "rawPrediction", "prediction")


#: Words and word pairs of the templates, the features.
VOCABULARY = sorted({g for _, t in _templates() for g in (*_pairs(t), *_WORD.findall(t.lower()))})


def _vectors(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(VOCABULARY, "grams", "features").transform(rows)


def unknown_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(half, grams, lines): the grams in the vocabulary of every line of every distinct text, and how many lines have them.

    Lines that look half like a template are no example of the unknown and left out.
    """
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("a"), F.md5(text).alias("b")).dropna()
    lines = texts.select("a", "b", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.trim("line") != "")
    known = with_grams(lines).withColumn("grams", F.filter("grams", lambda g: g.isin(VOCABULARY)))
    known = known.select("a", "b", "at", F.pmod(F.xxhash64("line"), F.lit(2)).alias("half"), F.array_sort("grams").alias("grams"))
    pairs = F.filter("grams", lambda g: g.contains(" "))
    near = F.greatest(*(share for _, share in _template_share(F.col("pairs"))))
    once = known.dropDuplicates(["a", "b", "at"]).groupBy("half", "grams").agg(F.count("*").alias("lines"))
    return once.withColumn("pairs", pairs).filter((F.size("pairs") == 0) | (near < 0.5)).drop("pairs")


def train(docs: DataFrame, text: str = "text") -> Scanner:
    """Fit on the templates and one half of the lines of all texts; the other half is kept for calibration."""
    spark = docs.sparkSession
    families = sorted(TEMPLATES)
    known = [(families.index(f) + 1.0, t) for f, t in _templates()]
    known += [(label, t.lower()) for label, t in known] + [(label, "Copyright notice. " + t) for label, t in known]
    other = staged(unknown_lines(docs, text), "unknown-lines")
    learnt = other.filter("half = 0")
    lines = learnt.agg(F.sum("lines")).first()[0] or 0
    each = min(1.0, UNKNOWN_WEIGHT / max(1, lines))
    positives = with_grams(spark.createDataFrame([*known, *((0.0, t) for t in CONFUSING)], "label double, line string"))
    rows = positives.select("label", F.lit(20.0).alias("weight"), "grams").unionByName(
        learnt.select(F.lit(0.0).alias("label"), (F.col("lines") * F.lit(each)).alias("weight"), "grams")
    )
    fitted = LogisticRegression(
        family="multinomial", regParam=1e-4, maxIter=60, weightCol="weight", standardization=False
    ).fit(_vectors(spark, rows))
    chances = fitted.transform(_vectors(spark, other.filter("half = 1"))).withColumn("p", vector_to_array("probability"))
    best = f"array_max(slice(p, 2, {len(families)}))"
    highest = chances.agg(F.expr(f"percentile({best}, {1 - FALSE_ALARMS}, lines)")).first()[0]
    return Scanner(spark, fitted, families, max(0.5, highest or 0.0))


def scan(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_no, block_no, first, last, line, family, probability, similarity) of all runs near a template."""
    runs = with_grams(runs_of(blocks_of(docs, doc_id, text)))
    near = runs.filter(F.greatest(*(share for _, share in _template_share(F.col("pairs")))) >= CONFIRM)
    return scanner.classify(near).select(
        "doc_id", "doc_no", "block_no", "first", "last", "line", "family", "probability", "similarity"
    )


def notices(found: DataFrame) -> DataFrame:
    """(doc_id, family, probability) of runs that share no line with an earlier one of their family and block."""
    run = F.struct("last", (-F.col("first")).alias("back"), "probability")
    runs = found.groupBy("doc_id", "doc_no", "block_no", "family").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    kept = F.aggregate(
        "runs", F.struct(F.lit(-1).alias("end"), F.array().cast("array<double>").alias("kept")),
        lambda state, r: F.when(-r["back"] <= state["end"], state).otherwise(
            F.struct(r["last"].alias("end"), F.concat(state["kept"], F.array(r["probability"])).alias("kept"))
        ),
        lambda state: state["kept"],
    )
    return runs.select("doc_id", "family", F.explode(kept).alias("probability"))


def licences_of(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, licences (families by name, comma-joined; ``unknown`` if none), n_notices, best probability."""
    found = notices(scan(docs, scanner, doc_id, text).filter(F.col("family") != UNKNOWN))
    rows = found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"),
        F.count("*").alias("n_notices"), F.max("probability").alias("probability"),
    )
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    return ids.join(rows, "doc_id", "left").select(
        "doc_id", F.coalesce("licences", F.lit(UNKNOWN)).alias("licences"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"), "probability",
    )
