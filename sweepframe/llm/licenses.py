"""Licence scans: a logistic regression on sparse word n-grams names a paragraph's licence family, templates confirm it.

A paragraph is a line, or a block of lines between blank ones. It is looked at if it holds a cue, a word of the
families' own notices that ordinary prose does not share; :func:`train` refuses notices that hold none. The classifier
is trained on the families' usual notices and on ordinary sentences with the same words; the least probability at
which a family is named is set on held-back sentences of the unknown class. A named family is confirmed if the
paragraph holds most of the words and word pairs of one of its notices and that notice grants a licence. A block counts
where its lines, each alone, confirm nothing. DataFrame and SQL functions, and Spark's own regression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StudyError

FEATURES = 1 << 12
CONFIRMED = 0.6
UNKNOWN = "unknown"

# Usual notices of public licences.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL, version 2 or later.",
        "Released under GPLv2.",
        "Released under GPLv3.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software under the terms of the GNU Lesser General Public License.",
    ),
    "bsd": (
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
    ),
}
#: Families whose notices grant nothing: they are named, but confirm no licence.
RESERVED = ("all-rights-reserved",)
#: Ordinary sentences with the same words.
ORDINARY = (
    "You need a driving licence to rent a car in this country.",
    "The restaurant lost its license to sell alcohol last year.",
    "He asked for permission to leave the room early.",
    "The warranty on the washing machine had expired.",
    "She applied for a fishing license at the town office.",
    "Copyright law was the subject of the second lecture.",
    "The redistribution of land began after the war.",
    "Poetic license allows a writer to bend the facts.",
    "The officer checked my license and the papers of the vehicle.",
    "They discussed the licence fee for public television.",
    "Planning permission was refused by the council.",
    "All copyright claims were settled out of court.",
    "The company will license its brand to a partner abroad.",
    "License plates must be clean and easy to read.",
    "The pilot renewed her licence every two years.",
    "Nobody gave permission for the tower to be built.",
    "Redistribution of income is a matter of debate.",
    "The seller offers no warranty for used goods.",
    "A license was issued to the new clinic in version two of the plan.",
    "The work was done under the terms of the contract, with written permission.",
    "The rights of the workers were the subject of the talk.",
    "A table by the window was reserved for all of the guests.",
    "All seats on the morning train are reserved.",
    "The public library is open to all, free of charge.",
    "The source of the river was found by a general in version of the tale.",
    "The file was released to the press under the new terms.",
)
#: Words of the notices that ordinary prose is full of (mit is a German word), so they are no cues.
_PLAIN = frozenset(
    "a all an and any are as at author been by can charge code conditions except extent file following for form free general"
    " granted has have hereby in international into is it law library may met mit not obtaining of on or other person possible program project"
    " public published released related root s see source subject that the their this to under use used v version waived"
    " with without work you terms authors associated files governed style 1.0 2.0 2.1 3 4.0 2 later"
    " lesser provided binary clause compliance copy domain foundation forms modification modify documentation software commons nc sa".split()
)
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words that licence talk uses besides those of the notices.
_MORE = ("licen[cs]\\w*", "copyright\\w*", "warrant\\w*", "permission\\w*", "permitted", "redistribut\\w*", "free software", "public domain", "under (?:the )?mit")


def cue() -> str:
    """A pattern that every notice holds: all words of the notices that are not plain."""
    own = {w for notices in TEMPLATES.values() for n in notices for w in re.findall(_WORD, n.lower())} - _PLAIN
    pattern = r"(?i)\b(?:" + "|".join([*_MORE, *(re.escape(w) for w in sorted(own))]) + r")\b"
    for notice in (n for notices in TEMPLATES.values() for n in notices):
        if not re.search(pattern, notice):
            raise StudyError(f"no cue in the notice: {notice}")
    return pattern


def grams(text: Column) -> Column:
    """Words in lower case and pairs of neighbours, each once."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    # The last word has no neighbour, so its pair is itself and goes.
    return F.array_distinct(F.concat(tokens, pairs))


@dataclass
class Scanner:
    model: LogisticRegressionModel
    names: list[str]
    least: float


def _variants(text: str) -> list[str]:
    """The text with each word left out in turn, and within a longer sentence."""
    words = text.split()
    cut = [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))] if len(words) > 4 else []
    return [text, text.upper(), f"Note: {text}", f"{text} All other rights are reserved.", *cut]


def train(spark: SparkSession) -> Scanner:
    """Fit on the notices and sentences above; a third of the ordinary ones is held back to set ``least``."""
    names = [UNKNOWN, *TEMPLATES]
    rows = [(v, float(names.index(f))) for f, notices in TEMPLATES.items() for notice in notices for v in _variants(notice)]
    rows += [(v, 0.0) for i, text in enumerate(ORDINARY) if i % 3 for v in _variants(text)]
    held = [(v, 0.0) for i, text in enumerate(ORDINARY) if i % 3 == 0 for v in _variants(text)]
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    table = spark.createDataFrame(rows, "text string, label double").repartition(4).select(grams(F.col("text")).alias("grams"), "label")
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(counted.transform(table))
    check = fitted.transform(counted.transform(spark.createDataFrame(held, "text string, label double").select(grams(F.col("text")).alias("grams"))))
    chance = F.array_max(F.slice(vector_to_array("probability"), 2, len(names)))
    highest = check.agg(F.max(chance)).first()[0]
    return Scanner(fitted, names, min(0.9, max(0.5, highest)))


def _paragraphs(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, line, paragraph, parts`` of all lines with a cue, and of all blocks of several lines with one.

    ``parts`` holds the lines of a block and is null for a line; ``line`` is where a block starts.
    """
    mark = F.lit(cue())
    cued = docs.where(F.col(text).rlike(cue()))
    lines = cued.select(F.col("doc_id").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "paragraph"))
    lines = lines.where(F.regexp_like("paragraph", mark)).withColumn("parts", F.lit(None).cast("array<string>"))
    # White space goes from blank lines, so that a block ends at two line ends.
    whole = F.regexp_replace(F.col(text), r"\n[ \t\r]+(?=\n)", "\n")
    blocks = cued.select(F.col("doc_id").alias("doc_id"), F.split(whole, r"(?<=\n\n)(?!\n)").alias("blocks"))
    placed = F.transform("blocks", lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, r"^\n+|[\r\n]+$", "").alias("x"), x.alias("raw")))
    some = F.filter(placed, lambda x: x["x"].contains("\n") & F.regexp_like(x["x"], mark))
    blocks = blocks.withColumn("b", F.explode(some))
    # Line ends before the block, and those at its own start.
    ahead = F.concat(F.array_join(F.slice("blocks", F.lit(1), F.col("b.i")), ""), F.regexp_extract("b.raw", r"^\n*", 0))
    blocks = blocks.select("doc_id", (F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit("")))).alias("line"), F.col("b.x").alias("paragraph"))
    return lines.union(blocks.withColumn("parts", F.split("paragraph", "\n")))


def license_lines(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """``doc_id, line, paragraph, family, probability, template, similarity, confirmed`` of every line with a cue.

    A notice that runs over several lines of a block, none of which holds enough of it, has a row with the whole
    block and its first line. ``family`` is ``unknown`` where no family reaches the calibrated probability.
    ``similarity`` is the largest share of a notice's words and pairs that the paragraph holds, over the family's
    notices (null for unknown). Null and empty texts have no lines; every repeated row has its lines; null ids stay
    null; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    cued = _paragraphs(docs, text).withColumn("grams", grams(F.col("paragraph")))
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(cued)
    scored = scanner.model.transform(counted).withColumn("chances", vector_to_array("probability"))
    names = F.array(*(F.lit(name) for name in scanner.names))
    best = F.array_max(F.slice("chances", 2, len(scanner.names)))
    place = F.array_position(F.slice("chances", 2, len(scanner.names)), best) + 1
    named = scored.withColumns({"probability": best, "family": F.element_at(names, place.cast("int"))})
    sure = F.col("probability") > scanner.least
    notices = spark.createDataFrame([(f, n) for f, ns in TEMPLATES.items() for n in ns], "family string, template string")
    notices = notices.groupBy("family").agg(F.collect_list(F.struct("template", grams(F.col("template")).alias("parts"))).alias("notices"))
    # One row per family of the list above.
    joined = named.join(F.broadcast(notices), "family", "left")
    def best_of(found: Column) -> Column:
        """The largest share of a notice that the grams hold, with the notice."""
        share = lambda n: F.size(F.array_intersect(n["parts"], found)) / F.size(n["parts"])
        return F.array_max(F.transform("notices", lambda n: F.struct(share(n).alias("share"), n["template"].alias("template"))))

    top = joined.withColumn("top", best_of(F.col("grams")))
    alone = F.array_max(F.transform("parts", lambda x: best_of(grams(x))["share"]))
    spans = sure & (F.col("top.share") >= CONFIRMED) & (alone < CONFIRMED)
    top = top.where(F.col("parts").isNull() | spans)
    return top.select(
        "doc_id", F.col("line").cast("int").alias("line"), "paragraph",
        F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.when(sure, F.col("probability")).otherwise(1 - F.col("probability")).alias("probability"),
        F.when(sure, F.col("top.template")).alias("template"),
        F.when(sure, F.col("top.share")).alias("similarity"),
        (sure & ~F.col("family").isin(*RESERVED) & (F.col("top.share") >= CONFIRMED)).alias("confirmed"),
    )
