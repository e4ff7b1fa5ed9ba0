"""Licence scans: sparse n-gram logistic regression with template confirmation (3).

Column and Spark ML operations only; no Python runs on the executors.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seclake.llm.tables import stored

UNKNOWN = "unknown"

# Names that notices use, by licence family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPL-3.0",
             "GNU Affero General Public License, version 3", "AGPL-3.0-or-later"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0 license",
               "Apache-2.0", "Apache Software License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-3-Clause",
            "BSD-2-Clause", "New BSD License", "Simplified BSD License"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License",
              "CC BY 3.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0",
                 "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0",
                 "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3",
            "GNU General Public License, version 2", "GNU GPL", "GPL", "GPLv3", "GPLv2",
            "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later"],
    "isc": ["ISC License", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPL-2.1", "LGPL-3.0",
             "GNU Lesser General Public License, version 2.1"],
    "mit": ["MIT License", "MIT license", "MIT", "The MIT License", "Expat License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0",
            "MPL-2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
NOTICES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.",
    "Released under the {}.", "This work is licensed under {}.",
    "This work is licensed under the {}.", "This software is distributed under the {}.",
    "Distributed under the terms of the {}.", "Available under the {}.",
    "This project is licensed under the {} - see the LICENSE file for details.",
    "SPDX-License-Identifier: {}", "License: {}",
]
PASSAGES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this "
        "program. If not, see https://www.gnu.org/licenses/"],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": [
        "it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."],
    "cc-by": [
        "You are free to share and adapt the material for any purpose, even commercially, under "
        "the following terms: you must give appropriate credit."],
    "cc-by-nc": ["You may not use the material for commercial purposes."],
    "cc-by-sa": [
        "If you remix, transform, or build upon the material, you must distribute your "
        "contributions under the same license as the original."],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose"],
}
OTHER = [
    "Copyright (c) the authors. All rights reserved.",
    "No part of this publication may be reproduced without the prior permission of the publisher.",
    "The driver's license had expired in May and the officer asked for another document.",
    "Her driving license was renewed by mail.", "A fishing license costs ten dollars a year.",
    "He asked for permission to leave the room.",
    "They were given permission by the council to build a house.",
    "The court heard arguments on copyright law and fair use.",
    "Copyright reform was debated in parliament for years.",
    "The warranty on the washing machine lasts two years.",
    "A license to practise medicine is required in every state.",
    "The company licensed its brand to a toy maker.",
    "This agreement grants the customer a proprietary license to the product for a fee.",
    "The end user license agreement forbids copying.",
    "The new version of the public library opened on Monday.",
    "The apache helicopter landed near the base.", "She studied at MIT before moving abroad.",
    "General public opinion shifted after the speech.",
    "Commons debates went on until the creative minister gave in.",
    "Poetic license allows the author to bend the facts.",
]

PIECE_WORDS = 48
STEP_WORDS = 36
CONFIRM_FROM = 0.6
FEW_RUNS = 4


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _trigrams(words: Column) -> Column:
    whole = F.array(F.array_join(words, " "))
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 2)),
        lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.array_distinct(F.when(F.size(words) >= 3, runs).otherwise(whole))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, line and words of every piece of every paragraph that has a word.

    Paragraphs part at blank lines; line is that of the piece's first word.
    """
    # Lines go with their numbers in front: a paragraph is then cut out as a string.
    numbered = F.array_join(F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(line.rlike(r"[^\s\p{Z}]"), F.concat(i.cast("string"), F.lit(":"), line))
        .otherwise(F.lit(""))), "\n")
    lines = docs.select("doc_id", F.explode(F.split(numbered, "\n\n+")).alias("_paragraph")).select(
        "doc_id", F.transform(F.split("_paragraph", "\n"), tokens).alias("_lines"))
    words = lines.select(
        "doc_id",
        F.flatten(F.transform("_lines", lambda w: F.slice(
            w, 2, F.greatest(F.size(w) - 1, F.lit(0))))).alias("_words"),
        F.flatten(F.transform("_lines", lambda w: F.array_repeat(
            F.get(w, F.lit(0)), F.greatest(F.size(w) - 1, F.lit(0))))).alias("_at"))
    last = F.greatest(F.lit(1), F.size("_words") - PIECE_WORDS + STEP_WORDS)
    pieces = F.transform(F.sequence(F.lit(1), last, F.lit(STEP_WORDS)), lambda i: F.struct(
        F.get("_at", i - 1).cast("int").alias("line"),
        F.slice("_words", i, PIECE_WORDS).alias("words")))
    return words.filter(F.size("_words") > 0).select("doc_id", F.inline(pieces))


def _listed() -> list[tuple[str, str]]:
    rows = [(family, notice.format(name)) for family, names in NAMES.items()
            for name in names for notice in NOTICES]
    rows += [(family, text) for family, texts in PASSAGES.items() for text in texts]
    return rows + [(UNKNOWN, text) for text in OTHER]


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _constant(values: list[str]) -> Column:
    """The values as one array, written as one string: plans stay short."""
    return F.split(F.lit("\n".join(values)), "\n")


def _names_a_licence(words: Column) -> Column:
    """Whether words hold a name of a licence or FEW_RUNS 3-word runs of a passage."""
    names = sorted({" ".join(_words(n)) for listed in NAMES.values() for n in listed})
    runs = sorted({" ".join(w[i:i + 3]) for texts in PASSAGES.values() for text in texts
                   for w in [_words(text)] for i in range(len(w) - 2)})
    shared = F.array_intersect(_trigrams(words), _constant(runs))
    return F.array_join(words, " ").rlike(rf"(?:^| )(?:{'|'.join(names)})(?: |$)") | (
        F.size(shared) >= FEW_RUNS)


def templates(spark: SparkSession) -> DataFrame:
    """family and text of each template: notices from names, passages, and others."""
    row = F.split("row", "\t")
    return spark.range(1).select(F.explode(_constant(
        [f"{family}\t{text}" for family, text in _listed()])).alias("row")).select(
        F.get(row, F.lit(0)).alias("family"), F.get(row, F.lit(1)).alias("text"))


def vocabulary() -> list[str]:
    """Runs of one to three words of the templates, the only ones that tell a licence. A piece
    with none of them is left to the intercepts, so no words of the table need be counted."""
    return sorted({" ".join(w[i:i + n]) for _, text in _listed() for w in [_words(text)]
                   for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def _longer(runs: Column, words: Column, n: int) -> Column:
    """Runs of ``n`` words from those of one less, as NGram gives them."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(runs, 1, count), F.slice(words, n, count),
                      lambda run, word: F.concat(run, F.lit(" "), word))


def _featured(rows: DataFrame) -> DataFrame:
    """Adds _x, which of the vocabulary the words hold.

    Other runs are left out before the counter, which makes an object of each.
    """
    known = vocabulary()
    counter = CountVectorizerModel.from_vocabulary(known, inputCol="_grams", outputCol="_x")
    rows = rows.withColumn("_2", _longer(F.col("words"), F.col("words"), 2))
    grams = F.concat("words", "_2", _longer(F.col("_2"), F.col("words"), 3))
    return counter.setBinary(True).transform(rows.withColumn(
        "_grams", F.filter(grams, lambda gram: gram.isin(known)))).drop("_2", "_grams")


class LicenceModel:
    def __init__(self, model: LogisticRegressionModel, families: list[str], known_from: float):
        self.model, self.families, self.known_from = model, families, known_from

    def classified(self, pieces: DataFrame) -> DataFrame:
        """Adds likely, the most probable family, and family, unknown if the probability is
        below the calibrated one."""
        out = self.model.transform(_featured(pieces))
        names = F.array(*[F.lit(f) for f in self.families])
        chance = F.array_max(vector_to_array("_chance"))
        best = F.element_at(names, F.col("_class").cast("int") + 1)
        return out.select(
            *pieces.columns, chance.alias("probability"), best.alias("likely"),
            F.when(chance >= self.known_from, best).otherwise(F.lit(UNKNOWN)).alias("family"))


def train(docs: DataFrame, other_rows: int = 1_500, false_share: float = 0.01) -> LicenceModel:
    """Fit on the templates and on about ``other_rows`` pieces of the table at most.

    Pieces as licence_scan judges them are examples of the unknown class, licence words or
    not, unless they name a licence or hold part of a passage. Most templates are also put
    between a few words, and between a piece's worth of words, of one of them.

    A first model learns without a fifth of the templates, and without the rows made of them,
    and a fifth of the pieces. On these a family counts as known from the least probability at
    which at most ``false_share`` of what is called known is of another class. The model used
    then learns from all rows.
    """
    spark = docs.sparkSession
    known = templates(spark)
    count = docs.filter("text IS NOT NULL").count()
    share = min(1.0, 3 * other_rows / max(1, count))
    mark = F.pmod(F.xxhash64(F.lit("line"), "text"), F.lit(1 << 20))
    pieces = _judged(docs.filter(mark < int(share * (1 << 20)) + 1)).filter(
        ~_names_a_licence(F.col("words"))).select("words").distinct().withColumn(
        "o", F.xxhash64(F.lit("other"), "words"))
    plain = stored(pieces.orderBy("o", "words").limit(other_rows), "plain")
    slots = max(1, plain.count())
    # Each template beside one piece: slot numbers meet.
    numbered = plain.select("words", F.pmod(F.col("o"), F.lit(slots)).alias("slot")).groupBy(
        "slot").agg(F.min("words").alias("around"))
    fifth = F.pmod(F.xxhash64(F.lit("fifth"), "text"), F.lit(5)) == 0
    rows = plain.select(F.lit(UNKNOWN).alias("family"), "words",
                        (F.pmod(F.xxhash64("words"), F.lit(5)) == 0).alias("later")).union(
        known.select("family", tokens(F.col("text")), fifth))
    for beside in (6, 20):
        wanted = known.withColumn(
            "slot", F.pmod(F.xxhash64("text", F.lit(beside)), F.lit(slots)))
        rows = rows.union(wanted.join(numbered, "slot").select("family", F.concat(
            F.slice("around", 1, beside), tokens(F.col("text")),
            F.slice("around", beside + 1, beside)), fifth))
    families = sorted([*NAMES, UNKNOWN])
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    data = stored(_featured(rows).select("_x", label.cast("double").alias("label"), "later"),
                  "licence-rows").coalesce(4)
    learner = LogisticRegression(
        featuresCol="_x", labelCol="label", predictionCol="_class", probabilityCol="_chance",
        rawPredictionCol="_raw", maxIter=30, regParam=0.002, family="multinomial")
    # A fifth of a bounded sample.
    told = learner.fit(data.filter("NOT later")).transform(data.filter("later")).filter(
        F.col("_class") != families.index(UNKNOWN)).select(
        F.array_max(vector_to_array("_chance")).alias("p"),
        (F.col("_class") != F.col("label")).alias("wrong")).collect()
    return LicenceModel(learner.fit(data), families, _threshold(
        [(r["p"], r["wrong"]) for r in told], false_share))


def _threshold(told: list[tuple[float, bool]], false_share: float) -> float:
    """The least probability at which few enough of those told are wrong, just above
    all if there is none, and a half if nothing was told."""
    told, bad, least = sorted(told, reverse=True), 0, None
    for i, (p, wrong) in enumerate(told):
        bad += wrong
        if (i + 1 == len(told) or told[i + 1][0] < p) and bad <= false_share * (i + 1):
            least = p
    if least is None:
        return math.nextafter(told[0][0], 2.0) if told else 0.5
    return least


def licence_scan(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: LicenceModel | None = None,
) -> DataFrame:
    """doc_id, line (from 0), family, probability, template, similarity and confirmed: a row
    for each paragraph, or piece of a long paragraph, that has a word.

    Paragraphs part at blank lines and their lines are joined, so a notice may be wrapped.
    Each is judged by the model; no list of words decides what it sees. Paragraphs of more
    than PIECE_WORDS words are judged in overlapping pieces; line is that of a piece's start. The most probable family is also
    told below the calibrated probability if the piece holds a template of its whole. A family
    is confirmed if a template of its has at least CONFIRM_FROM of its 3-word runs in the
    piece, or the piece has them in the template. The unknown class has no template and is never confirmed.

    Null and empty texts give no rows. Repeated rows and null ids are scanned each for itself.
    Other columns are not read. No shuffle of texts: templates are a fixed list.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    model = model or train(narrow)
    listed = templates(docs.sparkSession).filter(F.col("family") != UNKNOWN).select(
        "family", F.col("text").alias("template"), _trigrams(tokens(F.col("text"))).alias("grams"))
    # One row per family; the templates are constants of this module.
    listed = listed.groupBy(F.col("family").alias("_family")).agg(
        F.collect_list(F.struct("template", "grams")).alias("_templates"))
    judged = model.classified(_judged(narrow)).withColumn(
        "_own", F.when(F.col("likely") != UNKNOWN, _trigrams(F.col("words"))))

    def likeness(t):
        shared = F.size(F.array_intersect(t.grams, F.col("_own")))
        return F.struct(
            F.greatest(shared / F.size(t.grams), shared / F.size("_own")).alias("similarity"),
            (shared == F.size(t.grams)).alias("whole"),
            F.size(t.grams).alias("runs"), t.template.alias("template"))

    best = F.array_max(F.transform("_templates", likeness))
    joined = judged.join(F.broadcast(listed), F.col("likely") == F.col("_family"), "left")
    known = (F.col("family") != UNKNOWN) | F.coalesce(F.col("_best.whole"), F.lit(False))
    told = joined.withColumn("_best", best).select(
        "doc_id", "line", F.when(known, F.col("likely")).otherwise(F.lit(UNKNOWN)).alias("family"),
        "probability", F.when(known, F.col("_best")).alias("_best"))
    return told.select(
        "doc_id", "line", "family", F.round("probability", 6).alias("probability"),
        F.col("_best.template").alias("template"),
        F.col("_best.similarity").alias("similarity"),
        (F.coalesce(F.col("_best.similarity"), F.lit(0.0)) >= CONFIRM_FROM).alias("confirmed"))
