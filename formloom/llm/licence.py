"""Licence scans: a logistic regression over word n-grams names each passage's licence family; templates confirm it.

Every paragraph of every text is read, in its sentences and in windows of long ones; nothing is sorted out beforehand. The
classifier is trained on the templates below, on notices built from names and phrases, and on ordinary sentences (the
unknown class); its scores are calibrated on notices and sentences held out. Training and scoring use DataFrames and
pyspark.ml; no Python runs on the executors.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import table, text_of

UNKNOWN = "unknown"
#: What public licences and their notices say.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "You are free to share, copy and redistribute the material in any medium or format and to adapt, remix, transform, and build upon the material for any purpose, even commercially. You must give appropriate credit.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "You may not use the material for commercial purposes under the terms of the Creative Commons NonCommercial license.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "The accompanying materials are provided under the terms of this Eclipse Public License. Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}
#: Names by which notices call the families.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license", "Apache-2.0", "the Apache Software License", "version 2.0 of the Apache License"],
    "mit": ["the MIT License", "the MIT license", "the MIT licence", "MIT", "the Expat License", "an MIT-style license", "the terms of the MIT license", "the X11 MIT License"],
    "gpl": ["the GNU General Public License", "the GNU General Public License, version 3", "the GNU General Public License v2", "the GPL version 3", "the GPL", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "the GNU GPL", "the GNU GPL v3"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License, version 2.1", "the LGPL", "LGPLv3", "LGPL-2.1-or-later", "the GNU LGPL"],
    "bsd": ["the BSD License", "the 3-Clause BSD License", "the BSD 3-Clause License", "BSD-3-Clause", "the 2-clause BSD license", "the simplified BSD license", "the new BSD license", "BSD-2-Clause"],
    "mpl-2.0": ["the Mozilla Public License", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0", "the MPL 2.0", "the MPL"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution license", "CC BY 3.0", "Creative Commons Attribution 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 License", "the Creative Commons Attribution-ShareAlike license", "CC BY-SA 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 License", "the Creative Commons Attribution-NonCommercial license", "CC BY-NC 3.0"],
    "agpl": ["the GNU Affero General Public License", "the GNU Affero General Public License, version 3", "the AGPL", "the GNU AGPL v3", "AGPLv3", "AGPL-3.0-or-later", "the Affero GPL"],
    "epl-2.0": ["the Eclipse Public License", "the Eclipse Public License 2.0", "EPL-2.0", "the Eclipse Public License, version 2.0", "the EPL", "the EPL 2.0"],
    "isc": ["the ISC License", "the ISC license", "ISC", "the terms of the ISC license", "an ISC-style license"],
    "zlib": ["the zlib License", "the zlib license", "Zlib", "the zlib/libpng license", "the terms of the zlib license"],
    "public-domain": ["CC0", "CC0-1.0", "CC0 1.0 Universal", "the Unlicense", "the CC0 public domain dedication"],
}
#: Phrases that notices are built of, and those by which ordinary sentences speak of the same names.
PHRASES = [
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "This project is licensed under {}.", "This work is licensed under {}.", "The code is available under {}.", "This software is released under the terms of {}.",
    "All files in this repository are covered by {}.", "Published under {}, see the file LICENSE.", "SPDX-License-Identifier: {}", "License: {}", "You may use this package under {}.", "Made available under {} by its authors.", "Dual licensed under {}.",
    "Lizenziert unter {}.", "Veröffentlicht unter {}.", "Sous licence {}.", "Publié sous {}.", "Publicado bajo {}.", "Con licencia {}.",
    "Dieses Werk steht unter {}.", "Diese Software ist unter {} lizenziert.", "Ce logiciel est distribué sous {}.", "Cette œuvre est placée sous {}.", "Este software se distribuye bajo {}.", "Esta obra está bajo {}.",
    "The contents of this folder may be used under {}.", "Copyright by the authors, {}.", "Subject to {}.", "Use is governed by {}.",
]
#: Phrases and names (by their places above) that are held out whole, the plainest phrases among them: nothing that is built with
#: them is trained on, and what is held out is built of both, so calibration meets names and phrases that it never saw.
HELD_PHRASES, HELD_NAME = (0, 1, 4, 7, 11, 15, 18, 22, 26), 3
#: What stands right before a name in a notice; with a name it is a template of its own.
BEFORE_NAMES = ["under {}", "license {}", "identifier {}"]
ORDINARY_PHRASES = ["We compared {} with other choices in the meeting.", "The history of {} is told in chapter two.", "She wrote an essay about {} last year.", "Questions about {} came up in court."]
#: Sentences of the unknown class: they share words with notices but grant nothing.
ORDINARY = [
    "The driver renewed the license of the car before the end of the year.", "A fishing license is required at the lake from May to October.", "The court heard a case about copyright and the price of a song.",
    "All rights reserved by the hotel management for late arrivals.", "She asked for permission to use the library after hours.", "The general public was free to enter the work site in version of the plan.",
    "He released the bird under the old bridge and the terms of the bet were met.", "The foundation published a list of its contributors and their work.", "The software team met the conditions and retained the source of the error.",
    "The commons are open; creative people share the material there.", "Free copies of the map are distributed at the station, with or without charge.", "The warranty of the pump covers parts for two years from purchase.",
    "Copyright law was changed by the parliament in the spring.", "Her driving license was issued in version two of the form.", "Public domain films are shown in the hall on Sundays.", "The apache helicopter landed at the base under heavy rain.",
    "Students at MIT released a study of the wind.", "The weather in the north was cold and the roads were closed.", "In this chapter the author describes the work of the mill.", "Bread is made from flour, water, salt and time.",
    "The modified plan was used in the second year of the program.", "Licensed premises must close at midnight in this town.", "The version of events that the witness gave was not the same.", "Any person who received a letter should return it to the office.",
    "This is the file that you may use to see the other work.", "You should have received the parcel along with this letter.", "The following conditions are found at the coast in winter.", "To view a copy of the painting, visit the museum.",
    "Der Vertrag wurde unter den Bedingungen des Gerichts geschlossen.", "Die Lizenz der Brauerei wurde im Mai erneuert.", "La licence du bar a été retirée par la ville.", "Le livre a été publié sous un autre nom.", "La licencia de pesca se renueva cada año.", "El libro fue publicado bajo otro nombre.",
]
#: Words of the windows that longer sentences are cut into; each begins half a window after the one before.
WINDOW = 32
#: Share of the smaller one's word pairs, of passage and template, that both must have to confirm a prediction.
CONFIRMED = 0.5
#: A calibrated score from which a passage is believed to be a notice.
BELIEVED = 0.5


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _sentences(family: str) -> list[str]:
    """A family's templates, whole and by sentences."""
    return [s for s in [*(s for t in TEMPLATES[family] for s in re.split(r"(?<=[.!?])\s+", t)), *TEMPLATES[family]] if len(_words(s)) >= 3]


def _templates(family: str) -> list[str]:
    """What confirms a family: its templates' sentences, and its names after what stands before them in notices."""
    return [*_sentences(family), *(p.format(n) for p in BEFORE_NAMES for n in NAMES[family])]


def training_rows() -> list[tuple[str, str, bool]]:
    """(text, family, held out): sentences and parts of templates, notices built of phrases and names, ordinary sentences, and words of
    notices backwards, which are unknown. Whole phrases and whole names are held out: a row is trained on if it has neither, held
    out if it has both, and left out otherwise; so is a quarter of the ordinary sentences."""
    rows: set[tuple[str, str, bool]] = set()
    for family in TEMPLATES:
        for n, text in enumerate(_sentences(family)):
            words = text.split()
            rows |= {(text, family, False), (" ".join(words[: len(words) * 2 // 3]), family, False), (" ".join(words[len(words) // 3 :]), family, False)} if len(words) > 8 else {(text, family, False)}
            rows.add((" ".join(reversed(words)), UNKNOWN, n % 4 == 3))
        for i, name in enumerate(NAMES[family]):
            held = i == HELD_NAME
            rows |= {(phrase.format(name), family, held) for n, phrase in enumerate(PHRASES) if (n in HELD_PHRASES) == held}
            rows |= {(phrase.format(name), UNKNOWN, held) for n, phrase in enumerate(ORDINARY_PHRASES) if (n == 3) == held}
            rows |= {(" ".join(reversed(phrase.format(name).split())), UNKNOWN, held) for n, phrase in enumerate(PHRASES[:12]) if (n in HELD_PHRASES) == held}
    for n, text in enumerate(ORDINARY):
        words = text.split()
        rows |= {(form, UNKNOWN, n % 4 == 3) for form in (text, " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :]))}
    trained = {text for text, _, held in rows if not held}  # sentences that two families share are trained on
    return sorted(r for r in rows if not (r[2] and r[0] in trained))


class LicenceModel:
    """Trained stages, family names by label, and the calibration of the margin between notice and unknown."""

    def __init__(self, stages: PipelineModel, families: list[str], slope: float, shift: float):
        self.stages, self.families, self.slope, self.shift = stages, families, slope, shift

    def scores(self, passages: DataFrame, text: str, least: float = 0.0) -> DataFrame:
        """passages with `family` (the likeliest one but unknown) and `score`, the calibrated probability that the passage
        is a notice, where that is `least` or more. Working columns begin with ml_; passages must not have them."""
        scored = self.stages.transform(passages.withColumn("ml_grams", _grams(F.col(text))))
        # The bound stands as a probability before calibration: what is filtered by refers to the classifier once.
        found = scored.where(F.get(vector_to_array("ml_probability"), F.lit(0)) <= self._most_unknown(least)).withColumn("ml_p", vector_to_array("ml_probability"))
        known = F.slice("ml_p", 2, len(self.families))
        family = F.element_at(F.array(*(F.lit(f) for f in self.families[1:])), F.array_position(known, F.array_max(known)).cast("int"))
        score = 1 / (1 + F.exp(-(self.slope * _margin(F.get("ml_p", F.lit(0))) + self.shift)))
        return found.withColumn("family", family).withColumn("score", score).drop("ml_grams", "ml_counts", "ml_raw", "ml_probability", "ml_label", "ml_p")

    def _most_unknown(self, score: float) -> float:
        """The probability of the unknown class at which the calibrated score is `score`."""
        if not 0 < score < 1 or self.slope <= 0:
            return 1.0
        return 1 / (1 + math.exp((math.log(score / (1 - score)) - self.shift) / self.slope))


def _margin(unknown: Column) -> Column:
    """Log odds of being a notice."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), unknown))
    return F.log((1 - p) / p)


def _bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _grams(text: Column) -> Column:
    """The words of a text (letters and digits of ASCII, lower case) and its pairs of neighbours."""
    words = F.split(F.lower(text), "[^a-z0-9]++")
    return F.get(F.transform(F.array(words), lambda w: F.concat(w, _bigrams(w))), F.lit(0))


def train(spark: SparkSession) -> LicenceModel:
    """Fits on the rows that aren't held out and calibrates on those that are, the only ones it sees. A Platt scaling takes the log odds of being a notice to the probability that the family is right."""
    families = [UNKNOWN, *TEMPLATES]
    values = [(t, float(families.index(f)), f, h, 3.0 if f == UNKNOWN else 1.0) for t, f, h in training_rows()]
    rows = spark.createDataFrame(values, "piece string, label double, truth string, held boolean, weight double").coalesce(1).withColumn("ml_grams", _grams(F.col("piece")))
    stages = Pipeline(stages=[
        CountVectorizer(inputCol="ml_grams", outputCol="ml_counts", binary=True),
        LogisticRegression(featuresCol="ml_counts", labelCol="label", weightCol="weight", family="multinomial", regParam=0.001, probabilityCol="ml_probability", rawPredictionCol="ml_raw", predictionCol="ml_label", maxIter=80),
    ]).fit(rows.where("NOT held"))
    raw = LicenceModel(stages, families, 1.0, 0.0)
    held = raw.scores(rows.where("held").select("piece", "truth"), "piece").select((F.col("truth") == F.col("family")).cast("double").alias("right"), F.log(F.col("score") / (1 - F.col("score"))).alias("margin"))
    platt = LogisticRegression(featuresCol="x", labelCol="right", regParam=0.001, maxIter=50).fit(VectorAssembler(inputCols=["margin"], outputCol="x").transform(held))
    return LicenceModel(stages, families, float(platt.coefficients[0]), float(platt.intercept))


@functools.lru_cache(maxsize=4)
def _trained(app: str) -> LicenceModel:
    return train(SparkSession.getActiveSession())


def _passages(paragraph: Column) -> Column:
    """Sentences of a paragraph, wherever its lines break; those of more than WINDOW words as windows that overlap by half."""

    def cut(sentence: Column) -> Column:
        words = F.split(sentence, r"\s+")
        starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))
        windows = F.transform(F.array(words), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, WINDOW), " ")))
        return F.when(F.regexp_count(sentence, F.lit(r"\s+")) < WINDOW, F.array(sentence)).otherwise(F.get(windows, F.lit(0)))

    return F.flatten(F.transform(F.split(paragraph, r"(?<=[.;!?])\s+"), cut))


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, paragraph, family, score, overlap, confirmed): a row for each paragraph and family that the model finds in
    one of its passages.

    Paragraphs are what blank lines part, numbered from 0; passages are their sentences, and windows of long ones, so that
    a notice is found whatever stands beside it and however its lines break. Every passage is scored; where the calibrated
    score is below BELIEVED it belongs to the unknown class and has no row. overlap is the largest share of word pairs that
    a passage and a template of the family have in common, of the smaller one's; from CONFIRMED the prediction is
    confirmed. Null and empty texts have no notices; repeated rows repeat their results; an empty table gives an empty
    result. Only doc_id and text are read, so other columns can't clash.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    paragraphs = rows.select("row", "doc_id", F.posexplode(F.split("text", r"\n[^\S\n]*\n")).alias("paragraph", "body"))
    found = model.scores(paragraphs.select("row", "doc_id", "paragraph", F.explode(_passages(F.col("body"))).alias("piece")), "piece", BELIEVED)
    pairs = {f: sorted({tuple(sorted({f"{a} {b}" for a, b in zip(_words(t), _words(t)[1:])})) for t in _templates(f)}) for f in TEMPLATES}
    templates = F.element_at(F.create_map(*(x for f, ts in pairs.items() for x in (F.lit(f), F.array(*(F.array(*(F.lit(p) for p in ps)) for ps in ts))))), F.col("family"))
    own = F.array_distinct(_bigrams(F.regexp_extract_all(F.lower("piece"), F.lit("[a-z0-9]+"), F.lit(0))))
    found = found.withColumn("pairs", own).withColumn("templates", templates)
    overlap = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(F.col("pairs"), t)) / F.greatest(F.least(F.size(t), F.size("pairs")), F.lit(2))))
    each = found.select("row", "doc_id", "paragraph", "family", "score", overlap.alias("overlap")).groupBy("row", "doc_id", "paragraph", "family").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"))
    return each.select("doc_id", "paragraph", "family", "score", "overlap", (F.col("overlap") >= CONFIRMED).alias("confirmed"))


def licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row per doc_id: n_notices (confirmed paragraphs, once for each family), families (distinct confirmed ones,
    sorted, joined by commas; empty if none), n_unconfirmed. Null ids are one id; an empty table gives an empty result;
    other columns aren't read."""
    by_doc = scan(docs, model).groupBy("doc_id").agg(
        F.count(F.when(F.col("confirmed"), 1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("f"), F.count(F.when(~F.col("confirmed"), 1)).alias("u")
    )
    other = by_doc.withColumnRenamed("doc_id", "found_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return docs.select("doc_id").distinct().join(other, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select("doc_id", zero("n").alias("n_notices"), F.coalesce("f", F.lit("")).alias("families"), zero("u").alias("n_unconfirmed"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed licence families of all documents."""
    return licences(table(spark, sf_dir, "documents"), _trained(spark.sparkContext.applicationId))
