"""Licence scans: a trained classifier of paragraphs by sparse word n-grams, confirmed against templates.

The main path is DataFrame operations only; the small model is fitted on the driver.
"""

from __future__ import annotations

import json
import re
import textwrap
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_texts, documents, materialize

#: n-grams of one to so many words; documents from which paragraphs without licences are learned.
LONGEST = 3
BACKGROUND_DOCS = 300
BACKGROUND_LINES = 400
L1 = 2e-4
#: Lines before and behind a line, next to it and with anchor words too, that a template may run over.
WRAP = 3
#: The width at which the bodies of licences are taken to be broken.
COLUMNS = 79
#: The share of a template's n-grams that a paragraph must have to confirm a family.
CONFIRM = 0.6

# Names and phrases of common licences.
FAMILIES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License", "You may not use this file except in compliance with the License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GPL v3", "GPL-3.0", "GPL-2.0", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU Library General Public License", "LGPL v3", "LGPL-2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL v3", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "EPL": ["Eclipse Public License, version 2.0", "Eclipse Public License", "EPL 2.0", "EPL-2.0"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "CC-BY-3.0", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "CC-BY-SA"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0", "CC-BY-NC"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 3.0", "CC-BY-ND"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal public domain dedication", "dedicated to the public domain"],
    "Unlicense": ["The Unlicense", "This is free and unencumbered software released into the public domain"],
    "Proprietary": ["All rights reserved", "Proprietary and confidential", "Unauthorized copying of this file is strictly prohibited"],
}
# Paragraphs of licence texts and notices by which a family is known without its name.
BODIES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain worldwide"],
    "Unlicense": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# How statements are worded, licences outside the families, and look-alikes that are none.
WORDINGS = [
    "{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.",
    "This work is licensed under {}.", "This program is distributed under the terms of the {}.", "Available under the {}.", "SPDX-License-Identifier: {}",
    "The code is published under {}, see the LICENSE file.", "Copyright 2019 the authors. Use is governed by the {}.", "Dieses Werk steht unter der Lizenz {}.", "Ce texte est sous licence {}.",
]
OTHER = ["Boost Software License 1.0", "Artistic License 2.0", "Zlib License", "Open Font License", "Academic Free License", "Microsoft Reciprocal License", "our own license", "the usual license terms", "Python Software Foundation License", "X11 terms"]
NONE = [
    "his driving license was revoked", "a license to print money", "the license plate of the car", "the public library is open", "the general public was invited", "you may use this door",
    "see the version of the story", "the work of the committee is free", "the mit campus in spring", "an apache helicopter landed", "released under pressure from the public", "published under another name",
    "all of the rights of the people", "the terms of the treaty", "copyright law is a subject of study", "a work of art under restoration", "the foundation was laid under the old church", "version 2.0 of the plan",
    "a general statement to the public", "under the bridge", "the program is distributed to viewers", "this is the software of the future", "free of charge for any person", "in source and in style",
]

STOP = (
    "a all an any are by charge copy documentation fee files font for forms free from general in international into is it library of on open or our own "
    "person public purpose see software source strictly that the their this to use used usual version was with without you your"
).split()

_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
UNKNOWN, ANY = "unknown", "any"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def grams(text: str) -> set[str]:
    words = tokens(text)
    return {" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    """``weights``: (n-gram, class) to weight; ``bias`` and calibration by class; words of which a licence has one at least."""

    weights: dict[tuple[str, str], float]
    bias: dict[str, float]
    slope: float
    shift: float
    anchors: list[str]

    def probability(self, text: str) -> dict[str, float]:
        """The plain reading of the model, for comparison."""
        have = grams(text)
        z = dict(self.bias)
        for (gram, family), w in self.weights.items():
            if gram in have:
                z[family] += w
        return {f: 1 / (1 + np.exp(-(self.slope * v + self.shift))) for f, v in z.items()}


def sparse_logistic(x: np.ndarray, y: np.ndarray, l1: float = L1, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression a column of ``y``, with an L1 penalty, by accelerated proximal gradients."""
    n = len(x)
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.full(y.shape[1], -2.0, np.float32)
    v, u, t = w.copy(), b.copy(), np.float32(1.0)
    # the largest curvature, by power iteration
    d = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        d = x.T @ (x @ (d / np.linalg.norm(d)))
    step = np.float32(3.0 / (np.linalg.norm(d) / n + 1.0))
    for _ in range(rounds):
        residual = (1 / (1 + np.exp(-(x @ v + u))) - y) / n
        new = v - step * (x.T @ residual)
        new = np.sign(new) * np.maximum(np.abs(new) - step * np.float32(l1), 0)
        newer = u - step * residual.sum(axis=0)
        again = np.float32((1 + np.sqrt(1 + 4 * t * t)) / 2)
        v, u = new + (t - 1) / again * (new - w), newer + (t - 1) / again * (newer - b)
        w, b, t = new, newer, again
    return w, b


def common_words(background: list[str]) -> set[str]:
    """Words that make no feature by themselves or among themselves: those of plain paragraphs and of the wordings, numbers, single letters."""
    plain = set(STOP) | {w for t in (*background, *(x.replace("{}", "") for x in WORDINGS)) for w in tokens(t)}
    return {w for w in plain if not re.match("licen[cs]|copyright|lizenz|spdx|identifier", w)}


def is_common(word: str, common: set[str]) -> bool:
    return word in common or len(word) == 1 or not any(c.isalpha() for c in word)


def anchor_words(weights: dict[tuple[str, str], float], common: set[str]) -> list[str]:
    """Words of which a paragraph must contain one to have any feature that speaks for a class."""
    return sorted({w for (g, _), v in weights.items() if v > 0 for w in g.split() if not is_common(w, common)})


def fit(background: list[str]) -> Model:
    """Learn from wordings of the families, of other licences and of none, and from paragraphs of the corpus.

    A class ``any`` tells licences from all else; with it, but without a
    family, a paragraph is of the class unknown.  Every fifth name of a licence,
    in all its wordings, and every fifth other paragraph are left out of the
    regression and serve to calibrate the probabilities, so that these are of
    names that the model has not seen.
    """
    texts, labels, groups = [], [], []
    for family, names in FAMILIES.items():
        for n, name in enumerate([*names, *BODIES.get(family, [])]):
            for k, wording in enumerate(WORDINGS):
                if k and len(tokens(name)) > 9:
                    break
                texts.append(wording.format(name) if n < len(names) else name)
                labels.append(family)
                groups.append(n)
            # a body's lines as they stand in files, and the whole as often as a name has wordings
            lines = [line for line in textwrap.wrap(name, COLUMNS) if len(tokens(line)) >= 8] + [name] * 4 if n >= len(names) else []
            texts += lines
            labels += [family] * len(lines)
            groups += [n] * len(lines)
    for n, name in enumerate(OTHER):
        for wording in WORDINGS[1:]:
            texts.append(wording.format(name))
            labels.append(UNKNOWN)
            groups.append(n)
    clean = [t for t in background if not re.search(r"licen[cs]|copyright|lizenz|\bgpl\b|creative commons|all rights", t, re.I)]
    # lines of licence texts without such words are no plain paragraphs either
    bodies = [grams(" ".join(paragraphs)) for paragraphs in BODIES.values()]
    clean = [t for t in clean if not any(2 * len(g & body) > len(g) for g in [grams(t)] for body in bodies)][:BACKGROUND_LINES]
    common = common_words(clean)
    known = {g for t in texts for g in grams(t) if not all(is_common(w, common) for w in g.split())}
    for n, text in enumerate(NONE + NONE + clean):
        texts.append(text)
        labels.append("")
        groups.append(n)
    vocabulary = sorted(known)
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, text in enumerate(texts):
        x[i, [place[g] for g in grams(text) if g in place]] = 1
    classes = [*FAMILIES, ANY]
    y = np.array([[float(label == c or (c == ANY and label != "")) for c in classes] for label in labels])
    held = np.array(groups) % 5 == 4
    w, b = sparse_logistic(x[~held], y[~held])
    # calibration: one slope and shift for all classes, by Newton steps on the texts left out
    z, target = (x[held] @ w + b).ravel(), y[held].ravel()
    slope, shift = 1.0, 0.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        gradient = np.array([((p - target) * z).sum() + 0.1 * (slope - 1), (p - target).sum() + 0.1 * shift])
        q = p * (1 - p)
        curve = np.array([[(q * z * z).sum() + 0.1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        change = np.linalg.solve(curve, gradient)
        slope, shift = slope - change[0], shift - change[1]
    slope = max(slope, 0.1)
    weights = {(vocabulary[i], classes[k]): float(round(w[i, k], 6)) for i, k in zip(*np.nonzero(np.abs(w) > 1e-6))}
    bias = {c: float(round(v, 6)) for c, v in zip(classes, b)}
    return Model(weights, bias, float(slope), float(shift), anchor_words(weights, common))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table out of a literal, without leaving the engine's own expressions."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _any_word(text: Column, words: list[str]) -> Column:
    """Whether a text has any of the words in any case: long ones as strings, short ones between non-letters.

    The text is put in lower case once, bound by an array of one, not once a word.
    """
    long = [w for w in words if len(w) > 4]
    short = [w for w in words if len(w) <= 4]

    def found(low: Column) -> Column:
        out = F.lit(False)
        for word in long:
            if not any(o != word and o in word for o in long):
                out = out | F.contains(low, F.lit(word))
        if short:
            out = out | F.rlike(low, F.lit(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])"))
        return out

    return F.element_at(F.transform(F.array(F.lower(text)), found), 1)


def scan(docs: DataFrame, model: Model, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed, statement): each paragraph that states a licence.

    Paragraphs are lines; a line's features are its distinct n-grams of one to
    three words.  Lines without any anchor word cannot reach the threshold and
    are left early; the rest meet the model's table of weights.  The family is
    the most probable one, of probability 1/2 at least; where only the class
    ``any`` passes, it is unknown.  template_share is the largest share of a
    template of that family (a name, or a paragraph of a licence's text) whose
    n-grams the line has, or the line with up to ``WRAP`` lines with anchor
    words on either side, over which a statement may be broken; ``confirm`` of
    it confirms the family (an unknown licence is never confirmed).

    Null and empty texts have no rows; repeated rows come out as often; an
    empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    hits = rows.where(_any_word(F.col("text"), model.anchors)).withColumn("row_no", F.monotonically_increasing_id())
    lines = hits.select("doc_id", "row_no", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where(_any_word(F.col("line"), model.anchors))
    words = F.regexp_extract_all(F.lower("line"), F.lit(_TOKEN), F.lit(0))
    lines = lines.select("doc_id", "row_no", "paragraph", F.col("line").alias("statement"), words.alias("words")).where(F.size("words") > 0)
    # lines next to one another, out of those with anchor words, for the templates
    order = Window.partitionBy("row_no").orderBy("paragraph")
    none = F.array().cast("array<string>")
    beside = [F.when(F.lag("paragraph", k).over(order) == F.col("paragraph") - k, F.lag("words", k).over(order)).otherwise(none) for k in range(WRAP, -WRAP - 1, -1)]
    lines = materialize(lines.withColumn("near", F.concat(*beside)), "lines")

    def runs(words: str) -> Column:
        def of(n: int) -> Column:
            last = F.size(words) - (n - 1)
            return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(none)

        return F.array_distinct(F.concat(*[of(n) for n in range(1, LONGEST + 1)]))

    # only n-grams that the model or a template knows need to be told apart
    templates = [(f"{f}-{k}", f, sorted(grams(t))) for f, names in FAMILIES.items() for k, t in enumerate([*names, *BODIES.get(f, [])])]
    scores: dict[str, list] = {}
    for (g, family), w in model.weights.items():
        scores.setdefault(g, []).append({"class": family, "weight": w})
    shares: dict[str, list] = {}
    for name, family, parts in templates:
        for g in parts:
            shares.setdefault(g, []).append({"template": name, "family": family, "share": 1.0 / len(parts)})
    weighed = _table(spark, [{"known": g, "scores": x} for g, x in sorted(scores.items())], "known string, scores array<struct<class: string, weight: double>>")
    shared = _table(spark, [{"known": g, "templates": x} for g, x in sorted(shares.items())], "known string, templates array<struct<template: string, family: string, share: double>>")
    keys = ["row_no", "paragraph"]
    gram = lambda words, table: lines.select(*keys, F.explode(runs(words)).alias("gram")).join(F.broadcast(table), F.col("gram") == F.col("known"))
    scored = gram("words", weighed).select(*keys, F.explode("scores").alias("s")).groupBy(*keys, F.col("s.class").alias("class")).agg(F.sum("s.weight").alias("z"))
    bias = F.create_map(*[F.lit(x) for c, v in model.bias.items() for x in (c, v)])
    logit = F.round(F.lit(model.slope) * (F.col("z") + F.element_at(bias, F.col("class"))) + F.lit(model.shift), 9)
    p = F.round(1 / (1 + F.exp(-logit)), 6)
    best = F.max(F.when(F.col("class") != ANY, F.struct(p.alias("p"), F.col("class").alias("family"))))
    judged = scored.groupBy(*keys).agg(best.alias("best"), F.max(F.when(F.col("class") == ANY, p)).alias("any"))
    named = judged.where((F.col("best.p") >= 0.5) | (F.col("any") >= 0.5))
    named = named.withColumn("family", F.when(F.col("best.p") >= 0.5, F.col("best.family")).otherwise(F.lit(UNKNOWN)))
    named = named.withColumn("probability", F.when(F.col("best.p") >= 0.5, F.col("best.p")).otherwise(F.col("any")))
    named = named.select(*keys, "family", "probability")
    covered = gram("near", shared).select(*keys, F.explode("templates").alias("t")).groupBy(*keys, "t.template", "t.family").agg(F.sum("t.share").alias("share"))
    covered = covered.groupBy(F.col("row_no").alias("of_row"), F.col("paragraph").alias("of_paragraph"), F.col("family").alias("of_family")).agg(F.round(F.max("share"), 6).alias("template_share"))
    same = (F.col("row_no") == F.col("of_row")) & (F.col("paragraph") == F.col("of_paragraph")) & (F.col("family") == F.col("of_family"))
    stated = lines.select("doc_id", F.col("row_no").alias("line_row"), F.col("paragraph").alias("line_paragraph"), "statement")
    named = named.join(stated, (named["row_no"] == stated["line_row"]) & (named["paragraph"] == stated["line_paragraph"]))
    share = F.coalesce("template_share", F.lit(0.0))
    return named.join(covered, same, "left").select("doc_id", "paragraph", "family", "probability", share.alias("template_share"), (share >= confirm).alias("confirmed"), "statement")


def learn(docs: DataFrame, each: int = BACKGROUND_DOCS) -> Model:
    """The model, with paragraphs of up to ``each`` documents as examples of what is no licence."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lit("").alias("all"))
    rows = bounded_texts(docs, ids, "all", each)
    return fit([line for r in rows for line in (r.text or "").split("\n") if tokens(line)])


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, learn(docs))


SQL: str | None = None
