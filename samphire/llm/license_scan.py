"""Licence families of paragraphs: sparse word n-gram logistic regression, confirmed by comparison with templates.

The model is fitted on the driver from short notices of each family. It goes to
the executors as a table of n-grams, so that the scan is made of joins and
aggregates alone. A paragraph without any word of that table has no evidence
for a family: it is of the unknown class without being scored.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samphire.llm.common import hash_sample

UNKNOWN = "unknown"
#: Notices by which works name their licence, by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL-3.0 license.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain under CC0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or at your option any later version",
        "Licensed under the GPL, version 3 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "reserved": ["All rights reserved.", "Copyright, all rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved."],
}
#: Ordinary uses of licence words, for the unknown class.
OTHER = [
    "He lost his driving licence in the spring.",
    "The driver's license was renewed by the office.",
    "Permission to land was granted by the tower.",
    "The apache rode across the plain.",
    "She studied at MIT and moved to Boston.",
    "The public was not allowed in without a license to fish.",
    "All seats are reserved for the guests of the hotel.",
    "The general read the public letter, version three of it.",
    "Commons and lords met to discuss the creative proposal.",
    "The software was free of charge for any person at the fair.",
    "The terms of the contract were published by the foundation.",
    "Copyright law is taught in the second year.",
]
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
ORDER = 3


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower(), re.ASCII)


def grams(tokens: list[str]) -> list[str]:
    """Distinct n-grams of 1 to ORDER words."""
    return sorted({" ".join(tokens[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(tokens) - n + 1)})


class LicenseModel:
    """Families, n-gram weights (grams by class; the last class is unknown), intercepts, temperature and template n-grams."""

    def __init__(self, families, features, weights, bias, temperature, templates):
        self.families, self.features, self.weights, self.bias = families, features, weights, bias
        self.temperature, self.templates = temperature, templates

    def judge(self, text: str, threshold: float = 0.5, overlap: float = 0.5) -> tuple[str, float, float]:
        """(family, probability, template overlap) of a paragraph; for tests of the distributed form."""
        own = grams(words(text))
        at = [self.features[g] for g in own if g in self.features]
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p[:-1].argmax())
        near = max((len(t & set(own)) / len(t) for f, t in self.templates if f == self.families[k]), default=0.0)
        good = bool(at) and p[k] >= threshold and near >= overlap
        return (self.families[k] if good else UNKNOWN), float(p[k]), near


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 400, variants: int = 24, seed: int = 3) -> LicenseModel:
    """Fit on the driver: notices with words left out and corpus words around them, against corpus paragraphs.

    The corpus gives at most ``sample_rows`` whole documents (a bounded sample). Words of more than 1 in 200 of its
    paragraphs that name no licence are ordinary: an n-gram of ordinary words alone is no feature. Half of the variants
    fit the weights, the other half the temperature that calibrates the probabilities, the unknown class's among them.
    An empty corpus leaves the fixed notices alone.
    """
    rng = random.Random(seed)
    lines = [x for text in hash_sample(docs, text_col, sample_rows) for x in text.split("\n")]
    own = set().union(*(words(t) for notices in TEMPLATES.values() for t in notices))
    plain = [tokens for x in lines if (tokens := words(x)) and not {"license", "licensed", "reserved", "copyright", "permission"} & set(tokens)]
    spread: dict[str, int] = {}
    for tokens in plain:
        for w in own.intersection(tokens):
            spread[w] = spread.get(w, 0) + 1
    common = {"the", "of", "and", "to", "in", "is", "a", "or", "at", "it", "by", "as", "for", "this", "any", "that", "with", "not", "on", "are", "be", "you", "may", "use", "if", "no", "can", "has", "all", "from", "under", "1.0", "2", "3", "2.0", "2.1", "4.0", "v"}
    ordinary = common | {w for w, n in spread.items() if n > max(2, len(plain) / 200)}
    families = sorted(TEMPLATES)
    made: list[tuple[list[str], int]] = []
    filler = [t[:20] for t in plain] or [["lorem", "ipsum"]]
    for k, family in enumerate(families):
        for notice in TEMPLATES[family]:
            base = words(notice)
            made += [(base, k)] * 4
            for _ in range(variants):
                kept = [w for w in base if rng.random() > 0.08] or base
                around = rng.choice([[], rng.choice(filler), rng.choice(filler) + rng.choice(filler)])
                cut = rng.randint(0, len(around))
                made.append((around[:cut] + kept + around[cut:], k))
    unknown = len(families)
    made += [(words(x), unknown) for x in OTHER for _ in range(variants)]
    made += [(t, unknown) for t in (rng.sample(plain, min(len(plain), 1000)) if plain else [])]
    # single words of notices, out of their context, name no family
    singles = sorted(own - ordinary)
    made += [(rng.choice(filler)[:8] + [rng.choice(singles)], unknown) for _ in range(1000)]
    rng.shuffle(made)
    names = sorted({g for notices in TEMPLATES.values() for t in notices for g in grams(words(t)) if set(g.split()) - ordinary})
    features = {g: i for i, g in enumerate(names)}
    rows = [[features[g] for g in grams(t) if g in features] for t, _ in made]
    y = np.array([k for _, k in made])
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    half = len(rows) // 2
    weights, bias = _logistic(x[:half], y[:half], unknown + 1)
    z = x[half:] @ weights + bias
    loss = {t: float(-_log_softmax(z / t)[np.arange(len(z)), y[half:]].mean()) for t in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)}
    templates = [(f, {g for g in grams(words(t)) if g in features}) for f in families for t in TEMPLATES[f]]
    return LicenseModel(families, features, weights, bias, min(loss, key=loss.get), templates)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _logistic(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 120, l1: float = 2e-5, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with an l1 penalty, by AdaGrad with proximal steps."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    gw, gb = np.full(w.shape, 1e-8), np.full(classes, 1e-8)
    target = np.eye(classes)[y]
    for _ in range(rounds):
        g = (np.exp(_log_softmax(x @ w + b)) - target) / len(x)
        dw, db = x.T @ g, g.sum(axis=0)
        gw, gb = gw + dw**2, gb + db**2
        step = rate / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = b - rate / np.sqrt(gb) * db
    return w, b


def _trie(strings: list[str]) -> str:
    """A regular expression of the strings that tries each first character once."""
    if strings == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for s in strings:
        heads.setdefault(s[:1], []).append(s[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items()) if c]
    return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or "" in heads else parts[0]) + ("?+" if "" in heads else "")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


#: Bits of each of the three counts that a sum of a notice's worths holds.
_COUNT = 20


def _worths(model: LicenseModel) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """(worth of each n-gram for each notice, totals of each notice): counts of all its n-grams, those of no other family's
    notices, and its longest, packed into one number."""
    others = [set().union(*(t for f, t in model.templates if f != family)) for family, _ in model.templates]
    most = [max((len(g.split()) for g in t), default=0) for _, t in model.templates]
    kinds = lambda g, j: (1, int(g not in others[j]), int(len(g.split()) == most[j]))
    worths = [[sum(n << (_COUNT * i) for i, n in enumerate(kinds(g, j))) if g in t else 0 for j, (_, t) in enumerate(model.templates)] for g in model.features]
    totals = [tuple(sum(c) for c in zip(*(kinds(g, j) for g in t), strict=True)) for j, (_, t) in enumerate(model.templates)]
    return worths, totals


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """(id, n_paragraphs, families, family, score, overlap) of every whole text.

    Lines are judged, and runs of lines between lines without letters and digits as a whole, n-grams across line ends
    included. A line is known if its best family has the probability ``threshold`` or more, and ``overlap`` or more of the
    n-grams of one of the family's notices. A notice is confirmed by ``overlap`` of its n-grams and of those that no other
    family has. A known line has the families of confirmed notices too, and a line that confirms two families or more is
    known. A run has the families of confirmed notices that its lines don't have, if ``overlap`` of the notice's longest
    n-grams are there, so that words far apart confirm none.

    ``n_paragraphs``: known lines, and runs with such a family. ``families``: those found, sorted, joined by commas;
    ``family``: that of the greatest probability in its line or run (ties: the first by name), lines first, else UNKNOWN;
    ``score`` and ``overlap``: that one's, 0 without one. Null and empty texts have none. Repeated rows give a row each,
    null ids stay null, an empty table gives no row, other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    single = sorted({w for g in model.features for w in g.split() if w in model.features})
    wanted = f"(?<![a-z0-9])(?:{_trie(single)})(?![a-z0-9])"
    has = F.lower("text").rlike(wanted)
    none = rows.where(~has).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_paragraphs"), F.lit("").alias("families"), F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("score"), F.lit(0.0).alias("overlap"))

    worths, totals = _worths(model)
    table = [(g, [float(v) for v in model.weights[i]], worths[i]) for g, i in model.features.items()]
    known = F.broadcast(spark.createDataFrame(table, "gram string, weights array<double>, worths array<long>"))  # the notices' n-grams
    some = rows.where(has).withColumn("row", F.monotonically_increasing_id())  # ids may repeat; rows don't
    some = some.select("row", "id", F.posexplode(F.split("text", r"\n[^A-Za-z0-9]*\n")).alias("run", "body"))
    body, lines_of = F.col("body"), F.split("body", "\n")
    whole = F.when(F.size(lines_of) > 1, F.array(F.struct(F.lit(-1).alias("at"), body.alias("line")))).otherwise(F.array().cast("array<struct<at:int,line:string>>"))
    units = F.concat(whole, F.transform(lines_of, lambda line, i: F.struct(i.alias("at"), line.alias("line"))))
    some = some.select("row", "id", "run", F.explode(units).alias("unit")).select("row", "id", "run", "unit.at", "unit.line")
    # a line without such a word stays as one without n-grams, so that its document stays
    tokens = F.when(F.lower("line").rlike(wanted), _tokens(F.col("line"))).otherwise(F.array().cast("array<string>"))
    listed = some.select("row", "id", "run", "at", tokens.alias("w"))
    n_gram = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    every = F.array_distinct(F.concat(*[F.when(F.size("w") >= n, n_gram(n)).otherwise(F.array().cast("array<string>")) for n in range(1, ORDER + 1)]))
    hits = listed.select("row", "id", "run", "at", F.explode_outer(every).alias("gram")).join(known, "gram", "left")
    classes, notices = range(len(model.families) + 1), range(len(model.templates))
    sums = [F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)).alias(f"z{k}") for k in classes]
    met = [F.coalesce(F.sum(F.col("worths")[j]), F.lit(0)).alias(f"t{j}") for j in notices]
    lines = hits.groupBy("row", "id", "run", "at").agg(*sums, *met, F.count("weights").alias("evidence"))
    z = [(F.lit(float(model.bias[k])) + F.col(f"z{k}")) / float(model.temperature) for k in classes]
    top = F.greatest(*z)
    lines = lines.select("row", "id", "run", "at", "evidence", *[F.exp(v - top).alias(f"e{k}") for k, v in zip(classes, z, strict=True)], *[f"t{j}" for j in notices])
    total = sum((F.col(f"e{k}") for k in classes), F.lit(0.0))
    part = lambda j, kind: F.shiftright(F.col(f"t{j}"), _COUNT * kind).bitwiseAND(F.lit((1 << _COUNT) - 1)) / float(max(totals[j][kind], 1))
    each = []
    for k, family in enumerate(model.families):
        own = [j for j in notices if model.templates[j][0] == family]
        near = [part(j, 0) for j in own]
        sure = F.lit(False)
        for j in own:
            sure = sure | ((part(j, 0) >= overlap) & (part(j, 1) >= overlap) & ((F.col("at") >= 0) | (part(j, 2) >= overlap)))
        each.append(F.struct((F.col(f"e{k}") / total).alias("p"), F.lit(-k).alias("rank"), (F.greatest(*near) if len(near) > 1 else near[0]).alias("overlap"), F.lit(family).alias("family"), sure.alias("sure")))
    lines = lines.select("row", "id", "run", "at", "evidence", F.array(*each).alias("each")).withColumn("best", F.array_max("each")).withColumn("sure", F.filter("each", lambda x: x["sure"]))
    good = (F.col("evidence") > 0) & (F.col("best.p") >= threshold) & (F.col("best.overlap") >= overlap)
    besides = F.filter("sure", lambda x: x["family"] != F.col("best.family"))
    # of a line: its families; of a run: what its notices confirm
    found = F.when(F.col("at") < 0, F.col("sure")).when(good, F.concat(F.array("best"), besides)).when(F.size("sure") > 1, F.col("sure")).otherwise(F.filter("sure", lambda x: F.lit(False)))
    lines = lines.select("row", "id", "run", "at", found.alias("found"))
    inside = F.flatten(F.collect_list(F.when(F.col("at") >= 0, F.col("found"))))
    runs = lines.groupBy("row", "id", "run").agg(
        F.sum(((F.col("at") >= 0) & (F.size("found") > 0)).cast("long")).alias("n"),
        inside.alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("at") < 0, F.col("found")))).alias("across"),
    )
    runs = runs.withColumn("across", F.filter("across", lambda x: ~F.exists("inside", lambda y: y["family"] == x["family"])))
    told = runs.groupBy("row", "id").agg(
        F.sum(F.col("n") + (F.size("across") > 0).cast("long")).alias("n_paragraphs"),
        F.flatten(F.collect_list("inside")).alias("inside"),
        F.flatten(F.collect_list("across")).alias("across"),
    )
    told = told.withColumn("best", F.coalesce(F.array_max("inside"), F.array_max("across")))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat("inside", "across"), lambda x: x["family"]))), ",")
    told = told.select(F.col("id").alias(id_col), "n_paragraphs", families.alias("families"), F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), F.coalesce("best.p", F.lit(0.0)).alias("score"), F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"))
    return none.unionByName(told)
