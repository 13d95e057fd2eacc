"""Operator 6, licence scans [native]: a trained paragraph classifier.

A paragraph is a run of lines that hold a letter or digit; a longer one is read in overlapping pieces.
Pieces with a word of licence language are described by their word n-grams (one to three words). A
softmax regression over them, fitted here by gradient descent on statements made of licences' names
and of notices, and on counter-examples, tells the licence's family or ``unknown``; its temperature is
calibrated on turns of phrase that were held out. A prediction counts once the piece also shares
enough n-grams with a template of the predicted family. Fitting sees only the statements, on the
driver; the scan is DataFrame functions over whole texts, and all that is broadcast is fixed by them.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# The names by which texts call each licence.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache License v2.0", "Apache Software License", "Apache 2"],
    "mit": ["MIT License", "MIT licence", "MIT", "MIT/X11 license", "Expat License", "The MIT License (MIT)"],
    "isc": ["ISC License", "ISC", "ISC licence"],
    "bsd": ["BSD 3-Clause License", "BSD License", "BSD", "BSD-3-Clause", "BSD-2-Clause", "2-clause BSD license", "3-clause BSD license", "New BSD License", "Simplified BSD License", "BSD-style license"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL v3", "GPL-3.0", "GNU GPL version 3", "GPL-3.0-or-later", "GPL version 3", "GPLv3+"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL v2", "GPL-2.0", "GNU GPL version 2", "GPL-2.0-only", "GPL version 2", "GPLv2+"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPLv3", "AGPL-3.0", "AGPL v3", "GNU AGPL"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPL", "LGPLv3", "LGPL-2.1", "LGPLv2.1", "GNU LGPL version 3", "LGPL-3.0-or-later"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "Mozilla Public License, v. 2.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License v2.0", "EPL-2.0", "EPL 2.0 license"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "zlib": ["zlib License", "zlib/libpng license", "zlib licence"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License", "CC BY license", "CC BY 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License", "CC BY-NC"],
    "public-domain": ["CC0 1.0", "CC0", "Unlicense", "CC0-1.0", "public domain dedication license", "Creative Commons Zero license"],
}
# Paragraphs of the licences' own notices.
NOTICES = {
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "cc-by": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "cc-by-nc": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."],
}
#: Turns of phrase, which are also the templates; and others, by which the classifier is calibrated.
FRAMES = ["Released under the {}", "Licensed under the {}", "Licensed under {}", "is licensed under the terms of the {}", "available under the terms of the {}", "distributed under the {}", "License: {}", "SPDX-License-Identifier: {}", "is {} licensed", "made available under the {}", "Published under a {}"]
OTHER_FRAMES = ["This code is provided under {}", "may be redistributed under the {} only", "Dual licensed under {}", "all files here are covered by the {}", "we chose the {} for it"]
UNKNOWN = "unknown"
#: Sentences that use licence words without granting anything.
OTHERWISE = [
    "All rights reserved. No part of this work may be reproduced without permission.",
    "Copyright by the authors and the publisher.",
    "He was given permission to drive but his driving license had expired.",
    "The software was released in version 2.0 last year with many changes.",
    "The council licensed the new restaurant under the terms of the city code.",
    "A public license hearing was held in the general court on version 3 of the bill.",
    "Apache helicopters were used; the apache web server runs the software.",
    "She studied at MIT and released her first album there.",
    "The creative work of the commons committee was published in the public interest.",
    "The license fee is due in April and the conditions are met by the owner.",
    "Free software foundation donors met at the public library.",
    "Use of this file is restricted; redistribution in any form is not permitted.",
    "See the license file for terms and conditions.",
    "Licensed under a proprietary license; the terms are confidential.",
    "A fishing license is made available under the rules of the state.",
    "The house of commons gave permission for the vote in the general election.",
    "Their domain name license expired, with no warranty for the customers.",
    "The mozilla browser and the eclipse were both seen in August.",
    "This license is granted to the buyer only and may not be transferred to any person.",
    "The doctor is licensed in two states, and distributed the files under the desk.",
]
#: Function words: alone they say nothing of licences.
COMMON = frozenset("a an and any are as at be by can either for free from given had has have he her his in is it its last made many may new no not of on or out part person she so that the their there this to under use used was were with without work you your 0 1 2 3 4 all".split())
#: Beginnings of words of which every statement has one; a text without any is passed over.
STEMS = ("licen", "spdx", "gpl", "permission", "redistribut", "domain", "unencumbered", "commons", "apache", "bsd", "mozilla", "cc0", "copyright")
#: Words of a piece, and how far the next begins.
PIECE, STRIDE = 96, 48


def words_of(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits."""
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str], orders: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in orders for i in range(len(words) - n + 1)}


def templates() -> list[tuple[str, str]]:
    """(family, template): each name in each turn of phrase, and the notices; all have one of STEMS."""
    out = [(f, frame.format(n)) for f, names in NAMES.items() for n in names for frame in FRAMES]
    out += [(f, t) for f, notices in NOTICES.items() for t in notices]
    return [(f, t) for f, t in out if any(w.startswith(STEMS) or "gpl" in w for w in words_of(t))]


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  #: the last is UNKNOWN
    grams: tuple[str, ...]
    weights: np.ndarray  #: grams x families
    bias: np.ndarray
    temperature: float

    def probabilities(self, hits: list[int]) -> np.ndarray:
        z = (self.bias + self.weights[hits].sum(axis=0) / np.sqrt(max(1, len(hits)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(rng: random.Random, frames: list[str], each: int) -> list[tuple[list[str], int]]:
    """Statements of each family and of none, alone and with other words around them."""
    plain = "river stone light over bread glass house walks green seven project code author files please note read more details below section above they".split()
    around = lambda: rng.choices(plain, k=rng.choice((0, 2, 6, 20)))
    rows = []
    for k, f in enumerate(NAMES):
        made = [frame.format(n) for n in NAMES[f] for frame in frames]
        for t in [*rng.sample(made, min(each, len(made))), *NOTICES[f] * 3]:
            w = words_of(t)
            if len(w) > 12 and rng.random() < 0.5:
                at = rng.randrange(len(w) // 3)
                w = w[at : at + max(10, 2 * len(w) // 3)]
            rows.append(([*around(), *w, *around()], k))
    pool = [w for t in OTHERWISE for w in words_of(t)] + [w for f in NOTICES for t in NOTICES[f] for w in words_of(t)]
    for t in OTHERWISE:
        rows += [([*around(), *words_of(t), *around()], len(NAMES)) for _ in range(4)]
    rows += [(rng.choices(pool, k=rng.randrange(3, 25)), len(NAMES)) for _ in range(150)]  # licence words in no order
    rows += [([*around(), n, *around()], len(NAMES)) for f in NAMES for n in sorted({w for x in NAMES[f] for w in words_of(x)} - COMMON) for _ in range(2)]  # a word of a name
    return rows


@lru_cache(maxsize=1)
def fit(seed: int = 5, each: int = 60, epochs: int = 200, rate: float = 1.0, momentum: float = 0.9, decay: float = 1e-4) -> Model:
    """Fit the classifier; the same for every call."""
    rng = random.Random(seed)
    families = (*NAMES, UNKNOWN)
    train, held = _examples(rng, FRAMES, each), _examples(rng, OTHER_FRAMES, each)
    seen = Counter(g for w, _ in train for g in grams_of(w))
    own = {g for f in NAMES for x in (*NOTICES[f], *(frame.format(n) for n in NAMES[f] for frame in FRAMES)) for g in grams_of(words_of(x))} | {g for t in OTHERWISE for g in grams_of(words_of(t))}
    grams = tuple(sorted(g for g, n in seen.items() if n >= 2 and g in own and any(w not in COMMON for w in g.split())))
    index = {g: i for i, g in enumerate(grams)}

    def matrix(rows):
        x = np.zeros((len(rows), len(grams)), dtype=np.float32)
        for r, (w, _) in enumerate(rows):
            hits = [index[g] for g in grams_of(w) if g in index]
            x[r, hits] = 1 / np.sqrt(max(1, len(hits)))
        return x, np.eye(len(families), dtype=np.float32)[[k for _, k in rows]]

    x, y = matrix(train)
    w, b = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(epochs):
        d = (_softmax(x @ w + b) - y) / len(x)
        vw = momentum * vw - rate * 10 * (x.T @ d + decay * w)
        vb = momentum * vb - rate * d.sum(axis=0)
        w, b = w + vw, b + vb
    hx, hy = matrix(held)
    losses = [(-(hy * np.log(_softmax((hx @ w + b) / t) + 1e-12)).sum(), t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)]
    return Model(families, grams, w.astype(np.float64), b.astype(np.float64), min(losses)[1])


def pieces(docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraph, start, w): the pieces that have one of STEMS, of texts that have one.

    paragraph is the paragraph's number in its text, start the place of the piece's first word in it.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    some = None
    for x in STEMS:
        some = text.contains(x) if some is None else some | text.contains(x)
    t = docs.select("doc_id", text.alias("t")).where(some).withColumn("row", F.monotonically_increasing_id())
    t = t.select("row", "doc_id", F.posexplode(F.split("t", r"\n(?:[^a-z0-9\n]*\n)+")).alias("paragraph", "p"))
    t = t.select("row", "doc_id", "paragraph", F.expr("filter(split(p, '[^a-z0-9]+'), x -> x <> '')").alias("w"))
    last = F.floor(F.greatest(F.size("w") - (PIECE - STRIDE) - 1, F.lit(0)) / STRIDE).cast("int")
    t = t.select("row", "doc_id", "paragraph", "w", F.explode(F.sequence(F.lit(0), last * STRIDE, F.lit(STRIDE))).alias("start"))
    t = t.select("row", "doc_id", "paragraph", "start", F.slice("w", F.col("start") + 1, F.lit(PIECE)).alias("w"))
    return t.where(F.array_join("w", " ").rlike(r"(?:^| )(?:" + "|".join(STEMS) + ")|gpl"))


def _grams(orders: tuple[int, ...]) -> str:
    """SQL: the n-grams of w by place."""
    return "concat(" + ", ".join(f"IF(size(w) < {n}, array_repeat(struct('' AS gram, 0 AS at, 0 AS n), 0), transform(sequence(0, size(w) - {n}), i -> struct(array_join(slice(w, i + 1, {n}), ' ') AS gram, i AS at, {n} AS n)))" for n in orders) + ")"


def scan(docs: DataFrame, min_probability: float = 0.5, min_similarity: float = 0.6) -> DataFrame:
    """Rows (doc_id, paragraph, start_word, n_words, family, probability, similarity, statement) of licence statements.

    paragraph is the number from 0 of a run of lines that hold an ASCII letter or digit; start_word and
    n_words tell where in its words the template's n-grams lie, and statement is these words. A piece is reported if a
    family other than ``unknown`` is likeliest with ``min_probability``, and it holds a share of
    ``min_similarity`` or more of the two- and three-word n-grams of one of that family's templates. Of
    statements that overlap the most similar counts (then the longer, the first). How lines break, and what stands around a statement, does
    not matter; one in a hundred words is found as one alone is. Null and empty texts have none; texts
    are read whole; rows of a doc_id (or of none) that state the same in the same place are reported
    once; of families that tie the first in NAMES counts; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    C.need(docs, "doc_id", "text")
    m = fit()
    spark = docs.sparkSession
    found = C.materialise(pieces(docs).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    weights = spark.createDataFrame([(g, [float(x) for x in m.weights[i]]) for i, g in enumerate(m.grams)], "gram string, weights array<double>")
    texts = found.select("piece", F.explode(F.array_distinct(F.expr(f"transform({_grams((1, 2, 3))}, x -> x.gram)"))).alias("gram"))
    n = len(m.families)
    sums = texts.join(F.broadcast(weights), "gram").groupBy("piece").agg(F.count("*").alias("hits"), *[F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(n)])
    z = F.array(*[(F.lit(float(m.bias[k])) + F.col(f"s{k}") / F.sqrt("hits")) / m.temperature for k in range(n)])
    scored = sums.select("piece", z.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.select("piece", (F.array_position("z", F.col("top")) - 1).cast("int").alias("best"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("probability"))
    told = C.materialise(scored.where((F.col("best") < n - 1) & (F.col("probability") >= min_probability)), "told")
    # templates of the family that was told
    rows = []
    for number, (f, t) in enumerate(templates()):
        own = grams_of(words_of(t), (2, 3))
        rows += [(g, m.families.index(f), number, len(own)) for g in sorted(own)]
    table = spark.createDataFrame(rows, "gram string, best int, template int, size int")
    parts = told.join(found, "piece").select("piece", "best", F.explode(F.expr(_grams((2, 3)))).alias("x")).select("piece", "best", "x.*")
    shares = parts.join(F.broadcast(table), ["gram", "best"]).groupBy("piece", "template", "size").agg(F.countDistinct("gram").alias("k"), F.min("at").alias("lo"), F.max(F.col("at") + F.col("n")).alias("hi"))
    similar = shares.withColumn("similarity", F.col("k") / F.col("size")).where(F.col("similarity") >= min_similarity)
    # the most similar template; of those that are alike the longest, then the first
    similar = similar.groupBy("piece").agg(F.max(F.struct("similarity", "size", (-F.col("template")).alias("t"), "lo", "hi")).alias("x"))
    out = told.join(similar, "piece").join(found, "piece")
    named = F.element_at(F.array(*map(F.lit, m.families)), F.col("best") + 1)
    lo, hi = F.col("x.lo"), F.col("x.hi")
    out = out.select("row", "doc_id", "paragraph", F.struct((-F.col("x.similarity")).alias("far"), (lo - hi).alias("short"), (F.col("start") + lo).alias("start"), (F.col("start") + hi).alias("stop"), (-F.col("probability")).alias("p"), named.alias("family"), F.array_join(F.expr("slice(w, x.lo + 1, x.hi - x.lo)"), " ").alias("statement")).alias("s"))
    # bounded by the statements of one paragraph
    each = out.groupBy("row", "doc_id", "paragraph").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    chosen = F.expr("aggregate(ss, slice(ss, 1, 0), (a, x) -> IF(exists(a, y -> y.start < x.stop AND x.start < y.stop), a, concat(a, array(x))))")
    each = each.select("doc_id", "paragraph", F.explode(chosen).alias("s"))
    each = each.select("doc_id", "paragraph", F.col("s.start").alias("start_word"), (F.col("s.stop") - F.col("s.start")).alias("n_words"), "s.family", F.round(-F.col("s.p"), 6).alias("probability"), F.round(-F.col("s.far"), 6).alias("similarity"), "s.statement")
    return each.dropDuplicates(["doc_id", "paragraph", "start_word", "n_words", "family", "statement"])
